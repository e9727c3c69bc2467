"""Column expressions for normalising and extracting text. All stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the write verbs of the keyword check are (fixed values).
WRITE_VERBS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "TRUNCATE", "ATTACH", "DETACH", "PRAGMA", "VACUUM")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_sql(c: Column, fold: bool = False) -> Column:
    """A statement without trailing semicolons and with white space collapsed; ``fold`` lower-cases."""
    out = collapse(F.regexp_replace(F.trim(c), r"(?U)[;\s]+$", ""))
    return F.lower(out) if fold else out


def normalize_question(c: Column) -> Column:
    return F.lower(collapse(c))


def one_line(c: Column) -> Column:
    """One line of SQL; an empty statement becomes SELECT 1."""
    return F.coalesce(F.nullif(collapse(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("SELECT 1"))


def is_read_only(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^\s*(SELECT|WITH)\b"), F.lit(False))


def has_order_by(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)\bORDER\s+BY\b"), F.lit(False))


def first_verb_is_safe(c: Column) -> Column:
    """The robustness check: the first keyword is no write verb."""
    return ~F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1)).isin(*WRITE_VERBS)


def _strip(c: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _after_reasoning(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)^.*</think>", "")


def _fenced(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)```(?:sql|sqlite)?\s*(.*?)```", 1)


def extract_sql(c: Column) -> Column:
    """After a reasoning trace: the first fence, from its first SELECT or WITH up to the first semicolon."""
    text = _after_reasoning(F.coalesce(c, F.lit("")))
    body = F.when(text.rlike(r"(?is)```.*?```"), _fenced(text)).otherwise(text)
    found = F.regexp_extract(body, r"(?is)\b((?:SELECT|WITH)\b.*)$", 1)
    return _strip(F.substring_index(F.when(found != "", found).otherwise(body), ";", 1))


def extract_sql_strict(c: Column) -> Column:
    """Like extract_sql, but WITH counts only before ``name AS (``, a fenced text must begin with SELECT or
    WITH, and what is no statement is empty."""
    text = _strip(_after_reasoning(F.coalesce(c, F.lit(""))))
    bare = F.regexp_extract(text, r"(?is)\b((?:SELECT\b|WITH\s+(?:RECURSIVE\s+)?\w+\s+AS\s*\().*)$", 1)
    body = F.when(text.rlike(r"(?is)```.*?```"), _strip(_fenced(text))).otherwise(bare)
    return F.when(is_read_only(body), _strip(F.substring_index(body, ";", 1))).otherwise("")


def extract_sql_traced(c: Column) -> Column:
    """Needs a closed reasoning trace; without one the answer is empty."""
    return F.when(c.contains("</think>"), extract_sql(c)).otherwise("")


def extract_fence(c: Column) -> Column:
    """The content of the first fence, else the whole text."""
    return _strip(F.when(c.rlike(r"(?is)```.*?```"), _fenced(c)).otherwise(c))


def repair_operators(c: Column) -> Column:
    """Split comparison operators are joined."""
    return F.replace(F.replace(F.replace(c, F.lit("> ="), F.lit(">=")), F.lit("< ="), F.lit("<=")), F.lit("! ="), F.lit("!="))


def strip_distinct(c: Column) -> Column:
    """DISTINCT goes, except inside quotes of any kind."""
    quoted = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]"""
    return F.regexp_replace(c, rf"(?i)({quoted})|\bDISTINCT\b", "$1")


def strip_trailing_name(sql: Column, name: Column) -> Column:
    """A statement without the catalog name that some sources append to it."""
    cut = F.regexp_replace(F.trim(sql), r"\s+\S+$", "")
    return F.when(F.trim(sql).endswith(name), cut).otherwise(F.trim(sql))


def question_from_prompt(c: Column) -> Column:
    return F.trim(F.substring_index(c, "Question:", -1))


def schema_from_prompt(prompt: Column, otherwise: Column) -> Column:
    found = F.regexp_extract(prompt, r"(?s)Database Schema:\s*(.*)\n\s*\nQuestion:", 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), otherwise)


def split_identifier(c: Column) -> Column:
    """CustomerId, customer_id and customer.id as lower-case tokens."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[._\-\s]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda x: x != "")


#: E-mail addresses and web links.
PRIVATE = r"(?i)[\w.+-]+@[\w-]+\.[\w.]+|https?://"


def looks_private(c: Column) -> Column:
    return c.rlike(PRIVATE)


#: Domains by keyword in the name, the first that fits (fixed values).
DOMAINS = (
    ("education", ("student", "college", "school", "course", "university", "dorm")),
    ("healthcare", ("hospital", "patient", "doctor", "disease", "clinic")),
    ("sports", ("soccer", "basketball", "wta", "game", "player", "stadium", "baseball")),
    ("entertainment", ("music", "movie", "singer", "concert", "tv", "orchestra", "cinema")),
    ("business", ("store", "company", "employee", "hr", "customer", "invoice", "shop")),
    ("transport", ("flight", "car", "bike", "ship", "aircraft", "train", "railway")),
    ("geography", ("world", "geo", "country", "city", "address")),
    ("food", ("restaurant", "wine", "food", "bakery")),
    ("science", ("scientist", "protein", "planet", "gas")),
)


def domain_of(name: Column) -> Column:
    out = F.lit("other")
    for domain, words in reversed(DOMAINS):
        out = F.when(F.lower(name).rlike("|".join(words)), domain).otherwise(out)
    return out


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, three decimals half to even; 0 of nothing is 0."""
    return F.coalesce(F.bround(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 3), F.lit(0.0))


def hash_fraction(seed: int | str, key: Column) -> Column:
    """A reproducible number in [0, 1) from a seed and a key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def stable_hash(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def cell_text(c: Column, kind: str) -> Column:
    """A result cell: doubles to 8 decimals, bytes as hex."""
    if kind in ("double", "float"):
        return F.bround(c.cast("double"), 8).cast("string")
    return F.lower(F.hex(c)) if kind == "binary" else c.cast("string")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded half to even."""
    return F.bround(F.length(c) / 4).cast("long")


def dialect(c: Column) -> Column:
    """A statement of the small embedded dialect in Spark's: [name] and "name" become `name`, IIF becomes IF,
    STRFTIME of year, month or day becomes DATE_FORMAT, LIKE (blind to case there) becomes ILIKE. Text in
    quotes stays as it is."""
    kept = r"('(?:[^']|'')*')"
    out = F.regexp_replace(c, rf"{kept}|\[([^\]\[]+)\]", "$1\u0001$2\u0001")
    out = F.regexp_replace(out, "\u0001\u0001", "")
    out = F.regexp_replace(out, rf'{kept}|"([^"]+)"', "$1\u0001$2\u0001")
    out = F.replace(F.regexp_replace(out, "\u0001\u0001", ""), F.lit("\u0001"), F.lit("`"))
    for word, other in ((r"IIF\s*\(", "IF("), (r"LIKE\b", "ILIKE")):
        out = F.regexp_replace(F.regexp_replace(out, rf"(?i){kept}|\b{word}", "$1\u0001"), "(?<!')\u0001", other)
        out = F.replace(out, F.lit("\u0001"), F.lit(""))
    for code, form in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%Y-%m", "yyyy-MM"), ("%Y-%m-%d", "yyyy-MM-dd")):
        out = F.regexp_replace(out, rf"(?i)\bSTRFTIME\s*\(\s*'{code}'\s*,\s*([^()]+?)\s*\)", f"DATE_FORMAT($1, '{form}')")
    return out
