"""The queries of the corpus operators on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules of the url contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated, find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
with items as (
  select item_id::varchar as item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as k
  from items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as t(i) where len(w) > 0),
docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
places as (
  select r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as k
  from docs, (select distinct n from windows) as sizes, unnest(range(1, len(w) - n + 2)) as t(i)),
found as (select p.r, p.n, p.i, x.item from places p join windows x on p.n = x.n and p.k = x.k),
hits as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from found) group by r),
named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item from found where item is not null) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hits using (r) left join named using (r)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page. A page's outcome is that of the document whose id its path ends in:
    bad if that document is labelled as of low quality or toxic."""
    from .url_filter import filter_urls, url_path

    bad = F.max(((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int"))
    outcomes = table(spark, sf_dir, "labels").filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(bad.alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("doc", F.regexp_extract(url_path(F.col("url")), "/([0-9]{1,18})", 1).try_cast("long"))
    # Pages without a document have no part in the join, where they would all meet under one key.
    named = pages.filter("doc is not null").join(outcomes, F.col("doc") == F.col("doc_id"), "left").select("page_id", "url", "bad")
    labelled = named.union(pages.filter("doc is null").select("page_id", "url", F.lit(None).cast("int")))
    return filter_urls(labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
with parsed as (
  select page_id,
         case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') else '' end as raw_host,
         case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
lowered as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path,
         try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) as bigint) as doc from parsed),
outcomes as (
  select doc_id, max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as bad
  from labels where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
labelled as (
  select l.page_id, l.host, l.path, o.bad,
         case when address then bare when country then array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.')
              else array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') end as domain,
         case when address then '' when country then array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.')
              else string_split(bare, '.')[-1] end as suffix
  from (select *, regexp_full_match(bare, '[0-9.]+') or starts_with(bare, '[') as address,
               regexp_full_match(bare, '(.*\.)?(ac|co|com|edu|go|gov|ltd|mil|ne|net|nhs|or|org|plc|sch)\.[a-z][a-z]') as country
        from (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from lowered)) l
  left join outcomes o on l.doc = o.doc_id),
hosts as (select host, domain, suffix, count(bad) as n, coalesce(sum(bad), 0) as k from labelled group by all),
top as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from hosts),
suffix_sums as (select suffix, sum(n) as n, sum(k) as k, any_value(m) as m from hosts, top group by suffix),
suffix_s as (select case when sum(n * (n - 1) * m * (1 - m)) > 0 then 1 / least(0.99, greatest(0.0001, (sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)))) - 1 else 9999 end as s from suffix_sums),
suffix_means as (select suffix, (s * m + k) / (s + n) as m from suffix_sums, suffix_s),
domain_sums as (select domain, suffix, sum(n) as n, sum(k) as k, any_value(m) as m from (select hosts.*, suffix_means.m from hosts join suffix_means using (suffix)) group by domain, suffix),
domain_s as (select case when sum(n * (n - 1) * m * (1 - m)) > 0 then 1 / least(0.99, greatest(0.0001, (sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)))) - 1 else 9999 end as s from domain_sums),
domain_means as (select domain, (s * m + k) / (s + n) as m from domain_sums, domain_s),
host_sums as (select hosts.*, domain_means.m from hosts join domain_means using (domain)),
host_s as (select case when sum(n * (n - 1) * m * (1 - m)) > 0 then 1 / least(0.99, greatest(0.0001, (sum((k - n * m) ** 2) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)))) - 1 else 9999 end as s from host_sums),
host_means as (select host, (s * m + k) / (s + n) as mean, s + n as size from host_sums, host_s),
host_low as (select host, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) as low from host_means),
ruled as (
  select l.page_id, l.host, l.path, h.low,
         case when (l.host = 'example.net' or l.host like '%.example.net') and starts_with(l.path, '/en/') then 'example.net/en/'
              when (l.host = 'example.com' or l.host like '%.example.com') and starts_with(l.path, '/de/') then 'example.com/de/'
              when (l.host = 'org' or l.host like '%.org') and starts_with(l.path, '/fr/') then 'org/fr/'
              when (l.host = 'net' or l.host like '%.net') and starts_with(l.path, '/') then 'net/' end as rule
  from labelled l join host_low h using (host))
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when low > 0.5 then 'block' else 'allow' end as verdict
from ruled
"""


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probabilities; ``toxic`` is the flag."""
    from .toxicity import predict_toxicity

    out = predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ("quality", "toxic"))
    return out.select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (
  select doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) as s from docs, unnest(range(0, length(h) // 2 - 99)) as t(i)),
again as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from strings) where k > 1),
marked as (
  select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from again),
numbered as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from marked),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from numbered group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs),
cut as (
  select g.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept
  from gaps g join docs d on g.doc_id = d.doc_id group by g.doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from docs d left join cut c on d.doc_id = c.doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.col("line_dedup")
    kept = F.sha2(F.coalesce(out["kept"], F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", out["n_lines"].alias("n_lines"), out["n_dropped"].alias("n_dropped"), kept.alias("kept_sha256"))


OP8_SQL = r"""
with split as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (
  select r, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split),
keyed as (
  select r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
frequent as (select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10),
kept as (
  select r, count(*) as n_lines, count(*) filter (where f.key is not null) as n_dropped,
         coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '') as kept
  from keyed left join frequent f using (key) group by r)
select s.doc_id, k.n_lines, k.n_dropped, sha256(k.kept) as kept_sha256 from split s join kept k using (r)
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .language_id import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as k
  from docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as common from shingles x join shingles y on x.k = y.k and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from shared join sizes p on a = p.doc_id join sizes q on b = q.doc_id where 100 * common >= 80 * (p.n + q.n - common)),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select distinct a, a from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
least_ as (select a, min(b) as c from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(c, doc_id) as component_id
from docs left join sizes using (doc_id) left join least_ on doc_id = a
"""


def queries() -> dict:
    return {"op4_nearest_neighbours": op4_nearest_neighbours, "op6_toxicity": op6_toxicity, "op7_suffix_dedup": op7_suffix_dedup, "op10_ngram_jaccard": op10_ngram_jaccard, "op1_token_counts": op1_token_counts, "op2_decontamination": op2_decontamination, "op9_language_id": op9_language_id, "op3_url_filter": op3_url_filter, "op5_byte_bpe": op5_byte_bpe, "op8_line_dedup": op8_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op3_url_filter": OP3_SQL, "op7_suffix_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_ngram_jaccard": OP10_SQL}
