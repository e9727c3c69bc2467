"""URL filtering by rules and by an empirical-Bayes reputation of hosts, with DataFrame functions only.

Outcomes of labelled pages are summed for each host, then for its registered domain, its suffix and
all hosts. At each level the rate of bad pages is shrunk towards the level above by a beta prior: its
mean is the posterior mean above, its strength comes from the over-dispersion of the level's children
(method of moments for the beta-binomial). A host is blocked when the lower bound of its posterior
bad rate, mean minus ``z`` standard deviations of the beta posterior, is above ``max_bad``.

Explicit rules come first: the longest rule that fits a url decides. Only sums travel to the driver:
one row of moments for each of the three levels. Host sums are formed before the shuffle, so a host
with a third of all pages costs no more than others; adaptive execution splits the join back. Host and
path are those of the url as they stand; for the reputation alone, user information and port are left out
of the domain, and a country's second level (``co.uk``) counts as a suffix.

Defined results: a null url, or one without ``://``, has an empty host and path; it then has the
reputation of the empty host. Pages without outcome add nothing to the sums. Rows that repeat count
as often as they stand there. Among rules of equal length that fit, block wins. An empty table gives
an empty table. All input columns are kept, whatever their names; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, lower_ascii

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Labels that, before a country's two letters, belong to the suffix. No list of public suffixes is at hand.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ltd", "mil", "ne", "net", "nhs", "or", "org", "plc", "sch")
#: Bounds of the within-level correlation that the moments may give.
RHO_LOW, RHO_HIGH = 1e-4, 0.99


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _bare(host: Column) -> Column:
    """A host without user information and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9.]+$") | bare.startswith("[")


def _under_country(bare: Column) -> Column:
    return F.substring_index(bare, ".", -2).rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")


def registered_domain(host: Column) -> Column:
    """One label more than the suffix; of a numeric address all of it."""
    bare = _bare(host)
    return F.when(_is_address(bare), bare).when(_under_country(bare), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def host_suffix(host: Column) -> Column:
    """The last label, or the last two where these are a country's second level; empty for a numeric address."""
    bare = _bare(host)
    return F.when(_is_address(bare), "").when(_under_country(bare), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last one put outside is tried first: the longest, and among equals the blocking one.
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(children: DataFrame) -> float:
    """The strength of the beta prior from children's n, k and the mean m above them."""
    p = F.col("m") * (1 - F.col("m"))
    row = children.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2)).alias("seen"),
        F.sum(F.col("n") * p).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * p).alias("pairs"),
    ).first()
    if not row["pairs"]:
        rho = RHO_LOW
    else:
        rho = min(RHO_HIGH, max(RHO_LOW, (row["seen"] - row["binomial"]) / row["pairs"]))
    return 1 / rho - 1


def host_reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """From host sums (host, n, k): host, n, k, mean and low, the lower posterior bound of the bad rate."""
    hosts = hosts.select("host", registered_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"), "n", "k")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    total = hosts.agg(*sums).first()
    mean = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)

    def shrunk(level: DataFrame, name: str) -> tuple[DataFrame, float]:
        s = _strength(level)
        return level.withColumn(name, (F.lit(s) * F.col("m") + F.col("k")) / (F.lit(s) + F.col("n"))), s

    suffixes, _ = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(mean)), "mean")
    above = suffixes.select("suffix", F.col("mean").alias("m"))
    domains, _ = shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(above, "suffix"), "mean")
    above = domains.select("domain", F.col("mean").alias("m"))
    out, s = shrunk(hosts.join(above, "domain"), "mean")
    size = F.lit(s) + F.col("n")
    return out.select("host", "n", "k", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("low"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", bad: str = "bad", max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with host, path, rule, verdict and bad_low. ``bad`` names a column: 1 bad, 0 good, null unlabelled."""
    taken = {"host", "path", "rule", "verdict", "bad_low"}
    rest = [c for c in pages.columns if c not in taken]
    names = [f"__c{n}" for n in range(len(rest))]
    parsed = pages.select(url_host(column(url)).alias("__host"), url_path(column(url)).alias("__path"), column(bad).cast("long").alias("__bad"), *(column(c).alias(k) for c, k in zip(rest, names, strict=True)))
    hosts = parsed.groupBy(F.col("__host").alias("host")).agg(F.count("__bad").alias("n"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("k"))
    scratch = Scratch(pages.sparkSession, "hosts")
    # Written, so that the join below knows its size and can split the pages of a very large host.
    low = scratch.keep(host_reputation(scratch.keep(hosts), z).select(F.col("host").alias("__h"), F.col("low").alias("__low")))
    judged = parsed.withColumn("__rule", match_rule(F.col("__host"), F.col("__path"), rules)).join(low, F.col("__host") == F.col("__h"), "left")
    return judged.select(
        *(F.col(k).alias(c) for c, k in zip(rest, names, strict=True)),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("__low") > max_bad, "block").otherwise("allow")).alias("verdict"),
        F.col("__low").alias("bad_low"),
    )
