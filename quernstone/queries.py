"""The catalogue of queries on the driver's tables, each with equal SQL for DuckDB where SQL can say it.

The operators' own tables (predictions, candidates, statements) are not in the driver's data, so most
queries run an operator on a stand-in of the same structure. Doubles that are compared are rounded half
to even on both sides, and every tie has an explicit order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sqlfeatures as sf
from .functions import text as tx
from .operators import ask, compare, dataset, evaluate, records, schema, vote
from .operators.execute import guarded
from .session import TABLES, register, table, tables_of
from .streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return put


def _relational(name: str, sql: str, oracle: str | None = None) -> None:
    """A statement that goes through the read-only gate as it is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, [t for t in TABLES if t in sql])
        return guarded(spark, sql)

    _queries[name], _sql[name] = run, oracle or sql


# --- Relational statements through the gate -------------------------------------------------------

_relational(
    "top_nations_by_revenue",
    """SELECT n.n_name AS nation, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n_items
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY revenue DESC, nation LIMIT 10""",
)
_relational("join_inner", "SELECT o.o_orderkey AS orderkey, c.c_name AS customer, n.n_name AS nation FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000")
_relational("join_left", "SELECT o.o_orderkey AS orderkey, count(l.l_orderkey) AS n_items FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
_relational("join_right", "SELECT o.o_orderkey AS orderkey, count(l.l_orderkey) AS n_items FROM lineitem l RIGHT JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey HAVING count(l.l_orderkey) < 3")
_relational(
    "join_full",
    """SELECT coalesce(a.k, -1) AS poor, coalesce(b.k, -1) AS builder FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 1000) a
FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.k = b.k""",
)
_relational("join_cross", "SELECT n.n_name AS nation, r.r_name AS region FROM nation n CROSS JOIN region r")
_relational("join_comma_equi", "SELECT s.s_name AS supplier, n.n_name AS nation FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey")
_relational(
    "join_theta_range",
    """SELECT b.band AS band, count(*) AS n FROM part p JOIN (VALUES (1, 0, 1000), (2, 1000, 1400), (3, 1400, 100000)) AS b(band, lo, hi)
ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi GROUP BY b.band""",
)
_relational("semi_ids_present", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
_relational("anti_orders_without_items", "SELECT o_orderkey AS orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
_relational("scalar_subquery_filter", "SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
_relational("correlated_exists", "SELECT c_custkey AS custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
_relational(
    "cte_chain",
    """WITH items AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_orderkey),
by_nation AS (SELECT c.c_nationkey AS k, sum(i.revenue) AS revenue FROM items i JOIN orders o ON i.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey)
SELECT r.r_name AS region, round(sum(b.revenue), 2) AS revenue FROM by_nation b JOIN nation n ON b.k = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
)
_relational("set_union", "SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem")
_relational("set_intersect", "SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
_relational("set_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
_relational("group_having", "SELECT l_suppkey AS suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550 OR l_suppkey < 20")
_relational("count_distinct", "SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_relational(
    "min_max_avg_sum",
    """SELECT l_returnflag AS flag, l_linestatus AS status, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_extendedprice), 4) AS mean_price, round(sum(l_extendedprice), 2) AS total, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
_relational("window_running_total", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER w AS nth, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_relational("scalar_functions", "SELECT p_partkey AS partkey, upper(p_brand) AS brand, length(p_name) AS n, substr(p_type, 1, 5) AS kind, coalesce(nullif(p_size, 1), 0) AS size, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS class, replace(p_name, ' ', '-') AS slug, abs(p_size - 25) AS off FROM part")
_relational("order_limit", "SELECT s_suppkey AS suppkey, s_acctbal AS balance FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
_relational("like_between_in", "SELECT p_partkey AS partkey FROM part WHERE p_type LIKE '%STEEL%' OR (p_size BETWEEN 10 AND 12) OR p_brand IN ('Brand#11', 'Brand#23')")


# --- Slices, histograms, distributions ------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    out = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return out.withColumns({"good": F.col("quality") == 1, "rude": F.col("toxic") == 1})


_LABELLED = "(SELECT l.doc_id, l.quality = 1 AS good, l.toxic = 1 AS rude, d.lang, d.source, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_PCT = "round_even(100.0 * count(*) FILTER (WHERE good) / count(*), 3)"


@_add("slice_accuracy_by_group", f"SELECT lang, count(*) AS support, count(*) FILTER (WHERE good) AS correct, {_PCT} AS accuracy_pct FROM {_LABELLED} GROUP BY lang")
def _(spark, d):
    return evaluate.accuracy_by(_labelled(spark, d), ["lang"], F.col("good"))


@_add("slice_rollup_overall", f"SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS support, count(*) FILTER (WHERE good) AS correct, {_PCT} AS accuracy_pct FROM {_LABELLED} GROUP BY ROLLUP (lang)")
def _(spark, d):
    return evaluate.accuracy_with_total(_labelled(spark, d), "lang", F.col("good"))


@_add("two_metric_promotions", f"SELECT lang, count(*) AS support, count(*) FILTER (WHERE rude) AS strict, count(*) FILTER (WHERE good) AS compatible, count(*) FILTER (WHERE good AND NOT rude) AS promotions FROM {_LABELLED} GROUP BY lang")
def _(spark, d):
    return evaluate.two_metrics(_labelled(spark, d), ["lang"], F.col("rude"), F.col("good"))


@_add(
    "macro_accuracy_by_template",
    """WITH t AS (SELECT lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS k, l.quality = 1 AS good FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT k, avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) AS a, bool_and(good) AS e, bool_or(good) AS s FROM t GROUP BY k)
SELECT count(*) AS n_unique, round_even(100 * avg(a), 3) AS macro_pct, count(*) FILTER (WHERE e) AS all_correct, count(*) FILTER (WHERE s) AS any_correct FROM g""",
)
def _(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return evaluate.macro_accuracy(rows, tx.normalize_question(F.col("text")), F.col("quality") == 1)


@_add("status_histogram_first_seen", "SELECT event_type, count(*) AS n, min(event_id) AS first_seen, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank FROM events GROUP BY event_type")
def _(spark, d):
    return evaluate.histogram(table(spark, d, "events"), "event_type", "event_id")


@_add("distribution_stats", "SELECT lang, count(n_chars) AS n, min(n_chars) AS min, round_even(quantile_cont(n_chars::DOUBLE, 0.5), 3) AS median, round_even(quantile_cont(n_chars::DOUBLE, 0.95), 3) AS p95, max(n_chars) AS max FROM documents GROUP BY lang")
def _(spark, d):
    return evaluate.distribution(table(spark, d, "documents"), ["lang"], F.col("n_chars"))


@_add("length_percentile_lower_index", "WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT f::DOUBLE AS fraction, n_chars AS value FROM r, (VALUES (0.5), (0.95), (0.99)) AS q(f) WHERE place = floor((n - 1) * f::DOUBLE)")
def _(spark, d):
    return evaluate.lower_percentiles(table(spark, d, "documents"), "n_chars", [0.5, 0.95, 0.99]).select("fraction", "value")


@_add("length_summary", "SELECT min(n_chars) AS min, floor(quantile_cont(n_chars, 0.5))::BIGINT AS median, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.95::DOUBLE)::BIGINT] AS p95, list_sort(list(n_chars))[1 + floor((count(*) - 1) * 0.99::DOUBLE)::BIGINT] AS p99, max(n_chars) AS max, sum(n_chars)::BIGINT AS total, count(*) FILTER (WHERE n_chars > 5000) AS over_limit, (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1) AS longest_id FROM documents")
def _(spark, d):
    return evaluate.length_summary(table(spark, d, "documents"), "n_chars", "doc_id", 5000)


@_add("latency_summary", "SELECT event_type, count(value) AS n, round_even(avg(value), 6) AS mean, round_even(median(value), 6) AS median, min(value) AS min, max(value) AS max, round_even(stddev_samp(value), 6) AS stdev FROM events GROUP BY event_type")
def _(spark, d):
    return evaluate.latency_summary(table(spark, d, "events"), ["event_type"], "value")


@_add("hardest_groups", f"SELECT source, count(*) AS support, count(*) FILTER (WHERE good) AS correct, {_PCT} AS accuracy_pct FROM {_LABELLED} GROUP BY source HAVING count(*) >= 20 ORDER BY accuracy_pct, support DESC, source LIMIT 5")
def _(spark, d):
    return evaluate.hardest(_labelled(spark, d), "source", F.col("good"))


@_add("priority_ranking", f"SELECT lang, count(*) AS support, count(*) FILTER (WHERE good) AS correct, {_PCT} AS accuracy_pct, round_even((count(*) - count(*) FILTER (WHERE good)) * log2(count(*) + 1), 2) AS impact, CASE WHEN {_PCT} < 50 THEN 3.0::DOUBLE WHEN {_PCT} < 60 THEN 2.5 WHEN {_PCT} < 70 THEN 2.0 WHEN {_PCT} < 80 THEN 1.5 ELSE 1.0 END AS multiplier FROM {_LABELLED} GROUP BY lang")
def _(spark, d):
    return evaluate.priorities(_labelled(spark, d), "lang", F.col("good"))


@_add(
    "value_bins",
    """SELECT CASE WHEN l_quantity <= 10 THEN '01-10' WHEN l_quantity <= 20 THEN '11-20' WHEN l_quantity <= 30 THEN '21-30' ELSE '31+' END AS bin, count(*) AS support, count(*) FILTER (WHERE l_returnflag = 'R') AS correct,
round_even(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 3) AS accuracy_pct FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    items = table(spark, d, "lineitem").withColumn("bin", evaluate.bins(F.col("l_quantity"), [(10, "01-10"), (20, "11-20"), (30, "21-30")], "31+"))
    return evaluate.accuracy_by(items, ["bin"], F.col("l_returnflag") == "R")


@_add("join_rate_per_group", "SELECT c.c_nationkey AS nation, count(*) AS n, count(o.k) AS with_orders, round_even(100.0 * count(o.k) / count(*), 1) AS rate_pct FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.c_custkey = o.k GROUP BY c.c_nationkey")
def _(spark, d):
    active = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    both = table(spark, d, "customer").join(active, F.col("c_custkey") == F.col("k"), "left")
    out = both.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_orders"))
    return out.withColumn("rate_pct", F.bround(100.0 * F.col("with_orders") / F.col("n"), 1))


@_add("pair_cooccurrence", "WITH b AS (SELECT DISTINCT l.l_orderkey AS k, p.p_brand AS brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) SELECT x.brand AS a, y.brand AS b, count(*) AS n FROM b x JOIN b y ON x.k = y.k AND x.brand < y.brand GROUP BY x.brand, y.brand")
def _(spark, d):
    baskets = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return evaluate.pair_cooccurrence(baskets, "l_orderkey", "p_brand")


@_add("crosstab_share", "SELECT event_type AS row_key, date_part('isodow', ts)::INTEGER AS col_key, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 1) AS pct FROM events GROUP BY 1, 2")
def _(spark, d):
    return evaluate.crosstab_share(table(spark, d, "events"), F.col("event_type"), F.weekday("ts") + 1)


@_add("pivot_mean", "SELECT source, " + ", ".join(f"round_even(avg(n_chars) FILTER (WHERE lang = '{x}'), 3) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def _(spark, d):
    return evaluate.pivot_mean(table(spark, d, "documents"), "source", "lang", ["de", "en", "es", "fr"], "n_chars")


@_add("paired_transitions", f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT rude AND good) AS corrected, count(*) FILTER (WHERE rude AND NOT good) AS regressed, count(*) FILTER (WHERE rude AND good) AS both_correct, count(*) FILTER (WHERE NOT rude AND NOT good) AS both_wrong, count(*) FILTER (WHERE NOT rude AND good) - count(*) FILTER (WHERE rude AND NOT good) AS net, round_even(100.0 * (count(*) FILTER (WHERE NOT rude AND good) - count(*) FILTER (WHERE rude AND NOT good)) / count(*), 3) AS net_pp FROM {_LABELLED} GROUP BY lang")
def _(spark, d):
    return evaluate.paired(_labelled(spark, d), ["lang"], F.col("rude"), F.col("good"))


@_add("mcnemar_exact")
def _(spark, d):
    return evaluate.mcnemar_by(_labelled(spark, d), "lang", F.col("rude"), F.col("good"))


@_add(
    "disagreement_patterns",
    """SELECT coalesce(nullif(concat_ws(' + ', CASE WHEN quality = 1 THEN 'a' END, CASE WHEN toxic = 1 THEN 'b' END, CASE WHEN doc_id % 2 = 0 THEN 'c' END), ''), 'none') AS pattern, count(*) AS n FROM labels GROUP BY 1""",
)
def _(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"), (F.col("doc_id") % 2 == 0).alias("c"))
    return evaluate.disagreement(rows, ["a", "b", "c"])


# --- Schema ---------------------------------------------------------------------------------------


@_add(
    "column_profile",
    "WITH t AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) "
    + " UNION ALL ".join(f"SELECT 'documents' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, round_even(count(DISTINCT {c})::DOUBLE / count(*), 4) AS cardinality_ratio FROM t" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")),
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return schema.profile(docs.join(table(spark, d, "labels"), "doc_id", "left"), "documents")


_KEYS = [(f"{k.table}.{k.column}", f"{k.ref_table}.{k.ref_column}") for k in schema.FOREIGN_KEYS]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


@_add(
    "fk_alignment",
    f"""WITH j AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'orders.o_custkey' WHEN 1 THEN 'Customer.c_custkey' WHEN 2 THEN 'x.o_custkey' WHEN 3 THEN 'lineitem.l_partkey' ELSE 'y.c_custkey' END AS l,
CASE p_partkey % 5 WHEN 0 THEN 'customer.c_custkey' WHEN 1 THEN 'orders.o_custkey' WHEN 2 THEN 'y.c_custkey' WHEN 3 THEN 'supplier.s_suppkey' ELSE 'x.O_custkey' END AS r FROM part),
k AS (SELECT * FROM {_values(_KEYS)} AS k(l, r)),
m AS (SELECT EXISTS (SELECT 1 FROM k WHERE (lower(j.l) = k.l AND lower(j.r) = k.r) OR (lower(j.l) = k.r AND lower(j.r) = k.l)) AS whole,
EXISTS (SELECT 1 FROM k WHERE (lower(string_split(j.l, '.')[2]) = string_split(k.l, '.')[2] AND lower(string_split(j.r, '.')[2]) = string_split(k.r, '.')[2]) OR (lower(string_split(j.l, '.')[2]) = string_split(k.r, '.')[2] AND lower(string_split(j.r, '.')[2]) = string_split(k.l, '.')[2])) AS named FROM j)
SELECT count(*) AS n, count(*) FILTER (WHERE whole) AS aligned, count(*) FILTER (WHERE named AND NOT whole) AS by_column, round_even(100.0 * count(*) FILTER (WHERE whole OR named) / count(*), 1) AS aligned_pct FROM m""",
)
def _(spark, d):
    k = F.col("p_partkey") % 5
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    left = pick("orders.o_custkey", "Customer.c_custkey", "x.o_custkey", "lineitem.l_partkey", "y.c_custkey")
    right = pick("customer.c_custkey", "orders.o_custkey", "y.c_custkey", "supplier.s_suppkey", "x.O_custkey")
    return evaluate.fk_alignment(table(spark, d, "part").select(left.alias("l"), right.alias("r")), spark.createDataFrame(_KEYS, "l string, r string"))


_STAR = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"]
_T = _values([(t,) for t in _STAR])
_PAIRS = _values([(k.table, k.ref_table) for k in schema.FOREIGN_KEYS])


@_add("fk_coverage", f"WITH t AS (SELECT * FROM {_T} AS t(t)), k AS (SELECT * FROM {_PAIRS} AS k(a, b) WHERE a IN (SELECT t FROM t) AND b IN (SELECT t FROM t)), m AS (SELECT a FROM k UNION SELECT b FROM k) SELECT (SELECT count(*) FROM t)::INTEGER AS n_tables, (SELECT count(*) FROM m)::INTEGER AS n_touched, round_even(100.0 * (SELECT count(*) FROM m) / (SELECT count(*) FROM t), 1) AS coverage_pct")
def _(spark, d):
    return schema.fk_coverage(spark, _STAR)


_VIEWS = "(SELECT v.table_name, c.column_name, c.column_index, c.data_type FROM (SELECT view_name AS table_name FROM duckdb_views() WHERE NOT internal) v JOIN duckdb_columns() c ON c.table_name = v.table_name)"


def _every_column(spark: SparkSession, d: str) -> DataFrame:
    names = tables_of(spark, d)
    register(spark, d, names)
    return schema.columns(spark, names)


@_add("schema_columns", f"SELECT table_name, (column_index - 1)::INTEGER AS cid, column_name FROM {_VIEWS}")
def _(spark, d):
    return _every_column(spark, d).select("table_name", "cid", "column_name")


@_add("profile_of_every_table", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count FROM {t}" for t, cs in {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"]}.items() for c in cs))
def _(spark, d):
    names = ["region", "nation", "labels", "benchmark"]
    register(spark, d, names)
    wanted = F.concat_ws(".", "table_name", "column_name").isin(*(f"{t}.{c}" for t, cs in {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"]}.items() for c in cs))
    return schema.profile_tables(spark, [*names, "no_such_table"]).filter(wanted).drop("null_pct", "cardinality_ratio")


@_add(
    "found_keys",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'primary' AS kind, '{t}' AS table_name, '{c}' AS column_name, NULL::VARCHAR AS ref_table WHERE (SELECT count(*) = count(DISTINCT {c}) FROM {t})" for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'foreign', '{t}', '{c}', '{o}' WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {o}))" for t, c, o, k in (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"))) + ")",
)
def _(spark, d):
    names = ["region", "nation", "customer", "orders"]
    register(spark, d, names)
    keys = schema.found_keys(spark, names)
    rows = [("primary", t, c, None) for t, cs in keys.primary.items() for c in cs] + [("foreign", k.table, k.column, k.ref_table) for k in keys.foreign]
    return spark.createDataFrame(rows, "kind string, table_name string, column_name string, ref_table string")


@_add("global_keys")
def _(spark, d):
    register(spark, d, _STAR)
    return schema.global_keys(spark, _STAR)


@_add("ddl_text")
def _(spark, d):
    register(spark, d, _STAR)
    return schema.ddl(spark, _STAR)


@_add("compact_ddl_text")
def _(spark, d):
    register(spark, d, _STAR)
    return schema.compact_ddl(spark, _STAR)


@_add("mschema_text")
def _(spark, d):
    register(spark, d, _STAR)
    return spark.createDataFrame([(schema.mschema(spark, "shop", _STAR),)], "mschema string")


@_add("official_column_ids")
def _(spark, d):
    register(spark, d, _STAR)
    return schema.global_columns(spark, _STAR)


# --- Dataset building -----------------------------------------------------------------------------

_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("key", tx.normalize_question(F.col("text")))


@_add("dedup_keep_first", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def _(spark, d):
    return dataset.keep_first(_docs(spark, d).select("doc_id", F.sha2("key", 256).alias("key")), F.col("key"), "doc_id").select("doc_id")


@_add("template_frequency", f"SELECT doc_id, count(*) OVER (PARTITION BY {_NORM}) AS key_count FROM documents")
def _(spark, d):
    return dataset.with_key_count(_docs(spark, d).select("doc_id", F.sha2("key", 256).alias("key")), F.col("key")).select("doc_id", "key_count")


@_add("template_cap", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 3")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return dataset.cap_per_key(docs, F.col("source"), 3, dataset.stable_hash(17, F.col("doc_id")), "doc_id")


@_add("round_robin_sample", "SELECT o_orderkey AS orderkey, o_orderpriority AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('17:' || o_orderkey::VARCHAR)) AS r FROM orders) ORDER BY r, o_orderpriority LIMIT 37")
def _(spark, d):
    out = dataset.round_robin(table(spark, d, "orders"), "o_orderpriority", 37, dataset.stable_hash(17, F.col("o_orderkey")))
    return out.select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"))


@_add("length_stratified_sample", "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars FROM r WHERE place IN (SELECT round_even(k * (n - 1) / 9.0, 0)::BIGINT FROM range(10) AS s(k), (SELECT count(*) AS n FROM documents))")
def _(spark, d):
    return dataset.length_stratified(table(spark, d, "documents").select("doc_id", "n_chars"), 10, "n_chars", "doc_id")


@_add(
    "weighted_sample",
    """WITH k AS (SELECT doc_id, -ln(greatest(('0x' || substr(sha256('17:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE, pow(2, -33))) / CASE WHEN n_chars > 4000 THEN 2.5 WHEN n_chars > 1000 THEN 2.0 ELSE 1.0 END AS sample_key FROM documents)
SELECT doc_id FROM k ORDER BY sample_key, doc_id LIMIT 100""",
)
def _(spark, d):
    weight = F.when(F.col("n_chars") > 4000, 2.5).when(F.col("n_chars") > 1000, 2.0).otherwise(1.0)
    return dataset.weighted_sample(table(spark, d, "documents").select("doc_id", "n_chars"), 100, 17, "doc_id", weight).select("doc_id")


def _quota_sql(tie: str) -> str:
    return f"""WITH g AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT grp, n, 101 * n / sum(n) OVER () AS x FROM g), f AS (SELECT grp, n, floor(x)::BIGINT AS q, round_even(x - floor(x), 9) AS r FROM e)
SELECT grp, n, (q + CASE WHEN row_number() OVER (ORDER BY r DESC, grp {tie}) <= 101 - sum(q) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f"""


def _quotas(descending: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        groups = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
        return dataset.quotas(groups, 101, ties_descending=descending)

    return run


_add("largest_remainder_quotas", _quota_sql("ASC"))(_quotas(False))
_add("largest_remainder_desc_ties", _quota_sql("DESC"))(_quotas(True))


@_add("hash_group_split", "SELECT c_custkey AS custkey, CASE WHEN ('0x' || substr(sha256('split-v1:' || c_custkey::VARCHAR), 1, 8))::BIGINT % 1000 < 100 THEN 'validation' ELSE 'train' END AS part FROM customer")
def _(spark, d):
    return dataset.group_split(table(spark, d, "customer"), F.col("c_custkey"), 10).select(F.col("c_custkey").alias("custkey"), "part")


@_add(
    "group_disjoint_split_search",
    """WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS l, count(*) AS n FROM customer GROUP BY 1, 2), gs AS (SELECT DISTINCT g FROM c), share AS (SELECT 5.0::DOUBLE / count(*) AS f FROM gs),
goal AS (SELECT l, sum(n) * any_value(f) AS target FROM c, share GROUP BY l),
picked AS (SELECT t.trial, gs.g FROM range(50000) AS t(trial), gs QUALIFY row_number() OVER (PARTITION BY t.trial ORDER BY sha256('17:' || t.trial::VARCHAR || ':' || gs.g::VARCHAR), gs.g::VARCHAR) <= 5),
named AS (SELECT trial, string_agg(g::VARCHAR, ',' ORDER BY g::VARCHAR) AS groups FROM picked GROUP BY trial),
sums AS (SELECT p.trial, c.l, sum(c.n) AS n FROM picked p JOIN c ON p.g = c.g GROUP BY 1, 2),
every AS (SELECT n.trial, goal.l, goal.target, coalesce(s.n, 0) AS n FROM named n CROSS JOIN goal LEFT JOIN sums s ON s.trial = n.trial AND s.l = goal.l),
scored AS (SELECT trial, sum(n)::BIGINT AS n_rows, abs(sum(n) - sum(target)) / greatest(1.0, sum(target)) + avg(abs(n - target) / greatest(1.0, target)) AS e FROM every GROUP BY trial)
SELECT trial, round_even(e, 9) AS error, n_rows, groups FROM scored JOIN named USING (trial) ORDER BY error, groups LIMIT 1""",
)
def _(spark, d):
    groups = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return dataset.split_search(groups, 5)


@_add("drop_long_groups", "SELECT conv_id, turn FROM (SELECT conv_id, turn, max(length(text)) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE m <= 1400")
def _(spark, d):
    return dataset.drop_long_groups(table(spark, d, "conversations"), "conv_id", F.length("text"), 1400).select("conv_id", "turn")


@_add("leakage_overlap", f"WITH k AS (SELECT sha256({_NORM}) AS key, substr(source, 4)::INTEGER % 2 AS side FROM documents) SELECT key FROM k WHERE side = 0 INTERSECT SELECT key FROM k WHERE side = 1")
def _(spark, d):
    keys = _docs(spark, d).select(F.sha2("key", 256).alias("key"), (F.substring("source", 4, 9).cast("int") % 2).alias("side"))
    return dataset.overlap(keys.filter("side = 0"), keys.filter("side = 1"), "key")


@_add("protected_anti_join", f"SELECT doc_id FROM documents WHERE {_NORM} NOT IN (SELECT {_NORM} FROM documents WHERE source = 'src3')")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", "source", F.sha2("key", 256).alias("key"))
    return dataset.without_protected(docs, docs.filter("source = 'src3'").select("key"), F.col("key")).select("doc_id")


@_add(
    "alignment_report",
    "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS extra, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS aligned, 0::BIGINT AS repeated FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, d):
    return dataset.alignment(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@_add("label_completeness", f"SELECT source, count(DISTINCT good) = 2 AS complete, count(*) AS n FROM {_LABELLED} GROUP BY source")
def _(spark, d):
    return dataset.label_sets(_labelled(spark, d), "source", "quality", [0, 1])


@_add("top_k_stable", "SELECT nation, suppkey, balance FROM (SELECT s_nationkey AS nation, s_suppkey AS suppkey, s_acctbal AS balance, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 2")
def _(spark, d):
    s = table(spark, d, "supplier")
    return dataset.cap_per_key(s, F.col("s_nationkey"), 2, F.desc("s_acctbal"), "s_suppkey").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").alias("balance"))


@_add("dataset_fingerprint", "SELECT sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR COLLATE \"C\")) AS fingerprint, count(*) AS n FROM orders".replace(' COLLATE "C"', ""))
def _(spark, d):
    return dataset.fingerprint(table(spark, d, "orders"), "o_orderkey")


@_add("pending_after_resume", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def _(spark, d):
    done = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    return dataset.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), done)


# --- Statements as data ---------------------------------------------------------------------------

#: Statements that some queries without SQL of their own explain.
STATEMENTS = [
    (1, "SELECT name FROM singer;"),
    (2, "SELECT count(*) FROM singer WHERE age > 30"),
    (3, "SELECT T1.name, count(*) FROM singer AS T1 JOIN concert AS T2 ON T1.id = T2.singer_id GROUP BY T1.name HAVING count(*) > 1 ORDER BY count(*) DESC LIMIT 3"),
    (5, "SELECT name FROM singer WHERE id IN (SELECT singer_id FROM concert WHERE year >= 2014)"),
    (6, "SELECT name FROM a UNION SELECT name FROM b"),
]


def _part(n: int, m: int) -> str:
    return f"(floor(p_partkey / {n}) % {m})"


_J, _KIND, _W, _G, _H, _O, _A = "(p_partkey % 4)", _part(4, 3), _part(12, 4), _part(48, 2), _part(96, 2), _part(192, 2), _part(384, 2)


def _written(distinct: str = "'DISTINCT '", least: str = "< =") -> str:
    """A statement for each part, whose clauses follow from its key; an expression that both engines know."""
    prefix = f"CASE {_KIND} WHEN 0 THEN '' WHEN 1 THEN 'LEFT ' ELSE 'INNER ' END"
    joins = ", ".join(f"CASE WHEN {_J} >= {i} THEN concat(' ', {prefix}, 'JOIN t{i} ON t0.a = t{i}.b') ELSE '' END" for i in (1, 2, 3))
    where = f"CASE {_W} WHEN 0 THEN '' WHEN 1 THEN ' WHERE t0.x = 3' WHEN 2 THEN ' WHERE t0.x >= 3 AND t0.y LIKE ''distinct%''' ELSE ' WHERE t0.x IN (SELECT z FROM u WHERE z {least} 5)' END"
    rest = f"CASE WHEN {_G} = 1 THEN ' GROUP BY t0.c' ELSE '' END, CASE WHEN {_G} = 1 AND {_H} = 1 THEN ' HAVING count(*) > 1' ELSE '' END, CASE WHEN {_O} = 1 THEN ' ORDER BY t0.c LIMIT 9' ELSE '' END"
    return f"concat('SELECT ', CASE WHEN p_partkey % 7 = 0 THEN {distinct} ELSE '' END, CASE WHEN {_A} = 1 THEN 'count(*), max(t0.c)' ELSE 't0.c' END, ' FROM t0', {joins}, {where}, {rest})"


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """The keys are few bytes and much work: a file that one task reads is spread first."""
    text = _written().replace("''distinct%''", "\\'distinct%\\'")
    keys = table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select(F.col("p_partkey").cast("int").alias("id"), F.expr(text).alias("sql"))


_S = f"(SELECT p_partkey::INTEGER AS id, {_written()} AS sql FROM part)"
_U = "upper(regexp_replace(trim(sql), '[;\\s]+$', ''))"


def _n(p: str) -> str:
    return f"len(regexp_extract_all({_U}, '{p}'))"


_JC, _SC, _UC, _AC = _n("\\bJOIN\\b"), _n("\\bSELECT\\b"), _n("\\b(UNION|INTERSECT|EXCEPT)\\b"), _n("\\b(COUNT|SUM|AVG|MIN|MAX)\\s*\\(")


def _has(p: str) -> str:
    return f"regexp_matches({_U}, '{p}')"


@_add(
    "sql_features",
    f"""WITH f AS (SELECT id, len(string_split_regex(trim(sql), '\\s+'))::INTEGER AS token_count, {_JC}::INTEGER AS join_count, {_SC}::INTEGER AS select_count, {_UC}::INTEGER AS set_operation_count, {_AC}::INTEGER AS aggregate_count, {_SC} > 1 AS has_subquery, {_has('GROUP BY')} AS has_group_by, {_has('HAVING')} AS has_having, {_has('ORDER BY')} AS has_order_by, {_has('WHERE')} AS has_where, {_has('LIMIT')} AS has_limit, {_has('DISTINCT')} AS has_distinct FROM {_S})
SELECT *, CASE WHEN s <= 1 THEN 'simple' WHEN s <= 3 THEN 'moderate' ELSE 'complex' END AS complexity_proxy FROM (SELECT * FROM f) JOIN (SELECT id, join_count + 2 * has_subquery::INTEGER + 2 * set_operation_count + has_group_by::INTEGER + has_having::INTEGER + has_order_by::INTEGER + (aggregate_count > 1)::INTEGER AS s FROM f) USING (id)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (s), CASE"),
)
def _(spark, d):
    return sf.with_features(_statements(spark, d), F.col("sql")).drop("sql")


@_add(
    "feature_counts_exploded",
    "SELECT feature, count(*) AS n FROM (SELECT unnest([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in {"aggregation": f"{_AC} > 0", "multiple_aggregates": f"{_AC} > 1", "join": f"{_JC} > 0", "multi_join": f"{_JC} > 1", "set_operation": f"{_UC} > 0", "subquery": f"{_SC} > 1", "join_and_subquery": f"{_JC} > 0 AND {_SC} > 1", "where": _has("WHERE"), "group_by": _has("GROUP BY"), "having": _has("HAVING"), "order_by": _has("ORDER BY"), "limit": _has("LIMIT"), "distinct": _has("DISTINCT")}.items()) + f"]) AS feature FROM {_S}) WHERE feature IS NOT NULL GROUP BY feature",
)
def _(spark, d):
    rows = sf.with_features(_statements(spark, d), F.col("sql"))
    tags = sf.matched_features({k: F.col(k) for k in rows.columns})
    return rows.select(F.explode(tags).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


_COMPONENTS = f"(CASE {_W} WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END + {_G} + {_O} + {_J})"
_AGGREGATES = f"({_A} = 1 OR ({_G} = 1 AND {_H} = 1))"


@_add(
    "hardness_tiers",
    f"""WITH f AS (SELECT p_partkey, {_J} AS j, {_W} = 3 AS nested, {_COMPONENTS} AS c, {_AGGREGATES} AS a, ({_J} > 0)::INTEGER + ({_W} = 3)::INTEGER + {_G} + ({_G} * {_H}) + ({_J} > 1)::INTEGER AS score FROM part)
SELECT p_partkey::INTEGER AS id, CASE WHEN nested AND (j >= 2 OR c >= 3) THEN 'extra hard' WHEN nested OR c >= 4 OR j >= 2 THEN 'hard' WHEN c >= 2 OR j = 1 OR a THEN 'medium' ELSE 'easy' END AS hardness,
CASE WHEN score = 0 THEN 'simple' WHEN score = 1 THEN 'moderate' WHEN score <= 3 THEN 'complex' ELSE 'extra' END AS tier FROM f""",
)
def _(spark, d):
    return _statements(spark, d).select("id", sf.hardness(F.col("sql")).alias("hardness"), sf.complexity_tier(F.col("sql")).alias("tier"))


@_add(
    "join_types",
    f"""WITH f AS (SELECT p_partkey, {_J}::INTEGER AS j, {_W} = 3 AS nested, CASE {_KIND} WHEN 1 THEN 'LEFT' ELSE 'INNER' END AS k FROM part)
SELECT p_partkey::INTEGER AS id, array_to_string(list_transform(range(j), lambda i: k), ',') AS kinds, array_to_string(list_transform(range(j + 1), lambda i: 't' || i), ',') || CASE WHEN nested THEN ',u' ELSE '' END AS tables,
CASE WHEN j + nested::INTEGER = 0 THEN 'single' WHEN j + nested::INTEGER = 1 THEN 'binary' WHEN nested THEN 'partial' WHEN j = 3 THEN 'chain_or_star' ELSE 'chain' END AS topology FROM f""",
)
def _(spark, d):
    kinds, refs = sf.join_types(F.col("sql")), sf.table_refs(F.col("sql"))
    return _statements(spark, d).select("id", F.array_join(kinds, ",").alias("kinds"), F.array_join(refs, ",").alias("tables"), sf.relation_topology(F.size(refs), F.size(kinds)).alias("topology"))


@_add("where_operators", f"SELECT p_partkey::INTEGER AS id, CASE {_W} WHEN 0 THEN '' WHEN 1 THEN '=' WHEN 2 THEN '>=,LIKE' ELSE '<,=,IN' END AS operators, CASE WHEN {_W} = 3 THEN 'WHERE' ELSE '' END AS nested FROM part")
def _(spark, d):
    return _statements(spark, d).select("id", F.array_join(F.array_sort(sf.where_operators(F.col("sql"))), ",").alias("operators"), F.array_join(sf.subquery_locations(F.col("sql")), ",").alias("nested"))


@_add("strip_distinct_and_operators", f"SELECT p_partkey::INTEGER AS id, {_written(chr(39) + ' ' + chr(39), '<=')} AS clean FROM part")
def _(spark, d):
    return _statements(spark, d).select("id", compare.prepare_compatible(F.col("sql")).alias("clean"))


_RAW = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('Here it is:', chr(10), '```sql', chr(10), 'SELECT ', p_partkey, ';', chr(10), '```', chr(10), 'Done.') WHEN 1 THEN concat('<think>maybe SELECT bad</think>', chr(10), 'SELECT ', p_partkey) "
    "WHEN 2 THEN concat('people with the most songs ', p_partkey) WHEN 3 THEN concat('WITH a AS (SELECT ', p_partkey, ') SELECT * FROM a; SELECT 2') WHEN 4 THEN concat('The result: SELECT x FROM t', p_partkey) ELSE concat('```', chr(10), 'no statement ', p_partkey, chr(10), '```') END"
)


@_add(
    "extract_fenced_text",
    """SELECT p_partkey::INTEGER AS id, CASE p_partkey % 6 WHEN 0 THEN 'SELECT ' || p_partkey WHEN 1 THEN 'SELECT ' || p_partkey WHEN 3 THEN 'WITH a AS (SELECT ' || p_partkey || ') SELECT * FROM a' WHEN 4 THEN 'SELECT x FROM t' || p_partkey ELSE '' END AS strict,
CASE p_partkey % 6 WHEN 0 THEN 'markdown_fence' WHEN 3 THEN 'trailing_text_or_multiple_statements' WHEN 5 THEN 'markdown_fence' ELSE 'prose_before_sql' END AS issue FROM part""",
)
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), F.expr(_RAW).alias("raw"))
    return rows.select("id", tx.extract_sql_strict(F.col("raw")).alias("strict"), sf.format_issue(F.col("raw"), tx.extract_sql(F.col("raw")), F.lit(False)).alias("issue"))


@_add("dialect_rewrites", "SELECT p_partkey::INTEGER AS id, 'SELECT IF(`size ' || p_partkey || '` > 1, ''[x] LIKE'', `b`), DATE_FORMAT(d, ''yyyy'') FROM `t` WHERE a ILIKE ''IIF(%''' AS sql FROM part")
def _(spark, d):
    text = F.concat(F.lit("SELECT IIF([size "), F.col("p_partkey"), F.lit("""] > 1, '[x] LIKE', "b"), STRFTIME('%Y', d) FROM [t] WHERE a LIKE 'IIF(%'"""))
    return table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), tx.dialect(text).alias("sql"))


@_add("estimated_tokens", "SELECT doc_id, round_even(length(text) / 4.0, 0)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


@_add("normalize_text", f"SELECT doc_id, sha256({_NORM}) AS digest FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("key", 256).alias("digest"))


_ERRORS = ["no such column: t.age", "TABLE_OR_VIEW_NOT_FOUND: the table or view `shop`.`x` cannot be found", "", "", "AMBIGUOUS_REFERENCE", "", "DIVIDE_BY_ZERO", "misuse of aggregate: COUNT()", "no such table: concerts"]
_STATUSES = ["error", "error", "unsafe", "timeout", "error", "ok", "error", "error", "error"]


def _failures(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("event_id") % len(_ERRORS) + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), at)
    return table(spark, d, "events").select("event_id", pick(_STATUSES).alias("status"), pick(_ERRORS).alias("error"))


_FAILED = f"(SELECT event_id, event_id % {len(_ERRORS)} AS k FROM events)"


@_add(
    "taxonomy_counts",
    f"""SELECT CASE k WHEN 0 THEN 'unknown_column' WHEN 1 THEN 'unknown_table' WHEN 8 THEN 'unknown_table' WHEN 2 THEN 'non_sql_or_unsafe' WHEN 3 THEN 'timeout' WHEN 4 THEN 'ambiguous_column' WHEN 7 THEN 'aggregate_misuse' ELSE 'other_database_error' END AS category,
CASE k WHEN 0 THEN 'hallucinated_column' WHEN 1 THEN 'hallucinated_table' WHEN 8 THEN 'hallucinated_table' WHEN 4 THEN 'ambiguous_column' WHEN 5 THEN 'semantic_mismatch' ELSE 'other_execution_error' END AS kind,
CASE k WHEN 2 THEN 'non_sql_or_unsafe' WHEN 5 THEN 'executable_wrong_result' ELSE 'database_execution_error' END AS outcome, count(*) AS n FROM {_FAILED} GROUP BY ALL""",
)
def _(spark, d):
    no, yes, s, e = F.lit(False), F.lit(True), F.col("status"), F.col("error")
    rows = _failures(spark, d).select(sf.error_category(s, e).alias("category"), sf.taxonomy(no, yes, s, e).alias("kind"), sf.primary_outcome(no, s, yes).alias("outcome"))
    return rows.groupBy("category", "kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_add("missing_names_top", f"SELECT kind, name, count(*) AS n FROM (SELECT CASE k WHEN 0 THEN 'column' ELSE 'table' END AS kind, CASE k WHEN 0 THEN 't.age' WHEN 1 THEN 'shop.x' ELSE 'concerts' END AS name FROM {_FAILED} WHERE k IN (0, 1, 8)) GROUP BY ALL ORDER BY n DESC, name LIMIT 20")
def _(spark, d):
    found = sf.missing_name(F.col("error"))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in found.items())))
    rows = _failures(spark, d).select(names.alias("x")).select("x.*").filter("name is not null")
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20)


@_add("gold_feature_slices", f"""WITH f AS (SELECT p_size > 25 AS ok, {_J} >= 1 AS has_join, {_J} >= 2 AS multiple_joins, {_G} = 1 AS has_group_by, {_W} = 3 AS has_subquery, {_J} >= 1 AND {_W} = 3 AS join_and_subquery FROM part),
e AS (SELECT ok, unnest([{{'f': 'has_join', 'h': has_join}}, {{'f': 'multiple_joins', 'h': multiple_joins}}, {{'f': 'has_group_by', 'h': has_group_by}}, {{'f': 'has_subquery', 'h': has_subquery}}, {{'f': 'join_and_subquery', 'h': join_and_subquery}}]) AS x FROM f)
SELECT x.f AS feature, count(*) FILTER (WHERE x.h) AS n_with, round_even(100 * avg(ok::INTEGER) FILTER (WHERE x.h), 3) AS with_pct, count(*) FILTER (WHERE NOT x.h) AS n_without, round_even(100 * avg(ok::INTEGER) FILTER (WHERE NOT x.h), 3) AS without_pct FROM e GROUP BY 1""")
def _(spark, d):
    rows = _statements(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), "p_size"), "id")
    f = sf.gold_features(F.col("sql"))
    names = ["has_join", "multiple_joins", "has_group_by", "has_subquery", "join_and_subquery"]
    return evaluate.with_and_without(rows, {k: f[k] for k in names}, F.col("p_size") > 25)


@_add("accuracy_by_join_count", f"SELECT {_J}::INTEGER AS join_count, count(*) AS support, count(*) FILTER (WHERE p_size > 25) AS correct, round_even(100.0 * count(*) FILTER (WHERE p_size > 25) / count(*), 3) AS accuracy_pct FROM part GROUP BY 1")
def _(spark, d):
    rows = _statements(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), "p_size"), "id")
    return evaluate.accuracy_by(rows.withColumn("join_count", sf.gold_features(F.col("sql"))["join_count"]), ["join_count"], F.col("p_size") > 25)


@_add("statements_by_split", f"""WITH f AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'dev' ELSE 'train' END AS split, {_J} AS j, {_W} = 3 AS nested, {_G} AS g, {_G} * {_H} AS h, {_COMPONENTS} AS c, {_AGGREGATES} AS a FROM part),
t AS (SELECT *, (j > 0)::INTEGER + nested::INTEGER + g + h + (j > 1)::INTEGER AS score, CASE WHEN nested AND (j >= 2 OR c >= 3) THEN 'extra hard' WHEN nested OR c >= 4 OR j >= 2 THEN 'hard' WHEN c >= 2 OR j = 1 OR a THEN 'medium' ELSE 'easy' END AS hardness FROM f)
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS n, round_even(100.0 * count(*) FILTER (WHERE j > 0) / count(*), 3) AS has_join_pct, round_even(100.0 * count(*) FILTER (WHERE nested) / count(*), 3) AS has_subquery_pct, count(*) FILTER (WHERE score = 0) AS tier_simple, count(*) FILTER (WHERE score >= 4) AS tier_extra,
count(*) FILTER (WHERE hardness = 'easy') AS hardness_easy, count(*) FILTER (WHERE hardness = 'extra hard') AS hardness_extra_hard FROM t GROUP BY ROLLUP (split)""")
def _(spark, d):
    rows = _statements(spark, d).withColumn("split", F.when(F.col("id") % 3 == 0, "dev").otherwise("train"))
    return evaluate.split_report(rows, "sql").select("split", "n", "has_join_pct", "has_subquery_pct", "tier_simple", "tier_extra", "hardness_easy", "hardness_extra_hard")


@_add("dataset_report", f"""WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, source, {_NORM} AS q, 'SELECT ' || n_chars % 50 AS s, CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'not_run' ELSE 'ok' END AS status, len(string_split_regex(trim(text), '\\s+')) AS w FROM documents)
SELECT split, count(*) AS examples, count(*) FILTER (WHERE status IN ('ok', 'not_run')) AS usable_examples, count(DISTINCT source) AS databases, count(DISTINCT q) AS unique_questions, count(DISTINCT s) AS unique_sql, count(*) - count(DISTINCT s) AS duplicate_sql_rows, 2 AS sql_tokens_max FROM r GROUP BY split""")
def _(spark, d):
    docs = table(spark, d, "documents")
    status = F.element_at(F.array(F.lit("error"), F.lit("not_run"), F.lit("ok"), F.lit("ok")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs.select(F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split"), F.col("source").alias("db_id"), F.col("text").alias("question"), F.concat(F.lit("SELECT "), F.col("n_chars") % 50, F.lit(" ;")).alias("sql"), status.alias("status"))
    return evaluate.dataset_report(rows).select("split", "examples", "usable_examples", "databases", "unique_questions", "unique_sql", "duplicate_sql_rows", "sql_tokens_max")


@_add("statement_signatures")
def _(spark, d):
    from .plans.parsed import signature

    rows = [(k, ",".join(x["tables"]), ",".join(x["columns"]), x["join_count"], x["has_group_by"]) for k, s in STATEMENTS if (x := signature(spark, s.rstrip(";")))]
    return spark.createDataFrame(rows, "id int, tables string, columns string, joins int, grouped boolean")


# --- Voting and comparison ------------------------------------------------------------------------

_IDX = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_CAND = f"(SELECT l_orderkey AS example, {_IDX} AS idx, l_returnflag || l_linestatus AS signature, l_tax = 0 AND l_discount = 0 AS is_zero, l_quantity < 3 AS is_empty FROM lineitem)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("example"), F.row_number().over(order).alias("idx"), F.concat("l_returnflag", "l_linestatus").alias("signature"), ((F.col("l_tax") == 0) & (F.col("l_discount") == 0)).alias("is_zero"), (F.col("l_quantity") < 3).alias("is_empty"))


@_add("execution_consensus", f"WITH c AS (SELECT example, signature, count(*) AS v, min(idx) AS f FROM {_CAND} GROUP BY 1, 2) SELECT example, f AS chosen_idx, v AS votes FROM c QUALIFY row_number() OVER (PARTITION BY example ORDER BY v DESC, f) = 1")
def _(spark, d):
    return vote.consensus(_candidates(spark, d))


@_add("value_aware_vote", f"WITH c AS (SELECT example, signature, count(*) AS v, min(idx) AS f, max(CASE WHEN NOT is_empty AND NOT is_zero THEN 1 ELSE 0 END) AS p FROM {_CAND} GROUP BY 1, 2) SELECT example, f AS chosen_idx, v AS votes FROM c QUALIFY row_number() OVER (PARTITION BY example ORDER BY p DESC, v DESC, signature DESC) = 1")
def _(spark, d):
    return vote.value_aware(_candidates(spark, d))


@_add("published_signature_vote", "WITH r AS (SELECT l_orderkey AS example, list_sort([l_quantity::BIGINT::VARCHAR, l_linestatus, l_returnflag]) AS cells FROM lineitem) SELECT example, substr(array_to_string(list_sort(list_distinct(list(array_to_string(cells, '|')))), ';'), 1, 200) AS signature FROM r GROUP BY example")
def _(spark, d):
    cells = F.array(F.col("l_quantity").cast("long").cast("string"), "l_linestatus", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("example")).agg(F.collect_list(cells).alias("rows"))
    return rows.select("example", vote.published_signature(F.col("rows")).alias("signature"))


@_add("winner_runner_margin", f"WITH c AS (SELECT example, signature, count(*) AS v, row_number() OVER (PARTITION BY example ORDER BY count(*) DESC, signature DESC) AS r FROM {_CAND} GROUP BY 1, 2) SELECT a.example, a.signature AS winner, a.v AS votes, coalesce(b.v, 0)::BIGINT AS runner_up_votes, (a.v - coalesce(b.v, 0))::BIGINT AS margin FROM c a LEFT JOIN c b ON a.example = b.example AND b.r = 2 WHERE a.r = 1")
def _(spark, d):
    return vote.winner_runner_up(_candidates(spark, d))


_MODELS = "(SELECT o_orderkey AS example, m AS model, p AS priority, (o_orderkey // (p + 1)) % 3 = 0 AS correct, CASE WHEN o_orderkey % (p + 5) = 0 THEN NULL ELSE ((o_orderkey // (p + 1)) % 3)::VARCHAR END AS signature FROM orders, (VALUES ('a', 0), ('b', 1), ('c', 2)) AS t(m, p))"


def _models(spark: SparkSession, d: str) -> DataFrame:
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).alias("priority")) for p, m in enumerate("abc"))))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("example"), models.alias("m")).select("example", "m.*")
    rest = F.floor(F.col("example") / (F.col("priority") + 1)) % 3
    return rows.withColumn("correct", rest == 0).withColumn("signature", F.when(F.col("example") % (F.col("priority") + 5) != 0, rest.cast("string")))


@_add("priority_ensemble", f"WITH s AS (SELECT *, CASE WHEN signature IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY example, signature) END AS v FROM {_MODELS}), w AS (SELECT *, bool_or(correct) OVER (PARTITION BY example) AS oracle_match FROM s) SELECT example, model AS selected, v::BIGINT AS votes, correct, oracle_match FROM w QUALIFY row_number() OVER (PARTITION BY example ORDER BY v DESC, priority) = 1")
def _(spark, d):
    return vote.priority_ensemble(_models(spark, d))


_POOL = "(SELECT o_custkey AS example, o_orderpriority AS signature, count(*) AS base_votes, count(*) FILTER (WHERE o_orderstatus = 'F') AS core_votes, min(o_orderkey) % 2 = 0 AS correct FROM orders GROUP BY 1, 2)"


def _pool(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("example"), F.col("o_orderpriority").alias("signature")).agg(F.count(F.lit(1)).alias("base_votes"), F.count_if(F.col("o_orderstatus") == "F").alias("core_votes"), (F.min("o_orderkey") % 2 == 0).alias("correct"))


@_add("weighted_pool_grid", f"WITH b AS (SELECT w::INTEGER AS weight, example, correct FROM {_POOL}, range(13) AS g(w) QUALIFY row_number() OVER (PARTITION BY w, example ORDER BY base_votes + w * core_votes DESC, signature DESC) = 1) SELECT weight, count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n FROM b GROUP BY weight")
def _(spark, d):
    weights = spark.range(13).select(F.col("id").cast("int").alias("weight"))
    return vote.weighted_pool(_pool(spark, d), weights)


@_add("leave_one_group_out", f"WITH s AS (SELECT source AS grp, t AS setting, count(*) FILTER (WHERE good = (n_chars > t * 500)) AS n_correct FROM {_LABELLED}, range(6) AS g(t) GROUP BY 1, 2), e AS (SELECT *, sum(n_correct) OVER (PARTITION BY setting) - n_correct AS elsewhere FROM s) SELECT grp, setting, n_correct AS held_out, elsewhere::BIGINT AS elsewhere FROM e QUALIFY row_number() OVER (PARTITION BY grp ORDER BY elsewhere DESC, setting) = 1")
def _(spark, d):
    rows = _labelled(spark, d).withColumn("setting", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    scores = rows.groupBy(F.col("source").alias("grp"), "setting").agg(F.count_if(F.col("good") == (F.col("n_chars") > F.col("setting") * 500)).alias("n_correct"))
    return vote.leave_one_group_out(scores)


@_add("confidence_routing", "WITH e AS (SELECT o_orderkey % 7 = 0 AS agree, o_orderkey % 5 AS core_votes, o_custkey % 6 AS other_votes, o_custkey % 3 AS margin, o_orderkey % 2 = 0 AS core_correct, o_custkey % 2 = 0 AS other_correct FROM orders), g AS (SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c FROM range(4) AS x(a), range(31) AS y(b), range(9) AS z(c)) SELECT a, b, c, sum(CASE WHEN NOT agree AND core_votes >= a AND other_votes <= b AND margin <= c THEN core_correct::INTEGER ELSE other_correct::INTEGER END)::BIGINT AS n_correct, count(*) FILTER (WHERE NOT agree AND core_votes >= a AND other_votes <= b AND margin <= c) AS n_routed FROM e, g GROUP BY a, b, c")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select((k % 7 == 0).alias("agree"), (k % 5).alias("core_votes"), (c % 6).alias("other_votes"), (c % 3).alias("margin"), (k % 2 == 0).alias("core_correct"), (c % 2 == 0).alias("other_correct"))
    grid = spark.range(4 * 31 * 9).select((F.col("id") % 4).alias("a"), (F.floor(F.col("id") / 4) % 31).alias("b"), F.floor(F.col("id") / 124).alias("c"))
    return vote.routing_grid(rows, grid)


@_add("fallback_routing", "SELECT o_orderkey AS example, CASE WHEN o_custkey % 4 = 0 AND o_orderstatus = 'F' THEN 'other' ELSE 'core' END AS source, CASE WHEN o_custkey % 4 = 0 AND o_orderstatus = 'F' THEN o_orderkey % 3 = 0 ELSE o_orderkey % 2 = 0 END AS correct FROM orders")
def _(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    core = o.select(k.alias("example"), (F.col("o_custkey") % 4).alias("core_votes"), (k % 2 == 0).alias("core_correct"))
    other = o.select(k.alias("example"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("other_status"), (k % 3 == 0).alias("other_correct"))
    return vote.with_fallback(core, other)


@_add("candidate_groups", "WITH t AS (SELECT o_custkey AS example, o_orderpriority AS signature, o_orderstatus AS sql, count(*) AS n FROM orders GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY example, signature ORDER BY n DESC, length(sql), sql DESC) AS k FROM t) SELECT example, signature, sum(n)::BIGINT AS votes, count(*) AS distinct_sqls, max(sql) FILTER (WHERE k = 1) AS representative FROM r GROUP BY 1, 2")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("example"), F.col("o_orderpriority").alias("signature"), F.col("o_orderstatus").alias("sql"))
    return vote.candidate_groups(rows).drop("rank")


@_add("bag_difference", "SELECT 'n_regionkey' AS k, count(*) AS differing FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) a FULL JOIN (SELECT r_regionkey AS n_regionkey, 5 AS n FROM region WHERE r_regionkey < 3) b USING (n_regionkey) WHERE a.n IS DISTINCT FROM b.n")
def _(spark, d):
    nation = table(spark, d, "nation").select("n_regionkey")
    region = table(spark, d, "region").filter("r_regionkey < 3").select(F.explode(F.array_repeat("r_regionkey", 5)).alias("k"))
    return compare.bag_difference(nation, region).agg(F.count(F.lit(1)).alias("differing")).select(F.lit("n_regionkey").alias("k"), "differing")


_A_ROWS, _B_ROWS = "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey, n_nationkey FROM nation"


def _same(a: str, b: str) -> str:
    return f"NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a}))"


_UP, _DOWN = ("SELECT row_number() OVER (ORDER BY n_nationkey {}) AS at, n_name FROM nation".format(x) for x in ("", "DESC"))


@_add("result_equality", f"SELECT {_same(_A_ROWS, 'SELECT n_nationkey, n_name, n_regionkey FROM (' + _B_ROWS + ')')} AS permuted, {_same('SELECT n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR FROM nation', 'SELECT n_name, n_regionkey::VARCHAR, n_nationkey::VARCHAR FROM nation')} AS strict, {_same('SELECT n_name FROM nation', 'SELECT n_name FROM nation ORDER BY 1')} AS reordered, {_same(_UP, _DOWN)} AS ordered")
def _(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_nationkey", "n_name", "n_regionkey"), n.select("n_name", F.col("n_regionkey").cast("double").alias("r"), "n_nationkey")
    up, down = n.select("n_name").orderBy("n_nationkey"), n.select("n_name").orderBy(F.desc("n_nationkey"))
    found = (compare.compatible_equal(a, b), compare.strict_equal(a, b), compare.strict_equal(up, down), compare.strict_equal(up, down, ordered=True))
    return spark.createDataFrame([found], "permuted boolean, strict boolean, reordered boolean, ordered boolean")


_SCORED = [
    (1, "SELECT r_name FROM region", "SELECT r_name FROM region WHERE r_regionkey >= 0"),
    (2, "SELECT r_name, r_regionkey FROM region", "SELECT r_regionkey, r_name FROM region"),
    (3, "SELECT n_regionkey FROM nation", "SELECT DISTINCT n_regionkey FROM nation"),
    (4, "SELECT count(*) FROM nation", "SELECT count(*) FROM region"),
    (5, "SELECT n_name FROM nation WHERE n_regionkey < 2", "SELECT n_name FROM nation WHERE n_regionkey < = 1"),
]


def _loose(sql: str) -> str:
    return sql.replace("DISTINCT ", "").replace("< =", "<=")


@_add(
    "prediction_scores",
    " UNION ALL ".join(f"SELECT {k}::INTEGER AS id, {strict} AS strict, {loose} AS compatible" for k, strict, loose in (
        (1, _same(_SCORED[0][1], _SCORED[0][2]), _same(_SCORED[0][1], _SCORED[0][2])),
        (2, "false", _same(_SCORED[1][1], f"SELECT r_name, r_regionkey FROM ({_SCORED[1][2]})")),
        (3, _same(_SCORED[2][1], _SCORED[2][2]), _same(_SCORED[2][1], _loose(_SCORED[2][2]))),
        (4, _same(_SCORED[3][1], _SCORED[3][2]), _same(_SCORED[3][1], _SCORED[3][2])),
        (5, "false", _same(_SCORED[4][1], _loose(_SCORED[4][2]))),
    )),
)
def _(spark, d):
    register(spark, d, ["region", "nation"])
    rows = [(k, (x := compare.score(spark, g, p, 60.0))["strict"], x["compatible"]) for k, g, p in _SCORED]
    return spark.createDataFrame(rows, "id int, strict boolean, compatible boolean")


_ROWS_OF = "(SELECT l_orderkey AS example, l_linenumber AS idx, CASE WHEN l_quantity < 5 THEN [] WHEN l_quantity < 15 THEN [['0']] ELSE [[l_returnflag, l_linestatus]] END AS rows FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)"


def _first_items(spark: SparkSession, d: str) -> DataFrame:
    """The item of least part of each order and line. Equal parts are left open by the SQL; the first in the file is
    taken, as DuckDB does when it reads the table in order, whatever tasks the rows are read by. Rows are dealt by
    order first: they are sorted where they meet, and the votes of an order need no other shuffle."""
    placed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    dealt = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return dataset.keep_first(dealt, ["l_orderkey", "l_linenumber"], F.asc_nulls_last("l_partkey"), "__file", "__at")


def _rows_of(spark: SparkSession, d: str) -> DataFrame:
    first = _first_items(spark, d)
    rows = F.when(F.col("l_quantity") < 5, F.array().cast("array<array<string>>")).when(F.col("l_quantity") < 15, F.array(F.array(F.lit("0")))).otherwise(F.array(F.array("l_returnflag", "l_linestatus")))
    return first.select(F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("idx"), rows.alias("rows"))


@_add("published_vote", f"WITH c AS (SELECT example, idx, array_to_string(list_sort(list_distinct(list_transform(rows, lambda r: array_to_string(list_sort(r), '|')))), ';') AS s FROM {_ROWS_OF}), g AS (SELECT example, s, count(*) AS v, min(idx) AS f, CASE WHEN s = '' OR s = '0' THEN 0 ELSE 1 END AS p FROM c GROUP BY example, s) SELECT example, f::BIGINT AS chosen_idx, v AS votes FROM g QUALIFY row_number() OVER (PARTITION BY example ORDER BY p DESC, v DESC, s DESC) = 1")
def _(spark, d):
    return vote.published_vote(_rows_of(spark, d))


_STORED = "(SELECT l_orderkey AS example, l_linenumber AS idx, l_linestatus AS st, l_returnflag AS fl, l_quantity > 25 AS correct FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)"
_RESELECTED = f"(WITH c AS (SELECT example, idx, correct, CASE WHEN fl = 'N' THEN NULL ELSE fl || st END AS s FROM {_STORED}), g AS (SELECT example, s, count(*) AS v, min(idx) AS f, CASE WHEN s LIKE 'A%' THEN 0 ELSE 1 END AS p FROM c WHERE s IS NOT NULL GROUP BY example, s), b AS (SELECT example, f, v FROM g QUALIFY row_number() OVER (PARTITION BY example ORDER BY p DESC, v DESC, s DESC) = 1) SELECT e.example, coalesce(b.f, 0)::BIGINT AS chosen_idx, coalesce(b.v, 0)::BIGINT AS votes FROM (SELECT DISTINCT example FROM c) e LEFT JOIN b USING (example))"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    first = _first_items(spark, d)
    sql = F.concat(F.lit("SELECT DISTINCT "), "l_returnflag", F.lit(" FROM "), "l_linestatus", F.lit(" WHERE a > = 1"))
    return first.select(F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("idx"), sql.alias("sql"), (F.col("l_quantity") > 25).alias("correct"))


def _reselected(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f"SELECT  {f} FROM {s} WHERE a >= 1", f + s, False, f == "A") for f in "AR" for s in "FO"]
    return vote.reselect(_stored(spark, d), spark.createDataFrame(rows, "sql string, signature string, is_empty boolean, is_zero boolean"))


@_add("reselect_candidates", f"SELECT * FROM {_RESELECTED}")
def _(spark, d):
    return _reselected(spark, d)


@_add(
    "rescore_candidates",
    f"""WITH o AS (SELECT example, correct AS old FROM {_STORED} WHERE idx = 1), n AS (SELECT r.example, coalesce(s.correct, false) AS new FROM {_RESELECTED} r LEFT JOIN {_STORED} s ON s.example = r.example AND s.idx = r.chosen_idx), a AS (SELECT example, bool_or(correct) AS oracle FROM {_STORED} GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(old, false)) AS before, count(*) FILTER (WHERE new) AS after, count(*) FILTER (WHERE NOT coalesce(old, false) AND new) AS corrected, count(*) FILTER (WHERE coalesce(old, false) AND NOT new) AS regressed, count(*) FILTER (WHERE oracle) AS oracle FROM n LEFT JOIN o USING (example) JOIN a USING (example)""",
)
def _(spark, d):
    stored = _stored(spark, d)
    return vote.rescore(stored, stored.select("example", F.lit(1).alias("chosen_idx")).distinct(), _reselected(spark, d))


@_add("ensemble_report", f"WITH s AS (SELECT *, CASE WHEN signature IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY example, signature) END AS v FROM {_MODELS}), w AS (SELECT *, bool_or(correct) OVER (PARTITION BY example) AS o FROM s), e AS (SELECT example, correct AS c, o FROM w QUALIFY row_number() OVER (PARTITION BY example ORDER BY v DESC, priority) = 1), b AS (SELECT example, correct AS b FROM {_MODELS} WHERE model = 'b') SELECT count(*) AS n, count(*) FILTER (WHERE c) AS correct, count(*) FILTER (WHERE b) AS baseline_correct, count(*) FILTER (WHERE c AND NOT b) AS corrected, count(*) FILTER (WHERE NOT c AND b) AS regressed, count(*) FILTER (WHERE o) AS oracle FROM e JOIN b USING (example)")
def _(spark, d):
    rows = _models(spark, d)
    return vote.ensemble_report(vote.priority_ensemble(rows), rows.filter("model = 'b'"))


@_add("best_routing", "WITH e AS (SELECT o_orderkey % 7 = 0 AS agree, o_orderkey % 5 AS core_votes, o_custkey % 6 AS other_votes, o_custkey % 3 AS margin, o_orderkey % 2 = 0 AS core_correct, o_custkey % 2 = 0 AS other_correct FROM orders), g AS (SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c FROM range(4) AS x(a), range(31) AS y(b), range(9) AS z(c)), s AS (SELECT a, b, c, sum(CASE WHEN NOT agree AND core_votes >= a AND other_votes <= b AND margin <= c THEN core_correct::INTEGER ELSE other_correct::INTEGER END)::BIGINT AS n_correct, count(*) FILTER (WHERE NOT agree AND core_votes >= a AND other_votes <= b AND margin <= c) AS n_routed FROM e, g GROUP BY a, b, c) SELECT * FROM s ORDER BY n_correct DESC, a DESC, b DESC, c DESC LIMIT 1")
def _(spark, d):
    return vote.best_setting(_queries["confidence_routing"](spark, d))


# --- Error reports --------------------------------------------------------------------------------

_FLAGGED = "(SELECT l.doc_id, d.lang AS complexity, d.source, d.n_chars, CASE WHEN l.doc_id % 3 = 0 THEN NULL ELSE d.n_chars / 8.0 END AS ms, l.quality = 1 AS execution_match, l.toxic = 1 AS raw_exact_match, l.doc_id % 2 = 0 AS syntax_valid FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    rows, k = _labelled(spark, d), F.col("doc_id")
    return rows.select("doc_id", F.col("lang").alias("complexity"), "source", "n_chars", F.when(k % 3 != 0, F.col("n_chars") / 8).alias("ms"), F.col("good").alias("execution_match"), F.col("rude").alias("raw_exact_match"), (k % 2 == 0).alias("syntax_valid"))


@_add("summary_of_flags", "SELECT CASE WHEN grouping(complexity) = 1 THEN 'all' ELSE complexity END AS complexity, count(*) AS examples, " + ", ".join(f"count(*) FILTER (WHERE {k}) AS {k}_count, round_even(100.0 * count(*) FILTER (WHERE {k}) / count(*), 3) AS {k}_pct" for k in ("execution_match", "raw_exact_match", "syntax_valid")) + f", round_even(avg(ms), 3) AS mean_latency FROM {_FLAGGED} GROUP BY ROLLUP (complexity)")
def _(spark, d):
    return evaluate.summarize(_flagged(spark, d), latency="ms", flags=("execution_match", "raw_exact_match", "syntax_valid"))


@_add("accuracy_by_bins", "SELECT dimension, bin, count(*) AS support, count(*) FILTER (WHERE execution_match) AS correct, round_even(100.0 * count(*) FILTER (WHERE execution_match) / count(*), 3) AS accuracy_pct FROM (SELECT execution_match, unnest([{'d': 'length', 'b': CASE WHEN n_chars <= 500 THEN '0-500' WHEN n_chars <= 2000 THEN '501-2000' ELSE '2001+' END}, {'d': 'id', 'b': CASE WHEN doc_id <= 100 THEN 'low' ELSE 'high' END}, {'d': 'latency', 'b': CASE WHEN ms <= 100 THEN 'fast' ELSE 'slow' END}, {'d': 'source', 'b': CASE WHEN substr(source, 4)::INTEGER <= 3 THEN 'first' ELSE 'rest' END}], recursive := true)" + f" FROM {_FLAGGED}) AS t(execution_match, dimension, bin) GROUP BY 1, 2")
def _(spark, d):
    dimensions = {
        "length": evaluate.bins(F.col("n_chars"), [(500, "0-500"), (2000, "501-2000")], "2001+"),
        "id": evaluate.bins(F.col("doc_id"), [(100, "low")], "high"),
        "latency": evaluate.bins(F.col("ms"), [(100, "fast")], "slow"),
        "source": evaluate.bins(F.substring("source", 4, 9).cast("int"), [(3, "first")], "rest"),
    }
    return evaluate.binned_accuracy(_flagged(spark, d), dimensions, F.col("execution_match"))


@_add("nested_histogram", "SELECT source, lang, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 1) AS pct FROM documents GROUP BY source, lang")
def _(spark, d):
    return evaluate.nested_histogram(table(spark, d, "documents"), "source", "lang")


@_add("pivot_with_fill", "SELECT source, " + ", ".join(f"coalesce(round_even(avg(n_chars) FILTER (WHERE lang = '{x}' AND doc_id % 9 = 0), 3), -1.0) AS {x}" for x in ("de", "xx")) + " FROM documents GROUP BY source")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("x", F.when(F.col("doc_id") % 9 == 0, F.col("n_chars")))
    return evaluate.pivot_mean(docs, "source", "lang", ["de", "xx"], "x", -1.0)


@_add("valid_gold_accuracy", f"SELECT count(*) AS n, count(*) FILTER (WHERE execution_match) AS correct, count(*) FILTER (WHERE syntax_valid) AS usable, count(*) FILTER (WHERE syntax_valid AND execution_match) AS usable_correct, round_even(100.0 * count(*) FILTER (WHERE execution_match) / count(*), 3) AS accuracy_pct, round_even(100.0 * count(*) FILTER (WHERE syntax_valid AND execution_match) / count(*) FILTER (WHERE syntax_valid), 3) AS usable_accuracy_pct FROM {_FLAGGED}")
def _(spark, d):
    return evaluate.subset_accuracy(_flagged(spark, d), F.col("execution_match"), F.col("syntax_valid"))


@_add("simple_stats", "SELECT lang, min(n_chars) AS min, max(n_chars) AS max, round_even(avg(n_chars), 2) AS mean, median(n_chars::DOUBLE) AS median FROM documents GROUP BY lang")
def _(spark, d):
    return evaluate.simple_stats(table(spark, d, "documents"), ["lang"], "n_chars")


@_add("linking_precision", "WITH r AS (SELECT l_orderkey AS id, l_orderkey % 2 = 0 AS correct, CASE WHEN l_linenumber % 2 = 0 THEN 'table' ELSE 'column' END AS kind, lower(CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE l_returnflag END) IN ('o', 'r', 'a') AS hit FROM lineitem), e AS (SELECT id, correct, bool_and(hit) AS every, count(*) FILTER (WHERE kind = 'table') AS tr, count(*) FILTER (WHERE kind = 'table' AND hit) AS tg, count(*) FILTER (WHERE kind = 'column') AS cr, count(*) FILTER (WHERE kind = 'column' AND hit) AS cg FROM r GROUP BY 1, 2) SELECT correct, count(*) AS n, count(*) FILTER (WHERE every) AS fully_grounded, sum(tr)::BIGINT AS table_refs, sum(tg)::BIGINT AS table_grounded, sum(cr)::BIGINT AS column_refs, sum(cg)::BIGINT AS column_grounded, round_even(100.0 * sum(tg) / sum(tr), 3) AS table_precision_pct, round_even(100.0 * sum(cg) / sum(cr), 3) AS column_precision_pct FROM e GROUP BY 1")
def _(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 2 == 0).alias("correct"), F.when(even, "table").otherwise("column").alias("kind"), F.when(even, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("name"))
    known = spark.createDataFrame([("table", "o"), ("column", "R"), ("column", "a")], "kind string, name string")
    return evaluate.linking_precision(refs, known)


@_add("representative_failures", f"""WITH RECURSIVE f AS (SELECT doc_id, source AS outcome, complexity AS mismatch, n_chars, row_number() OVER (ORDER BY doc_id % 3, n_chars DESC, doc_id) AS r FROM {_FLAGGED} WHERE NOT execution_match),
walk AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS seen, []::BIGINT[] AS chosen UNION ALL SELECT f.r, CASE WHEN ok THEN list_concat(seen, ['o' || f.outcome, 'm' || f.mismatch]) ELSE seen END, CASE WHEN ok THEN list_append(chosen, f.doc_id) ELSE chosen END FROM (SELECT walk.*, f.doc_id, f.outcome, f.mismatch, f.r AS at, len(list_filter(seen, lambda x: x = 'o' || f.outcome)) < 3 AND len(list_filter(seen, lambda x: x = 'm' || f.mismatch)) < 2 AND len(chosen) < 12 AS ok FROM walk JOIN f ON f.r = walk.r + 1) AS f(r0, seen, chosen, doc_id, outcome, mismatch, r, ok)),
last AS (SELECT chosen FROM walk ORDER BY r DESC LIMIT 1), filled AS (SELECT doc_id, CASE WHEN list_contains(chosen, doc_id) THEN 0 ELSE 1 END AS extra, r FROM f, last)
SELECT doc_id FROM filled ORDER BY extra, r LIMIT 12""")
def _(spark, d):
    rows = _flagged(spark, d).filter(~F.col("execution_match")).withColumn("rank", F.col("doc_id") % 3)
    found = evaluate.representatives(rows, "source", "rank", "n_chars", "doc_id", "complexity", n=12)
    return spark.createDataFrame([(r["doc_id"],) for r in found], "doc_id long")


# --- Checks between datasets ----------------------------------------------------------------------


@_add("leakage_report", f"WITH k AS (SELECT source, lang, sha256({_NORM}) AS key, substr(source, 4)::INTEGER % 2 AS side FROM documents) SELECT (SELECT count(*) FROM (SELECT lang FROM k WHERE side = 0 INTERSECT SELECT lang FROM k WHERE side = 1)) AS lang_overlap, (SELECT count(*) FROM (SELECT key FROM k WHERE side = 0 INTERSECT SELECT key FROM k WHERE side = 1)) AS key_overlap, (SELECT count(*) FROM (SELECT lang, key FROM k WHERE side = 0 INTERSECT SELECT lang, key FROM k WHERE side = 1)) AS exact_overlap")
def _(spark, d):
    keys = _docs(spark, d).select("lang", F.sha2("key", 256).alias("key"), (F.substring("source", 4, 9).cast("int") % 2).alias("side"))
    return dataset.leakage(keys.filter("side = 0"), keys.filter("side = 1"), ["lang", "key"])


@_add("aligned_models", "SELECT o_orderkey AS id, o_orderstatus AS a, o_orderpriority AS b, o_totalprice > 100000 AS c FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    part = lambda c: o.select(F.col("o_orderkey").alias("id"), c.alias("v"))
    return dataset.align_models({"a": part(F.col("o_orderstatus")), "b": part(F.col("o_orderpriority")), "c": part(F.col("o_totalprice") > 100000)}, "id", "v")


@_add("unused_nations", "SELECT n_nationkey AS db_id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def _(spark, d):
    used = [table(spark, d, t).filter(F.col(f"{p}_acctbal") > 9000).select(F.col(f"{p}_nationkey").alias("db_id")) for t, p in (("customer", "c"), ("supplier", "s"))]
    return dataset.unused(table(spark, d, "nation").select(F.col("n_nationkey").alias("db_id")), used)


@_add("union_with_supplement", "SELECT n_name AS name, 0::INTEGER AS origin FROM nation UNION ALL SELECT r_name, 1 FROM region")
def _(spark, d):
    return dataset.supplemented(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name")))


@_add("first_rows", "SELECT o_orderkey AS orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def _(spark, d):
    return dataset.first_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey")), 25, "orderkey")


@_add("positional_join", "SELECT o_orderkey AS place, o_custkey AS k, o_orderstatus AS s FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return records.positional(o.select("place", "k"), o, ("k",), "place")


# --- Questions, charts, streams -------------------------------------------------------------------

@_add("grounded_terms", "SELECT c_custkey AS id, 'segment.' || lower(c_mktsegment) AS term FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    text = F.concat(F.lit("How many of the "), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.lit("s")).otherwise(F.lit("")), F.lit(" are there?"))
    token = F.lower("c_mktsegment")
    return ask.grounded_terms(c.select(F.col("c_custkey").alias("id"), text.alias("question")), c.select(F.concat(F.lit("segment."), token).alias("term"), token.alias("token")).distinct())


@_add("chart_choice")
def _(spark, d):
    register(spark, d, ["nation", "orders"])
    rows = []
    for sql in ("SELECT count(*) AS n FROM orders", "SELECT n_name, n_regionkey FROM nation", "SELECT o_orderdate, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50"):
        found = guarded(spark, sql).limit(201).collect()
        chart = ask.choose_chart(list(found[0].__fields__), [tuple(r) for r in found])
        rows.append((sql, chart.kind, chart.x, chart.y))
    return spark.createDataFrame(rows, "sql string, kind string, x string, y string")


@_add("explain_statements")
def _(spark, d):
    from .plans.parsed import explain_sql

    return spark.createDataFrame([(k, explain_sql(spark, s.rstrip(";"))) for k, s in STATEMENTS], "id int, explanation string")


@_add("ask_end_to_end")
def _(spark, d):
    names = ["region", "nation", "customer", "orders"]
    register(spark, d, names)
    rows = []
    for q in ("how many orders are there", "list all the nations", "show stuff", "delete everything from the moon"):
        a = ask.ask(spark, q, names)
        rows.append((q, a.status, a.sql, a.text))
    return spark.createDataFrame(rows, "question string, status string, sql string, answer string")


@_add("domain_of_name", "SELECT p_partkey::INTEGER AS id, CASE p_partkey % 5 WHEN 0 THEN 'entertainment' WHEN 1 THEN 'transport' WHEN 2 THEN 'other' WHEN 3 THEN 'education' ELSE 'sports' END AS domain FROM part")
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("concert_", "Flight_", "xyz_", "College_", "game_store_"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), tx.domain_of(F.concat(name, "p_partkey")).alias("domain"))


@_add("events_tumbling", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    out = streams.tumbling(table(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.bround("total", 4).alias("total"))


# --- Records --------------------------------------------------------------------------------------


@_add("prediction_faults", "WITH p AS (SELECT CASE WHEN doc_id % 50 = 0 THEN doc_id // 100 ELSE doc_id END AS id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS predicted_sql, doc_id % 4 AS n FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM p) SELECT id, 'no_sql' AS fault FROM c WHERE predicted_sql = '' UNION ALL SELECT id, 'wrong_candidates' FROM c WHERE n <> 3 UNION ALL SELECT id, 'repeated_id' FROM c WHERE k > 1")
def _(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(k % 50 == 0, F.floor(k / 100)).otherwise(k).alias("id"), F.when(k % 7 == 0, "").otherwise(F.col("lang")).alias("predicted_sql"), F.array_repeat(F.lit("x"), (k % 4).cast("int")).alias("candidates"))
    return records.prediction_faults(rows, 3)


@_add("latest_per_label", "SELECT o_orderpriority AS label, arg_max(o_orderkey, o_orderkey) AS orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))
    return records.latest(rows, "label", "orderkey", "orderkey", "price")


@_add("transition_ids", f"SELECT CASE WHEN good THEN 'corrected' ELSE 'regressed' END AS transition, doc_id FROM {_LABELLED} WHERE good <> rude")
def _(spark, d):
    return records.transition_ids(_labelled(spark, d), "doc_id", "rude", "good")


@_add("candidate_group_sizes", "SELECT min(n) AS least, round_even(avg(n), 4) AS mean, max(n) AS most FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    return records.group_sizes(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@_add("join_with_checked_side", "SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("k"))
    return records.join_small(c, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation")), "k").select("custkey", "nation")


@_add("override_from_manifest", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return records.override(c, c.filter("id % 10 = 0").select("id", F.lit("X").alias("segment")), "id")


def _sql_type(kind: Column) -> Column:
    """A type as the SQL names it: DuckDB's name for those that its CASE leaves as they are."""
    inner = F.regexp_extract(kind, "^ARRAY<(\\w+)>$", 1)
    item = F.when(inner == "INT", "INTEGER").when(inner == "STRING", "VARCHAR").when(inner == "BINARY", "BLOB").otherwise(inner)
    return F.when(kind == "BINARY", "BLOB").when((inner != "") & ~inner.isin("FLOAT", "DOUBLE"), F.concat(item, F.lit("[]"))).otherwise(kind)


@_add("type_histogram", f"SELECT CASE data_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' WHEN 'TIMESTAMP_NS' THEN 'TIMESTAMP_NTZ' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'TIMESTAMP' WHEN 'FLOAT[]' THEN 'ARRAY<FLOAT>' WHEN 'DOUBLE[]' THEN 'ARRAY<DOUBLE>' ELSE data_type END AS data_type, count(*) AS n_columns, count(DISTINCT table_name) AS n_tables FROM {_VIEWS} GROUP BY 1")
def _(spark, d):
    return records.type_histogram(_every_column(spark, d).withColumn("data_type", _sql_type(F.col("data_type"))))


@_add("validation_records", "SELECT doc_id::VARCHAR AS id, source AS db_id, lang AS schema, text AS question, 'SELECT 1' AS gold_sql FROM documents WHERE doc_id % 4 = 0")
def _(spark, d):
    rows = table(spark, d, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("db_id"), F.col("lang").alias("schema"), F.col("text").alias("question"), F.lit("SELECT 1").alias("sql"))
    return records.validation_record(rows)


@_add("training_records")
def _(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'user'").select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.lit("db").alias("db_id"), F.lit("t(a)").alias("schema"), F.col("text").alias("question"), F.lit("SELECT 1").alias("sql"))
    return records.training_record(rows, "Answer with SQL.", 2)


_DEMO = " , ".join(f"{name} AS ({sql})" for name, sql in records.DEMO.items())


@_add("demo_concerts", f"WITH {_DEMO} SELECT s.Name AS name, count(*) AS n FROM singer s JOIN concert c ON s.Singer_ID = c.Singer_ID GROUP BY s.Name")
def _(spark, d):
    records.demo(spark)
    return guarded(spark, "SELECT s.Name AS name, count(*) AS n FROM singer s JOIN concert c ON s.Singer_ID = c.Singer_ID GROUP BY s.Name")


@_add("session_windows")
def _(spark, d):
    return streams.sessions(table(spark, d, "events"), "6 hours")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
