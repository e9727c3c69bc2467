"""Approximate nearest neighbours with learned partitions.

On a bounded sample the nearest-neighbour graph is built and cut into balanced partitions by recursive
bisection: a Fiedler-like vector of the graph splits at its median, then pairs that lower the number
of cut edges are swapped. A small classifier (one hidden layer) learns, from a vector, how its
neighbours spread over the partitions. Every row of the table is put into its most probable
partition; a query visits its several most probable ones, as many as reach ``target`` recall on
sample vectors that the classifier has not seen, and is ranked there by exact distances.

Partitions grow with the table: where ``MOST`` of them would hold far more than ``PART_ROWS`` rows each, every
partition is cut again in the same way, by a classifier that a task learns from a bounded sample of
it. So there are up to ``MOST * MOST`` cells, and the rows that a query meets stay about the same.

Of rows with equal vectors only the k + 1 smallest ids can be among anyone's k nearest; the others of a
batch are dropped as candidates before anything is shuffled, so a vector that a third of all rows hold
costs little. Rows meet queries by (cell, slice of its rows, slice of its queries); the slices have
bounded sizes, so a large cell is shared out. Each slice returns the k best for each of its queries, and
the k best of these are the result. A query that found fewer than k is ranked once more, against all
cells, so only a table with fewer candidates gives less.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither do rows without id. Rows equal in id and vector are one row, as query
and as candidate; of several vectors of one id each is a query and a candidate of its own, but none is a
candidate for its own id, and an id at one distance is named once. Equal distances go to the smaller
id. A table of under ``2 * EACH`` different usable vectors is one partition, that is, ranked exactly. An
empty table, or one without queries, gives an empty table. Extra columns may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch, column, ship, tidy

#: Least vectors of the sample, its neighbours for the graph, hidden units, and rows or queries in a slice.
SAMPLE, DEGREE, HIDDEN, SLICE_ROWS, SLICE_QUERIES = 8_000, 10, 128, 25_000, 5_000
#: Different sample vectors that a partition needs, and those that are drawn for it: the sample grows with the
#: partitions, to about ``DRAWN * MOST`` vectors.
EACH, DRAWN = 24, 96
#: Rows that a partition should have, and the least and most partitions that one classifier tells apart.
PART_ROWS, LEAST, MOST = 4_000, 16, 256
#: Rows among which equal vectors are sought before the shuffle, and that a task of the second level routes.
BATCH, ROUTED = 50_000, 200_000


def nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool = False) -> np.ndarray:
    """The k nearest rows of y for each row of x, in blocks."""
    out, norms = [], (y**2).sum(1)
    block = max(1, 6_000_000 // max(1, len(y)))
    for a in range(0, len(x), block):
        d = norms - 2 * x[a : a + block] @ y.T
        if same:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(y) - 1), 1)[:, :k].copy() if len(y) > k else np.tile(np.arange(len(y)), (len(d), 1)))
    return np.concatenate(out)


def partition_graph(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Balanced partitions (a power of two of them) of a neighbour graph, by recursive bisection."""
    n, rng = len(near), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        after = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            number = np.full(n, -1)
            number[own] = np.arange(len(own))
            inside = (number[a] >= 0) & (number[b] >= 0)
            u, v, m = number[a[inside]], number[b[inside]], len(own)
            degree = np.sqrt(np.bincount(u, minlength=m) + 1.0)
            first = degree / np.linalg.norm(degree)
            x = rng.standard_normal(m)
            for _ in range(60):
                x -= first * (first @ x)
                x = x + np.bincount(u, (x / degree)[v], m) / degree
                x /= np.linalg.norm(x)
            side = np.zeros(m, bool)
            side[np.argsort(x / degree, kind="stable")[m // 2 :]] = True
            for _ in range(10):
                other = np.bincount(u, side[u] != side[v], m)
                gain = 2 * other - np.bincount(u, minlength=m)
                left, right = np.flatnonzero(~side), np.flatnonzero(side)
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                k = min(len(left), len(right), max(1, m // 50))
                good = gain[left[:k]] + gain[right[:k]] > 0
                if not good.any():
                    break
                side[left[:k][good]], side[right[:k][good]] = True, False
            after[own] += side
        part = after
    return part


class Router:
    """The classifier: probabilities of the partitions for a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-9
        x = (x - self.shift) / self.scale
        w = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, target.shape[1])) * np.sqrt(1 / HIDDEN), np.zeros(target.shape[1])]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(30):
            order = rng.permutation(len(x))
            for at in (order[k : k + 256] for k in range(0, len(x), 256)):
                step += 1
                h = np.maximum(0, x[at] @ w[0] + w[1])
                g = (self._softmax(h @ w[2] + w[3]) - target[at]) / len(at)
                gh = g @ w[2].T * (h > 0)
                for k, grad in enumerate((x[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    grad = grad + 1e-4 * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    w[k] -= 2e-3 * (1 - epoch / 30) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x - self.shift) / self.scale @ self.w[0] + self.w[1])
        return self._softmax(h @ self.w[2] + self.w[3])


def learn(x: np.ndarray, parts: int, k: int, target: float, seed: int = 7) -> tuple[Router, int]:
    """A router from a sample, and the number of partitions that a query visits."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, train = x[order[: len(x) // 4]], x[order[len(x) // 4 :]]
    near = nearest(train, train, min(DEGREE, len(train) - 1), True)
    part = partition_graph(near, parts)
    soft = np.zeros((len(train), parts))
    soft[np.arange(len(train)), part] = 1
    np.add.at(soft, (np.repeat(np.arange(len(train)), near.shape[1]), part[near].ravel()), 1)
    router = Router(train, soft / soft.sum(1, keepdims=True))
    p = router(held)
    rank = np.argsort(np.argsort(-p, 1, kind="stable"), 1)
    queries = np.arange(min(500, len(held)))
    near = nearest(held, held, min(k, len(held) - 1), True)[queries]
    needed = np.sort(rank[queries[:, None], p.argmax(1)[near]].ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return router, min(parts, probes)


def _usable(vectors: DataFrame, id: str, vector: str, queries: str, k: int) -> DataFrame:
    """(id, v, dim, asks, stands) with v the float64 components as bytes: whether the row is a query, and
    whether it is a candidate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[int]] = {}
        asking: set[tuple[int, bytes]] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            out = [(i, v, (i, v) in asking, True) for v, ids in held.items() for i in sorted(ids)[: k + 1]]
            stand = {(i, v) for i, v, _, _ in out}
            out += [(i, v, True, False) for i, v in asking if (i, v) not in stand]
            held.clear()
            asking.clear()
            id, v, asks, stands = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(id, pa.int64()), pa.array(v, pa.binary()), pa.array([len(x) // 8 for x in v], pa.int32()), pa.array(asks, pa.bool_()), pa.array(stands, pa.bool_())], ["id", "v", "dim", "asks", "stands"])

        for batch in (b.slice(n, 5000) for b in batches for n in range(0, b.num_rows, 5000)):
            for i, components, asks in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                if components and None not in components:
                    x = np.array(components, np.float64)
                    if np.isfinite(x).all() and x.any():
                        x += 0.0  # one zero, not two
                        held.setdefault(v := x.tobytes(), set()).add(i)
                        if asks:
                            asking.add((i, v))
            size += batch.num_rows
            if size >= BATCH:
                yield flush()
                size = 0
        if held:
            yield flush()

    base = vectors.select(column(id).cast("long").alias(id), column(vector).alias("__v")).withColumn("__asks", F.expr(queries))
    base = base.select(column(id), "__v", "__asks").filter(column(id).isNotNull() & F.col("__v").isNotNull())
    return base.mapInArrow(tidy(rows), "id long, v binary, dim int, asks boolean, stands boolean")


def _matrix(v: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(v)).reshape(len(v), -1)


def _rank(k: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and side: a group's queries (side 0), then its candidates."""
        group, asked, best = None, {}, []

        def flush() -> pa.RecordBatch:
            flat = [(id, h, x) for ((id, _), h), b in zip(asked.items(), best, strict=True) for x in b]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2][1] for x in flat], pa.int64()), pa.array([x[2][0] for x in flat], pa.float64())], ["query_id", "h", "vec_id", "score"])

        def meet(cand: np.ndarray, x: np.ndarray) -> None:
            block = max(1, 4_000_000 // max(1, x.size))
            ids, q = np.array([id for id, _ in asked]), _matrix([v for _, v in asked])
            for a in range(0, len(q), block):
                d = np.sqrt(((q[a : a + block, None, :] - x) ** 2).sum(2))
                for n, row in enumerate(d, a):
                    limit = best[n][-1][0] if len(best[n]) == k else np.inf
                    at = np.flatnonzero((row <= limit) & (cand != ids[n]))
                    if len(at) > k:
                        # An id at one distance is named once, however often it stands there.
                        at = at[np.lexsort((cand[at], row[at]))]
                        new = np.append(True, (cand[at][1:] != cand[at][:-1]) | (row[at][1:] != row[at][:-1]))
                        at = at[new][:k]
                    if len(at):
                        best[n] = sorted({*best[n], *zip(row[at].tolist(), cand[at].tolist(), strict=True)})[:k]

        for batch in (b.slice(n, 1000) for b in batches for n in range(0, b.num_rows, 1000)):
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "ds", "qs")], 1)
            side, id, h, v = *(batch.column(c).to_numpy() for c in ("side", "id", "h")), batch.column("v").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if group != tuple(keys[a]):
                    if asked:
                        yield flush()
                    group, asked, best = tuple(keys[a]), {}, []
                middle = a + int((side[a:b] == 0).sum())
                for n in range(a, middle):
                    if (int(id[n]), v[n]) not in asked:  # rows that repeat are one query
                        asked[int(id[n]), v[n]] = int(h[n])
                        best.append([])
                if asked and middle < b:
                    meet(id[middle:b], _matrix(v[middle:b]))
        if asked:
            yield flush()

    return rows


def _ranked(data: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, h, best): for each query, known by its id and a hash of its vector, the k best (score,
    vec_id) among the candidates (id, v, cell) of the cells that it is asked in (id, v, cell)."""
    # A row for each cell: in how many slices its rows and its queries are shared out.
    slices = (
        data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("nd"))
        .join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SLICE_QUERIES).cast("int").alias("nq")), "cell")
    )
    slices = F.broadcast(scratch.keep(slices))  # at most MOST * MOST rows of three numbers

    def cut(c: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(c)), F.col(c)).cast("int")

    def every(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    columns = ["cell", "ds", "qs", "side", "id", F.xxhash64("v").alias("h"), "v"]
    data = data.join(slices, "cell").withColumn("ds", cut("nd")).withColumn("qs", every("nq")).withColumn("side", F.lit(1))
    asked = asked.join(slices, "cell").withColumn("qs", cut("nq")).withColumn("ds", every("nd")).withColumn("side", F.lit(0))
    both = asked.select(columns).union(data.select(columns))
    found = both.repartition("cell", "ds", "qs").sortWithinPartitions("cell", "ds", "qs", "side").mapInArrow(tidy(_rank(k)), "query_id long, h long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k)
    return scratch.keep(found.groupBy("query_id", "h").agg(best.alias("best")))


def _draw(x: np.ndarray, parts: int) -> tuple[np.ndarray, int]:
    """The different vectors of a sample, and the partitions that these can tell apart."""
    x = np.unique(x, axis=0)
    return x, min(parts, _power(len(x) // EACH))


def _second_level(placed: DataFrame, sizes: list[Row], probes: int, k: int, target: float, scratch: Scratch) -> DataFrame:
    """(id, v, asks, cell) with a row for each cell that a row stands or asks in: partitions cut again, each
    by a classifier learned from a sample of it."""
    spark = placed.sparkSession
    plan = [(r["part"], _power(min(MOST, r["n"] // PART_ROWS)), -(-r["n"] // ROUTED), min(1.0, max(SAMPLE, DRAWN * (r["n"] // PART_ROWS)) / max(1, r["different"]), DRAWN * MOST / max(1, r["different"]))) for r in sizes]
    known = F.broadcast(spark.createDataFrame([(p, s, t, int(x * (1 << 20)) + 1) for p, s, t, x in plan], "part int, subs int, tasks int, share int"))  # at most MOST rows
    drawn = placed.filter("stands").join(known, "part").filter((F.col("subs") > 1) & (F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 20)) < F.col("share"))).select("part", "subs", "v").distinct()

    def learned(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, parts = _draw(_matrix(pdf["v"].tolist()), int(pdf["subs"].iloc[0]))
        return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps(learn(x, parts, k, target) if parts > 1 else (None, 1))]})

    routers = scratch.keep(drawn.groupBy("part").applyInPandas(learned, "part int, router binary"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by partition, task and side; side 0 is the partition's classifier."""
        where, router, visits = None, None, 1
        for batch in (b.slice(a, 5000) for b in batches for a in range(0, b.num_rows, 5000)):
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "task", "side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, task, side = keys[a].tolist()
                if where != (part, task):
                    where, router, visits = (part, task), None, 1
                own = batch.slice(a, b - a)
                if side == 0:
                    router, visits = pickle.loads(own.column("router")[0].as_py())
                    continue
                m = own.num_rows if side == 1 or router is None else own.num_rows * visits
                order = np.zeros((own.num_rows, 1), np.int64)
                if router is not None:
                    order = np.argsort(-router(_matrix(own.column("v").to_pylist())), 1, kind="stable")[:, : 1 if side == 1 else visits]
                row = pa.array(np.repeat(np.arange(own.num_rows), order.shape[1]))
                yield pa.RecordBatch.from_arrays([own.column("id").take(row), own.column("v").take(row), pa.array([side == 2] * m, pa.bool_()), pa.array(part * MOST + order.ravel(), pa.int64())], ["id", "v", "asks", "cell"])

    task, no = F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("task"), F.lit(None).cast("binary").alias("router")
    stand = placed.filter("stands").join(known, "part").select("part", task, F.lit(1).alias("side"), "id", "v", no)
    asked = placed.filter("asks").select("id", "v", F.explode(F.slice("visits", 1, probes)).alias("part")).join(known, "part").select("part", task, F.lit(2).alias("side"), "id", "v", no)
    learned_ = routers.join(known, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("id"), no.alias("v"), "router")
    every = learned_.union(stand).union(asked)
    return scratch.keep(every.repartition("part", "task").sortWithinPartitions("part", "task", "side").mapInArrow(tidy(rows), "id long, v binary, asks boolean, cell long"))


def _power(n: int) -> int:
    """The largest power of two up to n, at least 1."""
    return 1 << max(1, n).bit_length() - 1


def search(vectors: DataFrame, queries: str, id: str = "vec_id", vector: str = "embedding", k: int = 10, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for the rows that the SQL condition
    ``queries`` (over the column ``id``) picks, against all rows."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    base = scratch.keep(_usable(vectors, id, vector, queries, k))
    dims = base.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.col("dim") == dims[0]["dim"])
    size = base.filter("stands").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v", 0.02).alias("different")).first()
    n, parts = size["n"], _power(int(np.clip(size["n"] // PART_ROWS, LEAST, MOST)))
    router, probes = None, 1
    if size["different"] >= EACH:
        # Drawn by a hash of the vector, so copies count once.
        most = max(SAMPLE, DRAWN * parts)
        share = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1, most / size["different"])) + 1)
        sample, parts = _draw(_matrix([r["v"] for r in base.filter(share).select("v").distinct().limit(2 * most).collect()] or [bytes(8)]), parts)
        if parts > 1:
            router, probes = learn(sample, parts, k, target)
    shared = spark.sparkContext.broadcast(router)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in (b.slice(a, 5000) for b in batches for a in range(0, b.num_rows, 5000)):
            m = batch.num_rows
            order = np.zeros((m, 1), np.int32)
            if router is not None and m:
                order = np.argsort(-router(_matrix(batch.column("v").to_pylist())), 1, kind="stable").astype(np.int32)
            visits = [x if asks else None for x, asks in zip(order, batch.column("asks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "asks", "stands")), pa.array(order[:, 0]), pa.array(visits, pa.list_(pa.int32()))], ["id", "v", "asks", "stands", "part", "visits"])

    placed = scratch.keep(base.mapInArrow(tidy(rows), "id long, v binary, asks boolean, stands boolean, part int, visits array<int>"))
    deep = router is not None and parts == MOST and n >= 2 * MOST * PART_ROWS
    if deep:
        sizes = placed.filter("stands").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("different")).collect()  # at most MOST rows
        celled = _second_level(placed, sizes, probes, k, target, scratch)
        data, asked = celled.filter("not asks").select("id", "v", "cell"), celled.filter("asks").select("id", "v", "cell")
    else:
        data = placed.filter("stands").select("id", "v", F.col("part").cast("long").alias("cell"))
        asked = placed.filter("asks").select("id", "v", F.explode(F.slice("visits", 1, probes).cast("array<long>")).alias("cell"))
    best = _ranked(data, asked, k, scratch)
    if router is not None:
        # Queries that met fewer than k candidates see all cells.
        every, top = placed.filter("asks").select("id", "v").distinct(), MOST * MOST if deep else parts
        full = best.filter(F.size("best") >= k).select("query_id", "h")
        short = scratch.keep(every.join(full, (F.col("id") == F.col("query_id")) & (F.xxhash64("v") == F.col("h")), "left_anti"))
        if short.limit(1).count():
            again = _ranked(data, short.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top - 1).cast("long")))), k, scratch)
            best = again.union(best.join(again.select("query_id", "h"), ["query_id", "h"], "left_anti"))
    out = best.select("query_id", F.posexplode("best").alias("rank", "found"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))
