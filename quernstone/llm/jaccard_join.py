"""Similarity join of documents on word shingles, with R-trees over count vectors.

A document's set holds its distinct shingles of five words. Two documents link when the intersection
is at least 80 % of the union. The join finds the connected components of all links:

1.  Documents with equal sets form a class; from here on only classes are compared.
2.  Every class hashes its shingles into ``GROUPS`` groups; the group counts are its point.
3.  Linked sets share one of their first n - ceil(0.8 n) + 1 shingles in any fixed order. The order
    puts shingles that many documents hold last; their counts come from a pass over all documents.
    These first shingles are dealt by their hash, and the classes that share one form a bucket.
4.  In every bucket an R-tree is packed over points, and the bucket's classes are searched in it, all at
    once from level to level. The overlap of two sets is at most the sum of the smaller coordinates, and
    that of a set with any set below a node at most the sum of the minima with the node's upper corner;
    both must reach 4/9 of the summed sizes.
5.  Surviving pairs are verified on the sets themselves, read again from the texts.
6.  In a bucket of up to ``SMALL`` classes the tree holds them all, and if it leaves few pairs, these are
    the bucket's. A bucket of near copies, which leaves many, and a larger one is searched for a few
    classes of each size band first, so it costs pairs in proportion to its rows. What the verified
    links then leave apart in it is searched again: classes outside the bucket's largest component, by
    size band and in blocks, each block an R-tree that the bucket's classes of fitting bands are run
    against. So no link between components is lost.
7.  Components are found by label propagation with pointer jumping on written tables.

Nothing of the size of the corpus reaches the driver: a bounded list of the most frequent places of a
hash table (``MOST_FREQUENT``), which only orders the shingles, and row counts.

Defined results: a null text, or one without words, has an empty set and links with nothing; fewer
than five words are one shingle. A document id that repeats stands for one document with several
texts: all of these share its component. Rows without an id have a set but no component. An empty
table gives an empty table. Shingles are compared by 64-bit hashes, classes by such a hash and size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, likely, mix, ship, slices, tidy
from .rolling import shingle_sets

GROUPS = 512
#: Bits of the table that counts shingles; of its places, how many most frequent ones are kept apart.
TABLE_BITS, MOST_FREQUENT = 22, 100_000
#: Classes in a bucket whose tree holds them all; points in a block; entries of a tree's node.
SMALL, BLOCK, FAN = 64, 512, 4
#: Classes of each size band that the others of a bucket of near copies are first paired with, and the band's width.
PIVOTS, BAND = 6, 1.25
#: Pairs of a point and a tree's node that are bounded at once.
AT_ONCE = 20_000
#: First shingles that one task handles.
TASK_ROWS = 500_000


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _sums(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flat) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
        return mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _points(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The group counts of each set, in as many bytes for a count as the greatest one needs."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(of * GROUPS + (flat & np.uint64(GROUPS - 1)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS)
    return [x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes() for x, top in zip(counts, counts.max(1, initial=0).tolist(), strict=True)]


def _read_points(packed: list[bytes]) -> np.ndarray:
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}
    if all(len(x) == GROUPS for x in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(x, kinds[len(x)]).astype(np.uint32) for x in packed])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: id, class hash, size, point; and places of the table that are frequent here."""
    count, docs, last = np.zeros(1 << TABLE_BITS, np.int64), 0, None
    held: list[np.ndarray] = []
    for part, texts in slices(batches):
        flat, bounds = shingle_sets(texts)
        held.append((flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        if sum(map(len, held)) > 1 << TABLE_BITS:
            count += np.bincount(np.concatenate(held), minlength=len(count))
            held.clear()
        point = _points(flat, bounds)
        docs += len(texts)
        last = part.column("id").type
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(_sums(flat, bounds)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(point, pa.binary()), pa.nulls(len(texts), pa.int64())],
            ["id", "c", "n", "point", "seen"],
        )
    if last is not None:
        if held:
            count += np.bincount(np.concatenate(held), minlength=len(count))
        at = np.flatnonzero(count >= max(4, 4 * count.sum() / len(count) + 3))
        k = len(at)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, last), pa.array(at), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary()), pa.array(count[at])], ["id", "c", "n", "point", "seen"])


def _deal(frequent: Broadcast, parts: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first shingles of each class met in this task, packed for each part they go to."""
        rank = np.zeros(1 << TABLE_BITS, np.uint64)
        for place, n in frequent.value:
            rank[place] = min(62, int(n).bit_length())
        met: set[tuple[int, int]] = set()
        pack = zstandard.ZstdCompressor(level=1)
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def flush() -> pa.RecordBatch:
            token, c, n = (np.concatenate(x) for x in held)
            to = (token % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            out = [(int(to[order[a]]), pack.compress(token[o := order[a:b]].tobytes() + c[o].tobytes() + n[o].tobytes())) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "packed"])

        for _, texts in slices(batches):
            flat, bounds = shingle_sets(texts)
            hashes, places = _sums(flat, bounds), rank[(flat >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            for k, c in enumerate(hashes.tolist()):
                a, b = int(bounds[k]), int(bounds[k + 1])
                if a == b or (c, b - a) in met:
                    continue
                met.add((c, b - a))
                if len(met) > 500_000:
                    met.clear()  # later copies are sent once more, and dropped where they arrive
                own, place, first = flat[a:b], places[a:b], prefix_length(b - a)
                if place.any():
                    own = own[np.argsort(place, kind="stable")]  # the rest is in order of the hash
                held[0].append(own[:first])
                held[1].append(np.full(first, c, np.int64))
                held[2].append(np.full(first, b - a, np.int32))
                size += first
            if size >= 400_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    return rows


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each shingle that several classes sent, from the packed rows of whole parts."""
    unpack, by_part = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_part.setdefault(part, []).append(packed)
    for part in list(by_part):
        columns: list[list[np.ndarray]] = [[], [], []]
        for packed in by_part.pop(part):
            raw = unpack.decompress(packed)
            k = len(raw) // 20
            columns[0].append(np.frombuffer(raw, np.uint64, k))
            columns[1].append(np.frombuffer(raw, np.int64, k, 8 * k))
            columns[2].append(np.frombuffer(raw, np.int32, k, 16 * k))
        token, c, n = (np.concatenate(x) for x in columns)
        order = np.argsort(token, kind="stable")
        same = np.append(token[order][1:] == token[order][:-1], False)
        order = order[same | np.append(False, same[:-1])]
        order = order[np.lexsort((c[order], n[order], token[order]))]
        token, c, n = token[order], c[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
        token, c, n = token[new], c[new], n[new]
        begins = np.flatnonzero(np.diff(token, prepend=~token[:1]) != 0) if len(token) else np.empty(0, np.int64)
        m = np.diff(np.append(begins, len(token)))
        # Buckets of the same classes are one bucket; the sum of mixed classes tells them.
        total = np.zeros(len(token) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(c.view(np.uint64) + n.astype(np.uint64)), out=total[1:])
            key = total[np.append(begins, len(token))[1:]] - total[begins]
        _, first = np.unique(np.stack([key, m.astype(np.uint64)], 1), axis=0, return_index=True) if len(m) else (None, np.empty(0, np.int64))
        keep = np.zeros(len(m), bool)
        keep[first] = True
        keep &= m > 1
        rows = np.repeat(keep, m)
        bucket, size = np.repeat(mix(key ^ m.astype(np.uint64)).view(np.int64), m)[rows], np.repeat(m, m)[rows]
        for a in range(0, len(bucket), 200_000):
            z = slice(a, a + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[z]), pa.array(size[z].astype(np.int32)), pa.array(c[rows][z]), pa.array(n[rows][z])], ["bucket", "m", "c", "n"])


class RTree:
    """Packed over points sorted by size: each node keeps the upper corner and the sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*points.T[:4], sizes))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > FAN:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def near(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (number of a given point, number of a point of the tree) whose overlap may suffice."""
        roots = len(self.levels[-1][0])
        who, at = np.repeat(np.arange(len(points)), roots), np.tile(np.arange(roots), len(points))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            size = sizes[who]
            fits = (5 * high[at] >= 4 * size) & (5 * size >= 4 * low[at])
            who, at = who[fits], at[fits]
            both = [np.minimum(top[at[k : k + AT_ONCE]], points[who[k : k + AT_ONCE]]).sum(1, dtype=np.int64) for k in range(0, len(at), AT_ONCE)]
            fits = 9 * np.concatenate([np.empty(0, np.int64), *both]) >= 4 * (low[at] + sizes[who])
            who, at = who[fits], at[fits]
            if level:
                who, at = np.repeat(who, FAN), (at[:, None] * FAN + np.arange(FAN)).ravel()
                inside = at < len(self.levels[level - 1][0])
                who, at = who[inside], at[inside]
        return who, self.order[at]


_PAIR = "a long, ac long, an int, b long, bc long, bn int"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Sorted rows with equal keys, a batch of them at a time; first tells where a group begins."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names if name != "point"}
        points = _read_points(batch.column("point").to_pylist())
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= columns[k][1:] != columns[k][:-1]
        new[0] = before != tuple(columns[k][0] for k in keys)
        before = tuple(columns[k][-1] for k in keys)
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(new)]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            yield bool(new[a]), {k: x[a:b] for k, x in columns.items()} | {"point": points[a:b]}


class _Pairs(dict):
    """Distinct pairs of classes (rep, c, n), the smaller first."""

    def put(self, x: list[tuple], y: list[tuple], who: np.ndarray, at: np.ndarray) -> None:
        for k, j in zip(who.tolist(), at.tolist(), strict=True):
            if x[k] != y[j]:
                self[(*min(x[k], y[j]), *max(x[k], y[j]))] = None

    def take(self) -> pa.RecordBatch:
        names = ["a", "ac", "an", "b", "bc", "bn"]
        kinds = [pa.int64(), pa.int64(), pa.int32()] * 2
        columns = list(zip(*self, strict=True)) if self else [[]] * 6
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def _classes(g: dict[str, np.ndarray]) -> list[tuple]:
    return list(zip(g["rep"].tolist(), g["c"].tolist(), g["n"].tolist(), strict=True))


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that a search of an R-tree leaves. Of a bucket of up to SMALL classes the tree holds all;
    if it leaves at most PIVOTS pairs for each class, these are all pairs of the bucket. Else, and in larger
    buckets, each class is paired with the first classes of each size band only, and the bucket stays open:
    a row with its number and no pair tells so. Rows come sorted by bucket and by a hash of the class, so the
    buckets of one group of near copies have the same first classes."""
    pairs, group, held, count = _Pairs(), None, [], {}
    open_: list[int] = []

    def pivots(g: dict[str, np.ndarray]) -> np.ndarray:
        """Which rows are among the first of their band."""
        out = []
        for k, b in enumerate(np.floor(np.log(g["n"]) / math.log(BAND)).astype(np.int64).tolist()):
            count[b] = count.get(b, 0) + 1
            if count[b] <= PIVOTS:
                out.append(k)
        return np.array(out, np.int64)

    def small(g: dict[str, np.ndarray]) -> None:
        n, row = g["n"].astype(np.int64), _classes(g)
        who, at = RTree(g["point"], n).near(g["point"], n)
        who, at = who[who < at], at[who < at]
        if len(who) > PIVOTS * len(n):
            count.clear()
            first = np.zeros(len(n), bool)
            first[pivots(g)] = True
            own = first[who] | first[at]
            who, at = who[own], at[own]
            open_.append(int(g["bucket"][0]))
        pairs.put(row, row, who, at)

    def take() -> pa.RecordBatch:
        found = pairs.take()
        if open_:
            none = pa.nulls(len(open_), pa.int64()), pa.nulls(len(open_), pa.int32())
            opened = pa.RecordBatch.from_arrays([none[0], pa.array(open_, pa.int64()), none[1], none[0], none[0], none[1]], found.schema.names)
            open_.clear()
            found = pa.Table.from_batches([found, opened]).combine_chunks().to_batches()[0]
        return found

    for first, g in _groups(batches, ["bucket"]):
        if first and group is not None:
            small(group)
            group = None
        if g["m"][0] <= SMALL:
            group = g if group is None else {k: np.concatenate([group[k], x]) for k, x in g.items()}
            continue
        if first:
            count.clear()
            held.clear()
            open_.append(int(g["bucket"][0]))
        n, row = g["n"].astype(np.int64), _classes(g)
        held += [(row[k], g["point"][k]) for k in pivots(g).tolist()]
        tree = RTree(np.stack([p for _, p in held]), np.array([x[2] for x, _ in held], np.int64))
        for k in range(0, len(row), 1000):
            who, at = tree.near(g["point"][k : k + 1000], n[k : k + 1000])
            pairs.put(row[k : k + 1000], [x for x, _ in held], who, at)
        if len(pairs) >= 50_000:
            yield take()
    if group is not None:
        small(group)
    yield take()


def _rest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs between components: rows sorted by bucket, band, block, side. Those of side 0 are the block's tree
    and are run against it as well as the others."""
    pairs, held, tree, rows, block = _Pairs(), [], None, [], {}

    def run(g: dict[str, np.ndarray], among: bool = False) -> Iterator[pa.RecordBatch]:
        asked, n = _classes(g), g["n"].astype(np.int64)
        for k in range(0, len(asked), 1000):
            who, near = tree.near(g["point"][k : k + 1000], n[k : k + 1000])
            apart = block["label"][near] != g["label"][k : k + 1000][who]
            if among:
                apart &= who + k < near
            pairs.put(asked[k : k + 1000], rows, who[apart], near[apart])
        if len(pairs) >= 50_000:
            yield pairs.take()

    def plant() -> Iterator[pa.RecordBatch]:
        nonlocal tree, rows, block
        block = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        tree, rows = RTree(block["point"], block["n"].astype(np.int64)), _classes(block)
        yield from run(block, among=True)

    for first, g in _groups(batches, ["bucket", "band", "block"]):
        if first:
            if held and tree is None:
                yield from plant()
            held, tree = [], None
        inner = g["side"] == 0
        if inner.any():
            held.append({k: x[inner] for k, x in g.items()})
        if held and not inner.all():
            if tree is None:
                yield from plant()
            yield from run({k: x[~inner] for k, x in g.items()})
    if held and tree is None:
        yield from plant()
    yield pairs.take()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        flat, bounds = shingle_sets(texts)
        c, n = _sums(flat, bounds), np.diff(bounds).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n), pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["c", "n", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: tuple[list, list] = ([], [])
        for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "x", "y")), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= 80 * (len(p) + len(q) - both):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The links among pairs, as (a, b) of ids."""
    wanted = scratch.keep(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "w"))
    # Few texts are wanted, so the others don't go through the shuffle.
    texts = likely(docs, "id", wanted, "w", wanted.count()).join(wanted, F.col("id") == F.col("w"), "left_semi").select("text")
    sets = scratch.keep(texts.mapInArrow(tidy(_sets), "c long, n int, tokens binary"))
    one = sets.select(F.col("c").alias("ac"), F.col("n").alias("an"), F.col("tokens").alias("x"))
    two = sets.select(F.col("c").alias("bc"), F.col("n").alias("bn"), F.col("tokens").alias("y"))
    links = scratch.keep(pairs.join(one, ["ac", "an"]).join(two, ["bc", "bn"]).select("a", "b", "x", "y").mapInArrow(tidy(_verify), "a long, b long").distinct())
    scratch.drop(sets)
    return links


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes of the links (a, b); label is the smallest node that can be reached."""
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        met = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("mid"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("far"))
        step = scratch.keep(met.join(jump, met["mid"] == jump["j"], "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")))
        changed = step.filter("old <> label").limit(1).count()
        scratch.drop(labels)
        labels = step.select("node", "label")
        labels._kept_at = step._kept_at
        if not changed:
            scratch.drop(edges)
            return labels


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(column(id).cast("long").alias("id"), column(text).alias("text"))
    described = scratch.keep(docs.mapInArrow(tidy(_describe), "id long, c long, n int, point binary, seen long"))
    rows = described.filter("n >= 0")
    top = described.filter("n < 0").groupBy("c").agg(F.sum("seen").alias("n")).filter("n >= 32").orderBy(F.desc("n"), "c").limit(MOST_FREQUENT).collect()
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(16, -(-int(shingles) // (5 * TASK_ROWS)))
    classes = scratch.keep(rows.filter("n > 0").groupBy("c", "n").agg(F.min("id").alias("rep"), F.max("point").alias("point")))

    frequent = spark.sparkContext.broadcast([(r["c"], r["n"]) for r in top])  # at most MOST_FREQUENT
    dealt = docs.select("text").mapInArrow(tidy(_deal(frequent, parts)), "part int, packed binary")
    buckets = scratch.keep(dealt.repartition(parts, "part").mapInArrow(tidy(_buckets), "bucket long, m int, c long, n int").distinct())
    points = buckets.join(classes.filter("rep is not null"), ["c", "n"]).select("bucket", "m", "c", "n", "rep", "point")
    first = scratch.keep(points.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("c"), "c", "n").mapInArrow(tidy(_first_pairs), _PAIR).distinct())
    links = _verified(first.filter("a is not null"), docs, scratch)
    labels = components(links, scratch)

    # Classes of open buckets that the links so far leave apart.
    known = classes.select("c", "n", "rep", "point").join(labels, F.col("rep") == labels["node"], "left").select("c", "n", "rep", "point", F.coalesce("label", "rep").alias("label"))
    open_ = first.filter("a is null").select(F.col("ac").alias("open"))
    large = scratch.keep(buckets.join(open_, F.col("bucket") == F.col("open"), "left_semi").select("bucket", "c", "n").join(known.filter("rep is not null"), ["c", "n"]))
    # Linked sizes differ by a factor of 1.25 at most, so a class meets its own band and the two beside it.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    by_label = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    apart = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("major"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
    apart = scratch.keep(apart.withColumn("one", F.col("others") <= BLOCK).drop("others"))
    others = large.select("bucket", "label", band.alias("band")).join(apart, "bucket").filter("label <> major").withColumn("band", F.when(F.col("one"), 0).otherwise(F.col("band")))
    blocks = others.groupBy("bucket", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))  # an entry for each band
    rest = large.join(scratch.keep(apart.join(blocks, "bucket")), "bucket").withColumn("own", F.when(F.col("one"), 0).otherwise(band))
    rest = rest.withColumn("at", F.when(F.col("label") != F.col("major"), F.pmod(F.xxhash64("c", "n"), F.try_element_at("blocks", "own")).cast("int")))
    bands = F.when(F.col("one"), F.array(F.lit(0))).otherwise(F.array(*(F.col("own") + k for k in (-1, 0, 1))))

    def places(b: Column) -> Column:
        n = F.coalesce(F.try_element_at("blocks", b), F.lit(0))
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(b.alias("band"), x.alias("block")))

    run = rest.withColumn("to", F.explode(F.flatten(F.transform(bands, places))))
    side = F.when((F.col("to.band") == F.col("own")) & (F.col("to.block") == F.col("at")), 0).otherwise(1)
    run = run.select("bucket", "to.band", "to.block", side.alias("side"), "c", "n", "rep", "label", "point")
    more = scratch.keep(run.repartition("bucket", "band", "block").sortWithinPartitions("bucket", "band", "block", "side").mapInArrow(tidy(_rest_pairs), _PAIR).distinct())
    if more.limit(1).count():
        found = _verified(more, docs, scratch)
        if found.limit(1).count():
            links = scratch.keep(links.union(found))
            labels = components(links, scratch)
    scratch.drop(buckets, large, first, more)
    repeated = rows.filter("id is not null").groupBy("id").agg(F.min("c").alias("c"), F.max("c").alias("d")).filter("c <> d").select(F.col("id").alias("twice"))
    several = bool(repeated.limit(1).count())
    if several:  # the texts of one id are one document
        texts = rows.filter("n > 0").join(repeated, F.col("id") == F.col("twice")).select("id", "c", "n").distinct()
        reps = scratch.keep(texts.join(classes, ["c", "n"]).select("id", "rep").distinct())
        own = reps.groupBy("id").agg(F.min("rep").alias("a")).join(reps, "id").filter("a <> rep").select("a", F.col("rep").alias("b"))
        labels = components(links.union(own), scratch)
    named = classes.join(labels, F.col("rep") == labels["node"], "left").select(F.col("c").alias("kc"), F.col("n").alias("kn"), F.coalesce("label", "rep").alias("component"))
    out = rows.select("id", "c", "n").join(named, (F.col("c") == F.col("kc")) & (F.col("n") == F.col("kn")), "left")
    if several:  # also those without words
        least = out.join(repeated, F.col("id") == F.col("twice")).groupBy("twice").agg(F.min("component").alias("least"))
        out = out.join(least, F.col("id") == F.col("twice"), "left").withColumn("component", F.coalesce("least", "component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of texts stays, with all its columns: that of the smallest id, of several texts
    of that id the one of the least hash. Rows without id stay."""
    names = [f"__c{n}" for n in range(len(docs.columns))]
    own = docs.select(column(id).cast("long").alias("__id"), F.xxhash64(column(text)).alias("__hash"), *(column(c).alias(k) for c, k in zip(docs.columns, names, strict=True)))
    texts = own.filter("__id is not null").groupBy("__id").agg(F.min("__hash").alias("least"), F.max("__hash").alias("most"))
    if texts.filter("least <> most").limit(1).count():
        # Each text of an id is a document of its own here, or one text would go with the near copies of another.
        own = own.withColumn("__key", F.when(F.col("__id").isNotNull(), F.xxhash64("__id", "__hash")))
        shown = own.select("__key", F.col(names[docs.columns.index(text)]).alias("__text"))
        groups = similar_groups(shown, "__key", "__text").toDF("__stay", "__n", "__component").filter("__stay is not null").distinct()
        keys = own.select("__key", "__id", "__hash").filter("__key is not null").distinct()
        first = F.min_by("__stay", F.struct("__id", "__hash")).alias("__stay")
        stay = groups.join(keys, F.col("__stay") == F.col("__key")).groupBy("__component").agg(first).select("__stay")
    else:
        own = own.withColumn("__key", F.col("__id"))
        groups = similar_groups(docs, id, text).toDF("__id", "__n", "__component")
        stay = groups.filter("__id = __component").select(F.col("__id").alias("__stay")).distinct()
    kept = own.join(stay, F.col("__key") == F.col("__stay"), "left_semi").dropDuplicates(["__key"])
    return kept.unionByName(own.filter("__id is null")).select(*(F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)))
