"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

The categories are predicted in a given order. The model of a category sees the features of the text
and the probabilities of the categories before it. For training these probabilities are out of fold:
each labelled document gets them from models that were fit without its fold, so a later model learns
from probabilities as good as those it will meet. Each model is a logistic regression on the ``CHOSEN``
features that differ most between its two classes (by a two-proportion z score), with a ridge penalty.

Features are presences, so long texts need no cutting: the lower-cased words of a text, and their
first 4, 5 and 6 bytes, hashed to ``PLACES`` places. Whole texts are read.

The chain is fit on a bounded sample, ``max_train`` labelled documents or all if fewer, chosen by a
hash of the id. Only the sample's ids are broadcast and only its features reach the driver; both are
bounded by that parameter. Scoring is a pass over the documents without a shuffle.

Defined results: a null or empty text has no features and gets the models' base probabilities. Labels
of one id are combined by their maximum; ids without all categories, and labels without id, aren't
used. Of several texts of one labelled id the one of the least hash is learned from; a null text among
them only if there is no other. A category with one class only is predicted by its smoothed rate. Rows
that repeat are scored alike, each by its own text. A long text is hashed in groups of words, so beside
its bytes it needs some bytes for each word. An empty table gives an empty table. Extra columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, mix, ship, slices, tidy
from .rolling import CHUNK, grouped, prefix_hashes, range_hashes, ranges

PLACES, CHOSEN, FOLDS, RIDGE = 1 << 18, 4096, 5, 1.0
BEGINNINGS = (4, 5, 6)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_LETTER = np.array([0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])


def features(texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all distinct pairs; with ``chosen`` (a place's number or -1) only those."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    found = [np.empty(0, np.int64)]
    for a, b in grouped(start, stop):
        low, high = int(start[a]), int(stop[b - 1])
        prefix = prefix_hashes(data[low:high]) if high - low <= CHUNK else None  # else it is one very long word
        row, parts = np.searchsorted(begins, start[a:b], "right") - 1, []
        for k, most in enumerate((None, *BEGINNINGS)):
            at = np.arange(a, b) if most is None else a + np.flatnonzero(stop[a:b] - start[a:b] >= most)
            end = stop[at] if most is None else start[at] + most
            hashes = ranges(prefix, start[at] - low, end - low) if prefix is not None else range_hashes(data, start[at], end)
            place = (mix(hashes + np.uint64(k)) >> np.uint64(64 - 18)).astype(np.int64)
            own = row[at - a]
            if chosen is not None:
                place = chosen[place]
                own, place = own[place >= 0], place[place >= 0]
            parts.append(own * PLACES + place)
        found.append(np.unique(np.concatenate(parts)))
    both = found[-1] if len(found) < 3 else np.unique(np.concatenate(found))
    return both // PLACES, both % PLACES


class Logistic:
    """A linear model of one category over chosen places, and the probabilities of earlier categories."""

    def __init__(self, rows: np.ndarray, places: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray) -> None:
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.places, self.weights, self.earlier = np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1])
        if not n or y.min() == y.max():
            return
        with_, of = np.bincount(places, minlength=PLACES), np.bincount(places, y[rows], minlength=PLACES)
        p1, p0, p = of / y.sum(), (with_ - of) / (n - y.sum()), with_ / n
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (n - y.sum())) + 1e-12)
        z[with_ < 3] = 0
        self.places = np.sort(np.argsort(-z, kind="stable")[:CHOSEN][z[np.argsort(-z, kind="stable")[:CHOSEN]] > 2])
        number = np.full(PLACES, -1)
        number[self.places] = np.arange(len(self.places))
        own = number[places] >= 0
        rows, cols = rows[own], number[places[own]]
        m = len(self.places)
        x = np.zeros(m + earlier.shape[1] + 1)
        x[-1] = self.base

        def margin(x: np.ndarray) -> np.ndarray:
            return np.bincount(rows, x[cols], n) + earlier @ x[m:-1] + x[-1]

        def back(r: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(cols, r[rows], m), earlier.T @ r, [r.sum()]])

        penalty = np.append(np.full(m + earlier.shape[1], RIDGE), 0.0)
        for _ in range(8):  # Newton steps, each solved by conjugate gradients
            q = 1 / (1 + np.exp(-margin(x)))
            g, h = back(q - y) + penalty * x, q * (1 - q) + 1e-6
            d, r = np.zeros_like(x), -g
            s, rr = r.copy(), r @ r
            for _ in range(25):
                a = back(h * margin(s)) + penalty * s
                step = rr / max(s @ a, 1e-300)
                d += step * s
                r -= step * a
                if (new := r @ r) < 1e-10 * (g @ g):
                    break
                s, rr = r + new / rr * s, new
            x += d
            if np.abs(d).max() < 1e-4:
                break
        self.weights, self.earlier, self.base = x[:m], x[m:-1], float(x[-1])

    def predict(self, rows: np.ndarray, places: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        weight = np.zeros(PLACES)
        weight[self.places] = self.weights
        return 1 / (1 + np.exp(-(np.bincount(rows, weight[places], n) + earlier @ self.earlier + self.base)))


def fit_chain(ids: np.ndarray, rows: np.ndarray, places: np.ndarray, labels: np.ndarray) -> list[Logistic]:
    """One model for each column of labels; later ones are fit on out-of-fold predictions of earlier ones."""
    n, chain = len(ids), []
    fold = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    earlier = np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.append(Logistic(rows, places, n, earlier, y))
        if k + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                number = np.full(n, -1)
                number[train], number[test] = np.arange(len(train)), np.arange(len(test))
                a, b = fold[rows] != f, fold[rows] == f
                model = Logistic(number[rows[a]], places[a], len(train), earlier[train], y[train])
                out[test] = model.predict(number[rows[b]], places[b], len(test), earlier[test])
            earlier = np.column_stack([earlier, out])
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id: str = "doc_id", text: str = "text", max_train: int = 8_000) -> list[Logistic]:
    """The chain, fit on labelled documents."""
    spark = docs.sparkSession
    ship(spark)
    each = [F.max(column(c).cast("int")).alias(f"y{k}") for k, c in enumerate(categories)]
    known = labels.filter(column(id).isNotNull()).groupBy(column(id).cast("long").alias("label_id")).agg(*each).dropna()
    n = known.count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_train / n)))
    sample = docs.select(column(id).cast("long").alias("id"), column(text).alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_id"))
    columns = [f"y{k}" for k in range(len(categories))]
    # One text for an id: that of the least hash.
    sample = sample.groupBy("id", *columns).agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), "text"))).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 2 << 20, 500):
            row, place = features(texts)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = pa.array([place[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in columns), packed], ["id", *columns, "places"])

    found = sample.select("id", *columns, "text").mapInArrow(tidy(rows), "id long, " + ", ".join(f"{c} int" for c in columns) + ", places binary").toPandas()
    found = found.sort_values("id")
    ids, y = found["id"].to_numpy(), found[columns].to_numpy()
    flat = np.frombuffer(b"".join(found["places"]), np.int32)
    size = found["places"].str.len().to_numpy(np.int64) // 4
    del found
    # Places of fewer than three documents are never chosen, and they are most; they go before anything is fit.
    frequent = np.bincount(flat, minlength=PLACES) >= 3
    kept = frequent[flat]
    of = np.repeat(np.arange(len(ids), dtype=np.int32), size)[kept]
    return fit_chain(ids, of, flat[kept], y)


def predict_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id: str = "doc_id", text: str = "text", max_train: int = 8_000) -> DataFrame:
    """The id of every row and p_<category>, the probability of each category."""
    chain = learn(docs, labels, categories, id, text, max_train)
    # All models share one numbering of the places that any of them chose.
    used = np.unique(np.concatenate([np.empty(0, np.int64), *(m.places for m in chain)])).astype(np.int64)
    number = np.full(PLACES, -1)
    number[used] = np.arange(len(used))
    weights = np.zeros((len(chain), len(used)))
    for w, m in zip(weights, chain, strict=True):
        w[number[m.places]] = m.weights
    shared = docs.sparkSession.sparkContext.broadcast((used, weights, [(m.earlier, m.base) for m in chain]))
    names = [f"p_{c}" for c in categories]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, rest = shared.value
        number = np.full(PLACES, -1)
        number[used] = np.arange(len(used))
        for batch, texts in slices(batches, "text", 2 << 20, 500):
            n = batch.num_rows
            row, place = features(texts, number)
            p = np.zeros((n, 0))
            for w, (earlier, base) in zip(weights, rest, strict=True):
                p = np.column_stack([p, 1 / (1 + np.exp(-(np.bincount(row, w[place], n) + p @ earlier + base)))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(p[:, k]) for k in range(len(names)))], ["id", *names])

    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *(T.StructField(c, T.DoubleType()) for c in names)])
    return docs.select(column(id).alias("id"), column(text).alias("text")).mapInArrow(tidy(rows), schema).withColumnRenamed("id", id)
