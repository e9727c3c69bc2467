"""Benchmark decontamination with an FM-index for each training shard.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A
window is ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is
one window. Every document word inside any occurrence of a window is hit.

A task turns its documents into shards of at most ``SHARD_WORDS`` words. A shard holds all their words
that stand in the benchmark; each run of other words, and each end of a document, is one separating
symbol, which no window holds. Over a shard it builds a suffix array (prefix doubling that sorts only what
is not yet told apart), the Burrows-Wheeler transform as a wavelet matrix with bit ranks, and samples of
the suffix positions. All windows are searched backwards at once; the rows found are walked to sampled
positions, and the occurrences are merged into spans. A longer document is cut in shards that overlap
by the longest window but one word, so no occurrence is lost.

The windows travel to the tasks in blocks of at most ``block_bytes`` of benchmark text, so what is
broadcast has a checked size, and the driver holds one block at a time; a larger benchmark takes more
blocks, each over all documents, whose spans are merged by row. A single item is never cut.

Defined results: a null or empty text has no words and no spans, and is not contaminated. Benchmark
items that are null or hold no word have no window; items that repeat are named once, items without
id are searched but not named. A document row is known by its id and its text: rows equal in both
have equal spans. Very long texts are read in pieces cut at word ends. An empty benchmark hits nothing,
an empty table of documents gives an empty table. Extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, ship, slices, tidy

#: What is not a word character becomes a space, A-Z become a-z.
WORDS = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Words of a shard, the sampling rate of its positions, and bytes of a long text that are split at once.
SHARD_WORDS, SAMPLE, PIECE = 1_000_000, 8, 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling over the ranks; settled suffixes are not sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = s[order[1:]] != s[order[:-1]]
    rank = np.empty(n, np.int64)
    # A suffix has the place of the first of its group as its rank, so ranks of others stay as they are.
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        single = new & np.append(new[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            return order
        who = order[at]
        after = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        sort = np.lexsort((after, rank[who]))
        who, after = who[sort], after[sort]
        order[at] = who
        old = rank[who]
        differs = np.empty(len(at), bool)
        differs[:1] = True
        differs[1:] = (old[1:] != old[:-1]) | (after[1:] != after[:-1])
        new[at] = differs
        rank[who] = np.maximum.accumulate(np.where(differs, at, 0))
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol, with counts by word."""

    def __init__(self, s: np.ndarray, bits: int) -> None:
        self.n, self.levels = len(s), []
        for level in range(bits - 1, -1, -1):
            one = (s >> level & 1).astype(bool)
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = self.n - int(one.sum())
            self.levels.append((level, words, before, zeros))
            s = np.concatenate([s[~one], s[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo = np.zeros(len(i), np.int64)
        hi = i.astype(np.int64)
        for level, words, before, zeros in self.levels:
            bit = (symbol >> level & 1).astype(bool)
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbol, lo, hi = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, words, before, zeros in self.levels:
            bit = (words[hi >> 6] >> (hi & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol |= bit.astype(np.int64) << level
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return symbol, hi - lo


class FmIndex:
    """The index of one shard: ``s`` holds symbols from 1; 0 separates and occurs in no window. Inside, all are one greater, and a single 0 ends the sequence."""

    def __init__(self, s: np.ndarray, symbols: int) -> None:
        s = np.append(s + 1, 0)
        sa = suffix_array(s)
        self.bwt = WaveletMatrix(s[sa - 1], int(symbols + 1).bit_length())
        self.first = np.zeros(symbols + 3, np.int64)
        np.cumsum(np.bincount(s, minlength=symbols + 2), out=self.first[1:])
        self.sampled = sa % SAMPLE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """windows: symbols, right-aligned. The windows that occur, and their first and last row + 1."""
        who = np.arange(len(windows))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.bwt.n, np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        for k in range(windows.shape[1] if len(windows) else 0):
            over = length[who] == k
            if over.any():
                done.append((who[over], lo[over], hi[over]))
                who, lo, hi = who[~over], lo[~over], hi[~over]
            symbol = windows[who, windows.shape[1] - 1 - k] + 1
            lo, hi = self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)
            there = lo < hi
            who, lo, hi = who[there], lo[there], hi[there]
        done.append((who, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row, by walking back to a sampled one."""
        out, at, walked, open_ = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            found = self.sampled[at]
            out[open_[found]] = self.samples[self.place[at[found]]] + walked
            open_, at = open_[~found], at[~found]
            symbol, before = self.bwt.access(at)
            at = self.first[symbol] + before
            walked += 1
        return out


#: Stands between the words of two documents; the byte is in no UTF-8 text.
_MARK = b"\xff"
_END = b" \xff "


class Windows:
    """The distinct windows of some benchmark items, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).update([name] if name is not None else [])
        self.length = np.array([len(w) for w in found], np.int64)
        self.symbols = np.zeros((len(found), int(self.length.max(initial=0))), np.int64)
        for row, w in zip(self.symbols, found, strict=True):
            row[len(row) - len(w) :] = w
        self.items = [tuple(sorted(names)) for names in found.values()]
        self.longest = int(self.length.max(initial=1))
        self.number[_MARK] = -1

    def ids(self, words: bytes) -> np.ndarray:
        """The numbers of translated words, 0 for those of no window, -1 for the end of a document."""
        found, at = [], 0
        while at < len(words):
            to = len(words) if len(words) - at <= PIECE else words.find(b" ", at + PIECE)
            split = words[at : to if to >= 0 else len(words)].split()
            found.append(np.fromiter(map(self.number.get, split, repeat(0)), np.int32, len(split)))
            at = to if to >= 0 else len(words)
        return np.concatenate(found) if found else np.empty(0, np.int32)

    def occurrences(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and positions of all occurrences in a sequence of symbols, by an index of each shard."""
        who, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(s), SHARD_WORDS) if self.items else ():
            index = FmIndex(s[a : a + SHARD_WORDS + self.longest - 1], len(self.number) - 1)
            found, lo, hi = index.search(self.symbols, self.length)
            count = hi - lo
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            who.append(np.repeat(found, count))
            at.append(index.locate(rows) + a)
        return np.concatenate(who), np.concatenate(at)


class _Shard:
    """Documents gathered until they fill a shard."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.clear()

    def clear(self) -> None:
        self.n_words, self.size = [], 0
        # Of each symbol of the shard: itself, its document, and its place among the document's words.
        self.symbols, self.doc, self.at = [], [], []

    def add(self, texts: list[bytes]) -> None:
        ids = self.windows.ids(_END.join(t.translate(WORDS) for t in texts))
        ends = np.flatnonzero(ids < 0)
        if len(ends) != len(texts) - 1:  # bytes that no UTF-8 text holds
            for t in texts if len(texts) > 1 else []:
                self.add([t])
            if len(texts) > 1:
                return
            ids, ends = np.maximum(ids, 0), ends[:0]
        n = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        known = ids > 0
        # Of what is not known, the first after something known stays as a separator.
        kept = np.flatnonzero(known | np.append(False, known[:-1]))
        begins = np.concatenate([[0], ends + 1])
        doc = np.searchsorted(begins, kept, "right") - 1
        self.symbols += [np.maximum(ids[kept], 0), np.zeros(1, np.int32)]
        self.doc += [(doc + len(self.n_words)).astype(np.int32), np.full(1, -1, np.int32)]
        self.at += [kept - begins[doc], np.zeros(1, np.int64)]
        self.n_words += n.tolist()
        self.size += len(kept) + 1

    def spans(self) -> tuple[list[list[dict]], list[list[str]]]:
        """For each document its merged spans of hit words, and the items found in it."""
        spans: list[list[dict]] = [[] for _ in self.n_words]
        items: list[list[str]] = [[] for _ in self.n_words]
        if self.size and self.windows.items:
            s, docs, place = np.concatenate(self.symbols), np.concatenate(self.doc), np.concatenate(self.at)
            who, at = self.windows.occurrences(s)
            cover = np.zeros(len(s) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.windows.length[who], -1)
            inside = np.cumsum(cover[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                spans[docs[a]].append({"start": int(place[a]), "end": int(place[b - 1]) + 1})
            names: dict[int, set[str]] = {}
            for doc, w in np.unique(np.stack([docs[at], who], 1), axis=0).tolist():
                names.setdefault(doc, set()).update(self.windows.items[w])
            for doc, found in names.items():
                items[doc] = sorted(found)
        return spans, items


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)
ITEMS = T.ArrayType(T.StringType(), False)


def _search(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, keep: list[str]) -> DataFrame:
    """``keep`` columns of each row, and n_words, spans and items of one block of benchmark items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])
    span = pa.list_(pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, window)
        shard, held = _Shard(windows), []

        def flush() -> pa.RecordBatch:
            spans, items = shard.spans()
            kept = pa.Table.from_batches(held).combine_chunks()
            out = [kept.column(c).combine_chunks() for c in keep]
            out = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out]
            out += [pa.array(shard.n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]
            shard.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(out, [*keep, "n_words", "spans", "items"])

        for batch, texts in slices(batches, "__text", 1 << 20, 500):
            shard.add(texts)
            held.append(batch.select(keep))
            if shard.size >= SHARD_WORDS or len(shard.n_words) >= 20_000:
                yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(tidy(rows), schema)


def merge_spans(spans: Column) -> Column:
    """Spans of several blocks, in order and without overlaps."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def put(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), put)


def _blocks(benchmark: DataFrame, id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Benchmark items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).filter("t is not null").toLocalIterator():
        block.append((row["i"], bytes(row["t"])))
        size += len(row["t"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, keep: tuple[str, ...], window: int, block_bytes: int) -> DataFrame:
    """find_contamination with the kept columns named __k0, __k1 and so on."""
    ship(docs.sparkSession)
    columns = [f"__k{n}" for n in range(len(keep))]
    base = docs.select(*(column(c).alias(k) for c, k in zip(keep, columns, strict=True)), column(text).alias("__text"))
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = _search(base, first, window, columns)
    else:
        key = ["__h1", "__h2"]
        keyed = base.withColumns({"__h1": F.xxhash64("__text"), "__h2": F.xxhash64(F.lit(1), F.col("__text"))})
        union = _search(keyed, first, window, [*columns, *key]).withColumn("__block", F.lit(0))
        for n, block in enumerate(chain([second], blocks), 1):
            union = union.unionByName(_search(keyed, block, window, [*columns, *key]).withColumn("__block", F.lit(n)))
        # Equal rows meet in one group; the first block tells how many of them there are.
        out = (
            union.groupBy(*columns, *key)
            .agg(
                F.max("n_words").alias("n_words"),
                F.flatten(F.collect_set("spans")).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                F.sum((F.col("__block") == 0).cast("int")).alias("__n"),
            )
            .withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__n"))))
            .withColumn("spans", merge_spans(F.col("spans")))
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(*columns, "n_words", "spans", n_hit.alias("n_hit"), "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """The ``keep`` columns of every document row, with n_words, spans (of hit words, from 0, end
    excluded), n_hit and items (sorted ids of the items with occurring windows)."""
    found = _found(docs, benchmark, text, item_id, item_text, keep, window, block_bytes)
    return found.select(*(F.col(f"__k{n}").alias(c) for n, c in enumerate(keep)), "n_words", "spans", "n_hit", "items")


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    found = _found(docs, benchmark, text, item_id, item_text, tuple(docs.columns), window, block_bytes)
    clean = found.filter(~contaminated(F.col("n_words"), F.col("n_hit")))
    return clean.select(*(F.col(f"__k{n}").alias(c) for n, c in enumerate(docs.columns)))
