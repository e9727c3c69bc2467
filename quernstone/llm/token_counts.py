"""Token counts under a unigram model, by dynamic programming on a trie of pre-tokens.

The pieces are those of a public vocabulary of byte strings by rank; the probability of a piece is
taken from its rank by the Zipf-Mandelbrot rule, 1 / (rank + 2.7), normalised. Distinct pre-tokens are
inserted in a trie of their bytes. A node stands for a prefix and holds its forward score (the log of
the summed probability of all its segmentations), and cost and length of its best segmentation;
these are computed once, from the nodes above, however many pre-tokens share the prefix. The nodes at
which pre-tokens end give their counts. Costs are whole numbers (65536 to a nat, rounded), so equal
costs are exact ties; the segmentation with fewer pieces then wins.

A worker keeps one trie for the pre-tokens of all its tasks; at ``MAX_NODES`` it starts a new one, which
changes no result. Long texts are read a chunk of pre-tokens at a time. A pre-token of over ``LONG_WORD``
bytes gets no nodes: the same recurrence runs over it with the last sums only, so memory does not grow
with it.

Defined results: a null or empty text has no pre-tokens, no tokens and a score of 0. Bytes that aren't
UTF-8 are read as U+FFFD. A byte that is no piece costs as much as the last rank twice over. Rows
stand for themselves, also where ids are null or repeat; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CHUNK, LONG, read_ranks
from .common import resident, ship, slices, small_file, tidy

#: Nodes that a trie may have before a new one is begun.
MAX_NODES = 1_000_000
#: Bytes of a pre-token that is still inserted.
LONG_WORD = 4_096
UNIT = 65536


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """The log probability of each piece."""
    total = math.log(sum(1 / (r + 2.7) for r in ranks.values()))
    return {b: -math.log(r + 2.7) - total for b, r in ranks.items()}


class Trie(dict):
    """Maps a pre-token to (tokens, score); pre-tokens not yet known are inserted."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pieces = {b: (s, round(-s * UNIT)) for b, s in piece_scores(ranks).items()}
        self.longest = max(map(len, ranks))
        low = 2 * min(s for s, _ in self.pieces.values())
        for c in range(256):
            self.pieces.setdefault(bytes((c,)), (low, round(-low * UNIT)))
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.score, self.cost, self.count = [0.0], [0], [0]

    def _node(self, path: list[int], prefix: bytes) -> int:
        """A new node for a prefix; path has the nodes of the shorter prefixes."""
        get, score, cost, count = self.pieces.get, self.score, self.cost, self.count
        n, terms, best = len(prefix), [], None
        for k in range(max(0, n - self.longest), n):
            if (piece := get(prefix[k:])) is not None:
                node = path[k]
                terms.append(score[node] + piece[0])
                way = (cost[node] + piece[1], count[node] + 1)
                if best is None or way < best:
                    best = way
        top = max(terms)
        score.append(top + math.log(sum(math.exp(x - top) for x in terms)) if len(terms) > 1 else top)
        cost.append(best[0])
        count.append(best[1])
        return len(score) - 1

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self.score) > MAX_NODES:
            self.begin()
        piece, node, path = word.encode(), 0, [0]
        if len(piece) > LONG_WORD:
            return self._along(piece)
        for k, byte in enumerate(piece):
            step = node << 8 | byte
            if (node := self.child.get(step, 0)) == 0:
                node = self.child[step] = self._node(path, piece[: k + 1])
            path.append(node)
        found = self[word] = (self.count[node], self.score[node])
        return found

    def _along(self, word: bytes) -> tuple[int, float]:
        """(tokens, score) of a very long pre-token: (score, cost, count) of its last ``longest`` prefixes."""
        get, held = self.pieces.get, deque([(0.0, 0, 0)], self.longest)
        for n in range(1, len(word) + 1):
            terms, best = [], None
            for back, (score, cost, count) in enumerate(reversed(held), 1):
                if (piece := get(word[n - back : n])) is not None:
                    terms.append(score + piece[0])
                    way = (cost + piece[1], count + 1)
                    if best is None or way < best:
                        best = way
            top = max(terms)
            held.append((top + math.log(sum(math.exp(x - top) for x in terms)) if len(terms) > 1 else top, *best))
        return held[-1][2], held[-1][0]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of each row, n_pretokens, n_tokens (of the best segmentation of each pre-token) and score,
    the log probability of the text summed over all segmentations of its pre-tokens."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(small_file(ranks_path))
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    key = ("trie", hashlib.sha256(small_file(ranks_path)).hexdigest())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        trie, split = resident(key, lambda: Trie(read_ranks(shared.value))), regex.compile(pattern)
        gc.disable()  # a trie holds no cycles
        get = trie.__getitem__
        for batch, texts in slices(batches, "text", 1 << 20):
            out: tuple[list, ...] = ([], [], [])
            for raw in texts:
                whole, words, tokens, score = raw.decode("utf-8", "replace"), 0, 0, 0.0
                found = iter((split.findall(whole),)) if len(whole) <= LONG else _parts(split, whole)
                for part in found:
                    if part:
                        counts, scores = zip(*map(get, part), strict=True)
                        words, tokens, score = words + len(part), tokens + sum(counts), score + sum(scores)
                for column, value in zip(out, (words, tokens, score), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["id", "n_pretokens", "n_tokens", "score"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(rows, keep=True), schema).withColumnRenamed("id", id)


def _parts(split: object, text: str) -> Iterator[list[str]]:
    found = (x.group() for x in split.finditer(text))
    while part := list(islice(found, CHUNK)):
        yield part
