"""Language identification by unigram pieces with all segmentations summed.

The pieces are those of a fixed public vocabulary. Each language has its own piece probabilities; the
probability of a word is the sum over all its segmentations of the product of piece probabilities (the
forward algorithm), and a text is scored by the words in it. The prediction is the language under
which the text is most probable, ties going to the name that sorts first; its score is the posterior
probability under equal priors.

The probabilities are learned by expectation-maximisation: expected piece counts under the present
probabilities (forward-backward), summed by language, smoothed and normalised. This classifier is fit
on a bounded sample, ``max_train`` labelled documents or all if fewer, chosen by a hash of the id in
equal parts from the languages; those with fewer documents than their part give all. At most
``max_langs`` languages are learned, those with most documents (ties to the name that sorts first). The
sample's words are counted by language with a shuffle that sums before it sends; only piece counts, the
vocabulary's size for each language, reach the driver.

Words are runs of letters, lower-cased, with the vocabulary's word mark before them, of any length.
Longer ones than ``LONG`` letters are learned from in stretches of that length, but scored whole. The
vocabulary is a trie, walked for all places of many words at once; everything that is no letter is
ignored.

Defined results: a null text, and a text without a letter, is ``und`` with score 0, as is any text if
no language could be learned. Rows without an id are never learned from and count as held out. Rows
that repeat are learned from as often as they stand there. An empty table gives an empty table. Extra
columns may have any names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, column, resident, ship, slices, tidy

#: Words of over LONG letters are scored by logs, those of over VERY_LONG one at a time.
MARK, LONG, VERY_LONG = "▁", 32, 1_000
LETTERS = re.compile(r"[^\W\d_]+")
#: The probability of a character that is no piece, and the count that is added to every piece.
UNKNOWN, SMOOTH = 1e-7, 0.05
#: Forward sums hold this factor for each character, so that those of LONG letters stay in range.
SCALE = 1e6
#: Distinct words that a worker keeps the scores of.
MAX_WORDS = 150_000


def read_pieces(model_path: str) -> list[str]:
    """The text pieces of a sentencepiece vocabulary, in the order of its ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = sp.get_piece_size()
    return [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(True))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; none if no character is a letter."""
    words = LETTERS.findall(text.lower())
    if words and not (words[0].isalpha() or any(c.isalpha() for w in words for c in w)):
        return []
    return words


class Pieces:
    """The vocabulary as a trie, walked for many places of many words at once. A node stands for a prefix of
    pieces; node 0 is the root. The steps (node, character) stand in a hash table with open addressing."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        node: dict[str, int] = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        #: Of each node the number of the piece that ends there, or -1.
        self.piece = np.full(len(node), -1, np.int32)
        self.piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        key = np.array([node[p[:-1]] << 21 | ord(p[-1]) for p in node if p], np.uint64)
        to = np.arange(1, len(node), dtype=np.int32)
        self.bits = max(8, int(4 * len(node)).bit_length())
        self.key, self.to = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, np.int32)
        at, left = self._place(key), np.arange(len(key))
        while len(left):  # one more probe for all that found their place taken
            free = left[self.key[at[left]] == ~np.uint64(0)]
            self.key[at[free]] = key[free]  # of several that want one place the last stays
            own = left[self.key[at[left]] == key[left]]
            self.to[at[own]] = to[own]
            left = left[self.key[at[left]] != key[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The nodes after a character, 0 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | character.astype(np.uint64)
        at, out = self._place(key), np.zeros(len(key), np.int32)
        found = self.key[at]
        hit = found == key
        out[hit] = self.to[at[hit]]
        open_ = np.flatnonzero(~hit & (found != ~np.uint64(0)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found != ~np.uint64(0))]
        return out


class Lattice:
    """The segmentations of many words at once: edges (word, from, to, piece), ordered by their end."""

    def __init__(self, words: list[str], pieces: Pieces) -> None:
        text = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32) if words else np.empty(0, np.uint32)
        self.size = np.fromiter(map(len, words), np.int32, len(words)) + 1
        begins = np.cumsum(self.size, dtype=np.int64) - self.size
        word = np.repeat(np.arange(len(words), dtype=np.int32), self.size)
        start = (np.arange(len(text)) - begins[word]).astype(np.int32)
        room = self.size[word] - start
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        at, node = np.arange(len(text)), np.zeros(len(text), np.int32)
        for k in range(pieces.longest):
            node = pieces.step(node, text[at + k])
            alive = node > 0
            piece = pieces.piece[node]
            ends = piece >= 0
            if k == 0:  # a character that is no piece is an edge of its own
                found.append((at, 1, np.where(alive & ends, piece, -1)))
            else:
                found.append((at[ends & alive], k + 1, piece[ends & alive]))
            alive &= room[at] > k + 1
            at, node = at[alive], node[alive]
            if not len(at):
                break
        place = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        length = np.repeat(np.array([f[1] for f in found], np.int32), [len(f[0]) for f in found])
        end = start[place] + length
        order = np.argsort(end, kind="stable")
        place = place[order]
        self.word, self.start, self.end = word[place], start[place], end[order]
        self.piece = np.concatenate([f[2] for f in found])[order] if found else np.empty(0, np.int32)

    def _steps(self, key: np.ndarray) -> Iterator[slice]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if a < b:
                yield slice(a, b)

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """probability: a row for each piece and one for unknown ones, a column for each language.
        The summed probability of each word's prefixes, times SCALE for each character: word, length, language."""
        top = int(self.size.max(initial=0)) + 1
        alpha = np.zeros((len(self.size), top, probability.shape[1]))
        alpha[:, 0] = 1
        weight = probability[self.piece] * (SCALE ** (self.end - self.start))[:, None]
        for at in self._steps(self.end):
            np.add.at(alpha, (self.word[at], int(self.end[at.start])), alpha[self.word[at], self.start[at]] * weight[at])
        return alpha

    def score(self, probability: np.ndarray) -> np.ndarray:
        """The log probability of each word in each language."""
        return np.log(self.forward(probability)[np.arange(len(self.size)), self.size]) - (self.size * np.log(SCALE))[:, None]

    def score_by_logs(self, probability: np.ndarray) -> np.ndarray:
        """The same for words of any length, with the logs of the forward sums."""
        n, top = len(self.size), int(self.size.max(initial=0)) + 1
        alpha, logs = np.full((n, top, probability.shape[1]), -np.inf), np.log(probability)
        alpha[:, 0] = 0
        for at in self._steps(self.end):
            word = self.word[at]
            each = alpha[word, self.start[at]] + logs[self.piece[at]]
            most, total = np.full((n, probability.shape[1]), -np.inf), np.zeros((n, probability.shape[1]))
            np.maximum.at(most, word, each)
            np.add.at(total, word, np.exp(each - most[word]))
            word = np.unique(word)
            alpha[word, int(self.end[at.start])] = most[word] + np.log(total[word])
        return alpha[np.arange(n), self.size]

    def expect(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts for one language, words weighted."""
        alpha = self.forward(probability)[:, :, 0]
        each = probability[self.piece, 0] * SCALE ** (self.end - self.start)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(self.size)), self.size] = 1
        back = np.argsort(-self.start, kind="stable")
        for at in self._steps(self.start[back]):
            e = back[at]
            np.add.at(beta, (self.word[e], int(self.start[e[0]])), beta[self.word[e], self.end[e]] * each[e])
        total = alpha[np.arange(len(self.size)), self.size]
        share = alpha[self.word, self.start] * each * beta[self.word, self.end] * (weight / total)[self.word]
        return np.bincount(self.piece[self.piece >= 0], share[self.piece >= 0], len(probability) - 1)


def long_score(word: str, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """The log probability in each language of a word of any length, scaled anew at every character, so that
    only the last ``longest`` forward sums are held. The word is read in blocks of characters."""
    text, held = MARK + word, deque([np.ones(probability.shape[1])], pieces.longest)
    total, block = np.zeros(probability.shape[1]), 1 << 16
    for a in range(0, len(text), block):
        before = min(a, pieces.longest - 1)
        here = np.frombuffer(text[a - before : a + block].encode("utf-32-le"), np.uint32)
        # Of each place the pieces that begin there, by length.
        at, node, ends = np.arange(len(here)), np.zeros(len(here), np.int32), []
        for k in range(pieces.longest):
            node = pieces.step(node, here[at + k])
            piece = pieces.piece[node]
            by_end = np.full(len(here), -2, np.int32)
            by_end[at + k] = np.where((piece >= 0) & (node > 0), piece, -1 if k == 0 else -2)
            ends.append(by_end)
            alive = (node > 0) & (at + k + 1 < len(here))
            at, node = at[alive], node[alive]
        by_end = np.stack(ends, 1)
        for j in range(before, len(here)):
            own = np.zeros(probability.shape[1])
            for k in np.flatnonzero(by_end[j] > -2).tolist():
                if k < len(held):
                    own += held[-1 - k] * probability[by_end[j, k]]
            total += np.log(own)
            for k in range(len(held)):
                held[k] = held[k] / own
            held.append(np.ones_like(own))
    return total


def _stretches(words: list[str]) -> list[str]:
    """Long words in parts of at most LONG letters."""
    if any(map(LONG.__lt__, map(len, words))):
        words = [w[k : k + LONG] for w in words for k in range(0, len(w), LONG)]
    return words


def _count_words(train: DataFrame) -> DataFrame:
    """lang, word, n over a table (lang, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found: dict[str, Counter] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), texts, strict=True):
                found.setdefault(lang, Counter()).update(_stretches(words_of(raw.decode("utf-8", "replace"))))
            for lang, count in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])

    return train.mapInArrow(tidy(rows), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fair_quota(sizes: list[int], total: int) -> int:
    """The most rows that each language may give so that all together give about ``total``; small ones give all."""
    sizes = sorted(sizes)
    for k, n in enumerate(sizes):
        each = total // (len(sizes) - k)
        if n > each:
            return max(1, each)
        total -= n
    return sizes[-1] if sizes else 0


def learn(docs: DataFrame, pieces: list[str], id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = 40_000, rounds: int = 2, max_langs: int = 256) -> dict[str, np.ndarray]:
    """The piece probabilities of each language, learned from documents that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    train = docs.select(column(id).alias("id"), column(lang).cast("string").alias("lang"), column(text).alias("text")).filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    each = fair_quota(list(sizes.values()), max_train) if sum(sizes.values()) > max_train else max_train
    below = spark.createDataFrame([(x, int((1 << 40) * min(1, each / n))) for x, n in sizes.items()], "of string, below long")
    train = train.join(F.broadcast(below), F.col("lang") == F.col("of")).filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) < F.col("below"))
    scratch = Scratch(spark, "language")
    # Dealt evenly, so that as many tasks as there are can learn.
    counts = scratch.keep(_count_words(train.select("lang", "text")).repartition(spark.sparkContext.defaultParallelism))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    model = {x: np.full(len(pieces), 1 / len(pieces)) for x in langs}
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((pieces, model))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, model = shared.value  # noqa: B023
            known, total = Pieces(pieces), {}
            for batch in (b.slice(k, 20_000) for b in batches for k in range(0, b.num_rows, 20_000)):
                of, words, n = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for x in set(of.tolist()):
                    at = np.flatnonzero(of == x)
                    got = Lattice([words[k] for k in at], known).expect(np.append(model[x], UNKNOWN)[:, None], n[at])
                    total[x] = total.get(x, 0) + got
            for x, got in total.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.float64())], ["lang", "piece", "n"])

        found = counts.mapInArrow(tidy(expect), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        shared.unpersist()
        model = {}
        for x in langs:
            own = found[found["lang"] == x]
            p = np.full(len(pieces), SMOOTH)
            p[own["piece"].to_numpy()] += own["n"].to_numpy()
            model[x] = p / p.sum()
    scratch.drop(counts)
    return model


class Scorer:
    """Scores texts; keeps the scores of words already met."""

    def __init__(self, pieces: list[str], model: dict[str, np.ndarray]) -> None:
        self.pieces = Pieces(pieces)
        self.langs = sorted(model)
        self.probability = np.stack([np.append(model[x], UNKNOWN) for x in self.langs] or [np.empty(0)], 1)
        self.row: dict[str, int] = {}
        self.score = np.zeros((0, len(self.langs)))

    def words(self, words: list[str]) -> np.ndarray:
        """The log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for at in np.split(order := np.flatnonzero(size <= LONG), range(10_000, len(order), 10_000)):
            if len(at):
                out[at] = Lattice([words[k] for k in at], self.pieces).score(self.probability)
        for at in np.split(order := np.flatnonzero((size > LONG) & (size <= VERY_LONG)), range(200, len(order), 200)):
            if len(at):
                out[at] = Lattice([words[k] for k in at], self.pieces).score_by_logs(self.probability)
        for k in np.flatnonzero(size > VERY_LONG).tolist():
            out[k] = long_score(words[k], self.pieces, self.probability)
        return out

    def texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.row) > MAX_WORDS:
            self.row, self.score = {}, self.score[:0]
        split = [words_of(t) for t in texts]
        row, met = self.row, set().union(*split)
        if new := [w for w in met if w not in row]:
            row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
            self.score = np.concatenate([self.score, self.words(new)])
        size = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(row.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        langs, scores, at = [], [], 0
        for n in size.tolist():
            if not n:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.score[flat[at : at + n]].sum(0)
            at += n
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        for w in [w for w in new if len(w) > VERY_LONG]:  # not kept, whole texts may be one word
            del row[w]
        return langs, scores


def identify(docs: DataFrame, pieces: list[str], model: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row, as __k0, __k1 and so on, with lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    shared, key = spark.sparkContext.broadcast((pieces, model)), ("language", uuid.uuid4().hex)
    columns = [f"__k{n}" for n in range(len(keep))]
    base = docs.select(*(column(c).alias(k) for c, k in zip(keep, columns, strict=True)), column(text).alias("__text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = resident(key, lambda: Scorer(*shared.value))
        for batch, texts in slices(batches, "__text", 1 << 20):
            langs, scores = scorer.texts([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    schema = T.StructType([*(base.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(tidy(rows, keep=True), schema)


def predict_languages(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = 40_000) -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    pieces = read_pieces(model_path)
    model = learn(docs, pieces, id, text, lang, max_train)
    out = identify(docs, pieces, model, text, (id,))
    return out.select(F.col("__k0").alias(id), held_out(F.col("__k0")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = 40_000) -> DataFrame:
    """The rows whose text has a language, with all their columns; those that are ``und`` go. Rows without a
    language get the predicted one."""
    pieces = read_pieces(model_path)
    model = learn(docs, pieces, id, text, lang, max_train)
    out = identify(docs, pieces, model, text, tuple(docs.columns)).filter(F.col("lang_pred") != "und")
    filled = F.coalesce(F.col(f"__k{docs.columns.index(lang)}"), F.col("lang_pred"))
    return out.select(*((filled if c == lang else F.col(f"__k{n}")).alias(c) for n, c in enumerate(docs.columns)))
