"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding by ranks (always merge the adjacent pair of lowest rank, the leftmost first) has a property
that a left-to-right machine can use: the encoding of any prefix is decided by its last token, and
two tokens may stand side by side exactly if encoding their bytes together gives these two again. The
compiler asks the merges only for such pairs of tokens. The machine's state holds the longest suffix
read that can still grow into a token, and the last tokens of the prefixes that are still open. A
byte leads to the next state; as soon as all open prefixes agree on their first tokens, these are
emitted, so the lookahead is bounded by the open part. States and transitions are made when first
met and kept in a table. Once it holds ``MAX_STATES`` states, a piece that leaves the table is read to
its end with its open prefixes in a list, by the same steps and with the same result. A worker keeps one
machine for all its tasks, and the ids of pre-tokens in two generations of bounded size: what is asked
for again moves to the young one, and the old one is dropped when the young one is full.

Decoding joins the bytes of the ids and feeds them to an incremental UTF-8 state machine, so that a
character cut between two chunks is held back until it is whole.

Defined results: a null text counts as empty and has no ids. Bytes that aren't UTF-8 are read as
U+FFFD. Rows that repeat, null ids and an empty table need no special care: each row is encoded by
itself. Texts of any length are read in chunks of pre-tokens, so memory grows with the ids only where
they are asked for.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import resident, ship, slices, small_file, tidy

#: States of the transducer, and pre-tokens in a generation, that a worker keeps at once.
MAX_STATES, MAX_WORDS = 40_000, 200_000
#: Pairs of tokens of which it is kept whether they may stand side by side.
MAX_PAIRS = 400_000
#: Pre-tokens of a long text that are handled at once; texts over LONG characters are read so.
CHUNK, LONG = 200_000, 2_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Merges:
    """The merges as a relation on tokens: which tokens stand alone, and which stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self._own: dict[int, bool] = {}
        # Of a token that merges can make: its first and last parts, from a single byte to itself.
        self._first: dict[int, list[int]] = {}
        self._last: dict[int, list[int]] = {}
        self.rising = True
        # Of a right token the left ones met, and whether the two may stand side by side; -1 is no token.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.size = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes, default=0) + 1)]

    def reduce(self, parts: list[bytes], stop: int = 1) -> list[bytes]:
        """Merges by rank until no adjacent pair is a token, or ``stop`` parts are left."""
        get, none = self.ranks.get, 1 << 60
        while len(parts) > stop:
            best = min((get(a + b, none), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == none:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def own(self, token: int) -> bool:
        """Whether the merges can make this token at all; notes the parts at its edges."""
        if (found := self._own.get(token)) is None:
            b = self.bytes[token]
            halves = self.reduce([b[k : k + 1] for k in range(len(b))], 2)
            found = len(halves) <= 2
            self._own[token] = found
            if found and len(halves) == 2:
                left, right = self.ranks[halves[0]], self.ranks[halves[1]]
                self.own(left), self.own(right)
                self._first[token], self._last[token] = [*self._first[left], token], [*self._last[right], token]
                self.rising &= max(left, right) < token
            elif found:
                self._first[token] = self._last[token] = [token]
        return found

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, give these two again.

        Follows the tokens at the border from single bytes upwards: left's last parts and right's
        first parts grow in the order of ranks, unless a merge across the border comes before.
        """
        fits = self.fits(right)
        if (found := fits.get(left)) is not None:
            return found
        if self.n_pairs > MAX_PAIRS:
            for known in self.pairs.values():
                known.clear()
                known[-1] = True
            self.n_pairs = 0
        if not self.rising:  # ranks that fall towards the root of a merge tree: ask the merges themselves
            both = self.bytes[left] + self.bytes[right]
            found = self.reduce([both[k : k + 1] for k in range(len(both))]) == [self.bytes[left], self.bytes[right]]
        else:
            a, b, get, none = self._last[left], self._first[right], self.ranks.get, 1 << 60
            i = j = 0
            while True:
                grown_a = a[i + 1] if i + 1 < len(a) else none
                grown_b = b[j + 1] if j + 1 < len(b) else none
                across = get(self.bytes[a[i]] + self.bytes[b[j]], none)
                if across < none and across < grown_a and across <= grown_b:
                    found = False
                    break
                if grown_a == none and grown_b == none:
                    found = True
                    break
                if grown_a <= grown_b:
                    i += 1
                else:
                    j += 1
        fits[left] = found
        self.n_pairs += 1
        return found

    def fits(self, right: int) -> dict[int, bool]:
        return self.pairs.setdefault(right, {-1: True})


class Transducer:
    """The machine. A state is (tail, nodes): the open suffix, and for each open prefix, by its distance
    from the place just reached, the last token of its encoding (-1 at the agreed place)."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, tuple[tuple[int, int], ...], int]] = []
        self.number: dict[tuple, int] = {}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        # Open suffixes by number: their bytes, and for a next byte the suffix after it and the tokens that end
        # there, the longest first: (bytes, token, which left neighbours fit).
        self.tails, self.tail_number = [b""], {b"": 0}
        self.grown: list[dict[int, tuple[int, list[tuple[int, int, dict[int, bool]]]]]] = [{}]
        self.ends: list[tuple[int, ...] | None] = []
        self.start = self._state((0, ((0, -1),), -1))

    def _state(self, key: tuple) -> int:
        if (n := self.number.get(key)) is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.ends.append(None)
        return n

    def _grow(self, tail: int, byte: int) -> tuple[int, list[tuple[int, int, dict[int, bool]]]]:
        """The open suffix after one more byte, and the tokens that end there, the longest first."""
        m, grown = self.merges, self.tails[tail] + bytes((byte,))
        while grown not in m.prefixes:
            grown = grown[1:]
        ends = [(len(grown) - k, token, m.fits(token)) for k in range(len(grown)) if (token := m.ranks.get(grown[k:])) is not None and m.own(token)]
        if (n := self.tail_number.get(grown)) is None:
            n = self.tail_number[grown] = len(self.tails)
            self.tails.append(grown)
            self.grown.append({})
        found = self.grown[tail][byte] = (n, ends)
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """key = (tail, nodes, before): before is the token last emitted, the neighbour of the next one."""
        m, (tail, nodes, before) = self.merges, self.states[state]
        tail, ends = self.grown[tail].get(byte) or self._grow(tail, byte)
        last = {d + 1: t for d, t in nodes}
        root, length, size = nodes[-1][0] + 1, len(self.tails[tail]), m.size
        for n, token, fits in ends:
            if n in last:
                left = before if n == root else last[n]
                if (ok := fits.get(left)) or (ok is None and m.adjacent(left, token)):
                    last[0] = token
                    break
        # What is still open: the prefixes that a token ending later can start from, and their paths.
        needed = {root: -1}
        for d in range(min(length, root - 1) + 1):
            while d not in needed:
                token = needed[d] = last[d]
                d += size[token]
        # Emit what all paths share from the root on.
        out: list[int] = []
        while root > length:
            after = [d for d, token in needed.items() if token >= 0 and d + size[token] == root]
            if len(after) != 1:
                break
            del needed[root]
            root = after[0]
            before = needed[root]
            out.append(before)
            needed[root] = -1
        if root > length:
            before = -1  # no token can start there any more
        to = self._state((tail, tuple(sorted(needed.items())), before))
        step = self.steps[state][byte] = (to, tuple(out))
        return step

    def _end(self, state: int) -> tuple[int, ...]:
        _, nodes, _ = self.states[state]
        last, d, out = dict(nodes), 0, []
        while last[d] >= 0:
            out.append(last[d])
            d += len(self.merges.bytes[last[d]])
        found = self.ends[state] = tuple(reversed(out))
        return found

    def run(self, piece: bytes) -> tuple[int, ...]:
        out: list[int] = []
        state, steps, room = self.start, self.steps, len(self.states) < MAX_STATES
        for at, byte in enumerate(piece):
            if (step := steps[state].get(byte)) is None:
                if not room:
                    return (*out, *self._follow(state, piece, at))
                step = self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return (*out, *(self.ends[state] or self._end(state)))

    def _follow(self, state: int, piece: bytes, at: int) -> list[int]:
        """The rest of a piece from a state on, with the open prefixes in a list instead of new states."""
        m, (tail, nodes, before) = self.merges, self.states[state]
        root, grown, size, adjacent = nodes[-1][0], self.grown, m.size, m.adjacent
        last: list[int | None] = [None] * (root + 1)
        last[0] = before
        for d, token in nodes[:-1]:
            last[root - d] = token
        end, add = root, last.append
        for byte in piece[at:]:
            tail, ends = grown[tail].get(byte) or self._grow(tail, byte)
            end += 1
            here = None
            for n, token, fits in ends:
                if n <= end and (left := last[end - n]) is not None:
                    if (ok := fits.get(left)) is None:
                        ok = adjacent(left, token)
                    if ok:
                        here = token
                        break
            add(here)
        out, p = [], end
        while p > 0:
            out.append(last[p])
            p -= size[last[p]]
        return out[::-1]


class Codec:
    """Encodes texts to ids and decodes ids to texts."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        import regex

        ranks = read_ranks(raw)
        self.ranks, self.machine = ranks, Transducer(Merges(ranks))
        self.split = regex.compile(pattern)
        self.token = self.machine.merges.bytes
        self.words = _Words(self)

    def words_of(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text; those of a long one a chunk at a time."""
        if len(text) <= LONG:
            yield self.split.findall(text)
            return
        found = (x.group() for x in self.split.finditer(text))
        while part := list(islice(found, CHUNK)):
            yield part

    def coded(self, text: str) -> Iterator[tuple[list[int], str]]:
        """The ids of each chunk of a text, and the same in decimal, joined by commas."""
        for words in self.words_of(text):
            decimal = ",".join(map(self.words.__getitem__, words))
            yield np.fromstring(decimal, np.int32, sep=",").tolist(), decimal
            self.words.age()

    def chunks(self, text: str) -> Iterator[list[int]]:
        return (ids for ids, _ in self.coded(text))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.chunks(text)))

    def decode(self, chunks: Iterable[list[int]], errors: str = "replace") -> Iterator[str]:
        machine, token = codecs.getincrementaldecoder("utf-8")(errors), self.token.__getitem__
        for ids in chunks:
            yield machine.decode(b"".join(map(token, ids)))
        yield machine.decode(b"", True)


class _Words(dict):
    """Ids of pre-tokens already met, in decimal, joined by commas: the smallest form to keep. A pre-token that is
    itself a token is that token. This is the young generation; pre-tokens that only the old one has come
    back when asked for."""

    def __init__(self, codec: Codec) -> None:
        self.ranks, self.run, self.old = codec.ranks, codec.machine.run, {}

    def age(self) -> None:
        if len(self) > MAX_WORDS:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> str:
        if (found := self.old.get(word)) is None:
            piece = word.encode()
            whole = self.ranks.get(piece)
            ids = (whole,) if whole is not None else self.run(piece)
            found = ",".join([str(i) for i in ids])
        if len(word) < 200:
            self[word] = found
        return found


OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The id of each row and the asked ``outputs``: the ids of its text, the text decoded from these
    ids, their number and digests (of decimal ids joined by commas, and of the decoded bytes)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(small_file(ranks_path))
    columns, schema = tuple(outputs), T.StructType([T.StructField("id", docs.schema[id].dataType), *(T.StructField(c, OUTPUTS[c]) for c in outputs)])

    key = ("bpe", hashlib.sha256(pattern.encode() + small_file(ranks_path)).hexdigest())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = resident(key, lambda: Codec(shared.value, pattern))
        gc.disable()  # its tables hold no cycles
        for part, texts in slices(batches, "text", 1 << 20, 500):
            yield _encoded(codec, part, texts, columns)

    from pyspark.sql import functions as F

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(rows, keep=True), schema).withColumnRenamed("id", id)


def _encoded(codec: Codec, batch: pa.RecordBatch, texts: list[bytes], columns: tuple[str, ...]) -> pa.RecordBatch:
    found: dict[str, list] = {c: [] for c in columns}
    whole, text_too = "ids" in found, "decoded" in found
    for raw in texts:
        n, ids_sha, text_sha, ids, decoded = 0, hashlib.sha256(), hashlib.sha256(), [], []

        def seen(chunks: Iterable[tuple[list[int], str]]) -> Iterator[list[int]]:
            nonlocal n
            for part, decimal in chunks:
                if part:
                    ids_sha.update((("," if n else "") + decimal).encode())  # noqa: B023
                n += len(part)
                if whole:
                    ids.extend(part)  # noqa: B023
                yield part

        for piece in codec.decode(seen(codec.coded(raw.decode("utf-8", "replace")))):
            text_sha.update(piece.encode())
            if text_too:
                decoded.append(piece)
        row = {"ids": ids, "decoded": "".join(decoded), "n_tokens": n, "ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest()}
        for c in columns:
            found[c].append(row[c])
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], kinds.get(c, pa.string())) for c in columns)], ["id", *columns])
