"""Removal of repeated byte strings by hash-compared suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a document of smaller
id, or earlier in the same one) is removed; matches do not cross documents, overlaps count, and strings
are judged on the input.

Equal strings must meet in one task without shuffling every suffix of the corpus. The key of a string
is the least hash among its ``GRAM``-byte parts, so equal strings have equal keys; consecutive strings
whose key comes from the same place form a segment, which a key, a hash of its bytes and its place
describe. Segments are dealt by key. Of segments with equal bytes all but the earliest repeat as a whole;
those met in one task are put together before the shuffle, so a passage that a third of all documents
share sends a row for each batch of segments, not for each document. Only where a key has segments of
different bytes (where a passage begins or ends) are bytes needed: the suffixes of these segments are
sorted. The sort is a merge sort; it compares two suffixes by their longest common prefix, found by
binary search on prefix polynomial hashes. Neighbours that agree over ``length`` bytes repeat; each such
pair is verified byte by byte, and a block of suffixes in which hashes collided is sorted again by its
bytes.

A key with very many such segments is split by the place of its part in the string, which is the same in
equal strings: a segment is cut where that place passes from one part of the key to the next, so all
parts together get each string once and, beyond one place for a part, each string goes by a hash of its
bytes. The descriptions of one key's different segments, 44 bytes each, are held by one task.

Whole segments are equal by a 64-bit hash of their bytes under a common key, whole texts in one task by
128 bits; bytes are compared for the sorted suffixes only.

The spans found are gathered by document and cut out. Tables and shuffles hold descriptions of
segments, bytes of the ambiguous ones, and the texts twice; the driver gets row counts only.

Defined results: a null text has no bytes. Texts shorter than ``length`` lose nothing. Rows equal in id
and text are one document and lose the same; rows of one id with different texts are taken in the
order of a hash of the text, and so are rows without id, which come after all others. Very long texts
are hashed in overlapping pieces. An empty table gives an empty table. What is left may cut a character
in two, so it is returned as bytes. Extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, mix, ship, slices, tidy
from .rolling import CHUNK, prefix_hashes, ranges

GRAM = 24
#: Segments that one task handles, and suffixes that a part of a key sorts.
TASK_ROWS, PART_SUFFIXES = 400_000, 200_000
#: The id of rows without one. A document is known by its id and, where that repeats or is missing, a hash of its text.
LAST_ID = (1 << 63) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """text number, start, number of strings, place of the key in the first one, key and byte hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(size) - size
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = mix(ranges(prefix, at, at + GRAM))
    low = np.uint64((1 << max(1, int(len(gram)).bit_length())) - 1)
    place = (_sliding_min((gram & ~low) | at.astype(np.uint64), length - GRAM + 1) & low).astype(np.int64)
    # A string counts if it ends in the text it starts in.
    of = np.repeat(np.arange(len(texts)), size)[: len(place)]
    ok = np.arange(len(place)) + length <= (begins + size)[of]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | ~ok[:-1]
    start = np.flatnonzero(new & ok)
    edges = np.flatnonzero(np.append(new | ~ok, True))
    stop = edges[np.searchsorted(edges, start) + 1]
    n = stop - start
    digest = mix(ranges(prefix, start, stop + length - 1) ^ mix(n.astype(np.uint64)))
    return of[start], start - begins[of[start]], n, place[start] - start, gram[place[start]], digest


#: The columns of a packed description, and of a span.
_KINDS = {"key": np.uint64, "digest": np.uint64, "id": np.int64, "h": np.int64, "pos": np.int64, "n": np.int32, "offset": np.int32}
_SPAN = {"id": np.int64, "h": np.int64, "pos": np.int64, "n": np.int64}
_WHOLE = -1


def _pack(columns: dict[str, np.ndarray], kinds: dict[str, type], at: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    return pack.compress(b"".join(columns[k][at].astype(kind).tobytes() for k, kind in kinds.items()))


def _unpack(raw: list[bytes], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {k: [np.empty(0, kind)] for k, kind in kinds.items()}
    unpack, row = zstandard.ZstdDecompressor(), sum(np.dtype(kind).itemsize for kind in kinds.values())
    for packed in raw:
        data = unpack.decompress(packed)
        n, at = len(data) // row, 0
        for k, kind in kinds.items():
            found[k].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(x) for k, x in found.items()}


def _runs(spans: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans in order, those that follow each other put together."""
    order = np.lexsort((spans["pos"], spans["h"], spans["id"]))
    id, h, pos, n = (spans[k][order] for k in _SPAN)
    new = np.ones(len(id), bool)
    new[1:] = (id[1:] != id[:-1]) | (h[1:] != h[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return {"id": id[at], "h": h[at], "pos": pos[at], "n": np.add.reduceat(n.astype(np.int64), at) if len(at) else n.astype(np.int64)}


def _earliest(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Descriptions sorted by key, digest and place, which are the first of their key and digest, and which
    of the others stand at a place of their own."""
    order = np.lexsort((x["pos"], x["h"], x["id"], x["digest"], x["key"]))
    x = {k: v[order] for k, v in x.items()}
    first = np.ones(len(order), bool)
    first[1:] = (x["key"][1:] != x["key"][:-1]) | (x["digest"][1:] != x["digest"][:-1])
    moved = np.ones(len(order), bool)
    moved[1:] = (x["id"][1:] != x["id"][:-1]) | (x["h"][1:] != x["h"][:-1]) | (x["pos"][1:] != x["pos"][:-1])
    return x, first, ~first & moved


def _deal(length: int, parts: int) -> object:
    """Packed segments by part, the earliest of those equal in the task's batch; the spans of the others, and
    of copies of a text of smaller id met in the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        met: dict[bytes, tuple[int, int]] = {}
        held: dict[str, list[np.ndarray]] = {k: [] for k in _KINDS}
        copies: list[tuple[int, int, int, int]] = []
        size = 0

        def take(which: list[tuple[int, int]], texts: list[bytes], shift: int = 0) -> int:
            of, start, n, offset, key, digest = segments(texts, length)
            names = np.array(which, np.int64).reshape(-1, 2)[of]
            for k, v in {"key": key, "digest": digest, "id": names[:, 0], "h": names[:, 1], "pos": start + shift, "n": n, "offset": offset}.items():
                held[k].append(v)
            return len(key)

        def flush() -> pa.RecordBatch:
            x, first, again = _earliest({k: np.concatenate([np.empty(0, kind), *held[k]]).astype(kind) for k, kind in _KINDS.items()})
            spans = {k: np.concatenate([x[k][again], np.array([c[j] for c in copies], np.int64)]) for j, k in enumerate(_SPAN)}
            out = [(_WHOLE, _pack(runs := _runs(spans), _SPAN, np.arange(len(runs["id"])), pack))] if len(spans["id"]) else []
            to = np.where(first, (mix(x["key"]) % np.uint64(parts)).astype(np.int64), parts)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=False):
                if to[order[a]] < parts:
                    out.append((int(to[order[a]]), _pack(x, _KINDS, order[a:b], pack)))
            for v in held.values():
                v.clear()
            copies.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "packed"])

        for part, texts in slices(batches):
            names, send = list(zip(part.column("id").to_pylist(), part.column("h").to_pylist(), strict=True)), []
            for k, t in enumerate(texts):
                if len(t) < length:
                    continue
                me, digest = names[k], _digest(t)
                if (other := met.get(digest)) is not None and other < me:
                    copies.append((*me, 0, len(t) - length + 1))
                elif other != me:
                    if len(met) > 200_000:
                        met.clear()
                    met[digest] = me
                    send.append(k)
            if len(texts) == 1 and len(texts[0]) > CHUNK:
                for a in range(0, len(texts[0]) - length + 1, CHUNK) if send else ():
                    size += take(names, [texts[0][a : a + CHUNK + length - 1]], a)
                    if size >= 400_000:
                        yield flush()
                        size = 0
            else:
                size += take([names[k] for k in send], [texts[k] for k in send])
            if size >= 400_000 or len(copies) >= 100_000:
                yield flush()
                size = 0
        if size or copies:
            yield flush()

    return rows


def _digest(text: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(text)


_FOUND = "id long, h long, pos long, n long, key long, of int, more int"


def _found(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    none = {"key": pa.int64(), "of": pa.int32(), "more": pa.int32()}
    columns = [pa.array(x[k], pa.int64()) for k in _SPAN]
    columns += [pa.array(x[k].view(np.int64) if k == "key" else x[k], kind) if k in x else pa.nulls(len(x["id"]), kind) for k, kind in none.items()]
    return pa.RecordBatch.from_arrays(columns, [*_SPAN, *none])


def _match(length: int) -> object:
    width = length - GRAM + 1  # the places that a string's key may have in it

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments that repeat as a whole (key null), and those whose suffixes must be sorted."""
        by_part: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part == _WHOLE:
                    yield _found(_unpack([packed], _SPAN))
                else:
                    by_part.setdefault(part, []).append(packed)
        for part in list(by_part):
            x = _unpack(by_part.pop(part), _KINDS)
            order = np.argsort(x["key"], kind="stable")
            same = x["key"][order][1:] == x["key"][order][:-1]
            order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
            if not len(order):
                continue
            x, first, again = _earliest({k: v[order] for k, v in x.items()})
            yield _found(_runs({k: x[k][again] for k in _SPAN}))
            group = np.cumsum(np.append(True, x["key"][1:] != x["key"][:-1])) - 1
            unclear = first & (np.bincount(group, first)[group] > 1)
            suffixes = np.bincount(group, np.where(unclear, x["n"], 0))[group[unclear]].astype(np.int64)
            x = {k: v[unclear] for k, v in x.items()}
            parts = np.clip(-(-suffixes // PART_SUFFIXES), 1, width)
            x |= {"parts": parts, "more": np.where(parts == width, np.maximum(1, -(-suffixes // (width * PART_SUFFIXES))), 1)}
            one = parts == 1
            yield _found({k: x[k][one] for k in (*_SPAN, "key")} | {"of": np.zeros(one.sum(), np.int32), "more": np.ones(one.sum(), np.int32)})
            many = np.flatnonzero(~one)
            for at in np.array_split(many, max(1, int(x["n"][many].sum()) // 1_000_000)) if len(many) else ():
                yield _found(_split({k: v[at] for k, v in x.items()}, width))

    return rows


def _split(x: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Segments cut where the place of the key in the string passes to another part."""
    n = x["n"].astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    of = (x["offset"][row] - step) * x["parts"][row] // width
    at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])))
    row_at = row[at]
    out = {k: x[k][row_at] for k in ("id", "h", "key", "more")}
    return out | {"pos": x["pos"][row_at] + step[at], "n": np.diff(np.append(at, len(row))), "of": of[at]}


def _order(data: np.ndarray, prefix: np.ndarray, group: np.ndarray, at: np.ndarray, length: int, lane: int = 32) -> np.ndarray:
    """The order of suffixes by group, first ``length`` bytes, and number: a merge sort that compares by hashes.

    All runs of one level are merged together; each merge is cut in lanes of ``lane`` outputs, whose
    beginnings in both runs are found by binary search.
    """
    n = len(at)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | padded[at + k].astype(np.uint64)

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        gx, gy, hx, hy = group[x], group[y], head[x], head[y]
        out = (gx < gy) | ((gx == gy) & (hx < hy))
        tied = np.flatnonzero((gx == gy) & (hx == hy))
        if len(tied):
            x, y = x[tied], y[tied]
            a, b = at[x], at[y]
            lo, hi = np.full(len(a), 8, np.int64), np.full(len(a), length, np.int64)
            whole = ranges(prefix, a, a + length) == ranges(prefix, b, b + length)
            lo[whole] = length
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_] + 1) >> 1
                p, q = a[open_], b[open_]
                equal = ranges(prefix, p, p + mid) == ranges(prefix, q, q + mid)
                lo[open_] = np.where(equal, mid, lo[open_])
                hi[open_] = np.where(equal, hi[open_], mid - 1)
                open_ = open_[lo[open_] < hi[open_]]
            end = np.minimum(lo, length - 1)
            out[tied] = np.where(lo >= length, x < y, data[a + end] < data[b + end])
        return out

    order, run = np.arange(n), 1
    while run < n:
        out = np.empty_like(order)
        step = min(lane, 2 * run)
        first = np.arange(0, n, step)  # of each lane's outputs
        base = first // (2 * run) * (2 * run)
        mid_, end = np.minimum(base + run, n), np.minimum(base + 2 * run, n)
        diagonal, na, nb = first - base, mid_ - base, end - mid_
        lo, hi = np.maximum(0, diagonal - nb), np.minimum(diagonal, na)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            m = (lo[open_] + hi[open_]) >> 1
            left = less(order[base[open_] + m], order[mid_[open_] + diagonal[open_] - 1 - m])
            lo[open_] = np.where(left, m + 1, lo[open_])
            hi[open_] = np.where(left, hi[open_], m)
            open_ = open_[lo[open_] < hi[open_]]
        x, y, o = base + lo, mid_ + diagonal - lo, first.copy()
        last = np.minimum(first + step, end)
        live = np.arange(len(first))
        while len(live):
            i, j = x[live], y[live]
            take = j >= end[live]
            ask = np.flatnonzero(~take & (i < mid_[live]))
            take[ask] = less(order[i[ask]], order[j[ask]])
            out[o[live]] = order[np.where(take, i, j)]
            x[live] += take
            y[live] += ~take
            o[live] += 1
            live = live[o[live] < last[live]]
        order, run = out, 2 * run
    return order


def repeated_suffixes(data: np.ndarray, group: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes agree over ``length`` bytes with one of their group that has a smaller number."""
    prefix = prefix_hashes(data)
    order = _order(data, prefix, group, at, length)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (ranges(prefix, at[a], at[a] + length) == ranges(prefix, at[b], at[b] + length)))
    span = np.arange(length)
    for k in range(0, len(near), 50_000):
        z = near[k : k + 50_000]
        if (data[at[a[z]][:, None] + span] != data[at[b[z]][:, None] + span]).any():  # hashes collided
            rows = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), data[at[:, None] + span]], 1)
            order = np.lexsort((np.arange(len(at)), *rows.T[::-1]))
            a, b = order[:-1], order[1:]
            near = np.flatnonzero((rows[a] == rows[b]).all(1))
            break
    out = np.zeros(len(at), bool)
    out[b[near]] = True
    return out


def _cut(length: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of ambiguous segments, and the part of their key that they go to."""
        import xxhash

        for batch, texts in slices(batches):
            want = batch.column("want")
            row, flat = pc.list_parent_indices(want), pc.list_flatten(want)
            pos, n, key, of, more = (flat.field(k).to_pylist() for k in ("pos", "n", "key", "of", "more"))
            bytes_ = [texts[r][a : a + m + length - 1] for r, a, m in zip(row.to_pylist(), pos, n, strict=True)]
            of = [a * m + (xxhash.xxh3_64_intdigest(b) % m if m > 1 else 0) for a, m, b in zip(of, more, bytes_, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(of, pa.int64()), batch.column("id").take(row), batch.column("h").take(row), pa.array(pos, pa.int64()), pa.array(bytes_, pa.binary())],
                ["key", "of", "id", "h", "pos", "bytes"],
            )

    return rows


def _sort(length: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The spans that repeat, a row for each segment; rows come sorted by key and part, and are sorted in
        blocks of whole groups."""
        held: list[tuple] = []
        size, before, places = 0, None, set()

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda r: r[:5])
            data = np.frombuffer(b"".join(r[5] for r in held), np.uint8)
            bytes_ = np.array([len(r[5]) for r in held], np.int64)
            n = bytes_ - length + 1
            row = np.repeat(np.arange(len(held)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(bytes_) - bytes_)[row] + offset
            new = [k > 0 and held[k][:2] != held[k - 1][:2] for k in range(len(held))]
            again = repeated_suffixes(data, np.cumsum(new)[row], at, length)
            row, offset = row[again], offset[again]
            new = np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)) if len(row) else np.empty(0, bool)
            cuts = np.flatnonzero(new)
            count = np.diff(np.append(cuts, len(row)))
            own = row[cuts]
            id, h, pos = (np.array([r[k] for r in held], np.int64)[own] for k in (2, 3, 4))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(id), pa.array(h), pa.array(pos + offset[cuts]), pa.array(count.astype(np.int64))], list(_SPAN))

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "of", "id", "h", "pos", "bytes")), strict=True):
                if r[:2] != before:
                    if size >= PART_SUFFIXES:
                        yield flush()
                        size = 0
                    before = r[:2]
                    places.clear()
                if r[2:5] in places:  # a row that repeats is one document
                    continue
                places.add(r[2:5])
                held.append(r)
                size += len(r[5]) - length + 1
        if held:
            yield flush()

    return rows


def _remove(length: int) -> object:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: tuple[list, ...] = ([], [], [], [])
            spans = batch.column("spans").fill_null(pa.scalar([], batch.schema.field("spans").type))
            size, flat = pc.list_value_length(spans).to_pylist(), pc.list_flatten(spans)
            starts, counts, at = flat.field("pos").to_pylist(), flat.field("n").to_pylist(), 0
            for text, m in zip(texts, size, strict=True):
                kept, removed, runs, end = [], 0, 0, 0
                for pos, n in sorted(zip(starts[at : at + m], counts[at : at + m], strict=True)):
                    stop = pos + n + length - 1
                    if pos > end or not runs:
                        kept.append(text[end:pos])
                        runs += 1
                        removed += stop - pos
                        end = stop
                    elif stop > end:
                        removed += stop - end
                        end = stop
                at += m
                kept.append(text[end:])
                for column, value in zip(out, (b"".join(kept), len(text), removed, runs), strict=True):
                    column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["row_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """id, kept (bytes), n_bytes, n_removed and n_spans (maximal removed runs) of every row."""
    if not GRAM <= length < 1 << 15:
        raise ValueError(f"strings of {GRAM} to {(1 << 15) - 1} bytes are supported")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    docs = docs.select(column(id).cast("long").alias("row_id"), column(text).alias("text"))
    docs = docs.withColumn("id", F.coalesce("row_id", F.lit(LAST_ID)))
    digest = F.xxhash64("text").bitwiseAND(F.lit(LAST_ID)).bitwiseOR(F.lit(1).cast("long"))
    twice = docs.filter("row_id is not null").groupBy("id").count().filter("count > 1").select(F.col("id").alias("twice"))
    if twice.limit(1).count():
        docs = docs.join(scratch.keep(twice), F.col("id") == F.col("twice"), "left")
        docs = docs.withColumn("h", F.when(F.col("row_id").isNull() | F.col("twice").isNotNull(), digest).otherwise(F.lit(0).cast("long"))).drop("twice")
    else:
        docs = docs.withColumn("h", F.when(F.col("row_id").isNull(), digest).otherwise(F.lit(0).cast("long")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-int(size) // (40 * TASK_ROWS)))

    dealt = docs.select("id", "h", "text").mapInArrow(tidy(_deal(length, parts)), "part int, packed binary")
    where = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("packed"), F.lit(parts)).cast("int"))
    found = scratch.keep(dealt.repartition(parts, where).mapInArrow(tidy(_match(length)), _FOUND))
    unclear = found.filter("key is not null")
    want = unclear.groupBy(F.col("id").alias("w"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("pos", "n", "key", "of", "more")).alias("want"))
    cut = docs.join(want, (F.col("id") == F.col("w")) & (F.col("h") == F.col("wh"))).select("id", "h", "text", "want")
    cut = cut.mapInArrow(tidy(_cut(length)), "key long, of long, id long, h long, pos long, bytes binary")
    spans = cut.repartition("key", "of").sortWithinPartitions("key", "of").mapInArrow(tidy(_sort(length)), "id long, h long, pos long, n long")
    every = found.filter("key is null").select(*_SPAN).union(spans)
    both = scratch.keep(every.groupBy(F.col("id").alias("s"), F.col("h").alias("sh")).agg(F.collect_list(F.struct("pos", "n")).alias("spans")))
    out = docs.join(both, (F.col("id") == F.col("s")) & (F.col("h") == F.col("sh")), "left").select("row_id", "text", "spans")
    return out.mapInArrow(tidy(_remove(length)), "row_id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("row_id", id)
