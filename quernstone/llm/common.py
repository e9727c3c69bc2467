"""What the corpus operators share: reading tables, the shared scratch folder, text as UTF-8 bytes.

Bounded lifetime of intermediate results: an operator that needs a result twice, or must cut a long
lineage, writes it with ``Scratch.keep`` as Parquet under the folder in ``spark.checkpoint.dir``,
which all executors share, so that the loss of an executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: The letters that the contracts lower-case; every other letter keeps its case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space in the sense of the contracts: the space and the code points 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"

_own_folder: str | None = None
_resident: tuple[object, object] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in a local session (tests), one local
    folder. On a cluster the executors would not share such a folder, so there it must be set."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return _own_folder


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator call in the shared folder. ``drop`` frees one as soon as it is not needed;
    what is left, and may still be read by the result, goes when the driver ends."""

    _open: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        if not Scratch._open:
            atexit.register(Scratch._end)
        Scratch._open[self.root] = self

    @staticmethod
    def _end() -> None:
        for root, scratch in Scratch._open.items():
            with contextlib.suppress(Exception):  # the JVM may have gone before
                scratch._delete(root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        # Once the table is written nobody reads the shuffle files of its plan again.
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._kept_at)


def column(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def resident(key: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, kept in this Python worker for the tasks to come; one thing is kept at a time, so
    a worker that serves several operators holds the tables of the last one only."""
    global _resident
    if _resident is None or _resident[0] != key:
        _resident = None
        _resident = (key, make())
        gc.freeze()  # such tables hold no cycles; the collector need not walk them after every task
    return _resident[1]


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, and afterwards what it used goes back to the system: Python workers are used for many tasks.
    What is resident goes as well, unless ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _resident
        if not keep:
            _resident = None
        try:
            yield from rows(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20, rows: int = 1000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches, of about ``most`` bytes of text and at most ``rows`` rows, with their texts."""
    for batch in batches:
        for part in (batch.slice(k, rows) for k in range(0, batch.num_rows, rows)):
            texts, at = utf8(part.column(column)), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= most):
                    size += len(texts[to])
                    to += 1
                yield part.slice(at, to - at), texts[at:to]
                at = to


def likely(df: DataFrame, key: str, wanted: DataFrame, of: str, n: int, most_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``df`` whose whole number ``key`` may be among the ``n`` numbers in the column ``of`` of
    ``wanted``, told by one hash in a bitmap of 16 bits for each, but not over ``most_bits``: what is broadcast
    is at most an eighth of that in bytes. A join after it finds the exact rows without moving all others."""
    bits = min(most_bits, 1 << max(15, (16 * n - 1).bit_length()))

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # the bitmap functions count from 1

    maps = wanted.select(place(of).alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__m"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__m", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col("__b"))
    return found.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*map(column, df.columns))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer: equal values stay equal, their bits become even."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, which share no folder with the driver. Documents are
    large, so batches that go to Python hold 1,000 rows unless the session asks for a number of its own."""
    import os
    import zipfile

    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="quernstone-"), "quernstone_llm.zip")
    with zipfile.ZipFile(to, "w") as z:
        z.write(os.path.join(top, "__init__.py"), "quernstone/__init__.py")
        here = os.path.join(top, "llm")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"quernstone/llm/{name}")
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def small_file(path: str, most: int = 64 << 20) -> bytes:
    """A vocabulary file, read on the driver to be broadcast; its size is checked."""
    import os

    if os.path.getsize(path) > most:
        raise ValueError(f"{path} is larger than {most} bytes and would not be broadcast")
    with open(path, "rb") as f:
        return f.read()
