"""What the operators of this subpackage share: Arrow batches, the shared folder, written tables.

Every Python step here is a ``mapInArrow`` over whole texts. A batch holds at most ``BATCH_ROWS``
rows and about ``BATCH_BYTES`` bytes, so memory follows the batch and not the partition.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import importable, shared_path

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def ready_for_python(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, by rows and by bytes, and let workers import the package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class HashSet:
    """Which rows may have one of some keys: a bitmap of the keys' hashes, with 16 bits a key up to ``MOST_BITS`` (16 MB), so it can always be broadcast.

    Texts of other rows then need no shuffle to learn that they have none.
    """

    MOST_BITS = 27

    def __init__(self, hashes: DataFrame):
        """``hashes``: one column of 64-bit hashes."""
        name = hashes.columns[0]
        bits = min(self.MOST_BITS, max(15, (16 * hashes.count()).bit_length()))
        self.size = F.lit(1 << bits)
        place = hashes.select(F.pmod(F.col(name), self.size).alias("place"))
        self.parts = place.groupBy(F.expr("place div 32768").alias("__part")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("__bits"))  # 4 kB each

    def marked(self, df: DataFrame, own: Column, mark: str) -> DataFrame:
        """``df`` with the boolean column ``mark``: whether the hash ``own`` may be among the keys'."""
        found = df.withColumn("__place", F.pmod(own, self.size)).join(F.broadcast(self.parts), F.expr("__place div 32768") == F.col("__part"), "left")
        byte = F.conv(F.hex(F.expr("substring(__bits, cast(__place % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = F.expr("cast(__place % 8 as int)")
        return found.withColumn(mark, F.coalesce(F.call_function("getbit", byte, bit) == 1, F.lit(False))).drop("__place", "__part", "__bits")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded():
    """Lists the paths of the tables that :func:`written` makes meanwhile, so that who writes a result can delete what it came from."""
    own: list[str] = []
    _RECORDS.append(own)
    try:
        yield own
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not own]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on an executor."""
    path = shared_path(df.sparkSession, label)
    for record in _RECORDS:
        record.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, text: str) -> int:
    """About how many bytes a table has: the planner's figure where it knows files, else the bytes of its texts, summed."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first().n or 0


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, once nothing lazy reads it any more."""
    for file in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_path(df.sparkSession, file)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shielded(docs: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of the ``taken`` names renamed, and the columns that give ``docs`` back."""
    wanted, used = {t.lower() for t in taken}, {c.lower() for c in docs.columns}
    new: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in wanted:
            number = len(new)
            while f"__kept{number}" in used:
                number += 1
            used.add(f"__kept{number}")
            new[c] = f"__kept{number}"
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def local_path(path: str) -> str | None:
    return path.removeprefix("file://") if path.startswith(("file:", "/")) else None


def open_output(path: str):
    """A new file in the shared folder, from any process."""
    if (own := local_path(path)) is not None:
        where, name = fs.LocalFileSystem(), own
    else:
        where, name = fs.FileSystem.from_uri(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name)


def mapped(path: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped, or read where the store has no memory mapping."""
    if (own := local_path(path)) is not None:
        with pa.memory_map(own) as source:
            return np.frombuffer(source.read_buffer(), dtype=dtype)
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as source:
        return np.frombuffer(source.read_buffer(), dtype=dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of unsigned 64-bit integers (its constants are fixed values)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT: dict = {}


def per_worker(key=None, make=None):
    """``make()``, kept from task to task in a Python worker until another key (or none) is asked for; what was kept goes back to the system."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library
        _KEPT[key] = make() if make else None
    return _KEPT[key]


def byte_slices(data: bytes, size: int = 1 << 20):
    """``data`` in slices of about ``size`` bytes, each cut after a space or line feed; a longer run without one stays whole."""
    at = 0
    while len(data) - at > size:
        cuts = [c for c in (data.find(b" ", at + size), data.find(b"\n", at + size)) if c >= 0]
        if not cuts:
            break
        yield data[at : min(cuts) + 1]
        at = min(cuts) + 1
    yield data[at:]
