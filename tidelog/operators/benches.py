"""The fourteen engine workloads over a database handle: whole tables of operations, not loops over keys, except where single commits are the point."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument
from tidelog.operators import reads
from tidelog.sources.database import Database

KEY_SIZE, VALUE_SIZE = 16, 100
#: A prime that deals keys: id times it, modulo a number that it doesn't divide, meets every key once.
STRIDE = 1_000_003
SYNCED = 5  # single commits of fillsync and of the writer beside readwhilewriting


@dataclass(frozen=True)
class Result:
    name: str
    ops: int
    found: int
    bytes: int
    seconds: float

    def line(self) -> str:
        per = self.seconds * 1e6 / max(1, self.ops)
        return f"{self.name:<22}: {per:11.3f} micros/op {self.ops / max(self.seconds, 1e-9):12.0f} ops/sec; {self.bytes / max(self.seconds, 1e-9) / 2**20:8.1f} MB/s"


def key(number: Column) -> Column:
    return F.lpad(number.cast("string"), KEY_SIZE, "0").cast("binary")


def dealt(number: Column, many: int) -> Column:
    return number * STRIDE % many


def _values(number: Column, size: int) -> Column:
    return F.substring(F.repeat(F.sha2(number.cast("string"), 256), size // 64 + 1), 1, size).cast("binary")


class Benches:
    """Workloads of ``many`` operations over keys 0 to ``many`` - 1."""

    def __init__(self, db: Database, many: int, value_size: int = VALUE_SIZE):
        if many < 1 or many % STRIDE == 0:
            raise InvalidArgument("the number of keys must be positive and no multiple of the stride")
        self.db, self.many, self.size = db, many, value_size

    def names(self) -> list[str]:
        return list(self._all())

    def _all(self) -> dict[str, Callable[[], tuple[int, int]]]:
        return {
            "fillseq": self.fillseq, "fillrandom": self.fillrandom, "fillsync": self.fillsync, "readseq": self.readseq, "readreverse": self.readreverse, "readrandom": self.readrandom,
            "readmissing": self.readmissing, "overwrite": self.overwrite, "updaterandom": self.updaterandom, "deleterandom": self.deleterandom, "seekrandom": self.seekrandom,
            "readwhilewriting": self.readwhilewriting, "readrandomwriterandom": self.readrandomwriterandom, "compact": self.compact,
        }

    def run(self, name: str) -> Result:
        """One workload, timed; those that read or change fill the database first, which isn't timed."""
        if name not in self._all():
            raise InvalidArgument(f"workload {name}")
        if not name.startswith("fill") and not self.db.manifest.segments:
            self.fillseq()
        began = time.perf_counter()
        ops, found = self._all()[name]()
        return Result(name, ops, found, found * (KEY_SIZE + self.size), time.perf_counter() - began)

    def _numbers(self) -> DataFrame:
        return self.db.spark.range(self.many)

    def _put(self, numbers: DataFrame, at: Column, seed: int = 0) -> tuple[int, int]:
        log = numbers.select(key(at).alias("key"), (F.col("id") + 1).alias("seq"), F.lit("put").alias("op"), _values(F.col("id") + seed, self.size).alias("value"))
        self.db.replay(log)
        return self.many, self.many

    def fillseq(self) -> tuple[int, int]:
        return self._put(self._numbers(), F.col("id"))

    def fillrandom(self) -> tuple[int, int]:
        return self._put(self._numbers(), dealt(F.col("id"), self.many))

    def fillsync(self) -> tuple[int, int]:
        many = min(self.many, SYNCED)
        for i in range(many):
            self.db.put(b"%016d" % i, b"v" * self.size)
        return many, many

    def overwrite(self) -> tuple[int, int]:
        return self._put(self._numbers(), dealt(F.col("id"), self.many), 1)

    def readseq(self) -> tuple[int, int]:
        found = self.db.state().agg(F.count("*").alias("n"), F.sum(F.octet_length("value"))).first().n
        return found, found

    def readreverse(self) -> tuple[int, int]:
        found = reads.reverse(self.db.state()).agg(F.count("*").alias("n"), F.sum(F.octet_length("value"))).first().n
        return found, found

    def _read(self, at: Column) -> tuple[int, int]:
        asked = self._numbers().select(F.col("id").alias("ord"), key(at).alias("key"))
        near = reads.near_keys(self.db.log(), asked)
        from tidelog.plans.resolve import resolve

        found = reads.multi_get(resolve(near, None, self.db.options.merge), asked).agg(F.count("value").alias("n")).first().n
        return self.many, found

    def readrandom(self) -> tuple[int, int]:
        return self._read(dealt(F.col("id"), self.many))

    def readmissing(self) -> tuple[int, int]:
        return self._read(F.col("id") + self.many)

    def updaterandom(self) -> tuple[int, int]:
        """Read, change and write back every key."""
        log = self.db.state().select("key", (F.col("key").cast("string").cast("long") + 1).alias("seq"), F.lit("put").alias("op"), F.concat(F.col("value"), F.lit(b"+")).alias("value"))
        before = self.db.latest_sequence
        done = self.db.replay(log) - before
        return done, done

    def deleterandom(self) -> tuple[int, int]:
        """Delete every second key."""
        own = self._numbers().where("id % 2 = 0").select(key(F.col("id")).alias("key"), (F.col("id") + 1).alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("binary").alias("value"))
        self.db.replay(own)
        return -(-self.many // 2), 0

    def seekrandom(self) -> tuple[int, int]:
        asked = self._numbers().select(key(dealt(F.col("id"), self.many)).alias("target"))
        return self.many, reads.seek_many(self.db.state(), asked).where("found is not null").count()

    def readwhilewriting(self) -> tuple[int, int]:
        """Random reads of one view while a thread commits."""
        with self.db.pinned():
            writer = threading.Thread(target=lambda: [self.db.put(b"%016d" % i, b"w" * self.size) for i in range(SYNCED)])
            writer.start()
            out = self.readrandom()
            writer.join()
        return out

    def readrandomwriterandom(self) -> tuple[int, int]:
        """Nine reads to one write."""
        numbers = self._numbers().where("id % 10 = 9")
        log = numbers.select(key(dealt(F.col("id"), self.many)).alias("key"), (F.col("id") + 1).alias("seq"), F.lit("put").alias("op"), _values(F.col("id"), self.size).alias("value"))
        self.db.replay(log)
        return self.many, self._read(dealt(F.col("id"), self.many))[1]

    def compact(self) -> tuple[int, int]:
        self.db.compact_range()
        return 1, 0
