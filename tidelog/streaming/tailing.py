"""Tailing: what a growing database shows past everything returned before.

The cursor is a watermark in key space, not in time: a key at or below the last one returned is skipped for good, and none
is returned twice. What is shown is the visible state at a commit: deletes hide, merges are folded with their base, and files that no
commit names are never seen.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.merges import COUNTER
from tidelog.plans.resolve import resolve
from tidelog.sources.database import Cursor, Database, Options
from tidelog.sources.files import Files


def past_cursor(rows: DataFrame, batch: str, key: str) -> DataFrame:
    """Rows of a recorded sequence of batches that a cursor returns. The running maximum is over one row per batch."""
    tops = rows.groupBy(batch).agg(F.max(key).alias("__top"))
    before = W.Window.orderBy(batch).rowsBetween(W.Window.unboundedPreceding, -1)
    floors = tops.withColumn("__floor", F.max("__top").over(before)).drop("__top")
    return rows.join(floors, batch).where(F.col("__floor").isNull() | (F.col(key) > F.col("__floor"))).drop("__floor")


def visible_past_cursor(log: DataFrame, horizons: list[int], merge=COUNTER) -> DataFrame:
    """(batch, key, value, seq): what a cursor returns that drains the state at each of some rising horizons in turn."""
    states = [resolve(log, h, merge).withColumn("batch", F.lit(i)) for i, h in enumerate(horizons)]
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return past_cursor(rows, "batch", "key")


class TailingCursor:
    """Forward only, over the newest commits: at the end it looks again, for keys past the last one returned."""

    def __init__(self, db: Database, cf: int):
        self.db, self.cf, self.last, self.inner = db, cf, None, None

    def _open(self) -> None:
        if self.inner:
            self.inner.close()
        if self.db.options.read_only:
            self.db.refresh()
        self.inner = Cursor(self.db, self.db._cf(self.cf))

    def _place(self, start: bytes | None) -> None:
        self._open()
        self.inner._place(self.inner._rows(start), True)

    def seek(self, target: bytes) -> None:
        self.last = None
        self._place(target)

    def seek_to_first(self) -> None:
        self.last = None
        self._place(None)

    def valid(self) -> bool:
        return self.inner is not None and self.inner.valid()

    def key(self) -> bytes | None:
        return self.inner.key() if self.inner else None

    def value(self) -> bytes | None:
        return self.inner.value() if self.inner else None

    def next(self) -> None:
        """The following key of the view, or, where that ends, of a new one."""
        if self.valid():
            self.last = self.inner.key()
            self.inner.next()
        if not self.valid():
            self.refresh()

    def refresh(self) -> None:
        """A new view, from just past the last key that was left behind."""
        self._place(None if self.last is None else self.last + b"\x00")

    def close(self) -> None:
        if self.inner:
            self.inner.close()

    def _rest(self) -> DataFrame:
        """What there is to return now, in one pass and no order: the rest of the view, or, where that has ended, all of a new one past the last key."""
        start = self.inner.key() if self.valid() else None if self.last is None else self.last + b"\x00"
        if not self.valid():
            self._open()
        return self.inner._rows(start).select("key", "value", "seq")

    def _left(self, top: bytes | None) -> None:
        """All of the view is returned; ``top`` is the last key of it."""
        self.last = self.last if top is None else bytes(top)
        self.inner.positioned, self.inner.entry, self.inner.ahead, self.inner.full = True, None, [], False

    def drain(self) -> list[tuple[bytes, bytes]]:
        """What there is to return now."""
        out = [(bytes(r.key), bytes(r.value)) for r in self._rest().orderBy("key").collect()]
        self._left(out[-1][0] if out else None)
        return out

    def drain_to(self, path: str) -> DataFrame:
        """The same as a table (key, value, seq) in a new folder, of which only the last key comes to the driver."""
        self._rest().write.parquet(path)
        shown = self.db.spark.read.schema("key binary, value binary, seq long").parquet(path)
        self._left(shown.agg(F.max("key")).first()[0])
        return shown


class Tail:
    """A stream over a database's commits that appends, batch by batch, the values past its cursor to a Parquet folder.

    New edits of the manifest start a batch; it reads the state of the newest commit. The cursor of every batch is stored under the batch's
    number before its rows count as returned, so a repeated batch starts from the same place and overwrites its own output.
    """

    def __init__(self, spark: SparkSession, source: str, target: str, checkpoint: str, start: bytes | None = None, cf=None, options: Options | None = None):
        self.spark, self.source, self.target, self.checkpoint, self.start, self.cf, self.options = spark, source.rstrip("/"), target, checkpoint, start, cf, options
        self.files = Files(spark)

    def _floor(self, batch: int) -> bytes | None:
        done = [int(name.removesuffix(".json")) for name in self.files.names(f"{self.checkpoint}/cursor")]
        earlier = [n for n in done if n < batch]
        if not earlier:
            return None
        stored = json.loads(self.files.read(f"{self.checkpoint}/cursor/{max(earlier)}.json"))["floor"]
        return None if stored is None else bytes.fromhex(stored)

    def _batch(self, _: DataFrame, batch: int) -> None:
        floor = self._floor(batch)
        db = Database.open_read_only(self.spark, self.source, self.options)
        found = db.state(self.cf, self.start if floor is None else floor + b"\x00")
        found.select("key", "value", "seq").write.mode("overwrite").parquet(f"{self.target}/batch={batch}")
        top = self.spark.read.parquet(f"{self.target}/batch={batch}").agg(F.max("key")).first()[0]
        last = floor if top is None else bytes(top)
        self.files.replace(f"{self.checkpoint}/cursor/{batch}.json", json.dumps({"floor": None if last is None else last.hex()}))

    def run(self, once: bool = True) -> StreamingQuery:
        commits = self.spark.readStream.schema("value string").option("pathGlobFilter", "*.json").text(f"{self.source}/manifest")
        writer = commits.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.checkpoint}/stream")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/batch=*")
