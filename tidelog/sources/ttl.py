"""A database whose values expire by the age of their commit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument
from tidelog.operators import expiry, reads
from tidelog.sources.database import Database, Options


class DatabaseWithTtl(Database):
    """Reads hide values older than ``ttl`` seconds, and compaction removes them; 0 keeps everything stamped.

    The time of a commit is the stamp. Merges are not stamped, so keys that only merges made are hidden.
    """

    @classmethod
    def open_with_ttl(cls, spark: SparkSession, path: str, ttl: int, options: Options | None = None) -> DatabaseWithTtl:
        if ttl < 0:
            raise InvalidArgument("a time to live can't be negative")
        return cls.open(spark, path, replace(options or Options(), ttl=ttl))

    def state(self, cf=None, start: bytes | None = None, end: bytes | None = None, sequence: int | None = None, keys: list[bytes] | None = None, prefix: bytes | None = None) -> DataFrame:
        found = expiry.stamped_puts(self.log(cf, start, end, sequence, keys=keys, prefix=prefix))
        kept = expiry.unexpired(found, F.lit(int(self.clock())), self.options.ttl)
        return reads.scan(kept.select("cf", "key", "value", "seq"), start, end)
