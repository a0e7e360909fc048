"""Time to live: a value is hidden once its write is older than the limit, counted from an injected ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(stamp: Column, now: Column, ttl: int) -> Column:
    """``stamp < now - ttl``, strictly; an unstamped value is hidden, too; a ttl of 0 never expires anything stamped."""
    if ttl == 0:
        return stamp.isNull()
    return stamp.isNull() | (stamp < F.greatest(now - ttl, F.lit(0)))


def unexpired(state: DataFrame, now: Column, ttl: int, stamp: str = "commit_unix") -> DataFrame:
    return state.where(~expired(F.col(stamp), now, ttl))


def expiry_filter(stamp: Column, now: Column | None, ttl: int) -> Column:
    """What compaction removes: expired values; unlike reads it keeps unstamped ones, and all without a clock."""
    if now is None or ttl == 0:
        return F.lit(False)
    return F.coalesce(stamp < F.greatest(now - ttl, F.lit(0)), F.lit(False))


def stamped_puts(log: DataFrame, horizon: int | None = None) -> DataFrame:
    """The newest put of each key that no later put, delete or tombstone hides, with its stamp; merges are not stamped."""
    from tidelog.plans.resolve import surviving

    newest = surviving(log.where("op <> 'merge'"), horizon)  # without merges, terminators are all that is left
    return newest.where("op = 'put'").select("cf", "key", "value", "seq", "commit_unix")
