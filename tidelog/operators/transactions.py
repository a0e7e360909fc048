"""Transactions as queries: overlay scans, validation sets and conflict checks over whole histories.

``txns``: txn_id, isolation, snapshot_seq. ``reads``: txn_id, key, seq (the horizon of the first read), for_update.
``writes``: txn_id, key, op, value. A log row newer than what a transaction observed of a key, a point or a tombstone over
it, is a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ_COMMITTED, SNAPSHOT, SERIALIZABLE = "rc", "si", "ser"


def overlay(state: DataFrame, buffered: DataFrame) -> DataFrame:
    """What a transaction's scan sees: its buffered puts replace, its deletes hide; buffered merges don't show.

    ``buffered``: one (key, op, value) per key, the last put or delete.
    """
    own = buffered.select("key", F.col("op").alias("b_op"), F.col("value").alias("b_value"))
    both = state.select("key", "value").join(own, "key", "full_outer")
    value = F.when(F.col("b_op") == "put", F.col("b_value")).otherwise(F.col("value"))
    return both.where("b_op is null or b_op <> 'delete'").select("key", value.alias("value"), F.when(F.col("b_op") == "put", "buffer").otherwise("snapshot").alias("origin"))


def validation_set(txns: DataFrame, reads: DataFrame, writes: DataFrame, isolation: str, optimistic: bool = True) -> DataFrame:
    """(txn_id, key, seq, blind): keys whose newest version must not be above ``seq`` at commit.

    Read committed validates keys that were read and written, snapshot isolation reads for update too, serializable every
    read; optimistic transactions also validate all writes at their snapshot. ``blind``: only written, never read.
    """
    written = writes.select("txn_id", "key").distinct().withColumn("written", F.lit(True))
    seen = reads.groupBy("txn_id", "key").agg(F.min("seq").alias("seq"), F.max("for_update").alias("for_update"))
    seen = seen.join(written, ["txn_id", "key"], "left").withColumn("written", F.coalesce("written", F.lit(False)))
    wanted: Column = F.col("written") | (F.lit(isolation != READ_COMMITTED) & F.col("for_update")) | F.lit(isolation == SERIALIZABLE)
    checked = seen.where(wanted).select("txn_id", "key", "seq", F.lit(False).alias("blind"))
    if optimistic:
        unread = written.join(reads.select("txn_id", "key").distinct(), ["txn_id", "key"], "left_anti")
        checked = checked.unionByName(unread.join(txns.select("txn_id", F.col("snapshot_seq").alias("seq")), "txn_id").select("txn_id", "key", "seq", F.lit(True).alias("blind")))
    return checked


def newest(points: DataFrame, tombstones: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key) with ``latest``, the newest sequence number that touches each: points by equality, tombstones by range."""
    from tidelog.plans.tombstones import cover, distinct_tombstones

    last = points.groupBy("key").agg(F.max("seq").alias("point_seq"))
    asked = keys.select("key").distinct().withColumn("cf", F.lit(1))
    covered = cover(asked, distinct_tombstones(tombstones)).drop("cf")
    return covered.join(last, "key", "left").select("key", F.greatest("point_seq", "cover").alias("latest"))


def conflicts(checked: DataFrame, points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(txn_id, key, observed, latest, blind) of the validation set that lost."""
    latest = newest(points, tombstones, checked)
    return checked.join(latest, "key").where(F.col("latest") > F.col("seq")).select("txn_id", "key", F.col("seq").alias("observed"), "latest", "blind")


def without_identical(lost: DataFrame, writes: DataFrame, state: DataFrame) -> DataFrame:
    """Conflicts less those of blind puts that write what is already committed."""
    same = writes.where("op = 'put'").join(state.select("key", F.col("value").alias("committed")), "key").where(F.col("value") == F.col("committed"))
    elided = same.select("txn_id", "key", F.lit(True).alias("blind"))
    return lost.join(elided, ["txn_id", "key", "blind"], "left_anti")


def commit_order(writes: DataFrame) -> DataFrame:
    """Buffered operations in the order of their commit: points by key, then ranges, then merges, as ``batch_pos``."""
    from pyspark.sql import window as W

    rank = F.when(F.col("op") == "merge", 2).when(F.col("op") == "delete_range", 1).otherwise(0)
    order = W.Window.partitionBy("txn_id").orderBy(rank, "key", "pos")
    return writes.withColumn("batch_pos", F.row_number().over(order) - 1)
