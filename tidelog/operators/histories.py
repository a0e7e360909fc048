"""Consistency checks over recorded histories.

Operations: process, op_id, f (append or r or w), key, invoked, completed, ok, value. Joins are by key, so that witnesses meet
in the key's partition; the inequality on time is a residual filter of that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog.operators.reads import key_bounds
from tidelog.plans.tombstones import bucket_of

WITNESSES = 32


def cuts(sample: DataFrame) -> list:
    """Values that cut the only column of ``sample`` into ranges, by a bounded sample."""
    return key_bounds(sample.toDF("key"))


def dealt(rows: DataFrame, at: str, bounds: list) -> DataFrame:
    """``rows`` with ``part``, a range of the column ``at``: an order within a key is then one within its parts, and what a part
    lacks is carried from the parts before it, a row for each key and part. So a hot key's order is not one task's."""
    return rows.withColumn("part", bucket_of(F.col(at), bounds))


def paired(events: DataFrame) -> DataFrame:
    """Completions with the last pending invocation of their process: (process, op_id, invoked, completed, type)."""
    parts = dealt(events.select("process", "index", "time", "type"), "index", cuts(events.select("index")))
    last = F.struct("type", "time", "index")
    rows = parts.withColumn("last", F.lag(last).over(W.Window.partitionBy("process", "part").orderBy("index")))
    ends = parts.groupBy("process", "part").agg(F.max_by(last, "index").alias("end"))
    ends = ends.select("process", "part", F.lag("end").over(W.Window.partitionBy("process").orderBy("part")).alias("carried"))
    rows = rows.join(ends, ["process", "part"]).withColumn("last", F.coalesce("last", "carried"))
    found = rows.where("type <> 'invoke' and last.type = 'invoke'")
    return found.select("process", F.col("last.index").alias("op_id"), F.col("last.time").alias("invoked"), F.col("time").alias("completed"), "type")


def lossy_reads(appends: DataFrame, reads: DataFrame, witnesses: int | None = None) -> DataFrame:
    """The reads (key, read_id, invoked, list) that lack the value of some append completed before, none of those without a list; the first ``witnesses`` if given.

    By counts: appends before each read, less those whose value it lists. They come from one order of appends and reads per key and range of time, and one
    join by key and value, so no append meets every read of its key.
    """
    ended = cuts(appends.select("completed"))
    own = reads.where("list is not null").select("key", F.col("invoked").alias("at"), F.lit(0).alias("turn"), "read_id", "list")
    both = dealt(own.unionByName(appends.select("key", F.col("completed").alias("at"), F.lit(1).alias("turn")), allowMissingColumns=True), "at", ended)
    one = F.when(F.col("turn") == 1, 1)
    order = W.Window.partitionBy("key", "part").orderBy("at", "turn").rowsBetween(W.Window.unboundedPreceding, 0)
    inside = both.withColumn("inside", F.count(one).over(order)).where("turn = 0")
    # appends of a key by part: as many numbers as there are parts
    sums = dealt(appends.select("key", F.col("completed").alias("at")), "at", ended).groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.collect_list(F.struct("part", "n")).alias("sums"))
    earlier = F.expr("aggregate(sums, 0L, (a, s) -> a + if(s.part < part, s.n, 0L))")
    before = inside.join(sums, "key").withColumn("before", F.col("inside") + earlier).where("before > 0").select("key", "at", "read_id", "list", "before")
    listed = before.select("key", "at", "read_id", "before", F.explode_outer(F.array_distinct("list")).alias("value"))
    found = listed.join(appends.select("key", "value", "completed"), ["key", "value"], "left").groupBy("read_id").agg(F.max("before").alias("before"), F.count(F.when(F.col("completed") < F.col("at"), 1)).alias("found"))
    lossy = found.where("before > found").select("read_id")
    if witnesses is not None:
        lossy = F.broadcast(lossy.orderBy("read_id").limit(witnesses))
    return before.join(lossy, "read_id", "left_semi").select("key", "read_id", F.col("at").alias("invoked"), "list")


def lost_appends(appends: DataFrame, reads: DataFrame, witnesses: int | None = WITNESSES) -> DataFrame:
    """Reads (read_id, key, invoked, list) invoked after an append (append_id, key, completed, value) that lack its value.

    With a number of witnesses, the first by read and append, only as many lossy reads meet the appends of their keys.
    """
    lossy = lossy_reads(appends, reads, witnesses)
    lost = appends.join(lossy if witnesses is None else F.broadcast(lossy), "key").where((F.col("invoked") > F.col("completed")) & ~F.array_contains("list", F.col("value")))
    lost = lost.select("key", "append_id", "read_id", "value")
    return lost if witnesses is None else lost.orderBy("read_id", "append_id").limit(witnesses)


def stale_reads(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (read_id, key, invoked, seen) older than the newest write (key, completed, version) completed before them.

    As-of join by one order of writes and reads per key and range of time; the largest version so far is carried to each read.
    """
    both = writes.select("key", F.col("completed").alias("at"), F.lit(1).alias("turn"), "version", F.lit(None).cast("long").alias("read_id"), F.lit(None).cast("long").alias("seen")).unionByName(
        reads.select("key", F.col("invoked").alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("version"), "read_id", "seen")
    )
    parts = dealt(both, "at", cuts(writes.select("completed")))
    order = W.Window.partitionBy("key", "part").orderBy("at", "turn").rowsBetween(W.Window.unboundedPreceding, 0)
    before = W.Window.partitionBy("key").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    tops = parts.groupBy("key", "part").agg(F.max("version").alias("top")).select("key", "part", F.max("top").over(before).alias("carried"))
    rows = parts.withColumn("latest", F.max("version").over(order)).where("read_id is not null").join(tops, ["key", "part"])
    rows = rows.withColumn("latest", F.greatest("latest", "carried"))
    return rows.where("read_id is not null and latest > coalesce(seen, -1)").select("read_id", "key", "seen", "latest")


def shadow_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys whose last logged operation (key, value; null: deleted) and stored value (key, value) differ."""
    both = expected.select("key", F.col("value").alias("expected")).join(actual.select("key", F.col("value").alias("actual")), "key", "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def last_operations(log: DataFrame) -> DataFrame:
    """The newest put or delete of each key: (key, value), null for a delete."""
    rows = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return rows.select("key", F.when(F.col("x.op") == "put", F.col("x.value")).alias("value"))


def write_skews(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Pairs of committed transactions that each read what the other wrote and wrote something else, neither seeing the other.

    ``reads``: txn_id, key, seq (horizon); ``writes``: txn_id, key, seq (commit).
    """
    crossing = reads.join(writes.select("key", F.col("txn_id").alias("writer"), F.col("seq").alias("commit")), "key")
    crossing = crossing.where("txn_id <> writer and commit > seq").select(F.col("txn_id").alias("reader"), "writer").distinct()
    back = crossing.select(F.col("reader").alias("writer"), F.col("writer").alias("reader"))
    return crossing.join(back, ["reader", "writer"]).where("reader < writer").select(F.col("reader").alias("a"), F.col("writer").alias("b"))


def run_comparison(base: DataFrame, new: DataFrame, threshold: float = 5.0) -> DataFrame:
    """``base`` and ``new`` (name, median, low, high): percent change, whether the ranges overlap, and a verdict."""
    left = base.select("name", F.col("median").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    rows = left.join(new.select("name", F.col("median").alias("n"), "low", "high"), "name")
    change = F.round((F.col("n") - F.col("b")) * 100.0 / F.col("b"), 3)
    overlap = (F.col("low") <= F.col("b_high")) & (F.col("b_low") <= F.col("high"))
    verdict = F.when(overlap | (F.abs(change) < threshold), "same").when(change > 0, "up").otherwise("down")
    return rows.select("name", change.alias("change_pct"), overlap.alias("overlap"), verdict.alias("verdict"))
