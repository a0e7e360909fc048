"""Aggregates over the log and the segment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import in_range

#: Bytes an entry takes beside its key and value: column family, sequence number and type.
ENTRY_OVERHEAD = 13


def memory_stats(log: DataFrame, start=None, end=None, cf: int = 1, raw: bool = False) -> DataFrame:
    """Entries (every version, tombstones of points too) and bytes of a key range; ``raw``: values are bytes, else sized as text."""
    rows = log.where((F.col("cf") == cf) & (F.col("op") != "delete_range") & in_range(F.col("key"), start, end))
    value = F.col("value") if raw else F.col("value").cast("string")
    size = F.octet_length("key") + ENTRY_OVERHEAD + F.coalesce(F.octet_length(value), F.lit(0))
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def approximate_sizes(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (ord, lo, hi) with the bytes of the segments that overlap ``lo <= k < hi``; 0 for an empty or inverted range."""
    inside = (F.col("smallest_key") < F.col("hi")) & (F.col("largest_key") >= F.col("lo")) & (F.col("lo") < F.col("hi"))
    return ranges.join(segments, inside, "left").groupBy("ord").agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


def histogram(values: DataFrame, value: str, *by: str) -> DataFrame:
    """count, sum, min, max and the whole average, 0 where there is nothing."""
    own: Column = F.col(value)
    zero = F.lit(0).cast("long")
    rows = values.groupBy(*by).agg(F.count(own).alias("n"), F.coalesce(F.sum(own), zero).alias("total"), F.coalesce(F.min(own), zero).alias("least"), F.coalesce(F.max(own), zero).alias("most"))
    return rows.withColumn("average", F.when(F.col("n") > 0, F.expr("total div n")).otherwise(zero))


def version_history(log: DataFrame) -> DataFrame:
    """Operations of each key by kind, and its first and last sequence numbers."""
    count = lambda op: F.count(F.when(F.col("op") == op, 1))
    points = log.where("op <> 'delete_range'")
    return points.groupBy("key").agg(count("put").alias("puts"), count("delete").alias("deletes"), count("merge").alias("merges"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def estimated_keys(segments: DataFrame, buffered_bytes: int = 0) -> DataFrame:
    return segments.agg((F.coalesce(F.sum("num_entries"), F.lit(0)) + buffered_bytes // 48).cast("long").alias("keys"))


def ranked_latency(ops: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, whole average and the value at index ``len * 99 / 100`` of the sorted values (not an interpolated percentile).

    Ranks come from a count per distinct value, so a task sorts distinct values only.
    """
    from pyspark.sql import window as W

    counted = ops.groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    order = W.Window.partitionBy(*by).orderBy("x").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = counted.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(W.Window.partitionBy(*by))})
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.expr("sum(x * c) div sum(c)").alias("average"), F.min(F.when(F.col("upto") > F.expr("n * 99 div 100"), F.col("x"))).alias("p99"))
