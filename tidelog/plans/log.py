"""The operation log: one row per operation, and the logs that the sample tables stand for.

``cf, key, seq, op, value, end_key, batch_id, batch_pos, commit_unix`` with op one of put, delete, merge and
delete_range; a delete_range row covers ``key <= k < end_key``. No two operations share a sequence
number. Keys are stored, never computed in a filter, so that key predicates reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import padded

PUT, DELETE, MERGE, DELETE_RANGE = "put", "delete", "merge", "delete_range"
LOG = "cf int, key binary, seq long, op string, value binary, end_key binary, batch_id long, batch_pos int, commit_unix long"
SEGMENTS = "file_id long, level int, position int, smallest_key binary, largest_key binary, file_size long, num_entries long, path string"
DEFAULT_CF, ORDERS_CF, LINEITEM_CF, CONVERSATIONS_CF = 1, 2, 3, 4


#: Whole seconds since 1970, whatever the session's time zone.
UNIX = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({} as timestamp_ntz))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_of_events(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", MERGE).when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return events.select(
        F.lit(DEFAULT_CF).alias("cf"), padded(F.col("user_id")).alias("key"), (2 * F.col("event_id") + 1).alias("seq"), kind.alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("value"), F.lit(None).cast("string").alias("end_key"), F.expr(UNIX.format("ts")).alias("commit_unix"),
    )


def tombstones_of_events(events: DataFrame) -> DataFrame:
    return events.where("event_id % 1000 = 999").select(
        F.lit(DEFAULT_CF).alias("cf"), padded(F.col("user_id")).alias("key"), (2 * F.col("event_id") + 2).alias("seq"), F.lit(DELETE_RANGE).alias("op"),
        F.lit(None).cast("long").alias("value"), padded(F.col("user_id") + 10).alias("end_key"), F.expr(UNIX.format("ts")).alias("commit_unix"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and range deletes of the events, with string keys and whole cents."""
    events = table(spark, sf_dir, "events")
    return points_of_events(events).unionByName(tombstones_of_events(events))


def dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' log with a range delete over two users for every error: far more ranges than a plan can hold."""
    events = table(spark, sf_dir, "events")
    ranges = events.where("event_type = 'error'").select(
        F.lit(DEFAULT_CF).alias("cf"), padded(F.col("user_id")).alias("key"), (2 * F.col("event_id") + 2).alias("seq"), F.lit(DELETE_RANGE).alias("op"),
        F.lit(None).cast("long").alias("value"), padded(F.col("user_id") + 2 + F.col("event_id") % 5).alias("end_key"), F.expr(UNIX.format("ts")).alias("commit_unix"),
    )
    return points_of_events(events).unionByName(ranges)


def moving_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the events under keys that move on with time, so that a cursor in key space finds more and more."""
    events = table(spark, sf_dir, "events").withColumn("user_id", F.expr("event_id div 100 + user_id % 50"))
    return points_of_events(events).unionByName(tombstones_of_events(events))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put per order."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.lit(ORDERS_CF).alias("cf"), padded(F.col("o_orderkey")).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(PUT).alias("op"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("value"), F.lit(None).cast("string").alias("end_key"), F.expr(UNIX.format("o_orderdate")).alias("commit_unix"),
    )


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends of the turns of conversations; a turn's place in its conversation is its sequence number there."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.lit(CONVERSATIONS_CF).alias("cf"), padded(F.col("conv_id")).alias("key"), F.col("turn").alias("seq"), F.lit(MERGE).alias("op"),
        F.col("text").alias("value"), F.lit(None).cast("string").alias("end_key"), F.lit(0).cast("long").alias("commit_unix"),
    )
