"""Reads over a resolved state (cf, key, value, seq): points, batches, ranges, pages, seeks and steps.

All ranges are half-open, None is unbounded. Ascending key order is ``orderBy`` on the caller's side or, where an
operator's result depends on it, a ``pos`` column. Single seeks plan as a top-k per partition; ``steps`` needs the
neighbours of every key and deals keys into ranges first, so it sorts no more than a range in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tidelog.errors import InvalidArgument
from tidelog.functions.keys import has_prefix, in_range
from tidelog.plans.tombstones import bucket_of

FEW_TARGETS = 256


def get(state: DataFrame, key) -> DataFrame:
    return state.where(F.col("key") == F.lit(key))


def near_keys(log: DataFrame, keys: DataFrame, known: list | None = None) -> DataFrame:
    """What of a log can tell about ``keys`` (key): their point operations, and the range deletes. Resolve this instead of the whole.

    ``known`` are the same keys, if they are few: then they reach the scan as a filter. Else they join before anything is shuffled for the log.
    """
    ranged = F.col("op") == "delete_range"
    if known is not None:
        return log.where(ranged | F.col("key").isin(*known)) if known else log.where(F.lit(False))
    return log.where(~ranged).join(keys.select("key").distinct(), "key", "left_semi").select(*log.columns).unionByName(log.where(ranged))


def has(state: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """``keys`` (key) with ``present``; an empty value is present. ``few``: the state holds only what a few keys asked for, and is broadcast."""
    found = state.select("key", F.lit(True).alias("present"))
    return keys.join(F.broadcast(found) if few else found, "key", "left").select(*keys.columns, F.coalesce("present", F.lit(False)).alias("present"))


def value_size(value: Column) -> Column:
    """Length in bytes of a resolved value."""
    return F.octet_length(value)


def multi_get(state: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """``keys`` (ord, key) with ``value``: one row per request, duplicates kept, null for a missing key; ``ord`` is the order. ``few`` as for :func:`has`."""
    found = state.select("key", "value")
    return keys.join(F.broadcast(found) if few else found, "key", "left").select("ord", "key", "value")


def scan(state: DataFrame, start=None, end=None) -> DataFrame:
    return state.where(in_range(F.col("key"), start, end))


def scan_prefix(state: DataFrame, prefix: bytes) -> DataFrame:
    return state.where(has_prefix(F.col("key"), prefix))


def page(state: DataFrame, start=None, end=None, limit: int = 100) -> DataFrame:
    """At most ``limit`` rows in key order with ``pos`` and ``next_start``, the first key not returned (null at the end).

    A top-k of limit + 1 rows; the window runs over those only.
    """
    if limit < 1:
        raise InvalidArgument("limit must be positive")
    top = scan(state, start, end).orderBy("key").limit(limit + 1)
    order = W.Window.orderBy("key")
    rows = top.withColumns({"pos": F.row_number().over(order), "ahead": F.max("key").over(W.Window.partitionBy())})
    return rows.withColumn("next_start", F.when(F.count("*").over(W.Window.partitionBy()) > limit, F.col("ahead"))).where(F.col("pos") <= limit).drop("ahead")


def seek(state: DataFrame, target) -> DataFrame:
    """The first key at or after the target."""
    return state.where(F.col("key") >= F.lit(target)).orderBy("key").limit(1)


def seek_for_prev(state: DataFrame, target) -> DataFrame:
    """The last key at or before the target."""
    return state.where(F.col("key") <= F.lit(target)).orderBy(F.desc("key")).limit(1)


def seek_before(state: DataFrame, target) -> DataFrame:
    """The last key strictly before the target."""
    return state.where(F.col("key") < F.lit(target)).orderBy(F.desc("key")).limit(1)


def first(state: DataFrame) -> DataFrame:
    return state.orderBy("key").limit(1)


def last(state: DataFrame) -> DataFrame:
    return state.orderBy(F.desc("key")).limit(1)


def key_bounds(keys: DataFrame) -> list:
    """Keys that cut distinct ``keys`` (key) into about as many equal ranges as there are shuffle partitions, from a bounded sample by hash."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted({r.key for r in keys.select("key", F.xxhash64("key").alias("h")).orderBy("h").limit(20 * parts).collect()})
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) >= 10 * parts else []


def seek_many(state: DataFrame, targets: DataFrame, floor: bool = False, few: int = FEW_TARGETS) -> DataFrame:
    """``targets`` (target) with ``found``: the ceiling (or floor) key of each, null if none.

    A few targets (counted first) cut the keys into intervals, of which the least and the greatest key are all that matters: sums in parts, and no
    order of the keys. With more, targets and keys are carried along in one order per range of keys; what a range lacks comes from
    its neighbours' ends, one row per range.
    """
    some = [r.target for r in targets.select("target").limit(few + 1).collect()]
    if len(some) <= few:
        return _seek_few(state, targets, sorted({t for t in some if t is not None}), floor)
    keys, asked = state.select("key"), targets.select("target").distinct()
    # targets may lie where there are few keys, so both are cut
    bounds = sorted({*key_bounds(keys), *key_bounds(asked.where("target is not null").select(F.col("target").alias("key")))})
    kind = state.schema["key"].dataType
    both = keys.select(F.col("key").alias("at"), F.col("key").alias("own"), F.lit(None).cast(kind).alias("target")).unionByName(
        asked.select(F.col("target").alias("at"), F.lit(None).cast(kind).alias("own"), "target")
    )
    ranged = both.withColumn("part", bucket_of(F.col("at"), bounds))
    pick, side = (F.last, F.max) if floor else (F.first, F.min)
    # either way from the start of an order to the row: a frame to the end is evaluated anew for each row. A key equal to a target comes before it
    order = W.Window.partitionBy("part").orderBy(F.col("at") if floor else F.desc("at"), F.col("own").isNull())
    near = ranged.withColumn("near", F.last("own", ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    beyond = W.Window.orderBy("part")  # one row per range of keys
    beyond = beyond.rowsBetween(W.Window.unboundedPreceding, -1) if floor else beyond.rowsBetween(1, W.Window.unboundedFollowing)
    ends = ranged.groupBy("part").agg(side("own").alias("end_key")).withColumn("other", pick("end_key", ignorenulls=True).over(beyond))
    return near.where(F.col("target").isNotNull()).join(F.broadcast(ends.select("part", "other")), "part").select("target", F.coalesce("near", "other").alias("found"))


def _seek_few(state: DataFrame, targets: DataFrame, bounds: list, floor: bool) -> DataFrame:
    """Ceilings or floors of a few sorted targets by the ends of the intervals between them."""
    kind = state.schema["key"].dataType
    # interval i holds the keys from target i - 1 on and before target i
    ends = state.groupBy(bucket_of(F.col("key"), bounds).alias("part")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    asked = state.sparkSession.createDataFrame(list(enumerate(bounds)), T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("at", kind)]))
    if floor:
        near = (F.col("part") <= F.col("nth")) | ((F.col("part") == F.col("nth") + 1) & (F.col("lo") == F.col("at")))
        best = F.max(F.when(F.col("part") <= F.col("nth"), F.col("hi")).otherwise(F.col("lo")))
    else:
        near, best = F.col("part") > F.col("nth"), F.min("lo")
    found = asked.coalesce(1).join(F.broadcast(ends), near, "left").groupBy("at").agg(best.alias("found"))  # a row per interval on either side
    return targets.distinct().join(F.broadcast(found), F.col("target") == F.col("at"), "left").select("target", "found")


def steps(state: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Every key with ``prev_key`` and ``next_key``. Ranges of keys are cut by a sample of ``sample`` (key), that of the state if not given.

    The ends of the ranges come from the same sorted exchange as the rows.
    """
    ranged = state.select("key").withColumn("part", bucket_of(F.col("key"), key_bounds(state.select("key") if sample is None else sample)))
    order = W.Window.partitionBy("part").orderBy("key")
    rows = ranged.withColumns({"prev_key": F.lag("key").over(order), "next_key": F.lead("key").over(order)})
    beside = W.Window.orderBy("part")  # one row per range of keys
    ends = rows.where("prev_key is null or next_key is null").groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = ends.select("part", F.lag("hi").over(beside).alias("before"), F.lead("lo").over(beside).alias("after"))
    return rows.join(F.broadcast(ends), "part").select("key", F.coalesce("prev_key", "before").alias("prev_key"), F.coalesce("next_key", "after").alias("next_key"))


def reverse(state: DataFrame, start=None, end=None) -> DataFrame:
    return scan(state, start, end).orderBy(F.desc("key"))
