"""Range tombstones: which one covers a key, without a nested loop over all pairs.

Only the newest covering tombstone matters, so tombstones reduce to a skyline of disjoint intervals with
their largest sequence number, and cover depends on the key alone. A few tombstones (``FEW``, counted first)
give a skyline on the driver that is broadcast; a key finds its bucket of intervals by a tree of comparisons. More are cut at sampled keys into buckets of
so many tombstones and keys; each bucket's skyline is swept by itself and carried over the bucket's distinct keys by a window, and points join by key. No
step holds more than a bucket's distinct tombstones. Keys of families without tombstones, or beyond all of them, take no part.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tidelog.session import importable

FEW, IN_BUCKET = 256, 8
PER_BUCKET, KEYS_PER_BUCKET = 50_000, 200_000
MAX_BUCKETS = 1024


def skyline(tombstones: Iterable[tuple]) -> list[tuple]:
    """Disjoint (start, end, seq) of (start, end, seq), each with the largest seq that covers it; touching equals are one."""
    todo = sorted(t for t in tombstones if t[0] < t[1])
    points = sorted({p for s, e, _ in todo for p in (s, e)})
    out: list[tuple] = []
    heap: list[tuple] = []
    at = 0
    for lo, hi in zip(points, points[1:], strict=False):
        while at < len(todo) and todo[at][0] <= lo:
            heapq.heappush(heap, (-todo[at][2], todo[at][1]))
            at += 1
        while heap and heap[0][1] <= lo:
            heapq.heappop(heap)
        # an ended tombstone below the top is dropped when it gets there
        if heap:
            seq = -heap[0][0]
            if out and out[-1][1] == lo and out[-1][2] == seq:
                out[-1] = (out[-1][0], hi, seq)
            else:
                out.append((lo, hi, seq))
    return out


def distinct_tombstones(log: DataFrame, horizon: int | None = None) -> DataFrame:
    """(cf, s, e, rseq): non-empty ranges visible at the horizon, the newest of equal ranges."""
    rows = log.where("op = 'delete_range'")
    if horizon is not None:
        rows = rows.where(F.col("seq") <= horizon)
    return rows.where("key < end_key").groupBy("cf", F.col("key").alias("s"), F.col("end_key").alias("e")).agg(F.max("seq").alias("rseq"))


def bucket_of(key: Column, bounds: list) -> Column:
    """Number of bounds at or below the key, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _at(number: Column, bounds: list, kind: T.DataType) -> Column:
    """The bound with that number; null beyond the last."""
    return F.get(F.array(*map(F.lit, bounds)).cast(T.ArrayType(kind)), number)


def skyline_table(tombstones: DataFrame, bounds: list) -> DataFrame:
    """(cf, bucket, s, e, rseq): the skyline of each bucket of keys."""
    importable(tombstones.sparkSession)
    kind = tombstones.schema["s"].dataType
    rows = tombstones.select("cf", "s", "e", "rseq", F.explode(F.sequence(bucket_of(F.col("s"), bounds), bucket_of(F.col("e"), bounds))).alias("bucket"))
    if bounds:
        low, high = F.when(F.col("bucket") > 0, _at(F.col("bucket") - 1, bounds, kind)), _at(F.col("bucket"), bounds, kind)
        rows = rows.withColumns({"s": F.greatest("s", low), "e": F.least("e", high)}).where("s < e")

    def sweep(own: pd.DataFrame) -> pd.DataFrame:
        found = skyline(zip(own["s"], own["e"], own["rseq"], strict=True))
        return pd.DataFrame({"cf": own["cf"].iloc[0], "bucket": own["bucket"].iloc[0], "s": [x[0] for x in found], "e": [x[1] for x in found], "rseq": [x[2] for x in found]})

    schema = T.StructType([T.StructField("cf", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("s", kind), T.StructField("e", kind), T.StructField("rseq", T.LongType())])
    return rows.select("cf", "s", "e", "rseq", "bucket").groupBy("cf", "bucket").applyInPandas(sweep, schema)


def sampled_bounds(tombstones: DataFrame, many: int) -> list:
    """Keys that cut the starts of ranges into about equal parts, from a bounded sample by hash."""
    buckets = min(MAX_BUCKETS, -(-many // PER_BUCKET))
    sample = sorted({r.s for r in tombstones.select("s", F.xxhash64("s", "e").alias("h")).orderBy("h").limit(20 * buckets).collect()})
    return [sample[len(sample) * i // buckets] for i in range(1, buckets)] if len(sample) >= buckets else []


def key_cuts(points: DataFrame) -> list:
    """Keys that cut the distinct keys of ``points`` (cf, key) into parts of about ``KEYS_PER_BUCKET``, by a sample of them by hash."""
    at = F.xxhash64("cf", "key")
    many = points.agg(F.approx_count_distinct(at)).first()[0]
    buckets = min(MAX_BUCKETS, -(-many // KEYS_PER_BUCKET))
    if buckets < 2:
        return []
    sample = sorted({r.key for r in points.where(F.pmod(at, F.lit(max(1, many // (40 * buckets)))) == 0).select("key").distinct().collect()})
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if len(sample) >= buckets else []


def cover(points: DataFrame, tombstones: DataFrame, few: int = FEW, log: DataFrame | None = None) -> DataFrame:
    """``points`` with ``cover``, the largest sequence number of the ``tombstones`` (of :func:`distinct_tombstones`) over (cf, key).

    With ``log`` the points are the distinct keys of that log, a row each, and other columns of theirs.
    """
    some = tombstones.limit(few + 1).collect()
    kind = tombstones.schema["s"].dataType
    if len(some) <= few:
        by_cf: dict[int, list] = {}
        for r in some:
            by_cf.setdefault(r.cf, []).append((r.s, r.e, r.rseq))
        flat = [(cf, *x) for cf, own in by_cf.items() for x in skyline(own)]
        if not flat:
            return points.withColumn("cover", F.lit(None).cast("long"))
        # intervals are cut at some of their starts, so that a key meets those of its bucket only
        bounds = sorted({s for _, s, _, _ in flat})[IN_BUCKET::IN_BUCKET]
        rows = []
        for cf, s, e, seq in flat:
            first = bisect.bisect_right(bounds, s)
            inner = [b for b in bounds[first:] if b < e]
            rows += [(cf, first + i, lo, hi, seq) for i, (lo, hi) in enumerate(zip([s, *inner], [*inner, e], strict=True))]
        schema = T.StructType([T.StructField("__cf", T.IntegerType()), T.StructField("__part", T.IntegerType()), T.StructField("__s", kind), T.StructField("__e", kind), T.StructField("cover", T.LongType())])
        local = points.sparkSession.createDataFrame(rows, schema)
        same = (F.col("cf") == F.col("__cf")) & (bucket_of(F.col("key"), bounds) == F.col("__part"))
        return points.join(F.broadcast(local), same & (F.col("key") >= F.col("__s")) & (F.col("key") < F.col("__e")), "left").drop("__cf", "__part", "__s", "__e")
    known = tombstones.agg(F.count("*").alias("many"), F.collect_set("cf").alias("cfs"), F.min("s").alias("s"), F.max("e").alias("e")).first()
    near = F.coalesce(F.col("cf").isin(*known.cfs) & (F.col("key") >= F.lit(known.s)) & (F.col("key") < F.lit(known.e)), F.lit(False))
    bounds = sorted({*sampled_bounds(tombstones, known.many), *key_cuts((points if log is None else log).where(near))})
    sky = skyline_table(tombstones, bounds)
    edges = sky.select("cf", "bucket", F.col("s").alias("key"), F.struct("rseq", "e").alias("mark"), F.lit(0).alias("turn"))
    keys = (points.select("cf", "key").distinct() if log is None else points).where(near).withColumn("bucket", bucket_of(F.col("key"), bounds))
    both = edges.unionByName(keys.withColumns({"mark": F.lit(None).cast(edges.schema["mark"].dataType), "turn": F.lit(1)}), allowMissingColumns=True)
    order = W.Window.partitionBy("cf", "bucket").orderBy("key", "turn").rowsBetween(W.Window.unboundedPreceding, 0)
    carried = both.withColumn("mark", F.last("mark", ignorenulls=True).over(order)).where("turn = 1")
    reaches = F.col("mark.e") > F.col("key")
    if log is None:
        return points.join(carried.where(reaches).select("cf", "key", F.col("mark.rseq").alias("cover")), ["cf", "key"], "left")
    beyond = points.where(~near).withColumn("cover", F.lit(None).cast("long"))
    return carried.withColumn("cover", F.when(reaches, F.col("mark.rseq"))).select(*points.columns, "cover").unionByName(beyond)
