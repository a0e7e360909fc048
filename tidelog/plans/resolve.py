"""The state of a log at a sequence number.

For each key: operations above the horizon and those that a newer range tombstone covers are dropped; of the
rest the newest put or delete is the terminator, and the value is the merge of its value (if a put) with
the newer operands, oldest first. A key without put and operands is absent.

The plan: terminators are a maximum per key (partial sums first, so a hot key costs a row per task). A tombstone covers all of a key's
operations up to its number, so cover is looked up once a key. Both join the log by key at once (broadcast if the planner finds them small,
else a join whose hot keys can be split), and what is left folds by key, again with partial sums for operators whose order does not matter.
Where folded values are numbers, the terminator's comes with the maximum, and only operands of keys with newer ones join.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.merges import COUNTER, CustomMerge, Merge
from tidelog.plans.tombstones import FEW, cover, distinct_tombstones
from tidelog.session import importable


def live_points(log: DataFrame, horizon: int | None = None, few: int = FEW) -> DataFrame:
    """Point operations at the horizon that no newer tombstone covers."""
    seen = log if horizon is None else log.where(F.col("seq") <= horizon)
    points = seen.where("op <> 'delete_range'")
    return cover(points, distinct_tombstones(seen), few).where("cover is null or seq > cover").drop("cover")


def to_terminator(points: DataFrame) -> DataFrame:
    """Each key's operations from its terminator on, with ``term`` (null if it has none)."""
    terms = points.where("op <> 'merge'").groupBy("cf", "key").agg(F.max("seq").alias("term"))
    return points.join(terms, ["cf", "key"], "left").where("term is null or seq >= term")


def surviving(log: DataFrame, horizon: int | None = None, few: int = FEW) -> DataFrame:
    """The same of :func:`live_points`, by one join: operations of a log at the horizon that count, with ``term``."""
    seen = log if horizon is None else log.where(F.col("seq") <= horizon)
    points = seen.where("op <> 'delete_range'")
    terms = points.groupBy("cf", "key").agg(F.max(F.when(F.col("op") != "merge", F.col("seq"))).alias("term"))
    marks = cover(terms, distinct_tombstones(seen), few, points)
    term = F.when(F.col("cover").isNull() | (F.col("term") > F.col("cover")), F.col("term"))
    marks = marks.select("cf", "key", term.alias("term"), F.greatest(term, F.col("cover") + 1).alias("floor"))
    return points.join(marks, ["cf", "key"], "left").where("floor is null or seq >= floor").drop("floor")


def folded(kept: DataFrame, merge: Merge | CustomMerge | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(cf, key, value, seq, put, full) of :func:`surviving`'s rows: whether a value is there, and whether a terminator is; and the greatest of ``extra``."""
    if isinstance(merge, CustomMerge):
        return _custom(kept, merge)
    base = F.max(F.when((F.col("op") == "put") & (F.col("seq") == F.col("term")), F.col("value")))
    rest = [F.max("seq").alias("seq"), F.max(F.col("op").isin("put", "merge")).alias("put"), F.max(F.col("term").isNotNull()).alias("full"), *(F.max(c).alias(c) for c in extra)]
    if merge is None:
        rows = kept.groupBy("cf", "key").agg(base.alias("value"), F.max(F.col("op") == "merge").alias("merges"), *rest)
        value = F.when(F.col("merges"), F.raise_error(F.lit("merge without a merge operator")).cast(kept.schema["value"].dataType)).otherwise(F.col("value"))
    else:
        operand = F.when(F.col("op") == "merge", merge.load(F.col("value")))
        rows = kept.groupBy("cf", "key").agg(base.alias("base"), merge.fold(F.col("seq"), operand).alias("operands"), *rest)
        value = merge.store(merge.join(merge.load(F.col("base")), F.col("operands")))
    return rows.select("cf", "key", value.alias("value"), "seq", "put", "full", *extra)


def numeric(log: DataFrame, merge: Merge | CustomMerge | None) -> bool:
    """Whether an operator folds a log's values as numbers, which an aggregate by hash can hold."""
    return isinstance(merge, Merge) and isinstance(log.select(merge.load(F.col("value")).alias("v")).schema["v"].dataType, T.NumericType)


def folded_numbers(log: DataFrame, horizon: int | None, merge: Merge, few: int = FEW, extra: tuple[str, ...] = (), change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What :func:`folded` makes of :func:`surviving`, for operators on numbers.

    The newest put or delete of a key is an aggregate of hashes, so the log is shuffled as one row a key. Only keys with operands that are newer
    than that and their cover are joined, to their operands. ``change`` may replace ``op`` and ``value`` of terminators before they are folded.
    """
    seen = log if horizon is None else log.where(F.col("seq") <= horizon)
    points = seen.where("op <> 'delete_range'")
    at = F.when(F.col("op") != "merge", F.col("seq"))
    fits = F.coalesce(merge.fits(F.col("value")), F.lit(True))
    # a value that can't be loaded fails only if it is read
    kind = F.when(F.col("op") == "put", F.when(fits, 1).otherwise(2)).otherwise(0)
    keys = points.groupBy("cf", "key").agg(
        F.max("seq").alias("last"), F.max(at).alias("term"), F.max_by(F.when(fits, merge.load(F.col("value"))), at).alias("base"), F.max_by(kind, at).alias("kind"), *(F.max_by(c, at).alias(c) for c in extra)
    )
    marks = cover(keys, distinct_tombstones(seen), few, points)
    full = F.col("term").isNotNull() & (F.col("cover").isNull() | (F.col("term") > F.col("cover")))
    marks = marks.withColumn("full", full).withColumns({c: F.when(F.col("full"), F.col(c)) for c in ("term", "base", "kind", *extra)})
    marks = marks.withColumn("floor", F.greatest("term", "cover")).drop("cover")
    bad = F.raise_error(F.lit(f"{merge.name}: a value is not 8 bytes")).cast(marks.schema["base"].dataType)
    if change:
        loaded = F.when(F.col("kind") == 2, bad).otherwise(F.col("base"))
        own = marks.withColumns({"value": merge.store(loaded), "seq": F.col("term"), "op": F.when(F.col("kind") > 0, "put").when(F.col("full"), "delete"), "end_key": F.lit(None).cast("binary")})
        own = change(own)
        put = F.coalesce(F.col("op") == "put", F.lit(False))
        marks = own.withColumns({"base": F.when(put, merge.load(F.col("value"))), "kind": F.when(put, 1).otherwise(0)}).drop("value", "seq", "op", "end_key")
    base = F.when(F.col("kind") == 2, bad).when(F.col("kind") == 1, F.col("base"))
    newer = F.coalesce(F.col("last") > F.col("floor"), F.lit(True))
    none = F.lit(None).cast(points.select(merge.fold(F.col("seq"), merge.load(F.col("value"))).alias("v")).schema["v"].dataType)
    shut = marks.where(~newer & F.col("full")).select("cf", "key", base.alias("base"), none.alias("operands"), F.col("term").alias("seq"), (F.col("kind") > 0).alias("put"), "full", *extra)
    more = points.where("op = 'merge'").select("cf", "key", "seq", "value", *(F.col(c).alias(f"__{c}") for c in extra))
    more = more.join(marks.where(newer), ["cf", "key"]).where("floor is null or seq > floor")
    more = more.groupBy("cf", "key").agg(
        F.max("base").alias("base"), F.max("kind").alias("kind"), merge.fold(F.col("seq"), merge.load(F.col("value"))).alias("operands"), F.max("seq").alias("seq"),
        F.max("full").alias("full"), *(F.max(F.greatest(c, f"__{c}")).alias(c) for c in extra),
    )
    more = more.select("cf", "key", base.alias("base"), "operands", "seq", F.lit(True).alias("put"), "full", *extra)
    return shut.unionByName(more).select("cf", "key", merge.store(merge.join(F.col("base"), F.col("operands"))).alias("value"), "seq", "put", "full", *extra)


def _custom(kept: DataFrame, merge: CustomMerge) -> DataFrame:
    importable(kept.sparkSession)

    def fold(key, rows: list[tuple]) -> list[tuple]:
        puts = [value for _, op, value, *_ in rows if op == "put"]
        operands = [value for _, op, value, *_ in rows if op == "merge"]
        value = puts[-1] if puts else None
        if operands:
            value = merge.full(key, value, operands)
            if value is None:
                raise ValueError(f"MergeFailed: {key!r}")
        return [(rows[-1][0], "put" if operands or puts else "delete", value)]

    rows = by_key(kept.select("cf", "key", "seq", "op", "value"), fold)
    return rows.select("cf", "key", "value", "seq", (F.col("op") == "put").alias("put"))


OUT_BYTES = 4 << 20


def by_key(kept: DataFrame, fold: Callable[[object, list[tuple]], list[tuple]]) -> DataFrame:
    """Rows of ``kept`` (cf, key, seq, op, value, and more numbers) by a function of a key and its operations (seq, op, value, ...), oldest first, in Python.

    It returns (seq, op, value) of what stays; the other columns are the key's greatest. Keys are dealt to tasks, and a task takes them one after another.
    """
    more = kept.columns[5:]
    schema = T.StructType([*kept.schema.fields])
    # by a hash of its own: dealing by the keys that a join has dealt by is left out of a plan, and such a join may split a hot key
    dealt = kept.repartition(F.xxhash64("cf", "key")).sortWithinPartitions("cf", "key", "seq")

    def run(batches):
        types, at, rows, out, size = None, None, [], [], 0

        def close():
            last = [max(r[3 + i] for r in rows) for i in range(len(more))]
            found = [(*at, *x, *last) for x in fold(at[1], rows)]
            out.extend(found)
            return sum(len(x[4] or b"") for x in found) + 64 * len(found)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=kept_names)

        kept_names = ["cf", "key", "seq", "op", "value", *more]
        for batch in batches:
            types = batch.schema.types
            for cf, key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cf, key) != at:
                    if rows:
                        size += close()
                        if size > OUT_BYTES:
                            yield packed()
                            out, size = [], 0
                    at, rows = (cf, key), []
                rows.append(tuple(row))
        if rows:
            close()
        if out:
            yield packed()

    return dealt.mapInArrow(run, schema)


def resolve(log: DataFrame, horizon: int | None = None, merge: Merge | CustomMerge | None = COUNTER, few: int = FEW) -> DataFrame:
    """(cf, key, value, seq) of every key that is present at the horizon; ``seq`` is its newest operation's."""
    rows = folded_numbers(log, horizon, merge, few) if numeric(log, merge) else folded(surviving(log, horizon, few), merge)
    return rows.where("put").select("cf", "key", "value", "seq")
