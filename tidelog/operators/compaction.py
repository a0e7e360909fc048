"""Compaction as queries: pickers over the segment table, and rewrites of a log's versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidelog.functions.merges import COUNTER, CustomMerge, Merge
from tidelog.plans.resolve import by_key, folded, folded_numbers, numeric, surviving
from tidelog.session import importable

LEVELS = 7
L0_TRIGGER = 4
LEVEL_BASE_BYTES, LEVEL_MULTIPLIER = 256 << 20, 10


def level_stats(segments: DataFrame) -> DataFrame:
    """Files and bytes of every level, empty levels included."""
    own = segments.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    levels = segments.sparkSession.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    return levels.join(own, "level", "left").select("level", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def level_target(level: Column, base: int = LEVEL_BASE_BYTES, multiplier: int = LEVEL_MULTIPLIER) -> Column:
    return (F.lit(base) * F.pow(F.lit(multiplier), level - 1)).cast("long")


def pick_level(segments: DataFrame, trigger: int = L0_TRIGGER, base: int = LEVEL_BASE_BYTES, multiplier: int = LEVEL_MULTIPLIER) -> DataFrame:
    """The level to compact: 0 at ``trigger`` files, else the first above its target, but the last; no row if none."""
    stats = level_stats(segments)
    over = F.when(F.col("level") == 0, F.col("files") >= trigger).otherwise((F.col("level") < LEVELS - 1) & (F.col("bytes") > level_target(F.col("level"), base, multiplier)))
    return stats.where(over).orderBy("level").limit(1)


def fifo_drop(segments: DataFrame, cap: int) -> DataFrame:
    """Files to drop, oldest first, until the rest fit in ``cap`` bytes; the newest always stays.

    A running sum over the segment table, which has a row per file and none per key.
    """
    newest = W.Window.orderBy(F.desc("file_id"))
    rows = segments.withColumns({"kept": F.sum("file_size").over(newest.rowsBetween(W.Window.unboundedPreceding, 0)), "nth": F.row_number().over(newest)})
    return rows.where((F.col("kept") > cap) & (F.col("nth") > 1)).drop("kept", "nth")


def universal_pick(segments: DataFrame, ratio: int = 1, min_width: int = 2, amplification: int = 200, max_width: int = 1 << 30) -> DataFrame:
    """One row (reason, file_ids): the newest runs to merge.

    Newest first, a run joins while the group's size times (100 + ratio) / 100 is at least the next run's, up to ``max_width`` runs; ``min_width`` runs
    merge. Else all merge if all but the oldest weigh ``amplification`` percent of the oldest. Null ids if neither holds.
    """
    runs = segments.agg(F.sort_array(F.collect_list(F.struct("file_id", "file_size")), asc=False).alias("runs"))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(group: Column, run: Column) -> Column:
        fits = group["open"] & (group["n"] < max_width) & ((group["n"] == 0) | (group["bytes"] * (100 + ratio) >= 100 * run["file_size"]))
        return F.struct(F.when(fits, group["bytes"] + run["file_size"]).otherwise(group["bytes"]).alias("bytes"), (group["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    rows = runs.select("runs", F.aggregate("runs", start, take, lambda g: g["n"]).alias("n"), F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["file_size"]).alias("all"))
    oldest = F.element_at("runs", -1)["file_size"]
    ids = F.transform("runs", lambda r: r["file_id"])
    picked = (
        F.when(F.col("n") >= min_width, F.struct(F.lit("size_ratio").alias("reason"), F.slice(ids, 1, F.col("n")).alias("file_ids")))
        .when((F.size("runs") > 1) & ((F.col("all") - oldest) * 100 >= oldest * amplification), F.struct(F.lit("amplification").alias("reason"), ids.alias("file_ids")))
    )
    return rows.select(picked["reason"].alias("reason"), picked["file_ids"].alias("file_ids"))


def overlapping(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of ``ranges`` (range_id, lo, hi) and segments that overlap, both ends inclusive; ranges are few and broadcast if the planner finds them small."""
    return ranges.join(segments, (F.col("smallest_key") <= F.col("hi")) & (F.col("largest_key") >= F.col("lo")))


def garbage_collected(log: DataFrame, pin: int | None = None, few: int | None = None) -> DataFrame:
    """Point versions that compaction keeps: those under a tombstone visible at the pin go, then each key's older than its newest put or delete there.

    Without a pin all is at or below. The state at the pin and at any later sequence number is unchanged.
    """
    below = surviving(log, pin, **({} if few is None else {"few": few})).select(*log.columns)
    return below if pin is None else log.where((F.col("op") != "delete_range") & (F.col("seq") > pin)).unionByName(below)


def filtered(points: DataFrame, remove: Column, change: Column | None = None) -> DataFrame:
    """A compaction filter over puts: removed ones become deletes of the same sequence number, ``change`` (null: keep) replaces values."""
    put = F.col("op") == "put"
    value = F.col("value") if change is None else F.when(put, F.coalesce(change, F.col("value"))).otherwise(F.col("value"))
    gone = put & F.coalesce(remove, F.lit(False))
    return points.withColumns({"op": F.when(gone, "delete").otherwise(F.col("op")), "value": F.when(gone, F.lit(None)).otherwise(value)})


def collapsed(log: DataFrame, merge: Merge = COUNTER, extra: tuple[str, ...] = (), change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One operation per key: a put where the chain has a terminator (a delete if nothing is left), else one merged operand; and the greatest of ``extra``.

    ``change`` may replace ``op`` and ``value`` of what no tombstone and no newer version hides, before that is folded.
    """
    if numeric(log, merge):
        rows = folded_numbers(log, None, merge, extra=extra, change=change)
    else:
        kept = surviving(log)
        rows = folded(change(kept) if change else kept, merge, extra)
    op = F.when(~F.col("put"), "delete").when(F.col("full"), "put").otherwise("merge")
    return rows.select("cf", "key", "seq", op.alias("op"), F.when(F.col("put"), F.col("value")).alias("value"), *extra)


def collapsed_custom(log: DataFrame, merge: CustomMerge, extra: tuple[str, ...] = (), change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same by user functions: a chain with a terminator by ``full``, neighbours in one without by ``partial``; what fails stays."""
    importable(log.sparkSession)

    def fold(key, own: list[tuple]) -> list[tuple]:
        rows = [(seq, op, value) for seq, op, value, *_ in own]
        seq, op, base = rows[0]
        if op == "merge":
            out = [rows[0]]
            for later in rows[1:]:
                both = merge.partial(key, out[-1][2], later[2])
                out[-1:] = [out[-1], later] if both is None else [(later[0], "merge", both)]
        else:
            operands = [v for _, _, v in rows[1:]]
            value = merge.full(key, base if op == "put" else None, operands) if operands else None
            out = rows if value is None else [(rows[-1][0], "put", value)]
        return out

    kept = surviving(log)
    return by_key((change(kept) if change else kept).select("cf", "key", "seq", "op", "value", *extra), fold)


def tombstones_unique(log: DataFrame) -> DataFrame:
    """Range tombstones by (start, end, newest first), without repeats."""
    return log.where("op = 'delete_range'").select("cf", "key", "end_key", "seq").distinct()


def stall(l0_files: int, pending_bytes: int, options) -> str:
    """Whether writes run, slow down or stop, by files in level 0 and bytes that wait for compaction."""
    if l0_files >= options.l0_stop or pending_bytes >= options.hard_pending_bytes:
        return "stop"
    return "slowdown" if l0_files >= options.l0_slowdown or pending_bytes >= options.soft_pending_bytes else "run"


def stall_state(segments: DataFrame, slowdown: int, stop: int, pending_bytes: int, soft_bytes: int, hard_bytes: int) -> DataFrame:
    """The same as one row over a segment table."""
    files = F.count(F.when(F.col("level") == 0, 1))
    state = F.when((files >= stop) | F.lit(pending_bytes >= hard_bytes), "stop").when((files >= slowdown) | F.lit(pending_bytes >= soft_bytes), "slowdown").otherwise("run")
    return segments.agg(files.alias("l0_files"), state.alias("state"))
