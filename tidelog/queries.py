"""The query catalogue: every operator as a query over the sample tables, and its DuckDB SQL.

Each entry of ``CATALOGUE`` is (function, SQL or None). Logs are those of :mod:`tidelog.plans.log`; ``HORIZON`` is the
sequence number of the snapshot queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import padded
from tidelog.functions.merges import APPEND, COUNTER
from tidelog.operators import compaction, expiry, histories, introspection, reads, transactions, workloads
from tidelog.plans.log import DEFAULT_CF, ORDERS_CF, conversation_log, dense_log, event_log, moving_log, order_log, table
from tidelog.plans.resolve import live_points, resolve
from tidelog.plans.tombstones import bucket_of, distinct_tombstones, sampled_bounds, skyline_table

HORIZON = 8000
NOW, TTL = 1706572800, 7 * 86400  # 2024-01-30 00:00 UTC, a week

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return register


def key(n: int) -> str:
    return f"{n:012d}"


LOG = """log as (select 1 cf, lpad(user_id::varchar, 12, '0') k, 2 * event_id + 1 seq,
    case event_type when 'purchase' then 'merge' when 'error' then 'delete' else 'put' end op, round(value * 100)::bigint v, floor(epoch(ts))::bigint unix from events),
rt as (select lpad(user_id::varchar, 12, '0') s, lpad((user_id + 10)::varchar, 12, '0') e, 2 * event_id + 2 rseq from events where event_id % 1000 = 999)"""


def live_sql(horizon: int | None = None, log: str = "log", rt: str = "rt") -> str:
    seen, cut = (f"where seq <= {horizon}", f"rseq <= {horizon} and") if horizon is not None else ("where true", "")
    return f"live as (select * from {log} {seen} and not exists (select 1 from {rt} where {cut} k >= s and k < e and rseq > seq))"


STATE = """t as (select *, max(case when op <> 'merge' then seq end) over (partition by k) term from live),
u as (select * from t where term is null or seq >= term),
state as (select k, coalesce(max(case when op = 'put' then v end), 0) + coalesce(sum(case when op = 'merge' then v end), 0)::bigint v, max(seq) seq
    from u group by k having max(case when op = 'put' then v end) is not null or sum(case when op = 'merge' then v end) is not null)"""


def state_sql(horizon: int | None = None) -> str:
    return f"with {LOG}, {live_sql(horizon)}, {STATE}"


NOW_STATE = state_sql()


def state(spark: SparkSession, sf_dir: str, horizon: int | None = None) -> DataFrame:
    return resolve(event_log(spark, sf_dir), horizon, COUNTER)


def kv(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("k"), F.col("value").alias("v"), "seq")


def rows_of(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- point reads and ranges


@query(f"{NOW_STATE} select k, v, seq from state")
def kv_scan_latest(spark, sf):
    return kv(state(spark, sf))


@query(f"{state_sql(HORIZON)} select k, v, seq from state")
def kv_snapshot_scan(spark, sf):
    return kv(state(spark, sf, HORIZON))


@query(f"{NOW_STATE} select k, v, seq from state where k = '{key(7)}'")
def kv_point_get(spark, sf):
    own = event_log(spark, sf)
    # the key reaches both sides of the log: points of the key, and tombstones that may cover it
    near = own.where((F.col("key") == key(7)) | ((F.col("op") == "delete_range") & (F.col("key") <= key(7)) & (F.col("end_key") > key(7))))
    return kv(reads.get(resolve(near, None, COUNTER), key(7)))


_ASKED = [0, 3, 7, 7, 12, 14, 99, 149, 150, 999999]


@query(f"{NOW_STATE} select x.k, state.k is not null present from (select distinct unnest([{', '.join(repr(key(n)) for n in _ASKED)}]) k) x left join state on state.k = x.k")
def kv_has(spark, sf):
    asked = rows_of(spark, "key string", *((key(n),) for n in sorted(set(_ASKED))))
    near = reads.near_keys(event_log(spark, sf), asked, [key(n) for n in sorted(set(_ASKED))])
    return reads.has(resolve(near, None, COUNTER), asked, few=True).select(F.col("key").alias("k"), "present")


@query(f"{NOW_STATE} select k, strlen(v::varchar)::bigint size from state")
def kv_get_size(spark, sf):
    return state(spark, sf).select(F.col("key").alias("k"), reads.value_size(F.col("value").cast("string")).cast("long").alias("size"))


@query(f"{NOW_STATE} select x.ord, x.k, state.v from (select unnest(range({len(_ASKED)}))::bigint ord, unnest([{', '.join(repr(key(n)) for n in _ASKED)}]) k) x left join state on state.k = x.k")
def kv_multi_get(spark, sf):
    asked = rows_of(spark, "ord long, key string", *((i, key(n)) for i, n in enumerate(_ASKED)))
    near = reads.near_keys(event_log(spark, sf), asked, [key(n) for n in sorted(set(_ASKED))])
    return reads.multi_get(resolve(near, None, COUNTER), asked, few=True).select("ord", F.col("key").alias("k"), F.col("value").alias("v"))


@query(f"{NOW_STATE} select s_suppkey ord, x.k, state.v from (select s_suppkey, lpad((s_suppkey * 7)::varchar, 12, '0') k from supplier) x left join state on state.k = x.k")
def kv_multi_get_table(spark, sf):
    """As many requests as there are suppliers."""
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), padded(F.col("s_suppkey") * 7).alias("key"))
    near = reads.near_keys(event_log(spark, sf), asked)
    return reads.multi_get(resolve(near, None, COUNTER), asked).select("ord", F.col("key").alias("k"), F.col("value").alias("v"))


@query(f"{NOW_STATE} select k, v, seq from state where k >= '{key(5)}' and k < '{key(50)}'")
def kv_range_scan(spark, sf):
    return kv(reads.scan(state(spark, sf), key(5), key(50)))


@query(f"{NOW_STATE} select k, v, seq from state where starts_with(k, '00000000001')")
def kv_prefix_scan(spark, sf):
    return kv(reads.scan_prefix(state(spark, sf), "00000000001"))


@query(f"{NOW_STATE} select k, v, row_number() over (order by k desc) pos from state where k < '{key(100)}' order by k desc limit 20")
def kv_reverse_scan(spark, sf):
    from pyspark.sql import window as W

    top = reads.reverse(state(spark, sf), None, key(100)).limit(20)
    return top.select(F.col("key").alias("k"), F.col("value").alias("v"), F.row_number().over(W.Window.orderBy(F.desc("key"))).cast("long").alias("pos"))


def _page_sql(start: str) -> str:
    return f"""{NOW_STATE}, top as (select k, v, row_number() over (order by k) pos from state where k >= {start}),
    ahead as (select k from top where pos = 6) select top.k, v, pos, (select k from ahead) next_start from top where pos <= 5"""


@query(_page_sql(f"'{key(2)}'"))
def kv_scan_page(spark, sf):
    return reads.page(state(spark, sf), key(2), None, 5).select(F.col("key").alias("k"), F.col("value").alias("v"), F.col("pos").cast("long").alias("pos"), "next_start")


@query(_page_sql(f"(select k from (select k, row_number() over (order by k) n from state where k >= '{key(2)}') where n = 6)"))
def kv_page_next(spark, sf):
    own = state(spark, sf)
    following = reads.page(own, key(2), None, 5).first().next_start  # the cursor that a caller would hold
    return reads.page(own, following, None, 5).select(F.col("key").alias("k"), F.col("value").alias("v"), F.col("pos").cast("long").alias("pos"), "next_start")


_TARGETS = [key(0), key(4) + "x", "", key(149), "z"]
_TARGET_SQL = f"(select unnest([{', '.join(repr(t) for t in _TARGETS)}]) target)"


@query(f"{NOW_STATE} select target, (select min(k) from state where k >= target) found from {_TARGET_SQL}")
def kv_seek_ceil(spark, sf):
    return reads.seek_many(state(spark, sf), rows_of(spark, "target string", *((t,) for t in _TARGETS)))


@query(f"{NOW_STATE} select target, (select max(k) from state where k <= target) found from {_TARGET_SQL}")
def kv_seek_floor(spark, sf):
    return reads.seek_many(state(spark, sf), rows_of(spark, "target string", *((t,) for t in _TARGETS)), floor=True)


@query(f"{NOW_STATE} select target, (select min(k) from state where k >= target) found from (select distinct lpad((s_suppkey * 13)::varchar, 12, '0') target from supplier)")
def kv_seek_ceil_table(spark, sf):
    """As many targets as there are suppliers: beyond a few they are carried along with the keys."""
    asked = table(spark, sf, "supplier").select(padded(F.col("s_suppkey") * 13).alias("target")).distinct()
    return reads.seek_many(state(spark, sf), asked, few=50)


@query(f"{NOW_STATE} select 'first' what, min(k) k from state union all select 'last', max(k) from state union all select 'before', max(k) from state where k < '{key(9)}'")
def kv_seek_ends(spark, sf):
    own = state(spark, sf)
    found = [("first", reads.first(own)), ("last", reads.last(own)), ("before", reads.seek_before(own, key(9)))]
    parts = [rows.select(F.lit(what).alias("what"), F.col("key").alias("k")) for what, rows in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"{NOW_STATE} select k, lag(k) over (order by k) prev_k, lead(k) over (order by k) next_k from state")
def kv_next_prev(spark, sf):
    return reads.steps(state(spark, sf), event_log(spark, sf).select("key").distinct()).select(F.col("key").alias("k"), F.col("prev_key").alias("prev_k"), F.col("next_key").alias("next_k"))


# --- range deletes and merges


@query(f"with {LOG} select k, seq, max(rseq) covered_by from log join rt on k >= s and k < e and rseq > seq group by k, seq")
def kv_delete_range_effect(spark, sf):
    from tidelog.plans.tombstones import cover

    log = event_log(spark, sf)
    hidden = cover(log.where("op <> 'delete_range'"), distinct_tombstones(log)).where("cover > seq")
    return hidden.select(F.col("key").alias("k"), "seq", F.col("cover").alias("covered_by"))


@query(f"""with {LOG}, p as (select s x from rt union select e from rt), piece as (select x lo, lead(x) over (order by x) hi from p),
covered as (select lo, hi, (select max(rseq) from rt where s <= lo and e > lo) r from piece where hi is not null),
marked as (select *, case when lag(r) over (order by lo) = r and lag(hi) over (order by lo) = lo then 0 else 1 end fresh from covered where r is not null),
island as (select *, sum(fresh) over (order by lo) g from marked) select min(lo) s, max(hi) e, max(r) rseq from island group by g""")
def kv_tombstone_skyline(spark, sf):
    rows = distinct_tombstones(event_log(spark, sf))
    return skyline_table(rows, sampled_bounds(rows, rows.count())).select("s", "e", "rseq")


DENSE = LOG[: LOG.index("rt as")] + "rt as (select lpad(user_id::varchar, 12, '0') s, lpad((user_id + 2 + event_id % 5)::varchar, 12, '0') e, 2 * event_id + 2 rseq from events where event_type = 'error')"


@query(f"with {DENSE}, {live_sql()}, {STATE} select k, v, seq from state")
def kv_dense_ranges(spark, sf):
    """The state of a log with a fifth as many range deletes as operations."""
    return kv(resolve(dense_log(spark, sf), None, COUNTER))


@query(f"""with {LOG}, {live_sql()}, t as (select *, max(case when op <> 'merge' then seq end) over (partition by k) term from live)
select k, max(case when op = 'put' then v end) base, sum(case when op = 'merge' then v end)::bigint operand_sum, count(case when op = 'merge' then 1 end) operands
from t where term is null or seq >= term group by k having count(case when op = 'merge' then 1 end) > 0""")
def kv_merge_counter(spark, sf):
    from tidelog.plans.resolve import to_terminator

    kept = to_terminator(live_points(event_log(spark, sf)))
    merged = F.when(F.col("op") == "merge", F.col("value"))
    rows = kept.groupBy(F.col("key").alias("k")).agg(F.max(F.when(F.col("op") == "put", F.col("value"))).alias("base"), F.sum(merged).alias("operand_sum"), F.count(merged).alias("operands"))
    return rows.where("operands > 0")


@query("select lpad(conv_id::varchar, 12, '0') k, string_agg(text, '' order by turn) v, max(turn) seq from conversations group by conv_id having count(text) > 0")
def kv_merge_append(spark, sf):
    return kv(resolve(conversation_log(spark, sf), None, APPEND))


def _op_count(op: str) -> str:
    return f"count(case when op = '{op}' then 1 end)"


@query(f"with {LOG} select k, {_op_count('put')} puts, {_op_count('delete')} deletes, {_op_count('merge')} merges, min(seq) first_seq, max(seq) last_seq from log group by k")
def kv_version_history(spark, sf):
    return introspection.version_history(event_log(spark, sf)).withColumnRenamed("key", "k")


@query(f"with {LOG} select count(*) entries, sum(strlen(k) + 13 + strlen(v::varchar))::bigint bytes from log where k >= '{key(3)}' and k < '{key(60)}'")
def kv_memtable_stats(spark, sf):
    return introspection.memory_stats(event_log(spark, sf), key(3), key(60))


# --- compaction


def _gc_sql(pin: int | None) -> str:
    below = "true" if pin is None else f"seq <= {pin}"
    cut = "" if pin is None else f"rseq <= {pin} and"
    return f"""with {LOG}, shadowed as (select * from log where not ({below}) or not exists (select 1 from rt where {cut} k >= s and k < e and rseq > seq)),
    w as (select *, coalesce(sum(case when op <> 'merge' and {below} then 1 else 0 end) over (partition by k order by seq desc rows between unbounded preceding and 1 preceding), 0) newer from shadowed)
    select k, seq, op, v from w where not ({below}) or newer = 0"""


def _versions(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("k"), "seq", "op", F.col("value").alias("v"))


@query(_gc_sql(HORIZON))
def kv_gc_pin(spark, sf):
    return _versions(compaction.garbage_collected(event_log(spark, sf), HORIZON))


@query(_gc_sql(None))
def kv_gc_nopin(spark, sf):
    return _versions(compaction.garbage_collected(event_log(spark, sf)))


@query(f"""with {LOG}, changed as (select cf, k, seq, case when op = 'put' and v < 10000 then 'delete' else op end op,
    case when op = 'put' and v < 10000 then null when op = 'put' and v >= 40000 then 40000 else v end v from log), {live_sql(log='changed')}, {STATE} select k, v, seq from state""")
def kv_filter_remove(spark, sf):
    log = event_log(spark, sf)
    cut = F.when(F.col("value") >= 40000, F.lit(40000))
    return kv(resolve(compaction.filtered(log, F.col("value") < 10000, cut), None, COUNTER))


@query(f"""with {LOG}, {live_sql()}, t as (select *, max(case when op <> 'merge' then seq end) over (partition by k) term from live), u as (select * from t where term is null or seq >= term)
select k, max(seq) seq, case when count(case when op in ('put', 'merge') then 1 end) = 0 then 'delete' when max(term) is not null then 'put' else 'merge' end op,
case when count(case when op in ('put', 'merge') then 1 end) > 0 then coalesce(max(case when op = 'put' then v end), 0) + coalesce(sum(case when op = 'merge' then v end), 0)::bigint end v from u group by k""")
def kv_merge_collapse(spark, sf):
    return _versions(compaction.collapsed(event_log(spark, sf), COUNTER))


@query(f"with {LOG} select distinct s, e, rseq from rt")
def kv_tombstones_unique(spark, sf):
    return compaction.tombstones_unique(event_log(spark, sf)).select(F.col("key").alias("s"), F.col("end_key").alias("e"), F.col("seq").alias("rseq"))


SEGMENT_SQL = """segment as (select file_id, (file_id * file_id % 4)::integer lvl, min(lpad(user_id::varchar, 12, '0')) smallest_key, max(lpad(user_id::varchar, 12, '0')) largest_key,
    sum(25 + strlen(round(value * 100)::bigint::varchar))::bigint file_size, count(*) num_entries
    from (select *, event_id // 250 - event_id // 250 % (1 + event_id // 1000 % 3) + user_id % 3 * 1000000 file_id from events) group by file_id)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in runs of neighbours by time and thirds of the users, of unequal sizes, over levels 0 to 3."""
    block = "event_id div 250 - (event_id div 250) % (1 + (event_id div 1000) % 3)"
    events = table(spark, sf_dir, "events").withColumn("file_id", F.expr(f"{block} + user_id % 3 * 1000000"))
    k, size = padded(F.col("user_id")), 25 + F.length(F.round(F.col("value") * 100).cast("long").cast("string"))
    rows = events.groupBy("file_id").agg(F.min(k).alias("smallest_key"), F.max(k).alias("largest_key"), F.sum(size).cast("long").alias("file_size"), F.count("*").alias("num_entries"))
    return rows.withColumn("level", F.expr("cast(file_id * file_id % 4 as int)"))


@query(f"with {SEGMENT_SQL} select file_id from (select file_id, sum(file_size) over (order by file_id desc) kept, row_number() over (order by file_id desc) n from segment) where kept > 20000 and n > 1")
def kv_fifo_drop(spark, sf):
    return compaction.fifo_drop(segments(spark, sf), 20000).select("file_id")


@query(f"""with recursive {SEGMENT_SQL}, run as (select file_id, file_size, row_number() over (order by file_id desc) n from segment),
grow as (select n, file_size bytes from run where n = 1 union all select run.n, grow.bytes + run.file_size from grow join run on run.n = grow.n + 1 and grow.bytes * 125 >= 100 * run.file_size),
width as (select max(n) n from grow), total as (select sum(file_size) s, (select file_size from run order by n desc limit 1) o, count(*) c from run)
select case when width.n >= 2 then 'size_ratio' when c > 1 and (s - o) * 100 >= o * 200 then 'amplification' end reason,
  case when width.n >= 2 then (select string_agg(file_id::varchar, ',' order by file_id desc) from run where run.n <= width.n) when c > 1 and (s - o) * 100 >= o * 200 then (select string_agg(file_id::varchar, ',' order by file_id desc) from run) end file_ids from width, total""")
def kv_universal_pick(spark, sf):
    return compaction.universal_pick(segments(spark, sf), ratio=25).select("reason", F.array_join("file_ids", ",").alias("file_ids"))


@query(f"""with {SEGMENT_SQL}, stats as (select l.lvl, count(file_id) files, coalesce(sum(file_size), 0) bytes from (select unnest(range(7))::integer lvl) l left join segment on segment.lvl = l.lvl group by l.lvl)
select lvl "level", files from stats where case when lvl = 0 then files >= 400 else lvl < 6 and bytes > 4000 * power(10, lvl - 1) end order by lvl limit 1""")
def kv_level_pick(spark, sf):
    return compaction.pick_level(segments(spark, sf), trigger=400, base=4000).select("level", "files")


_RANGES = [(0, key(3), key(7)), (1, key(100), key(120)), (2, key(9), key(4)), (3, "a", "b"), (4, key(0), key(0))]
_RANGE_SQL = "(values " + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in _RANGES) + ")"


@query(f"with {SEGMENT_SQL} select range_id::bigint range_id, file_id from {_RANGE_SQL} r(range_id, lo, hi) join segment on smallest_key <= hi and largest_key >= lo")
def kv_overlap(spark, sf):
    return compaction.overlapping(segments(spark, sf), rows_of(spark, "range_id long, lo string, hi string", *_RANGES)).select("range_id", "file_id")


@query(f"""with {SEGMENT_SQL} select r.ord::bigint ord, coalesce(sum(file_size), 0)::bigint bytes from {_RANGE_SQL} r(ord, lo, hi) left join segment on smallest_key < hi and largest_key >= lo and lo < hi group by r.ord""")
def kv_approx_sizes(spark, sf):
    return introspection.approximate_sizes(segments(spark, sf), rows_of(spark, "ord long, lo string, hi string", *_RANGES))


@query(f"""with {SEGMENT_SQL} select l.lvl "level", count(file_id) files, coalesce(sum(file_size), 0)::bigint bytes from (select unnest(range(7))::integer lvl) l left join segment on segment.lvl = l.lvl group by l.lvl""")
def kv_levelstats(spark, sf):
    return compaction.level_stats(segments(spark, sf))


@query(f"with {SEGMENT_SQL} select count(case when lvl = 0 then 1 end) l0_files, case when count(case when lvl = 0 then 1 end) >= 36000 or sum(file_size) >= {1 << 40} then 'stop' when count(case when lvl = 0 then 1 end) >= 4000 or sum(file_size) >= 100000 then 'slowdown' else 'run' end state from segment")
def kv_write_stall(spark, sf):
    size = segments(spark, sf).agg(F.sum("file_size")).first()[0]
    return compaction.stall_state(segments(spark, sf), 4000, 36000, size, 100_000, 1 << 40)


@query(f"with {SEGMENT_SQL} select sum(num_entries)::bigint keys from segment")
def kv_estimate_keys(spark, sf):
    return introspection.estimated_keys(segments(spark, sf))


@query("select event_type, count(v) n, sum(v)::bigint total, min(v) least, max(v) most, (sum(v) // count(v))::bigint average from (select event_type, round(value * 100)::bigint v from events) group by event_type")
def kv_histogram(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return introspection.histogram(rows, "v", "event_type")


# --- time to live


_TTL_STATE = f"""with {LOG}, {live_sql()}, newest as (select k, arg_max(op, seq) op, arg_max(v, seq) v, arg_max(unix, seq) unix, max(seq) seq from live where op <> 'merge' group by k)"""


@query(f"{_TTL_STATE} select k, v, seq from newest where op = 'put' and not (unix < {NOW - TTL})")
def kv_ttl_scan(spark, sf):
    return kv(expiry.unexpired(expiry.stamped_puts(event_log(spark, sf)), F.lit(NOW), TTL))


@query(f"{_TTL_STATE} select k, unix, seq from newest where op = 'put' and unix < {NOW - 3600}")
def kv_ttl_expired(spark, sf):
    rows = expiry.stamped_puts(event_log(spark, sf))
    return rows.where(expiry.expired(F.col("commit_unix"), F.lit(NOW), 3600)).select(F.col("key").alias("k"), F.col("commit_unix").alias("unix"), "seq")


# --- column families, ingest


@query(f"{NOW_STATE} select 1 cf, k, v from state union all select 2, lpad(o_orderkey::varchar, 12, '0'), round(o_totalprice * 100)::bigint from orders")
def kv_cf_union(spark, sf):
    both = event_log(spark, sf).unionByName(order_log(spark, sf))
    return resolve(both, None, COUNTER).select("cf", F.col("key").alias("k"), F.col("value").alias("v"))


@query(f"{NOW_STATE} select 1 cf, count(*) n from state")
def kv_cf_drop(spark, sf):
    both = event_log(spark, sf).unionByName(order_log(spark, sf))
    dropped = rows_of(spark, both.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), (ORDERS_CF, "", 1 << 40, "delete_range", None, "~", 0))
    return resolve(both.unionByName(dropped), None, COUNTER).groupBy("cf").agg(F.count("*").alias("n"))


@query(f"""{NOW_STATE}, file as (select lpad(c_custkey::varchar, 12, '0') k, round(c_acctbal * 100)::bigint v from customer)
select coalesce(file.k, state.k) k, case when file.k is not null then file.v else state.v end v from state full join file on file.k = state.k""")
def kv_ingest_overlay(spark, sf):
    log = event_log(spark, sf)
    latest = log.agg(F.max("seq")).first()[0]
    # one new sequence number for a file; no operation of the log has it
    file = table(spark, sf, "customer").select(
        F.lit(DEFAULT_CF).alias("cf"), padded(F.col("c_custkey")).alias("key"), F.lit(latest + 1).cast("long").alias("seq"), F.lit("put").alias("op"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("value"), F.lit(None).cast("string").alias("end_key"), F.lit(0).cast("long").alias("commit_unix"),
    )
    return kv(resolve(log.unionByName(file), None, COUNTER)).drop("seq")


# --- transactions


def _buffered(own: DataFrame) -> DataFrame:
    kept = own.where(f"seq % 2 = 1 and key < '{key(100)}'").select("key", F.when(F.expr("seq % 3 = 0"), "delete").otherwise("put").alias("op"), (F.col("seq") * 10).alias("value"))
    fresh = own.sparkSession.range(5, 9).select(F.concat(F.lit("00000000000"), F.col("id").cast("string")).alias("key"), F.lit("put").alias("op"), F.col("id").alias("value"))
    return fresh.unionByName(kept.join(fresh.select("key"), "key", "left_anti"))


_OVERLAY_SQL = f"""{NOW_STATE}, fresh as (select '00000000000' || x k, 'put' op, x::bigint v from (select unnest(range(5, 9)) x)),
buffered as (select * from fresh union all select k, case when seq % 3 = 0 then 'delete' else 'put' end, seq * 10 from state where seq % 2 = 1 and k < '{key(100)}' and k not in (select k from fresh)),
seen as (select coalesce(b.k, state.k) k, case when b.op = 'put' then b.v else state.v end v, case when b.op = 'put' then 'buffer' else 'snapshot' end origin from state full join buffered b on b.k = state.k where b.op is null or b.op <> 'delete')"""


@query(f"{_OVERLAY_SQL} select k, v, origin from seen")
def kv_txn_overlay_fwd(spark, sf):
    own = state(spark, sf)
    return transactions.overlay(own, _buffered(own)).select(F.col("key").alias("k"), F.col("value").alias("v"), "origin")


@query(f"{_OVERLAY_SQL} select k, v, origin, row_number() over (order by k desc) pos from seen order by k desc limit 10")
def kv_txn_overlay_rev(spark, sf):
    from pyspark.sql import window as W

    own = state(spark, sf)
    rows = transactions.overlay(own, _buffered(own)).orderBy(F.desc("key")).limit(10)
    return rows.select(F.col("key").alias("k"), F.col("value").alias("v"), "origin", F.row_number().over(W.Window.orderBy(F.desc("key"))).cast("long").alias("pos"))


_TXN_SQL = f"""{NOW_STATE}, txn as (select t txn_id, (select max(seq) from log) - 20 * t snapshot_seq from (select unnest(range(50)) t)),
rd as (select txn_id, lpad((txn_id * 3 % 150)::varchar, 12, '0') k, snapshot_seq seq, txn_id % 2 = 0 upd from txn union all select txn_id, lpad(((txn_id * 7 + 1) % 150)::varchar, 12, '0'), snapshot_seq + 4, false from txn),
wr as (select txn_id, lpad((txn_id * 3 % 150)::varchar, 12, '0') k from txn where txn_id % 3 = 0 union select txn_id, lpad((txn_id * 11 % 150)::varchar, 12, '0') from txn),
seen as (select txn_id, k, min(seq) seq, bool_or(upd) upd from rd group by txn_id, k),
newest as (select k, max(seq) latest from (select k, seq from log union all select x.k, rseq from rt join (select distinct k from rd union select k from wr) x on x.k >= s and x.k < e) group by k)"""


def _txn_history(spark: SparkSession, sf_dir: str):
    log = event_log(spark, sf_dir)
    latest = log.where("op <> 'delete_range'").agg(F.max("seq")).first()[0]
    txns = spark.range(50).select(F.col("id").alias("txn_id"), (F.lit(latest) - 20 * F.col("id")).alias("snapshot_seq"))
    t, snapshot = F.col("txn_id"), F.col("snapshot_seq")
    read = txns.select(t, padded(t * 3 % 150).alias("key"), snapshot.alias("seq"), (t % 2 == 0).alias("for_update"))
    read = read.unionByName(txns.select(t, padded((t * 7 + 1) % 150).alias("key"), (snapshot + 4).alias("seq"), F.lit(False).alias("for_update")))
    write = txns.where("txn_id % 3 = 0").select(t, padded(t * 3 % 150).alias("key")).unionByName(txns.select(t, padded(t * 11 % 150).alias("key"))).distinct()
    return log, txns, read, write


def _conflicts(spark: SparkSession, sf_dir: str, isolation: str) -> DataFrame:
    log, txns, read, write = _txn_history(spark, sf_dir)
    checked = transactions.validation_set(txns, read, write, isolation)
    lost = transactions.conflicts(checked, log.where("op <> 'delete_range'"), log)
    return lost.select("txn_id", F.col("key").alias("k"), "observed", "latest")


def _conflict_sql(wanted: str) -> str:
    return f"""{_TXN_SQL}, checked as (select seen.txn_id, seen.k, seen.seq from seen left join wr on wr.txn_id = seen.txn_id and wr.k = seen.k where {wanted}
    union all select wr.txn_id, wr.k, snapshot_seq from wr join txn using (txn_id) where not exists (select 1 from rd where rd.txn_id = wr.txn_id and rd.k = wr.k))
    select txn_id, k, seq observed, latest from checked join newest using (k) where latest > seq"""


@query(_conflict_sql("wr.k is not null"))
def kv_txn_conflicts_rc(spark, sf):
    return _conflicts(spark, sf, transactions.READ_COMMITTED)


@query(_conflict_sql("wr.k is not null or upd"))
def kv_txn_conflicts_si(spark, sf):
    return _conflicts(spark, sf, transactions.SNAPSHOT)


@query(_conflict_sql("true"))
def kv_txn_conflicts_ser(spark, sf):
    return _conflicts(spark, sf, transactions.SERIALIZABLE)


@query(f"""{NOW_STATE}, wr as (select seq % 50 txn_id, k, case when seq % 4 = 1 then v else v + 1 end v, seq - 1 snapshot from state)
select txn_id, wr.k, snapshot observed, state.seq latest from wr join state using (k) where state.seq > snapshot and not (wr.v = state.v)""")
def kv_idempotent_elision(spark, sf):
    own = state(spark, sf)
    write = own.select((F.col("seq") % 50).alias("txn_id"), "key", F.lit("put").alias("op"), F.when(F.expr("seq % 4 = 1"), F.col("value")).otherwise(F.col("value") + 1).alias("value"), (F.col("seq") - 1).alias("seq"))
    lost = write.select("txn_id", "key", "seq", F.lit(True).alias("blind")).join(own.select("key", F.col("seq").alias("latest")), "key").where("latest > seq")
    lost = lost.select("txn_id", "key", F.col("seq").alias("observed"), "latest", "blind")
    return transactions.without_identical(lost, write, own).select("txn_id", F.col("key").alias("k"), "observed", "latest")


# --- histories


_APPEND_SQL = """ap as (select event_id append_id, user_id || '/' || event_id // 500 k, event_id completed, event_id % 997 v from events where event_type = 'purchase'),
rd as (select r.event_id read_id, r.user_id || '/' || r.event_id // 500 k, r.event_id invoked, list(a.v) l from events r left join ap a on a.k = r.user_id || '/' || r.event_id // 500 and a.completed < r.event_id and (a.completed + r.event_id) % 11 <> 0
  where r.event_type = 'view' group by r.event_id, r.user_id)"""


def _appends(spark: SparkSession, sf_dir: str):
    events = table(spark, sf_dir, "events").withColumn("key", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.expr("event_id div 500").cast("string")))
    appends = events.where("event_type = 'purchase'").select(F.col("event_id").alias("append_id"), "key", F.col("event_id").alias("completed"), (F.col("event_id") % 997).alias("value"))
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("read_id"), "key", F.col("event_id").alias("invoked"))
    seen = views.join(appends, "key", "left").groupBy("read_id", "key", "invoked").agg(F.collect_list(F.when((F.col("completed") < F.col("invoked")) & ((F.col("completed") + F.col("read_id")) % 11 != 0), F.col("value"))).alias("list"))
    return appends, seen


@query(f"with {_APPEND_SQL} select ap.k, append_id, read_id, ap.v from rd join ap on ap.k = rd.k and invoked > completed and not coalesce(list_contains(l, ap.v), false) order by read_id, append_id limit 32")
def kv_lost_appends(spark, sf):
    appends, seen = _appends(spark, sf)
    return histories.lost_appends(appends, seen).select(F.col("key").alias("k"), "append_id", "read_id", F.col("value").alias("v"))


@query(f"""with {LOG} select read_id, k, seen, latest from (select 2 * r.event_id + 1 read_id, lpad(r.user_id::varchar, 12, '0') k, (r.event_id * 7) % (2 * r.event_id + 1) seen,
  (select max(seq) from log where log.k = lpad(r.user_id::varchar, 12, '0') and op = 'put' and log.seq < 2 * r.event_id + 1) latest from events r where event_type = 'view') where latest > seen""")
def kv_stale_reads(spark, sf):
    events = table(spark, sf, "events")
    write = event_log(spark, sf).where("op = 'put'").select("key", F.col("seq").alias("completed"), F.col("seq").alias("version"))
    at = 2 * F.col("event_id") + 1
    read = events.where("event_type = 'view'").select(at.alias("read_id"), padded(F.col("user_id")).alias("key"), at.alias("invoked"), ((F.col("event_id") * 7) % at).alias("seen"))
    return histories.stale_reads(write, read).select("read_id", F.col("key").alias("k"), "seen", "latest")


@query(f"""with {LOG}, last as (select k, case when arg_max(op, seq) = 'put' then arg_max(v, seq) end v from log where op <> 'merge' group by k),
store as (select k, case when seq % 3 = 0 then v + 1 else v end v from (select k, arg_max(v, seq) v, max(seq) seq from log where op = 'put' group by k))
select coalesce(last.k, store.k) k, last.v expected, store.v actual from last full join store on store.k = last.k where last.v is distinct from store.v""")
def kv_shadow_verify(spark, sf):
    points = event_log(spark, sf).where("op in ('put', 'delete')")
    puts = points.where("op = 'put'").groupBy("key").agg(F.max(F.struct("seq", "value")).alias("x"))
    actual = puts.select("key", F.when(F.expr("x.seq % 3 = 0"), F.col("x.value") + 1).otherwise(F.col("x.value")).alias("value"))
    return histories.shadow_differences(histories.last_operations(points), actual).withColumnRenamed("key", "k")


@query("""select process, op_id, invoked, completed, type from (select user_id % 8 process, event_id completed, case when event_type in ('view', 'click') then 'invoke' when event_type = 'error' then 'fail' else 'ok' end type,
  lag(case when event_type in ('view', 'click') then 'invoke' else 'x' end) over w b, lag(event_id) over w invoked, lag(event_id) over w op_id from events window w as (partition by user_id % 8 order by event_id)) where type <> 'invoke' and b = 'invoke'""")
def kv_invoke_complete(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "invoke").when(F.col("event_type") == "error", "fail").otherwise("ok")
    rows = table(spark, sf, "events").select((F.col("user_id") % 8).alias("process"), F.col("event_id").alias("index"), F.col("event_id").alias("time"), kind.alias("type"))
    return histories.paired(rows)


_SKEW_SQL = """rd as (select event_id txn_id, unnest([0, 1]) side, event_id // 2 pair, event_id // 2 * 2 seq from events),
wr as (select event_id txn_id, event_id % 2 side, event_id // 2 pair, event_id // 2 * 2 + user_id % 3 seq from events where event_type <> 'error'),
crossing as (select distinct rd.txn_id a, wr.txn_id b from rd join wr on wr.pair = rd.pair and wr.side = rd.side where rd.txn_id <> wr.txn_id and wr.seq > rd.seq)"""


@query(f"with {_SKEW_SQL} select x.a, x.b from crossing x join crossing y on y.a = x.b and y.b = x.a where x.a < x.b")
def kv_write_skew(spark, sf):
    # Neighbouring events are pairs of transactions that read x and y of their pair; the even one writes x, the odd one y.
    events = table(spark, sf, "events").withColumn("start", F.expr("event_id div 2 * 2"))
    name = lambda side: F.concat(side.cast("string"), F.lit("/"), F.col("start").cast("string"))
    read = events.select(F.col("event_id").alias("txn_id"), F.explode(F.array(name(F.lit(0)), name(F.lit(1)))).alias("key"), F.col("start").alias("seq"))
    write = events.where("event_type <> 'error'").select(F.col("event_id").alias("txn_id"), name(F.col("event_id") % 2).alias("key"), (F.col("start") + F.col("user_id") % 3).alias("seq"))
    return histories.write_skews(read, write)


_RUNS = "select event_type name, round(avg(value), 6) median, min(value) + 50 low, max(value) / 2 + 60 high from events where event_id % 2 = {} group by event_type"


@query(f"""with b as ({_RUNS.format(0)}), n as ({_RUNS.format(1)}), j as (select b.name, round((n.median - b.median) * 100.0 / b.median, 3) change_pct, n.low <= b.high and b.low <= n.high overlap from b join n using (name))
select name, change_pct, overlap, case when overlap or abs(change_pct) < 1 then 'same' when change_pct > 0 then 'up' else 'down' end verdict from j""")
def kv_perf_compare(spark, sf):
    def run(n: int) -> DataFrame:
        own = table(spark, sf, "events").where(F.col("event_id") % 2 == n).groupBy(F.col("event_type").alias("name"))
        return own.agg(F.round(F.avg("value"), 6).alias("median"), (F.min("value") + 50).alias("low"), (F.max("value") / 2 + 60).alias("high"))

    return histories.run_comparison(run(0), run(1), 1.0)


@query("select user_id % 7 client, event_type op, count(*) n from events group by 1, 2")
def kv_ycsb_mix(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("client"), F.col("event_type").alias("op")).agg(F.count("*").alias("n"))


@query("""with x as (select event_type op, round(value * 100)::bigint v from events), r as (select *, row_number() over (partition by op order by v) - 1 i, count(*) over (partition by op) n from x)
select op, max(n) n, (sum(v) // max(n))::bigint average, min(case when i = n * 99 // 100 then v end) p99 from r group by op""")
def kv_latency_summary(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return introspection.ranked_latency(rows, "v", "op")


# --- generated workloads


_ZIPF_ETA, _ZIPF_WHOLE = (1 - (2 / 1000) ** (1 - 0.99)) / (1 - workloads.zeta(2, 0.99) / workloads.zeta(1000, 0.99)), workloads.zeta(1000, 0.99)


@query(f"""with x as (select (event_id * 7919 % 100003) / 100003.0::double u from events) select case when u * {_ZIPF_WHOLE!r} < 1 then 0 when u * {_ZIPF_WHOLE!r} < {1 + 0.5**0.99!r} then 1
  else least(floor(1000 * power({_ZIPF_ETA!r}::double * u - {_ZIPF_ETA!r}::double + 1, {1 / (1 - 0.99)!r}::double)), 999) end::bigint rank, count(*) n from x group by 1""")
def kv_zipf_ranks(spark, sf):
    u = (F.col("event_id") * 7919 % 100003) / F.lit(100003.0)
    return table(spark, sf, "events").groupBy(workloads.zipf(u, 1000).alias("rank")).agg(F.count("*").alias("n"))


def _mix_sql() -> str:
    parts = []
    for mix, shares in workloads.MIXES.items():
        upto, cases = 0, ""
        for name, share in zip(workloads.OPERATIONS, shares, strict=True):
            upto += share
            cases += f" when p < {upto} then '{name}'"
        parts.append(f"select '{mix}' mix, case{cases} end op, count(*) n from (select event_id * 7919 % 100 p from events) group by all")
    return " union all ".join(parts)


@query(_mix_sql())
def kv_ycsb_workloads(spark, sf):
    percent = F.col("event_id") * 7919 % 100
    kinds = F.array(*(F.struct(F.lit(mix).alias("mix"), workloads.ycsb_operation(percent, mix).alias("op")) for mix in workloads.MIXES))
    return table(spark, sf, "events").select(F.explode(kinds).alias("x")).groupBy("x.mix", "x.op").agg(F.count("*").alias("n"))


# --- streaming


@query("""with x as (select event_id // 500 b, lpad((event_id // 500 * 4 + user_id % 11)::varchar, 12, '0') || lpad((event_id % 3)::varchar, 2, '0') k from events),
m as (select b, max(k) top from x group by b), f as (select b, max(top) over (order by b rows between unbounded preceding and 1 preceding) floor from m) select x.b batch, k, count(*) n from x join f using (b) where floor is null or k > floor group by x.b, k""")
def kv_tail_batches(spark, sf):
    """What a tailing cursor yields of successive batches: only keys past everything returned before."""
    from tidelog.streaming.tailing import past_cursor

    events = table(spark, sf, "events").withColumn("batch", F.expr("event_id div 500"))
    rows = events.select("batch", F.concat(padded(F.col("batch") * 4 + F.col("user_id") % 11), F.lpad((F.col("event_id") % 3).cast("string"), 2, "0")).alias("k"))
    return past_cursor(rows, "batch", "k").groupBy("batch", "k").agg(F.count("*").alias("n"))


_REFRESHES = (2, 5, 7, 10)  # tenths of the log
_MOVING_SQL = "lpad((event_id // 100 + user_id % 50)::varchar, 12, '0')"


def _visible_sql() -> str:
    """States at some horizons of a log whose keys move on with time; each shows what is past the greatest key shown before."""
    parts, floors = [], "''"
    for i, share in enumerate(_REFRESHES):
        cut = f"(select max(seq) * {share} // 10 from log)"
        parts.append(f"""live{i} as (select * from log where seq <= {cut} and not exists (select 1 from rt where rseq <= {cut} and k >= s and k < e and rseq > seq)),
t{i} as (select *, max(case when op <> 'merge' then seq end) over (partition by k) term from live{i}),
state{i} as (select k, coalesce(max(case when op = 'put' then v end), 0) + coalesce(sum(case when op = 'merge' then v end), 0)::bigint v from t{i} where term is null or seq >= term
  group by k having max(case when op = 'put' then v end) is not null or sum(case when op = 'merge' then v end) is not null)""")
    selects = []
    for i in range(len(_REFRESHES)):
        selects.append(f"select {i} batch, k, v from state{i} where k > {floors}")
        floors = f"greatest({floors}, coalesce((select max(k) from state{i}), ''))"
    log = LOG.replace("lpad(user_id::varchar, 12, '0') k", f"{_MOVING_SQL} k").replace("lpad(user_id::varchar, 12, '0') s", f"{_MOVING_SQL} s").replace("lpad((user_id + 10)::varchar, 12, '0') e", "lpad((event_id // 100 + user_id % 50 + 10)::varchar, 12, '0') e")
    return f"with {log}, {', '.join(parts)} {' union all '.join(selects)}"


@query(_visible_sql())
def kv_tail_visible(spark, sf):
    """What a tailing cursor shows of a log whose keys move on with time, drained at some horizons: range deletes, merges and older bases count."""
    from tidelog.streaming.tailing import visible_past_cursor

    log = moving_log(spark, sf)
    last = log.where("op <> 'delete_range'").agg(F.max("seq")).first()[0]
    shown = visible_past_cursor(log, [last * share // 10 for share in _REFRESHES])
    return shown.select("batch", F.col("key").alias("k"), F.col("value").alias("v"))


@query("""with recursive x as (select user_id % 16 writer, row_number() over (partition by user_id % 16 order by event_id) i, 12 + strlen(round(value * 100)::bigint::varchar) size from events),
run as (select writer, i, size, 0 chunk, size buffered from x where i = 1 union all
  select x.writer, x.i, x.size, case when run.buffered >= 200 then run.chunk + 1 else run.chunk end, case when run.buffered >= 200 then x.size else run.buffered + x.size end from run join x on x.writer = run.writer and x.i = run.i + 1)
select writer, chunk::bigint chunk, count(*) ops, sum(size)::bigint bytes from run group by writer, chunk""")
def kv_stream_chunks(spark, sf):
    """Atomic chunks of writers that flush once a budget of 200 bytes is reached."""
    from tidelog.streaming.writer import chunked

    size = 12 + F.length(F.round(F.col("value") * 100).cast("long").cast("string"))
    rows = table(spark, sf, "events").select((F.col("user_id") % 16).alias("writer"), F.col("event_id").alias("pos"), size.cast("long").alias("bytes"))
    return chunked(rows, 200).groupBy("writer", "chunk").agg(F.count("*").alias("ops"), F.sum("bytes").alias("bytes"))


# --- backups: files of successive backups, some of equal content


_BACKUP_SQL = """file as (select event_id // 200 backup_id, event_id file_id, 'h' || (event_id * 7 % 900) hash, event_id * 7 % 900 + 100 size from events)"""


def _backup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.expr("event_id * 7 % 900")
    rows = table(spark, sf_dir, "events")
    return rows.select(F.expr("event_id div 200").alias("backup_id"), F.col("event_id").alias("file_id"), F.concat(F.lit("h"), content.cast("string")).alias("hash"), (content + 100).alias("size"))


@query(f"with {_BACKUP_SQL} select hash, min(size) size, min(backup_id) first_backup, count(*) uses from file group by hash")
def kv_backup_dedup(spark, sf):
    from tidelog.operators.backups import shared_files

    return shared_files(_backup_files(spark, sf))


@query(f"with {_BACKUP_SQL}, kept as (select distinct backup_id from file order by backup_id desc limit 2) select distinct hash from file where hash not in (select hash from file where backup_id in (select backup_id from kept))")
def kv_backup_gc(spark, sf):
    from tidelog.operators.backups import purged, unreferenced

    files = _backup_files(spark, sf)
    return unreferenced(files.select("hash").distinct(), purged(files, 2))


@query(f"with {_BACKUP_SQL} select backup_id, count(*) files, sum(size)::bigint bytes from file group by backup_id")
def kv_backup_list(spark, sf):
    from tidelog.operators.backups import listed

    return listed(_backup_files(spark, sf))


from tidelog import database_queries  # noqa: E402, F401  (adds its own to the catalogue)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
