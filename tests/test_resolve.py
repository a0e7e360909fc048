import random

import pytest
from pyspark.sql import functions as F

from tests.model import resolve as model
from tidelog.functions.keys import prefix_successor
from tidelog.functions.merges import APPEND, BUILT_IN, COUNTER, LAST, MAX, CustomMerge
from tidelog.operators.compaction import collapsed, garbage_collected
from tidelog.plans.log import event_log
from tidelog.plans.resolve import resolve
from tidelog.plans.tombstones import cover, distinct_tombstones, skyline

SCHEMA = "cf int, key string, seq long, op string, value long, end_key string"
KEYS = ["", "a", "a\x00", "ab", "abc", "b", "b~", "m", "m\x00\x00", "z"]


def history(seed, n=120):
    r = random.Random(seed)
    ops = []
    for seq in range(1, n + 1):
        op = r.choices(["put", "delete", "delete_range", "merge"], [6, 2, 2, 2])[0]
        key = r.choice(KEYS)
        end = None
        if op == "delete_range":
            key, end = sorted([key, r.choice(KEYS)])
        ops.append((key, seq, op, r.randint(-50, 50) if op in ("put", "merge") else None, end))
    return ops


def frame(spark, ops):
    return spark.createDataFrame([(1, k, s, op, v, e) for k, s, op, v, e in ops], SCHEMA)


def found(df):
    return {r.key: (r.value, r.seq) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_resolve_is_the_model_at_every_horizon(spark, seed):
    ops = history(seed)
    log = frame(spark, ops).cache()
    for horizon in (1, 17, 60, 119, None):
        assert found(resolve(log, horizon, COUNTER)) == model(ops, horizon)


def test_many_tombstones_take_the_bucketed_way(spark):
    ops = history(7, 200)
    assert found(resolve(frame(spark, ops), None, COUNTER, few=3)) == model(ops)


def test_cover_with_bounds_between_keys(spark, monkeypatch):
    from tidelog.plans import tombstones

    monkeypatch.setattr(tombstones, "PER_BUCKET", 4)
    r = random.Random(5)
    spans = [(f"{a:03d}", f"{a + r.randint(1, 300):03d}", i) for i, a in enumerate(r.sample(range(600), 60))]
    log = spark.createDataFrame([(1, s, i, "delete_range", None, e) for s, e, i in spans], SCHEMA)
    points = spark.createDataFrame([(1, f"{k:03d}", 0) for k in range(0, 950, 3)], "cf int, key string, seq long")
    got = {x.key: x.cover for x in cover(points, distinct_tombstones(log), few=1).collect()}
    assert got == {f"{k:03d}": max((i for s, e, i in spans if s <= f"{k:03d}" < e), default=None) for k in range(0, 950, 3)}


def test_skyline_merges_touching_pieces():
    assert skyline([("a", "c", 1), ("c", "e", 1), ("b", "d", 5), ("x", "x", 9)]) == [("a", "b", 1), ("b", "d", 5), ("d", "e", 1)]
    assert skyline([]) == []


def test_garbage_collection_keeps_pinned_states(spark):
    ops = history(11, 150)
    log = frame(spark, ops)
    kept = garbage_collected(log, 70).unionByName(log.where("op = 'delete_range'")).cache()
    assert kept.count() < log.count()
    for horizon in (70, 71, 100, 150):
        assert found(resolve(kept, horizon, COUNTER)) == model(ops, horizon)


def test_collapse_keeps_the_latest_state(spark):
    ops = history(3)
    log = frame(spark, ops)
    once = collapsed(log, COUNTER).withColumn("end_key", F.lit(None).cast("string"))
    assert found(resolve(once.unionByName(log.where("op = 'delete_range'")), None, COUNTER)) == model(ops)


def test_shared_sequence_trap(spark):
    """A point that is newer than its own key's range delete survives; an older one doesn't."""
    ops = [("k", 1, "put", 1, None), ("k", 2, "delete_range", None, "l"), ("k", 3, "merge", 5, None)]
    assert found(resolve(frame(spark, ops), None, COUNTER)) == {"k": (5, 3)}
    assert found(resolve(frame(spark, ops), 2, COUNTER)) == {}


def test_merge_operators(spark):
    rows = [(1, "k", s, op, v, None) for s, op, v in [(1, "put", "x"), (2, "merge", "b"), (3, "merge", "a"), (4, "merge", "b")]]
    log = spark.createDataFrame(rows, SCHEMA.replace("value long", "value string"))
    joined = CustomMerge("join", lambda key, base, operands: "-".join([base or "", *operands]))
    for merge, value in ((APPEND, "xbab"), (LAST, "b"), (MAX, "x"), (joined, "x-b-a-b")):
        assert resolve(log, None, merge).first().value == value


def test_merge_without_operator_fails(spark):
    log = frame(spark, [("k", 1, "merge", 5, None)])
    with pytest.raises(Exception, match="merge without"):
        resolve(log, None, None).collect()


def test_empty_log(spark):
    assert resolve(frame(spark, []), None, COUNTER).collect() == []


def test_events_agree_with_the_model(spark):
    rows = event_log(spark, "/root/testdata/sf0.001").collect()
    ops = [(r.key, r.seq, r.op, r.value, r.end_key) for r in rows]
    log = event_log(spark, "/root/testdata/sf0.001")
    for horizon in (500, 1999, None):
        assert found(resolve(log, horizon, COUNTER)) == model(ops, horizon)


def test_prefix_successor():
    assert prefix_successor(b"ab") == b"ac"
    assert prefix_successor(b"a\xff\xff") == b"b"
    assert prefix_successor(b"\xff") is None and prefix_successor(b"") is None


def test_counters_fold_by_hash(spark):
    """Numbers need no sort of the log: one aggregate a key, and one of the operands that are newer."""
    log = spark.createDataFrame([(1, b"k", 1, "put", b"\0" * 8, None), (1, b"r", 2, "delete_range", None, b"s")], "cf int, key binary, seq long, op string, value binary, end_key binary")
    plan = resolve(log, None, BUILT_IN["counter_i64"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_hidden_values_of_another_form_are_no_failure(spark):
    schema = "cf int, key binary, seq long, op string, value binary, end_key binary"
    one = (1).to_bytes(8, "big")
    rows = [(1, b"a", 1, "put", b"xyz", None), (1, b"a", 2, "put", one, None), (1, b"b", 3, "put", b"xyz", None), (1, b"b", 4, "delete", None, None), (1, b"b", 5, "merge", one, None)]
    assert {(bytes(r.key), bytes(r.value)) for r in resolve(spark.createDataFrame(rows, schema), None, BUILT_IN["counter_i64"]).collect()} == {(b"a", one), (b"b", one)}
    with pytest.raises(Exception, match="8 bytes"):
        resolve(spark.createDataFrame([*rows, (1, b"b", 6, "put", b"xyz", None)], schema), None, BUILT_IN["counter_i64"]).collect()


def test_keys_beyond_tombstones_are_no_bucket_of_theirs(spark, monkeypatch):
    """With many tombstones their own keys are cut into parts, and other families' keys are not among them."""
    from tidelog.plans import tombstones

    monkeypatch.setattr(tombstones, "KEYS_PER_BUCKET", 50, raising=False)
    schema = "cf int, key binary, seq long, op string, value long, end_key binary"
    ranges = [(1, b"%03d" % n, 2 * n + 2, "delete_range", None, b"%03d" % (n + 2)) for n in range(0, 400, 4)]
    log = spark.createDataFrame([*((cf, b"%03d" % n, 2 * n + 1, "put", n, None) for cf in (1, 2) for n in range(400)), *ranges], schema)
    points = log.where("op <> 'delete_range'")
    assert len(tombstones.key_cuts(points.where("cf = 1"))) >= 6
    kept = tombstones.cover(points.select("cf", "key", "seq"), tombstones.distinct_tombstones(log), few=5, log=points)
    assert {(r.cf, bytes(r.key), r.cover) for r in kept.collect()} == {(cf, b"%03d" % n, 2 * (n - n % 4) + 2 if cf == 1 and n % 4 < 2 else None) for cf in (1, 2) for n in range(400)}
    assert resolve(log, None, few=5).count() == 700


@pytest.mark.parametrize("floor", [False, True])
def test_many_seeks_go_one_way(spark, floor):
    """Targets where no keys are, keys equal to targets, and no frame that reaches the end of a part: that is evaluated anew for each row."""
    from tidelog.operators.reads import seek_many

    keys, targets = [f"{n:05d}" for n in range(0, 900, 3)], [f"{n:05d}" for n in range(0, 3000, 7)]
    found = seek_many(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(t,) for t in [*targets, *targets[:5]]], "target string"), floor, few=5)
    want = {(t, max((k for k in keys if k <= t), default=None) if floor else min((k for k in keys if k >= t), default=None)) for t in targets}
    assert len(rows := found.collect()) == len(want) and {tuple(r) for r in rows} == want
    assert "RangeFrame" not in found._jdf.queryExecution().optimizedPlan().toString()
