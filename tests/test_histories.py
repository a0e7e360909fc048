"""Consistency checks over histories against plain loops."""

import random

from tidelog.operators import histories


def test_lost_appends_are_brute_force(spark):
    draw = random.Random(4)
    appends = [(i, draw.choice("ab"), draw.randrange(100), draw.randrange(8)) for i in range(40)]  # values repeat
    reads = []
    for i in range(50):
        key, at = draw.choice("abc"), draw.randrange(110)
        seen = [v for _, k, done, v in appends if k == key and (done < at) == (draw.random() < 0.9)]
        reads.append((i, key, at, draw.choice([seen, seen, sorted(set(seen)), [], None])))
    left = spark.createDataFrame(appends, "append_id long, key string, completed long, value long")
    right = spark.createDataFrame(reads, "read_id long, key string, invoked long, list array<long>")
    want = sorted((r, a) for r, key, at, seen in reads if seen is not None for a, k, done, v in appends if k == key and at > done and v not in seen)
    found = histories.lost_appends(left, right, None).select("read_id", "append_id").collect()
    assert sorted(map(tuple, found)) == want
    for many in (1, 5, 30):
        few = histories.lost_appends(left, right, many).select("read_id", "append_id").collect()
        assert sorted(map(tuple, few)) == want[:many]
    assert histories.lost_appends(left.limit(0), right).collect() == [] and histories.lost_appends(left, right.limit(0)).collect() == []


def test_orders_are_carried_over_parts(spark, monkeypatch):
    """One hot process and one hot key, with the order dealt in many parts."""
    draw = random.Random(2)
    monkeypatch.setattr(histories, "key_bounds", lambda keys: list(range(0, 300, 7)))
    events = [(draw.choice([1, 1, 1, 2]), draw.choice(["invoke", "ok", "fail"]), i * 10, i) for i in draw.sample(range(300), 250)]
    want, last = [], {}
    for process, kind, at, i in sorted(events, key=lambda e: e[3]):
        if kind != "invoke" and last.get(process, ("",))[0] == "invoke":
            want.append((process, last[process][2], last[process][1], at, kind))
        last[process] = (kind, at, i)
    frame = spark.createDataFrame(events, "process long, type string, time long, index long")
    assert sorted(map(tuple, histories.paired(frame).collect())) == sorted(want)
    writes = [(draw.choice("aab"), draw.randrange(300), v) for v in range(80)]
    reads = [(i, draw.choice("aabc"), draw.randrange(300), draw.choice([None, *range(80)])) for i in range(150)]
    newest = lambda key, at: max((v for k, done, v in writes if k == key and done < at), default=-1)
    stale = sorted((i, key, seen, newest(key, at)) for i, key, at, seen in reads if newest(key, at) > (-1 if seen is None else seen))
    left = spark.createDataFrame(writes, "key string, completed long, version long")
    right = spark.createDataFrame(reads, "read_id long, key string, invoked long, seen long")
    assert sorted(map(tuple, histories.stale_reads(left, right).collect())) == stale
