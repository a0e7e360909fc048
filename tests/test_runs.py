"""Runs, levels, the manifest, threads and views of a database."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tests.model import resolve as model_resolve
from tidelog.errors import Busy, Conflict, Corruption, InvalidArgument, InvalidColumnFamily
from tidelog.functions.keys import fixed_length_prefix
from tidelog.functions.merges import CustomMerge
from tidelog.sources import manifest as manifests
from tidelog.sources.database import BOTTOM, Database, Options, SstFileWriter
from tidelog.sources.transaction import SERIALIZABLE, TransactionDb
from tidelog.streaming.tailing import Tail


def opened(spark, tmp_path, **options):
    return Database.open(spark, f"file://{tmp_path}/db", Options(**options))


def test_cursor_keeps_its_view(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.put(b"a", b"1")
    cursor, stream = db.cursor(), db.scan_stream()
    db.put(b"a", b"2")
    db.put(b"b", b"2")
    db.compact_range()
    cursor.seek_to_first()
    assert cursor.value() == b"1" and list(cursor.entries()) == [(b"a", b"1")] and list(stream) == [(b"a", b"1")]
    assert db.outstanding_snapshots() == 1
    cursor.close()
    del cursor
    assert db.outstanding_snapshots() == 0 and db.statistics.get_ticker("snapshots_released") == 2
    one = db.create_column_family("one")
    gone = db.cursor(one)
    db.drop_column_family(one)
    with pytest.raises(InvalidColumnFamily):
        gone.seek_to_first()
    with pytest.raises(InvalidColumnFamily):
        db.get(b"a", one.id)


def test_drop_all_keeps_numbers(spark, tmp_path):
    db = opened(spark, tmp_path)
    one = db.create_column_family("one")
    db.put(b"k", b"old", one)
    files = db.manifest.next_file
    view = db.snapshot()
    db.drop_all()
    again = db.create_column_family("one")
    assert again.id > one.id and db.manifest.next_file >= files
    assert db.put(b"k", b"new", again) == 1
    with pytest.raises(InvalidColumnFamily):
        db.get(b"k", one)
    later = db.snapshot()
    view.release()  # of before the drop: not the later view's pin
    assert db.outstanding_snapshots() == 1
    later.release()
    assert db.purge_obsolete() == 1 and Database.open(spark, db.path).get(b"k", again) == b"new"


def test_levels_stay_apart(spark, tmp_path):
    db = opened(spark, tmp_path, l0_compaction_trigger=2)
    db.write(db.batch().put(b"a", b"1").put(b"z", b"1"))
    db.compact_range()
    assert [s.level for s in db.manifest.segments] == [BOTTOM]
    bottom = db.manifest.segments[0]
    db.put(b"b", b"2")
    db.put(b"c", b"2")
    assert db.compact_step() and not db.compact_step()
    assert sorted(s.level for s in db.manifest.segments) == [1, BOTTOM] and bottom in db.manifest.segments
    assert db.scan() == [(b"a", b"1"), (b"b", b"2"), (b"c", b"2"), (b"z", b"1")]
    db.delete(b"a")
    db.delete_range(b"b", b"c")
    db.compact_range()
    assert db.scan() == [(b"c", b"2"), (b"z", b"1")] and db.log().where("op <> 'put'").isEmpty()


def test_a_step_rewrites_two_levels(spark, tmp_path):
    """Many small runs: a step takes one of them and what it overlaps below, or moves it."""
    db = opened(spark, tmp_path, l0_compaction_trigger=1, target_file_size=2000, level_base_bytes=4000, level_size_multiplier=1000)
    draw = random.Random(1)
    value = lambda: draw.randbytes(40)
    model = {}
    for _ in range(3):
        batch = db.batch()
        for _ in range(150):
            key = b"%04d" % draw.randrange(1000)
            model[key] = value()
            batch.put(key, model[key])
        db.write(batch)
        while db.compact_step():
            pass
        for n in range(1, BOTTOM + 1):
            own = sorted(db.manifest.level(n), key=lambda s: s.smallest_key)
            assert all(a.limit <= b.smallest_key for a, b in zip(own, own[1:], strict=False)), own
    assert len(db.manifest.segments) > 6 and db.scan() == sorted(model.items())
    one = db.manifest.level(2)
    db.options = Options(level_base_bytes=1, level_size_multiplier=1000, target_file_size=2000, l0_compaction_trigger=1)
    before = {s.file_id for s in db.manifest.segments}
    assert one and db.compact_step()
    after = {s.file_id for s in db.manifest.segments}
    assert len(before & after) >= len(before) - 8 and db.scan() == sorted(model.items())


def test_split_runs_hold_random_histories(spark, tmp_path):
    """Batches with range deletes and merges, tiny runs, steps and full compactions, a pinned view: always the model."""
    db = opened(spark, tmp_path, merge_operator="append_bytes", l0_compaction_trigger=2, target_file_size=1500, level_base_bytes=3000, level_size_multiplier=2)
    draw, ops, seq = random.Random(7), [], 0
    keys = [b"%02d" % i + b"\x00" * (i % 3) for i in range(60)]
    view, seen = None, None
    for step in range(9):
        batch = db.batch()
        for _ in range(25):
            key, op = draw.choice(keys), draw.choice(["put", "put", "merge", "delete", "range"])
            seq += 1
            if op == "range":
                lo, hi = sorted([key, draw.choice(keys)])
                batch.delete_range(lo, hi)
                seq -= lo >= hi
                if lo < hi:
                    ops.append((lo, seq, "delete_range", None, hi))
            else:
                value = draw.randbytes(3).hex().encode()
                getattr(batch, op)(*((key,) if op == "delete" else (key, value)))
                ops.append((key, seq, op, value, None))
        assert db.write(batch) == seq
        model = {k: v for k, (v, _) in model_resolve(ops, None, lambda base, o: (base or b"") + b"".join(o)).items()}
        if step == 3:
            view, seen = db.snapshot(), dict(model)
        if step % 3 == 2:
            assert db.compact_step() == (step != 8)
        if step == 5:
            db.compact_range(b"10", b"20")
        if step == 7:
            view.release()
            db.compact_range()
        assert dict(db.scan()) == model
        if view and step < 7:
            assert dict(view.scan()) == seen
    asked = draw.sample(keys, 20) + [b"none"]
    assert db.multi_get(asked) == [model.get(k) for k in asked]
    again = Database.open(spark, db.path, db.options)
    assert dict(again.scan()) == model and again.obsolete


def test_bounds_carry_their_family(spark, tmp_path):
    db = opened(spark, tmp_path)
    one, two = db.create_column_family("one"), db.create_column_family("two")
    db.write(db.batch().put(b"k", b"1", one).put(b"a", b"2", two))
    assert db.get_approximate_sizes([(b"", b"z")]) == [0]
    assert db.get_approximate_sizes([(b"a", b"z"), (b"l", b"m"), (b"b", b"a")], one)[0] > 0 and db.get_approximate_sizes([(b"b", b"z")], two) == [0]
    db.compact_range(b"j", b"l", two)
    assert db.manifest.level(0)
    db.compact_range(b"j", b"l", one)
    assert not db.manifest.level(0) and db.get(b"k", one) == b"1"


def test_ingest_is_all_or_nothing(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.put(b"m", b"1")

    def file(*keys):
        out = SstFileWriter(spark)
        for k in keys:
            out.put(k, b"new")
        return out.finish()

    before = db.manifest
    with pytest.raises(InvalidArgument):
        db.ingest([file(b"a"), file(b"m")], behind=True)
    assert db.manifest == before and db.scan() == [(b"m", b"1")] and not db._orphans()
    db.ingest([file(b"a", b"b"), file(b"m"), file(b"b")])
    assert db.scan() == [(b"a", b"new"), (b"b", b"new"), (b"m", b"new")] and db.latest_sequence == 4
    assert sorted(s.level for s in db.manifest.segments) == [0, 0, 0, BOTTOM]


def test_threads_share_a_handle(spark, tmp_path):
    db = opened(spark, tmp_path)
    errors = []

    def run(work):
        def safely(n):
            try:
                work(n)
            except Exception as e:
                errors.append(e)

        threads = [threading.Thread(target=safely, args=(n,)) for n in range(8)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert not errors

    before = db.manifest.version
    run(lambda n: [db.put(b"%d/%d" % (n, i), b"v") for i in range(4)])
    assert len(db.scan()) == 32 and db.latest_sequence == 32
    assert db.manifest.version - before < 32  # those that waited went together
    seqs = sorted(r.seq for r in db.log().select("seq").collect())
    assert seqs == list(range(1, 33))
    txns = TransactionDb(db, SERIALIZABLE)

    def increments(_):
        done = 0
        while done < 2:
            txn = txns.begin()
            txn.put(b"n", b"%d" % (int(txn.get(b"n") or 0) + 1))
            try:
                txn.commit()
                done += 1
            except Conflict:
                pass

    run(increments)
    assert db.get(b"n") == b"16" and db.outstanding_snapshots() == 0


def test_a_failed_check_is_its_own(spark, tmp_path):
    """In one group, a transaction that lost to a write before it fails alone."""
    db = opened(spark, tmp_path)
    db.put(b"x", b"0")
    one, two = TransactionDb(db).begin(), TransactionDb(db).begin()
    one.put(b"x", b"1")
    two.put(b"x", b"2")
    from tidelog.sources.database import _Request

    group = [_Request([(1, b"x", "put", b"1", None)], one._check), _Request([(1, b"x", "put", b"2", None)], two._check), _Request([(1, b"y", "put", b"3", None)], None)]
    with pytest.raises(Conflict):
        db._submit(group)
    assert [r.error is None for r in group] == [True, False, True] and db.scan() == [(b"x", b"1"), (b"y", b"3")]


def test_a_small_run_is_small(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.put(b"k", b"v")
    assert db.manifest.segments[0].file_size < 10_000
    files = [f"{db.path}/{db.manifest.segments[0].path}/{n}" for n in db.files.names(f"{db.path}/{db.manifest.segments[0].path}")]
    assert sum(db.files.size(f) for f in files) < 10_000


def test_commits_write_in_proportion(spark, tmp_path):
    db = opened(spark, tmp_path)
    for i in range(250):
        db._commit(manifests.Edit(create=(f"family{i}",), drop=(f"family{i - 1}",) if i else ()))
    size = db.files.size(f"{db.path}/manifest") + db.files.size(f"{db.path}/checkpoints")
    assert size < 250 * 120 and db.statistics.get_ticker("wal_sync_count") == 250
    again = Database.open(spark, db.path)
    assert again.list_column_families() == ["default", "family249"] and again.manifest == db.manifest
    stale = Database.open(spark, db.path)
    stale.manifest = manifests.Manifest(version=3)
    assert db.store.prune() > 100 and Database.open(spark, db.path).manifest == db.manifest
    with pytest.raises(Busy):
        stale.create_column_family("late")
    db.files.delete(f"{db.path}/manifest/{240:020d}.json")
    with pytest.raises(Corruption):
        Database.open(spark, db.path)


def test_leftovers_are_purged_after_a_restart(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.put(b"a", b"1")
    spark.range(1).write.parquet(f"{db.path}/data/{99:08d}-{'0' * 32}")  # a write that crashed before its commit
    db.put(b"a", b"2")
    db.compact_range()
    again = Database.open(spark, db.path)
    assert len(again.obsolete) == 3 and again.scan() == [(b"a", b"2")]
    assert again.purge_obsolete() == 3 and len(again.files.names(f"{db.path}/data")) == 1
    assert Database.open(spark, db.path).scan() == [(b"a", b"2")] and not Database.open_read_only(spark, db.path).obsolete


def test_tail_shows_what_is_visible(spark, tmp_path):
    db = opened(spark, tmp_path, merge_operator="append_bytes")
    db.put(b"a", b"1")
    db.delete_range(b"a", b"b")
    db.put(b"c", b"1")
    db.merge(b"c", b"2")
    db.put(b"e", b"1")
    ghost = db.log().where("key = X'65'").selectExpr("cf", "X'67' key", "seq + 100 seq", "op", "value", "end_key", "batch_id", "batch_pos", "commit_unix")
    ghost.write.parquet(f"{db.path}/data/{77:08d}-{'1' * 32}")  # committed by no edit
    tail = Tail(spark, db.path, f"file://{tmp_path}/out", f"file://{tmp_path}/state", options=db.options)
    tail.run().awaitTermination()
    state = lambda: sorted((bytes(r.key), bytes(r.value)) for r in tail.rows().collect())
    assert state() == [(b"c", b"12"), (b"e", b"1")]
    db.merge(b"f", b"x")
    db.put(b"d", b"late")
    db.compact_range()
    tail.run().awaitTermination()
    assert state() == [(b"c", b"12"), (b"e", b"1"), (b"f", b"x")]


def test_tailing_cursor_follows_random_histories(spark, tmp_path):
    db = opened(spark, tmp_path, merge_operator="append_bytes")
    draw, ops, seq, floor, want, got = random.Random(5), [], 0, None, [], []
    cursor = db.tailing_cursor()
    for round_ in range(6):
        batch = db.batch()
        for _ in range(6):
            key, op = b"%02d" % draw.randrange(10 * round_, 10 * round_ + 30), draw.choice(["put", "merge", "delete", "range"])
            seq += 1
            if op == "range":
                batch.delete_range(key, key + b"\xff")
                ops.append((key, seq, "delete_range", None, key + b"\xff"))
            else:
                getattr(batch, op)(*((key,) if op == "delete" else (key, b"v%d" % seq)))
                ops.append((key, seq, op, b"v%d" % seq, None))
        db.write(batch)
        state = model_resolve(ops, None, lambda base, o: (base or b"") + b"".join(o))
        new = sorted((k, v) for k, (v, _) in state.items() if floor is None or k > floor)
        floor = new[-1][0] if new else floor
        want += new
        got += cursor.drain()
        assert got == want
    cursor.seek(b"00")
    assert cursor.valid() and cursor.key() == min(state)
    cursor.close()
    assert db.outstanding_snapshots() == 0


def test_runs_are_cut_by_what_is_written(spark, tmp_path):
    """Not by what is read: old versions and footers of small files make no more runs. And of many runs, all keys get to theirs."""
    db = opened(spark, tmp_path, target_file_size=4000)
    for n in range(5):
        db.write_group([db.batch().put(b"%03d" % k, b"%d" % n) for k in range(100)])
    for _ in range(2):
        db.compact_range()
        assert len(db.manifest.segments) <= 3 and len(db.files.names(f"{db.path}/data")) <= 8
    db.options = Options(target_file_size=100)
    key = F.format_string("%04d", F.col("id")).cast("binary")
    db.replay(spark.range(1500).select(key.alias("key"), (F.col("id") + 1).alias("seq"), F.lit("put").alias("op"), F.lit(b"v").alias("value")))
    view = db.snapshot()
    db.delete_range(b"0700", b"0710")
    db.compact_range()
    own = sorted(db.manifest.segments, key=lambda s: s.smallest_key)
    assert len(own) > 257 and all(a.limit <= b.smallest_key for a, b in zip(own, own[1:], strict=False))
    assert len(db.scan()) == 1589 and len(view.scan()) == 1600  # 071 lies in the range, too
    view.release()


def test_a_drain_is_one_pass(spark, tmp_path, monkeypatch):
    """Not a state a page: the list and the table hold the same, from the middle of a view and from a new one."""
    from tidelog.sources.database import Cursor

    monkeypatch.setattr(Cursor, "PAGE", 2)
    db = opened(spark, tmp_path)
    names = [b"k%d" % n for n in range(7)]
    db.write_group([db.batch().put(k, k) for k in names])
    one, two, states, state = db.tailing_cursor(), db.tailing_cursor(), [], db.state
    one.seek_to_first(), two.seek_to_first()
    one.next(), two.next()
    monkeypatch.setattr(db, "state", lambda *args: states.append(1) or state(*args))
    assert one.drain() == [(k, k) for k in names[1:]] and len(states) == 1 and not one.valid()
    assert sorted((bytes(r.key), bytes(r.value)) for r in two.drain_to(f"file://{tmp_path}/a").collect()) == [(k, k) for k in names[1:]]
    db.write(db.batch().put(b"a", b"1").put(b"l", b"1").delete(b"k6"))
    assert one.drain() == [(b"l", b"1")] and [bytes(r.key) for r in two.drain_to(f"file://{tmp_path}/b").collect()] == [b"l"]
    assert two.drain_to(f"file://{tmp_path}/c").isEmpty() and one.drain() == [] and len(states) == 6
    one.close(), two.close()
    assert db.outstanding_snapshots() == 0


def test_a_stream_of_a_table_has_the_same_chunks(spark, tmp_path):
    """One commit, however many chunks; what was buffered goes before, and the tail is buffered."""
    one, many = Database.open(spark, f"file://{tmp_path}/one"), Database.open(spark, f"file://{tmp_path}/many")
    draw = random.Random(3)
    ops = [(n * 3, b"%04d" % n, *(("delete", None) if n % 5 == 0 else ("put", draw.randbytes(draw.randrange(9))))) for n in range(60)]
    writers = one.streaming_writer(30), many.streaming_writer(30)
    for w in writers:
        w.put(b"a", b"first")
    for _, key, op, value in ops:
        writers[0].put(key, value) if op == "put" else writers[0].delete(key)
    rows = spark.createDataFrame(ops[::-1], "pos long, key binary, op string, value binary")
    assert writers[1].write_all(rows) == writers[0].last and writers[1].batch.ops == writers[0].batch.ops
    assert writers[1].finish() == writers[0].finish() and len(many.manifest.segments) <= 2 < len(one.manifest.segments)
    columns = ["key", "seq", "op", "value", "batch_id", "batch_pos"]
    logs = [sorted(map(tuple, db.log().select(*columns).collect()), key=lambda r: r[1]) for db in (one, many)]
    assert logs[0] == logs[1] and one.manifest.next_batch == many.manifest.next_batch
    with pytest.raises(InvalidArgument):
        writers[1].write_all(rows.unionByName(rows))
    with pytest.raises(InvalidArgument):
        writers[1].write_all(rows.withColumn("op", F.lit("merge")))


def test_custom_merges_are_streamed(spark, monkeypatch):
    """Keys of a task one after another, not a table each; results leave in parts."""
    from tidelog.plans import resolve

    monkeypatch.setattr(resolve, "OUT_BYTES", 200, raising=False)
    log = spark.range(400).select(F.lit(1).alias("cf"), (F.col("id") % 40).cast("string").cast("binary").alias("key"), (F.col("id") + 1).alias("seq"), F.lit("merge").alias("op"), F.col("id").cast("string").cast("binary").alias("value"), F.lit(None).cast("binary").alias("end_key"))
    state = resolve.resolve(log, None, CustomMerge("bar", lambda k, base, operands: b"|".join(operands)))
    assert "FlatMapGroupsInPandas" not in state._jdf.queryExecution().executedPlan().toString()
    assert {bytes(r.key): bytes(r.value) for r in state.collect()} == {b"%d" % k: b"|".join(b"%d" % n for n in range(k, 400, 40)) for k in range(40)}


def test_a_split_join_splits_no_key(spark):
    """A join whose hot keys the planner splits leaves a key in many tasks; the fold deals it anew."""
    from tidelog.plans import resolve
    from tidelog.session import tuned

    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0"}
    before = {name: spark.conf.get(name) for name in own}
    session = tuned(spark)
    try:
        for name, value in own.items():
            session.conf.set(name, value)
        key = F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("hot")
        log = spark.range(0, 40000, 1, 8).select(F.lit(1).alias("cf"), key.cast("binary").alias("key"), (F.col("id") + 1).alias("seq"), F.lit("merge").alias("op"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("value"), F.lit(None).cast("binary").alias("end_key"))
        state = resolve.resolve(log, None, CustomMerge("n", lambda k, base, operands: b"%d" % len(operands)))
        assert "REPARTITION_BY_COL" in state._jdf.queryExecution().executedPlan().toString()  # the planner drops one by the join's keys
        rows = state.collect()
    finally:
        for name, value in before.items():
            session.conf.set(name, value)
    assert len(rows) == 801 and {bytes(r.key): bytes(r.value) for r in rows}[b"hot"] == b"39200"


def test_custom_merges_fold_in_compaction(spark, tmp_path):
    def full(key, base, operands):
        return None if b"bad" in operands else (base or b"") + b"+".join(operands)

    merge = CustomMerge("plus", full, lambda key, a, b: None if b"bad" in (a, b) else a + b"+" + b)
    db = opened(spark, tmp_path, merge_operator=merge)
    db.write(db.batch().put(b"a", b"0").merge(b"a", b"1").merge(b"a", b"2").merge(b"b", b"1").merge(b"b", b"2").merge(b"b", b"3").merge(b"c", b"1").merge(b"c", b"bad").merge(b"d", b"9").delete(b"d"))
    db.compact_range()
    ops = sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in db.log().collect())
    assert ops == [(b"a", 3, "put", b"01+2"), (b"b", 6, "merge", b"1+2+3"), (b"c", 7, "merge", b"1"), (b"c", 8, "merge", b"bad")]
    assert db.get(b"a") == b"01+2" and db.get(b"b") == b"1+2+3" and db.get(b"d") is None
    with pytest.raises(Exception, match="MergeFailed"):
        db.get(b"c")


def test_prefix_filters(spark, tmp_path):
    db = opened(spark, tmp_path, prefix_extractor=fixed_length_prefix(2))
    db.write(db.batch().put(b"aa1", b"1").put(b"ab1", b"2").put(b"a", b"3").put(b"aa2", b"4").delete_range(b"aa2", b"ab"))
    db.put(b"zz", b"5")
    found = lambda p: sorted(bytes(r.key) for r in db.scan_prefix(p).collect())
    for _ in range(2):
        assert found(b"aa") == [b"aa1"] and found(b"a") == [b"a", b"aa1", b"ab1"] and found(b"aa1") == [b"aa1"] and found(b"") == [b"a", b"aa1", b"ab1", b"zz"]
        cursor = db.cursor()
        cursor.seek_prefix(b"ab")
        assert cursor.key() == b"ab1"
        cursor.PAGE = 1
        cursor.seek_prefix(b"a")
        assert [k for k, _ in cursor.entries()] == [b"a", b"aa1", b"ab1"]
        cursor.seek(b"ab")
        cursor.next()
        assert cursor.key() == b"zz"
        cursor.prev()
        assert cursor.key() == b"ab1"
        db.compact_range()
    assert fixed_length_prefix(2).query(b"a") is None and fixed_length_prefix(2).query(b"abc") == b"ab"


def test_reads_of_keys_with_a_large_dictionary(spark, tmp_path):
    """A dictionary of keys beyond 8 kB, which a range of keys doesn't pass over."""
    db = opened(spark, tmp_path)
    key = F.format_string("%012d", F.col("id") % 3000)
    db.replay(spark.range(30000).select(key.cast("binary").alias("key"), (F.col("id") + 1).alias("seq"), F.when(F.col("id") < 3000, "delete").otherwise("put").alias("op"), F.lit(b"v").alias("value")))
    name = lambda n: b"%012d" % n
    found = db.multi_get([name(7 * n) for n in range(500)])
    assert sum(v is not None for v in found) == 429
    cursor = db.cursor()
    cursor.seek(name(1500))
    assert cursor.key() == name(1500) and db.get(name(2999)) == b"v" and db.scan_page(name(2998), limit=5)[0] == [(name(2998), b"v"), (name(2999), b"v")]
    cursor.close()


def test_a_large_run_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Versions that a view keeps, all of one key: they are dealt by number, and the run has a file a task."""
    monkeypatch.setattr("tidelog.sources.database.ROWS_IN_TASK", 100, raising=False)
    db = opened(spark, tmp_path)
    db.put(b"k", b"first")
    view = db.snapshot()
    db.replay(spark.range(1000).select(F.lit(b"k").alias("key"), (F.col("id") + 1).alias("seq"), F.lit("put").alias("op"), F.col("id").cast("string").cast("binary").alias("value")))
    db.compact_range()
    (run,) = db.manifest.segments
    assert run.num_entries == 1001 and len(db.files.names(f"{db.path}/{run.path}")) >= 10
    assert view.get(b"k") == b"first" and db.get(b"k") == b"999" and [n for n in db.files.names(f"{db.path}/data") if n not in run.path] == db.files.names(f"{db.path}/data")[:2]
    view.release()


def test_a_view_that_opens_in_between_sees_no_filter(spark, tmp_path):
    db = opened(spark, tmp_path, remove=F.col("key") == F.lit(b"x"))
    db.write(db.batch().put(b"x", b"1").put(b"y", b"2"))
    runs, views = db._runs, []

    def slow(*args):
        if not views:
            views.append(db.snapshot())
        return runs(*args)

    db._runs = slow
    db.compact_range()
    assert views[0].get(b"x") == b"1" and [s.level for s in db.manifest.segments] == [BOTTOM] and len(db._orphans()) == 1
    views[0].release()
    db.compact_range()
    assert db.scan() == [(b"y", b"2")]


def test_filter_sees_the_level(spark, tmp_path):
    db = opened(spark, tmp_path, remove=(F.col("level") == BOTTOM) & (F.col("key") == F.lit(b"x")), l0_compaction_trigger=1)
    db.put(b"x", b"1")
    assert db.compact_step() and db.get(b"x") == b"1"
    db.compact_range()
    assert db.get(b"x") is None


def test_properties_and_stalls(spark, tmp_path):
    db = opened(spark, tmp_path, soft_pending_bytes=1, hard_pending_bytes=1 << 40, l0_compaction_trigger=1)
    db.put(b"k", b"v")
    assert db.write_stall() == "slowdown" and db.get_int_property("pending-compaction-bytes") == db.manifest.segments[0].file_size
    with pytest.raises(Busy):
        db.write(db.batch().put(b"k", b"w"), no_slowdown=True)
    with db.snapshot():
        assert db.get_int_property("num-snapshots") == 1 and db.get_int_property("oldest-snapshot-time") > 0
    assert db.get_int_property("total-sst-files-size") == db.get_int_property("estimate-live-data-size") > 0 and db.get_int_property("block-cache-usage") == 0
    assert db.get_property("stats")["tickers"]["keys_written"] == 1 and len(db.get_property("stats")["histograms"]) == 10
    with pytest.raises(InvalidArgument):
        db.get_int_property("none")
    with pytest.raises(InvalidArgument):
        db.statistics.get_ticker("none")


def test_replayed_logs(spark, tmp_path):
    db = opened(spark, tmp_path, merge_operator="append_bytes")
    db.put(b"a", b"0")
    log = spark.createDataFrame([(b"a", 1, "merge", b"1", None), (b"b", 2, "put", b"2", None), (b"b", 3, "delete_range", None, b"c")], "key binary, seq long, op string, value binary, end_key binary")
    assert db.replay(log) == 4 and db.scan() == [(b"a", b"01")]
    assert db.manifest.segments[-1].file_size < 20_000
    assert db.replay(log.limit(0)) == 4
    with pytest.raises(InvalidColumnFamily):
        db.replay(log.withColumn("cf", F.lit(9)))
    assert db.scan() == [(b"a", b"01")]


def test_replaced_options():
    with pytest.raises(InvalidArgument):
        Options(compression_per_level=("zip",))
    with pytest.raises(InvalidArgument):
        Options(l0_slowdown=40)
    assert Options(compression_per_level=("none", "snappy")).codec(5) == "snappy" and Options.small(l0_stop=50).target_file_size == 1 << 20
