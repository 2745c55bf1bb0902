"""Schedules and invariants of transactions, versions, compaction and merges."""

import random

import pytest
from pyspark.sql import functions as F

from changelake.operators import gc, latest, logfiles, merge, mvcc, occ, replication
from changelake.plans.prefix import carried, numbered, running

LOG = "seq bigint, tx bigint, k string, v string, del boolean"
REQUESTS = "db bigint, arrival bigint, txid bigint, read_tx bigint, reads array<string>, writes array<struct<k: string, v: string, del: boolean>>"


def log(spark, *rows):
    return spark.createDataFrame([(i + 1, tx, k, v, v is None) for i, (tx, k, v) in enumerate(rows)], LOG)


def outcomes(spark, history, *requests):
    rows = [(0, n, n, read_tx, list(reads), [(k, "v", False) for k in writes]) for n, (read_tx, reads, writes) in enumerate(requests, 1)]
    return [r.outcome for r in occ.commit(spark.createDataFrame(rows, REQUESTS), history).orderBy("arrival").collect()]


@pytest.mark.parametrize(
    ("requests", "want"),
    [
        ([(1, "k", "k"), (1, "k", "k")], ["ok", "conflict"]),  # both read and write one key
        ([(1, "", "k"), (1, "", "k")], ["ok", "conflict"]),  # blind writes: the first committer wins
        ([(1, "", "k"), (1, "k", "o")], ["ok", "conflict"]),  # a read that has become stale
        ([(1, "ab", "b"), (1, "ac", "c")], ["ok", "ok"]),  # disjoint writes
        ([(1, "", "a"), (0, "k", "b"), (1, "", "c"), (1, "", "a")], ["ok", "conflict", "ok", "conflict"]),  # mixed validity
        ([(0, "k", "x"), (0, "k", "y")], ["conflict", "conflict"]),  # all stale
        ([(0, "k", ""), (1, "", "k")], ["ok", "ok"]),  # a read-only request never conflicts
    ],
)
def test_schedules(spark, requests, want):
    assert outcomes(spark, log(spark, (1, "k", "v0")), *requests) == want


def test_numbering_skips_requests_without_operations(spark):
    survivors = spark.createDataFrame([(1, 2), (2, 0), (3, 3)], "txid bigint, n bigint")
    assert sorted(map(tuple, occ.numbering(survivors).collect())) == [(1, 1, 1), (3, 2, 3)]


def sequential(history_tx, requests, size):
    """One database's committer: requests one after another, against the log's latest versions, the survivors of earlier groups and those of their own."""
    index, clock = dict(history_tx), max(history_tx.values(), default=0)
    out, group = [], set()
    for n, (read_tx, reads, writes) in enumerate(requests):
        if n % size == 0:
            group = set()
        keys = {*reads, *writes}
        ok = not writes or not any(index.get(k, 0) > read_tx for k in keys) and not keys & group
        if ok and writes:
            clock += 1
            group |= {*writes}
            index |= dict.fromkeys(writes, clock)
        out.append("ok" if ok else "conflict")
    return out


def test_groups_know_earlier_survivors(spark):
    requests = [(1, "", "k")] * 4
    for size, want in ((1, "occc"), (2, "occc"), (128, "occc")):
        rows = [(0, n, n, r, list(reads), [(k, "v", False) for k in w]) for n, (r, reads, w) in enumerate(requests, 1)]
        got = occ.commit(spark.createDataFrame(rows, REQUESTS), log(spark, (1, "j", "v")), size=size).orderBy("arrival").collect()
        assert "".join(r.outcome[0] for r in got) == want


@pytest.mark.parametrize("size", [1, 3, 128])
def test_commits_against_a_sequential_committer(spark, size):
    rng = random.Random(size)
    history = log(spark, *((t, f"k{rng.randint(0, 30)}", "v") for t in range(1, 20)))
    index = {r.k: r.t for r in history.groupBy("k").agg(F.max("tx").alias("t")).collect()}
    rows, want = [], {}
    for db in range(3):
        requests = [(rng.randint(10, 40), [f"k{rng.randint(0, 30)}" for _ in range(rng.randint(0, 2))], sorted({f"k{rng.randint(0, 30)}" for _ in range(rng.randint(0, 2))})) for _ in range(150)]
        rows += [(db, n, db * 1000 + n, r, reads, [(k, "v", False) for k in w]) for n, (r, reads, w) in enumerate(requests, 1)]
        want |= {db * 1000 + n: o for n, o in enumerate(sequential(index | {"": 19}, requests, size), 1)}
    rng.shuffle(rows)
    got = occ.commit(spark.createDataFrame(rows, REQUESTS), history, size).collect()
    assert {r.txid: r.outcome for r in got} == want and len(set(want.values())) == 2


def test_conflicts_before_a_bound(spark):
    rng = random.Random(8)
    versions = [(i, rng.randint(1, 60), f"k{rng.randint(0, 5)}", "v", False) for i in range(80)]
    asked = [(t, rng.randint(0, 50), f"k{rng.randint(0, 6)}", rng.randint(1, 60)) for t in range(100) for _ in range(2)]
    want = {}
    for t, read, k, until in asked:
        if any(v[2] == k and read < v[1] < until for v in versions):
            want.setdefault(t, set()).add(k)
    touched = spark.createDataFrame(asked, "txid bigint, read_tx bigint, k string, until bigint")
    for spread in (False, True, None):
        got = {r.txid: r.bad_keys for r in occ.conflicts(touched, spark.createDataFrame(versions, LOG), until="until", spread=spread).collect()}
        assert got == {t: len(k) for t, k in want.items()}


def test_own_writes_and_snapshots(spark):
    history = log(spark, (1, "k", "v1"), (2, "k", "v2"), (2, "gone", "x"), (3, "gone", None))
    probes = spark.createDataFrame([("k", 1), ("k", 2), ("gone", 2), ("gone", 3), ("none", 9)], "k string, read_tx bigint")
    want = [("gone", 2, "x", 2), ("gone", 3, None, 3), ("k", 1, "v1", 1), ("k", 2, "v2", 2), ("none", 9, None, None)]
    assert sorted(map(tuple, mvcc.as_of_get(history, probes).collect())) == want
    assert sorted(map(tuple, mvcc.as_of_get_union(history, probes).collect())) == want
    pending = spark.createDataFrame([("k", "mine", False), ("gone", None, True)], "k string, v string, del boolean")
    got = {(r.k, r.read_tx): (r.v, r.own) for r in mvcc.read_own_writes(history, probes, pending).collect()}
    assert got["k", 1] == ("mine", True) and got["gone", 2] == (None, True) and got["none", 9] == (None, False)


def test_key_counts(spark):
    steps = [(1, "k1", "a"), (1, "k2", "a"), (2, "k1", "b"), (3, "k2", None), (4, "k2", "c")]
    for n, want in ((2, 2), (3, 2), (4, 1), (5, 2)):
        history = log(spark, *steps[:n])
        assert latest.key_count(history).first().n == latest.key_count_by_delta(history).first().n == want


def test_multi_get_and_delete(spark):
    history = log(spark, (1, "k1", "v1"), (1, "k2", "v2"), (1, "k3", "v3"))
    assert [r.v for r in mvcc.multi_get(history, ["k1", "k2", "missing", "k3"]).collect()] == ["v1", "v2", None, "v3"]
    assert mvcc.delete_count(history, spark.createDataFrame([("k1",), ("k2",), ("k1",)], "k string")).first().n == 2


def test_restore_takes_the_last_record(spark):
    rows = [(0, "a", "1", False), (1, "b", "1", False), (2, "a", "2", False), (3, "b", None, True)]
    got = mvcc.restore_replay(spark.createDataFrame(rows, "pos bigint, k string, v string, del boolean"), 5, 9).collect()
    assert [tuple(r) for r in got] == [("a", "2", 9, 5)]


def test_garbage_and_compaction(spark):
    history = log(spark, (1, "key1", "old_value"), (2, "key1", "new"), (3, "B", "v1"), (4, "B", None), (5, "A", "v1")).withColumn("file_id", (F.col("seq") - 1).cast("bigint"))
    assert {r.file_id: r.garbage for r in gc.garbage(history).collect()} == {0: 29 + 4 + 9, 2: 29 + 1 + 2}
    assert tuple(gc.compaction_pick(history, 1).first()) == (0, 42)
    small = gc.compact(history, [0, 1, 2, 3], 9)
    assert latest.live_state(small).select("k", "v").orderBy("k").collect() == latest.live_state(history).select("k", "v").orderBy("k").collect()
    assert small.count() == 3
    kept = gc.compact(history, [0, 1, 2, 3], 9, horizon=1)
    probes = spark.createDataFrame([("key1", 1), ("key1", 2), ("B", 3)], "k string, read_tx bigint")
    assert [r.v for r in mvcc.as_of_get(kept, probes).orderBy("read_tx").collect()] == ["old_value", "new", "v1"]


def test_readers_keep_files(spark):
    files = spark.createDataFrame([(1, 5), (2, 9)], "file_id bigint, obsolete_at bigint")
    readers = lambda *r: spark.createDataFrame([(x,) for x in r], "read_tx bigint")
    assert [r.file_id for r in gc.deletable(files, readers(7, 20), 30).collect()] == [1]
    assert gc.deletable(files, readers(5), 30).count() == 0
    assert gc.deletable(files, readers(), 9).count() == 2


def test_merges_against_a_sequential_model(spark):
    rng = random.Random(42)
    rows = [(s, s, f"k{rng.randint(0, 9)}", f"v{s}" if rng.random() < 0.8 else None, rng.randint(0, 7)) for s in range(1, 200)]
    frame = spark.createDataFrame([(s, t, k, v, v is None, f, s * 1000) for s, t, k, v, f in rows], LOG + ", file bigint, ts bigint")
    model: dict[str, tuple[int, str]] = {}
    for f in range(8):
        batch: dict[str, tuple] = {}
        for s, _, k, v, g in rows:
            if g == f and (k not in batch or s > batch[k][0]):
                batch[k] = (s, v)
        for k, (s, v) in batch.items():
            if v is None:
                if k in model and s > model[k][0]:
                    del model[k]
            elif k not in model or s > model[k][0]:
                model[k] = (s, v)
    assert {r.k: (r.seq, r.v) for r in merge.fold_files(frame, "file").collect()} == model
    state = spark.createDataFrame([], "k string, v string, log_seq bigint, tx_id bigint, updated_at timestamp")
    for f in range(8):
        state = spark.createDataFrame(merge.merge_batch(state, frame.where(F.col("file") == f).drop("file")).collect(), state.schema)
    assert {r.k: (r.log_seq, r.v) for r in state.collect()} == model
    live = {}
    for s, _, k, v, _ in rows:
        live[k] = (s, v)
    assert {r.k: (r.seq, r.v) for r in latest.live_state(frame).collect()} == {k: x for k, x in live.items() if x[1] is not None}


def purged(files, least):
    """File after file: empty ones go; others go if the next begins at or before `least`, stay before an empty one, and end the purge otherwise."""
    out = []
    for n, (file_id, first) in enumerate(files[:-1]):
        after = files[n + 1][1]
        if first is None:
            out.append(file_id)
        elif after is None:
            if n + 2 == len(files):
                break
        elif after <= least:
            out.append(file_id)
        else:
            break
    return out


def test_purges_against_a_loop(spark):
    rng = random.Random(21)
    cases = [([(0, 1), (1, None), (2, 10), (3, 20)], 20), ([(0, 1), (1, None)], 9), ([(0, None)], 9), ([], 9)]
    for _ in range(12):
        op, files = 0, []
        for n in range(rng.randint(1, 9)):
            op += rng.randint(1, 9)
            files.append((n, None if rng.random() < 0.3 else op))
        cases.append((files, rng.randint(0, 40)))
    for files, least in cases:
        frame = spark.createDataFrame([(n, first, 0, n) for n, first in files], "file_id bigint, first_op bigint, tli int, start_offset bigint")
        assert sorted(r.file_id for r in logfiles.purgeable(frame, least).collect()) == purged(files, least), (files, least)
    assert purged(*cases[0]) == [1, 2]


def test_forks_end_between_transactions(spark):
    rows = [(seq, tx, 1, f"k{seq}") for tx, first in ((1, 97), (2, 99), (3, 102)) for seq in range(first, first + 3 - (tx == 1))]
    frame = spark.createDataFrame(rows + [(500, 9, 2, "k")], "seq bigint, tx bigint, tli bigint, k string")
    history = spark.createDataFrame([(1, 0, 100)], "tli bigint, start_op bigint, end_op bigint")
    assert sorted(r.seq for r in logfiles.prune_timelines(frame, history).collect()) == [97, 98, 99, 100, 101, 500]


def test_timelines_jump_forward_only(spark):
    changes = spark.createDataFrame([(1, None, 10), (2, 5, 20), (3, 5, 25), (4, 3, 28), (5, None, 30)], "at bigint, tli bigint, last_op bigint")
    assert [tuple(r) for r in logfiles.timeline_changes(changes).collect()] == [(1, 0, 10), (2, 10, 20), (5, 20, 30)]
    assert logfiles.timeline_changes(changes.limit(0)).count() == 0


def test_packets_and_chunks_count_bytes(spark):
    rows = [(1, 1, "é", "ab"), (2, 1, "k", None), (3, 2, "k" * 50, "v")]
    frame = spark.createDataFrame(rows, "seq bigint, tx bigint, k string, v string")
    got = [(r.seq, r.marker, r.size, r.packet) for r in logfiles.packed(frame, 60).orderBy("seq", "marker").collect()]
    assert got == [(1, False, 29, 0), (2, False, 26, 0), (2, True, 25, 0), (3, False, 76, 1), (3, True, 25, 2)]
    assert [tuple(r) for r in logfiles.overflowing(logfiles.packed(frame), 60).collect()] == [(2, 76)]
    assert [r.chunk for r in logfiles.chunked(frame, 4).orderBy("k").collect()] == [0, 0, 13]


def test_retention(spark):
    slots = spark.createDataFrame([(10,), (7,)], "log_seq bigint")
    assert logfiles.retention_floor(slots, None, 9).first().safe == 7 and logfiles.retention_floor(slots.limit(0), None, None).first().safe == (1 << 63) - 1
    with pytest.raises(logfiles.LogUnavailable):
        logfiles.scan_from(log(spark, (1, "a", "b")).where("seq > 1").unionByName(log(spark, (1, "a", "b")).withColumn("seq", F.lit(5).cast("bigint"))), 2, checked=True)
    assert logfiles.scan_from(spark.range(1, 51).withColumnRenamed("id", "seq"), 25, checked=True).count() == 26


def test_replicas(spark):
    slots = spark.createDataFrame([(10, "server", True), (4, "server", False), (8, "cdc", True)], "log_seq bigint, role string, connected boolean")
    head = spark.createDataFrame([(10,)], "head bigint")
    assert replication.quorum(slots, 1).first().committed == 10 and replication.quorum(slots, 2).first().committed == 4 and replication.quorum(slots, 3).first().committed is None
    assert tuple(replication.lag(slots, head).first()) == (0, 6) and replication.healthy(slots).first().n == 1 and not replication.drained(slots, head, 0).first().drained
    events = spark.createDataFrame([(1, 1, "replicaof"), (1, 2, "promote"), (1, 3, "replicaof"), (1, 4, "stepdown"), (2, 1, "stepdown"), (3, 1, "promote"), (3, 2, "flushdb")], "db bigint, at bigint, event string")
    assert {r.db: r.state for r in replication.states(events).collect()} == {1: "STEPPING_DOWN", 2: "UNDEFINED", 3: "UNDEFINED"}
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), at, rng.choice(["replicaof", "promote", "stepdown", "drained", "flushdb"])) for at in range(300)]
    want = {}
    for db, _, event in rows:
        want[db] = replication.MOVES.get((want.get(db, "UNDEFINED"), event), want.get(db, "UNDEFINED"))
    assert {r.db: r.state for r in replication.states(spark.createDataFrame(rows, "db bigint, at bigint, event string").repartition(4)).collect()} == want


def test_gates(spark):
    rows = [("client", "UNDEFINED", "begin", False), ("client", "REPLICA", "get", False), ("client", "REPLICA", "set", False), ("client", "STEPPING_DOWN", "begin", False), ("client", "STEPPING_DOWN", "set", True), ("client", "PRIMARY", "promote", False), ("admin", "PRIMARY", "stat", True), ("cdc", "PRIMARY", "hello", False)]
    got = {tuple(r)[:4]: r.ok for r in occ.gated(spark.createDataFrame(rows, "role string, state string, op string, in_tx boolean")).collect()}
    assert [got[r] for r in rows] == [False, True, False, False, True, False, False, True]


def test_prefix_sums(spark):
    rng = random.Random(1)
    values = [(i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 500)]
    got = {r.i: r.s for r in running(spark.createDataFrame(values, "i bigint, x bigint"), ["i"], "x", "s").collect()}
    total = 0
    for i, x in sorted(values):
        total += x
        assert got[i] == total
    assert sorted(r.n for r in numbered(spark.createDataFrame(values, "i bigint, x bigint"), ["i"], "n").collect()) == list(range(1, 501))


def test_a_hot_key_spans_ranges(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", i, rng.choice([None, i])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, i bigint, x bigint")
    for before in (False, True):
        for backwards in (False, True):
            got = {r.i: r.y for r in carried(frame, "k", ["i"], "x", "y", before, backwards).collect()}
            last: dict[str, int | None] = {}
            for k, i, x in reversed(rows) if backwards else rows:
                want = last.get(k)
                if x is not None:
                    last[k] = x
                assert got[i] == (want if before else last.get(k))
