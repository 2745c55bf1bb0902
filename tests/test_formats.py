"""Files: round trips, damage, change files, versioned tables and restarts of streams."""

import functools
import hashlib
import itertools
import json
import random
import time
from datetime import datetime
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelake.functions import codec, workload
from changelake.operators import merge, stats
from changelake.plans.table import VersionedTable
from changelake.schemas import STATE, STATE_TOMBSTONE
from changelake.sources import binary, cdc_json
from changelake.streaming import loader

ENTRY = st.tuples(st.binary(min_size=1, max_size=20), st.one_of(st.none(), st.binary(max_size=40))).map(lambda x: (x[0], x[1], x[1] is None))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**60), st.integers(0, 2**60), st.lists(ENTRY, max_size=5)), max_size=5))
def test_wal_round_trip(frames):
    data = b"".join(binary.wal_frame(tx, op, entries) for tx, op, entries in frames)
    assert list(binary.wal_rows(data)) == [(n, tx, op + i, *e) for n, (tx, op, entries) in enumerate(frames) for i, e in enumerate(entries)]
    for cut in (1, 5):
        if data:
            with pytest.raises(binary.Corrupt):
                list(binary.wal_rows(data[:-cut]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**60), st.integers(0, 2**60), ENTRY), min_size=1, max_size=6), st.integers(0, 10**6))
def test_vlog_round_trip_and_damage(records, where):
    parts = [binary.vlog_record(tx, op, *e) for tx, op, e in records]
    data = b"".join(parts)
    rows = list(binary.vlog_rows(data))
    assert [(r[1], r[2], *r[3:6]) for r in rows] == [(tx, op, *e) for tx, op, e in records] and [r[6] for r in rows] == list(map(len, parts))
    damaged = bytearray(data)
    damaged[where % len(data)] ^= 0x40
    hit = next(i for i in range(len(parts)) if where % len(data) < sum(map(len, parts[: i + 1])))
    assert list(binary.vlog_rows(bytes(damaged), last=True)) == rows[:hit]
    with pytest.raises(binary.Corrupt):
        list(binary.vlog_rows(bytes(damaged)))


def test_checksum_and_keys():
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert sorted([codec.index_key(b"a", 1), codec.index_key(b"a", 9), codec.index_key(b"b", 5)]) == [codec.index_key(b"a", 9), codec.index_key(b"a", 1), codec.index_key(b"b", 5)]
    assert codec.index_key_parts(codec.index_key(b"x\0y", 77)) == (b"x\0y", 77)
    value = codec.index_value(3, 1 << 40, 12, 5, 6, True)
    assert len(value) == 33 and codec.index_value_parts(value) == (3, 1 << 40, 12, 5, 6, True)


def test_scalar_functions(spark):
    rows = spark.createDataFrame([("64MB", b"123456789"), (" 2 gb", None), ("", b""), ("x", b"a")], "x string, b binary")
    got = rows.select(codec.parse_bytes(F.col("x")).alias("n"), codec.crc32c_column(F.col("b")).alias("c")).collect()
    assert [r.n for r in got] == [64 << 20, 2 << 30, 0, None] and got[0].c == 0xE3069283 and got[1].c is None
    keys = spark.createDataFrame([("ok",), ("",), ("é",), ("!sys!x",)], "k string").select(codec.valid_key(F.col("k")).alias("v")).collect()
    assert [r.v for r in keys] == [True, False, False, False]


def test_binary_readers(spark, tmp_path):
    (tmp_path / "wal_0_00000000000000000000.wal").write_bytes(binary.wal_frame(1, 1, [(b"a", b"1", False), (b"b", b"2", False)]))
    (tmp_path / "wal_1_00000000000000000050.wal").write_bytes(binary.wal_frame(2, 3, [(b"a", None, True)]) + binary.wal_frame(3, 4, []))
    got = binary.read_wal(spark, str(tmp_path)).orderBy("op").collect()
    assert [(r.tx, r.op, bytes(r.k), None if r.v is None else bytes(r.v), r["del"]) for r in got] == [(1, 1, b"a", b"1", False), (1, 2, b"b", b"2", False), (2, 3, b"a", None, True)]
    (tmp_path / "1.vlog").write_bytes(binary.vlog_record(1, 1, b"a", b"1", False))
    (tmp_path / "2.vlog").write_bytes(binary.vlog_record(1, 2, b"b", b"2", False) + b"half a rec")
    assert [(r.file_id, r.offset, r.size) for r in binary.read_vlog(spark, str(tmp_path)).orderBy("op").collect()] == [(1, 0, 31), (2, 0, 31)]


def test_checksums_of_many_values():
    rng = random.Random(11)
    plain = lambda data: functools.reduce(lambda c, b: codec.TABLE[(c ^ b) & 255] ^ c >> 8, data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    values = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 127, 128, 129, 1000, 5000, 70_001)] + [bytes(200), b"\xff" * 4096] + [rng.randbytes(rng.randint(0, 300)) for _ in range(50)]
    assert codec.crc32c_all(values).tolist() == [plain(v) for v in values] == [codec.crc32c(v) for v in values]
    assert codec.crc32c_all([]).size == 0


@pytest.mark.parametrize("split", [90, 1000])
def test_large_files_are_read_in_parts(spark, tmp_path, split):
    rng = random.Random(4)
    entries = [(f"k{i}".encode(), None if i % 5 == 0 else rng.randbytes(rng.randint(0, 30)), i % 5 == 0) for i in range(60)]
    wal = b"".join(binary.wal_frame(n, 3 * n, entries[3 * n : 3 * n + 3]) for n in range(20))
    (tmp_path / "00000000000000000000.wal").write_bytes(wal)
    vlog = b"".join(binary.vlog_record(i, i, *e) for i, e in enumerate(entries))
    (tmp_path / "1.vlog").write_bytes(vlog)
    (tmp_path / "2.vlog").write_bytes(vlog + b"half a rec")
    found = binary.read_wal(spark, str(tmp_path), split)
    assert found.rdd.getNumPartitions() == -(-len(wal) // split)
    assert [(r.frame, r.tx, r.op, bytes(r.k)) for r in found.orderBy("op").collect()] == [(i // 3, i // 3, i, e[0]) for i, e in enumerate(entries)]
    got = binary.read_vlog(spark, str(tmp_path), split).orderBy("file_id", "offset").collect()
    assert [(r.op, r.offset, r.size) for r in got] == [(r[2], r[0], r[6]) for r in binary.vlog_rows(vlog)] * 2
    (tmp_path / "basebackup.bin").write_bytes(data := b"".join(binary.backup_bytes(entries)))
    (tmp_path / "backup.meta").write_text(json.dumps({"sha256": hashlib.sha256(data).hexdigest()}))
    rows, _ = binary.read_backup(spark, str(tmp_path), split)
    assert [(r.pos, bytes(r.k), r["del"]) for r in rows.orderBy("pos").collect()] == [(i, e[0], e[2]) for i, e in enumerate(entries)]
    (tmp_path / "00000000000000000000.wal").write_bytes(wal[:-1])
    with pytest.raises(Exception, match="wrong length"):
        binary.read_wal(spark, str(tmp_path), split).collect()


@pytest.mark.parametrize("compressed", [False, True])
def test_backup(spark, tmp_path, compressed):
    state = spark.createDataFrame([(f"k{i}", f"v{i}") for i in range(500)], "k string, v string")
    meta = binary.write_backup(state, str(tmp_path / "b"), "1", 2, 7, 99, "2024-01-01T00:00:00Z", compressed)
    rows, read = binary.read_backup(spark, str(tmp_path / "b"))
    assert read == meta and {(bytes(r.k), bytes(r.v)) for r in rows.collect()} == {(f"k{i}".encode(), f"v{i}".encode()) for i in range(500)}
    name = next((tmp_path / "b").glob("basebackup*"))
    name.write_bytes(name.read_bytes() + b"x")
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(binary.Corrupt):
        binary.read_backup(spark, str(tmp_path / "b"))


LINES = [
    '{"k":"a","v":"text","seq":1,"tx":1,"ts":1000}',
    '{"k":"b","v":{"z":1,"a":[1.0,"x"]},"seq":2,"tx":1,"ts":1500}',
    '{"k":"c","v":9007199254740993,"seq":3,"tx":2,"ts":2000}',
    '{"k":"d","v":1.0,"seq":4,"tx":2,"ts":2000}',
    '{"k":"e","v":null,"seq":5,"tx":2,"ts":2000}',
    '{"k":"a","del":true,"seq":6,"tx":3,"ts":2500}',
    '{"k":"b","v":"later","seq":7,"tx":3,"ts":2600}',
    "not json",
    "",
    '{"v":"no key","seq":8,"tx":3,"ts":1}',
    '{"k":"z","v":"cut of',
]


def test_change_files(spark, tmp_path):
    (tmp_path / "cdc-my-db-100-1.jsonl").write_text("\n".join(LINES))
    (tmp_path / "cdc-my-db-100-2.jsonl.part").write_text('{"k":"never","v":1,"seq":9,"tx":9,"ts":1}')
    got = {(r.k, r.seq): (r.v, r["del"], r.db) for r in cdc_json.read(spark, str(tmp_path)).collect()}
    assert got == {("a", 1): ('"text"', False, "my-db"), ("b", 2): ('{"z":1,"a":[1.0,"x"]}', False, "my-db"), ("c", 3): ("9007199254740993", False, "my-db"), ("d", 4): ("1.0", False, "my-db"), ("e", 5): (None, False, "my-db"), ("a", 6): (None, True, "my-db"), ("b", 7): ('"later"', False, "my-db")}
    assert cdc_json.dropped(spark, str(tmp_path)).first().dropped == 3


@pytest.mark.parametrize("form", ["text", "base64", "json"])
def test_change_files_round_trip(spark, tmp_path, form):
    rows = [("a", '{"x": 1}', False, 1, 1, 5), ("q\"\\", 'say "hi"\n', False, 2, 1, 6), ("b", None, True, 3, 2, 7), ("c", "12", False, 4, 2, 8)]
    frame = spark.createDataFrame(rows, "k string, v string, del boolean, seq bigint, tx bigint, ts bigint")
    names = cdc_json.write(frame, str(tmp_path), "0", 123, records_per_file=2, form=form)
    assert len(names) >= 2 and all(n.startswith("cdc-0-123-") for n in names) and not list(tmp_path.glob("*.part"))
    lines = [json.loads(x) for n in names for x in (tmp_path / n).read_text().splitlines()]
    assert [x["seq"] for x in lines] == [1, 2, 3, 4] and [x["k"] for x in lines] == [r[0] for r in rows]
    assert lines[2] == {"k": "b", "del": True, "seq": 3, "tx": 2, "ts": 7}
    want = {"text": ['{"x": 1}', 'say "hi"\n', "12"], "base64": ["eyJ4IjogMX0=", "c2F5ICJoaSIK", "MTI="], "json": [{"x": 1}, 'say "hi"\n', 12]}[form]
    assert [lines[i]["v"] for i in (0, 1, 3)] == want
    assert cdc_json.read(spark, str(tmp_path)).count() == 4


def write_file(folder: Path, number: int, rows):
    text = "".join(json.dumps({"k": k, **({"del": True} if v is None else {"v": v}), "seq": s, "tx": s, "ts": s * 1000}) + "\n" for k, v, s in rows)
    part = folder / f"cdc-0-{number:05d}-1.jsonl.part"
    part.write_text(text)
    part.rename(folder / f"cdc-0-{number:05d}-1.jsonl")


def state_table(spark, tmp_path, hard):
    return VersionedTable(spark, str(tmp_path / "table"), STATE) if hard else VersionedTable(spark, str(tmp_path / "table"), STATE_TOMBSTONE, order="log_seq")


@pytest.mark.parametrize("hard", [False, True])
def test_a_new_checkpoint_loses_and_repeats_nothing(spark, tmp_path, hard):
    folder = tmp_path / "in"
    folder.mkdir()
    table = state_table(spark, tmp_path, hard)
    for n, checkpoint in enumerate(("a", "a", "b", "b")):
        write_file(folder, n, [(f"k{n}", "v", n + 1), ("gone", None if n == 2 else f"v{n}", 10 - n if n == 3 else n + 10)])
        loader.start(cdc_json.stream(spark, str(folder)), table, str(tmp_path / checkpoint), hard_delete=hard).awaitTermination(120)
        assert sorted(r.filename for r in table.processed().collect()) == [f"cdc-0-{m:05d}-1.jsonl" for m in range(n + 1)]
    live = table.read() if hard else table.read().where("not is_deleted")
    # A hard delete forgets, so an older put brings the key back.
    assert {r.k for r in live.collect()} == {"k0", "k1", "k2", "k3", *(["gone"] if hard else [])}


def test_a_table_is_never_without_a_manifest(spark, tmp_path):
    table = state_table(spark, tmp_path, True)
    assert table.read().count() == 0 and table.processed().count() == 0
    rows = lambda *keys: spark.createDataFrame([(k, "v", 1, 1, None) for k in keys], STATE)
    assert [table.write(rows("a")), table.append(rows("b")), table.append(rows("c"))] == [1, 2, 3]
    folder = tmp_path / "table"
    (folder / "manifest-000000000004.json").write_text('{"version": 4, "par')  # cut off while it was written
    (folder / ".manifest-000000000004.json.crc").unlink(missing_ok=True)
    assert table.manifest()["version"] == 3 and {r.k for r in table.read().collect()} == {"a", "b", "c"}
    assert {r.k for r in table.read(2).collect()} == {"a", "b"}
    (folder / "v4").mkdir()  # what a failed run leaves is replaced
    assert table.append(rows("d").withColumn("_gone", F.lit(False)).unionByName(rows("a").withColumn("_gone", F.lit(True)))) == 4
    assert {r.k for r in table.read().collect()} == {"b", "c", "d"} and sorted(p.name for p in folder.glob("v*")) == ["v1", "v2", "v3", "v4"]
    assert table.vacuum() == 5 and table.manifest()["statistics"]["rows"] == 3 and table.manifest()["statistics"]["highest"] == "d"
    assert table.write(rows("z")) == 6 and table.write(rows("y")) == 7 and sorted(p.name for p in folder.glob("v*")) == ["v6", "v7"]


def test_every_so_many_files_the_table_is_rewritten(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table = state_table(spark, tmp_path, True)
    for n in range(3):
        write_file(folder, n, [(f"k{n}", "v", n + 1)])
        loader.start(cdc_json.stream(spark, str(folder)), table, str(tmp_path / "c"), hard_delete=True, vacuum_every=2).awaitTermination(120)
    assert len(table.manifest()["parts"]) == 2 and table.read().count() == 3 and table.processed().count() == 3


@pytest.mark.parametrize("hard", [False, True])
def test_stream_restarts_and_repeats(spark, tmp_path, hard):
    folder, rng = tmp_path / "in", random.Random(7)
    folder.mkdir()
    table = state_table(spark, tmp_path, hard)
    model, everything, seq = {}, {}, 0
    for round_ in range(3):
        for n in range(2):
            rows = []
            for _ in range(15):
                seq += 1
                rows.append((f"k{rng.randint(0, 6)}", rng.choice([None, f"v{seq}"]), seq))
            write_file(folder, round_ * 2 + n, rows)
            for k, v, s in rows:
                everything[k] = (v, s)
                if v is None:
                    model.pop(k, None)
                else:
                    model[k] = (json.dumps(v), s)
        stream = cdc_json.stream(spark, str(folder))
        loader.start(stream, table, str(tmp_path / "checkpoint"), hard_delete=hard).awaitTermination(120)
        state = table.read() if hard else table.read().where("not is_deleted")
        assert {r.k: (r.v, r.log_seq) for r in state.collect()} == model
    version = table.manifest()
    run = loader.into_hard_deletes(table) if hard else loader.into_tombstones(table)
    run(cdc_json.read(spark, str(folder)), 0)  # repeated files change nothing
    assert table.manifest() == version
    assert table.vacuum() == version["version"] + 1 and table.read().count() == (len(model) if hard else len(everything))
    assert table.read().where("updated_at is null").count() == 0


def test_hard_deletes_resurrect_in_file_order(spark):
    rows = [("k", "old", False, 1, 1, "cdc-2"), ("k", None, True, 5, 5, "cdc-1"), ("k", "first", False, 2, 2, "cdc-0")]
    frame = spark.createDataFrame([(*r, 1000) for r in rows], "k string, v string, del boolean, seq bigint, tx bigint, file string, ts bigint")
    assert [tuple(r) for r in merge.fold_files(frame, "file").collect()] == [("k", 1, "old")]
    state = spark.createDataFrame([("k", "before", 9, 9, None), ("other", "x", 1, 1, None)], STATE)
    assert [(r.k, r.v, r.log_seq, r._gone) for r in merge.fold_into(state, frame).collect()] == [("k", "before", 9, False)]
    state = spark.createDataFrame([("k", "before", 1, 1, None)], STATE)
    assert [(r.k, r.log_seq, r._gone) for r in merge.fold_into(state, frame.where("file = 'cdc-1'")).collect()] == [("k", 1, True)]


def test_rotations(spark):
    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [(0, at(0), 60), (0, at(1), 60), (0, at(2), 10), (0, at(40), 10), (0, at(41), 10), (1, at(0), 1), (1, at(59), 1)]
    got = sorted((r.db, r.at, r.number) for r in loader.rotations(spark.createDataFrame(rows, "db bigint, at timestamp, size bigint"), 100, 60, 30).collect())
    assert [n for *_, n in got] == [0, 0, 1, 2, 2, 0, 1]


def test_workloads(spark):
    assert workload.shards(10, 3) == [(1, 3), (4, 6), (7, 10)]
    assert [stats.duration_text(n) for n in (5, 65, 3600)] == ["5s", "1m5s", "1h0m0s"]
    keys = workload.bench_keys(spark, 3, 4).collect()
    assert len({r.k for r in keys}) == 12 and all(len(r.k) == 32 for r in keys)
    d = workload.devices(spark, 300)
    apps = workload.applications(d)
    assert d.collect() == workload.devices(spark, 300).collect() and d.count() == 300
    managed = apps.agg(F.avg((F.col("status") == "Managed").cast("int")).alias("m")).first().m
    assert 0.77 < managed < 0.83 and apps.select("app_uuid").distinct().count() == apps.count()
    lists = spark.createDataFrame([(["a", "b"], ["b", "c"])], "current array<string>, target array<string>")
    r = workload.list_diff_arrays(lists).first()
    assert (r.to_update, r.to_add, r.to_remove) == (["b"], ["c"], ["a"])


def odd_log(spark, n=3000):
    """Files of unlike sizes; keys and values of any letters, empty and missing values, deletes with one."""
    rng = random.Random(9)
    rows = [(min(i // 7, 20), i // 7 // 3, i, rng.choice(["a", "é", "k" * 300]) + str(i), rng.choice([None, "", "ü", "v" * rng.randint(1, 700)]), rng.choice([True, False, None])) for i in range(n)]
    return rows, spark.createDataFrame(rng.sample(rows, n), "file_id bigint, tx bigint, seq bigint, k string, v string, del boolean")


def contents(blobs):
    return {r.name: (bytes(r.content), r["last"]) for r in blobs.collect()}


def entry(row):
    return row[3].encode(), None if row[4] is None else row[4].encode(), bool(row[5])


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_log_files_are_those_of_single_frames(spark, batch):
    rows, log = odd_log(spark)
    want = {}
    for number, own in itertools.groupby(rows, lambda r: r[0]):
        frames = [binary.wal_frame(tx, of[0][2], map(entry, of)) for tx, of in ((tx, list(of)) for tx, of in itertools.groupby(own, lambda r: r[1]))]
        want[f"{number:020d}.wal"] = b"".join(frames), number == 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert contents(binary.wal_blobs(log)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert binary.wal_blobs(log.limit(0)).count() == 0
    with pytest.raises(Exception, match="without a key"):
        binary.wal_blobs(log.withColumn("k", F.when(F.col("seq") != 77, F.col("k")))).collect()


def test_small_transactions_cost_a_log_file_little(spark):
    """Frames of three entries take about as long as records of one; each was once a table of its own."""
    log = spark.range(90_000).select(F.expr("id div 1000").alias("file_id"), F.expr("id div 3").alias("tx"), F.col("id").alias("seq"), F.expr("concat('user:', id)").alias("k"), F.lit('{"k": 12}').alias("v"), F.lit(False).alias("del")).repartition(4).cache()

    def seconds(kind):
        blobs = {"wal": binary.wal_blobs, "vlog": binary.vlog_blobs}[kind](log)
        start = time.perf_counter()
        blobs.select(F.sum(F.length("content"))).collect()
        return time.perf_counter() - start

    seconds("vlog")
    assert min(seconds("wal") for _ in range(2)) < 2 * min(seconds("vlog") for _ in range(2)) + 1


def test_value_log_files_are_those_of_single_records(spark):
    rows, log = odd_log(spark)
    want = {f"{number}.vlog": (b"".join(binary.vlog_record(r[1], r[2], *entry(r)) for r in own), number == 20) for number, own in itertools.groupby(rows, lambda r: r[0])}
    assert contents(binary.vlog_blobs(log)) == want
    got = binary.decoded(binary.vlog_blobs(log), "vlog").orderBy("op").collect()
    assert [(r.file_id, r.tx, r.op, bytes(r.k), r["del"]) for r in got] == [(*r[:3], r[3].encode(), bool(r[5])) for r in rows]
    assert [r.v if r["del"] else bytes(r.v) for r in got] == [None if r[5] else (r[4] or "").encode() for r in rows]


def test_backup_ranges_are_those_of_single_records(spark):
    rows, log = odd_log(spark)
    got = contents(binary.backup_blobs(log.select("k", "v"), parts=3))
    want = b"".join(binary.backup_bytes((k, v, v is None) for k, v, _ in sorted(map(entry, rows))))
    assert len(got) == 3 and b"".join(got[name][0] for name in sorted(got)) == want
    assert not b"".join(data for data, _ in contents(binary.backup_blobs(log.select("k", "v").where("seq < 0"))).values())


@pytest.mark.parametrize("kind", ["wal", "vlog", "backup"])
def test_tasks_of_a_larger_log_hold_no_more(spark, monkeypatch, kind):
    """All blobs of a task reach its worker together."""
    monkeypatch.setattr(binary, "TOGETHER", 100_000, raising=False)
    made = {"wal": binary.wal_blobs, "vlog": binary.vlog_blobs, "backup": binary.backup_blobs}[kind]
    for n in (20_000, 80_000):
        log = spark.range(n).select(F.expr("id div 100").alias("file_id"), F.expr("id div 3").alias("tx"), F.col("id").alias("seq"), F.expr("concat('user:', id)").alias("k"), F.lit('{"k": 12}').alias("v"), F.lit(False).alias("del"))
        size = made(log).groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("size")).agg(F.max("size")).first()[0]
        assert size < 300_000
