"""The queries of the change-log engine, with the SQL that gives the same rows.

Every query runs over the whole log, which is made of the `events` table. Snapshots, floors and cutoffs, which the operators take as parameters, are shares of
the log's highest numbers. Queries that read no table or a fixed request: c06_mget, g04_bytes, g08_bench_keys, h04_devices, h04_applications, h05_shards, e08_states,
e09_roles and e10_in_tx; they show functions of their parameters, and truth tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.fixtures import kv_log, statements, table
from changelake.functions import codec, workload
from changelake.operators import gc, latest, logfiles, merge, mvcc, occ, replication, stats
from changelake.plans.prefix import numbered
from changelake.sources import binary, cdc_json
from changelake.streaming import loader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = """with log0 as (select event_id+1 seq, cast(floor(event_id/3) as bigint)+1 tx, concat('user:',cast(user_id as varchar)) k,
  case when event_type='error' then null else props end v, event_type='error' del, user_id % 4 db, cast(floor(event_id/1000) as bigint) file_id, ts from events),
 log as (select * exclude (_r) from (select l.*, row_number() over (partition by tx,k order by seq desc) _r from log0 l) z where _r=1),
 newest as (select * exclude (_n) from (select *, row_number() over (partition by k order by seq desc) _n from log) z where _n=1),
 slots as (select db, max(seq) ack from log group by db),
 waste as (select prev_file as file_id, cast(sum(prev_sz) as bigint) as garbage from (select lag(file_id) over (partition by k order by seq) prev_file, lag(29+length(k)+coalesce(length(v),0)) over (partition by k order by seq) prev_sz from log) t where prev_file is not null group by prev_file)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of the same rows if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = VIEWS + sql
        return f

    return add


def _slots(log: DataFrame) -> DataFrame:
    return log.groupBy("db").agg(F.max("seq").alias("log_seq")).withColumns({"replica_id": F.col("db").cast("string"), "role": F.lit("server"), "connected": F.col("db") > 0})


def _head(log: DataFrame) -> DataFrame:
    return log.agg(F.max("seq").alias("head"))


def _probes(log: DataFrame) -> DataFrame:
    """A read of every key just before each of its versions."""
    return log.select("k", (F.col("tx") - 1).alias("read_tx")).distinct()


def _share(log: DataFrame, column: str, percent: int) -> int:
    """A share of the highest number of a column, as a parameter."""
    return (log.agg(F.max(column)).first()[0] or 0) * percent // 100


def _share_sql(column: str, percent: int) -> str:
    return f"(select max({column}) * {percent} // 100 from log)"


@query("select k,v,del,seq,tx from newest")
def c01_dedup_latest(spark, d):
    return latest.dedup_latest(kv_log(spark, d)).select("k", "v", "del", "seq", "tx")


@query("select k,v,seq,tx from newest where not del")
def c04_live_state(spark, d):
    return latest.live_state(kv_log(spark, d)).select("k", "v", "seq", "tx")


@query("select k, v, seq as log_seq, tx as tx_id, del as is_deleted from newest")
def c04_replacing_merge(spark, d):
    log = kv_log(spark, d).select("k", "v", F.col("seq").alias("log_seq"), F.col("tx").alias("tx_id"), F.col("del").alias("is_deleted"))
    return merge.replacing_merge(log)


@query("select cast(count(*) as bigint) n from newest where not del")
def c08_key_count(spark, d):
    return latest.key_count(kv_log(spark, d))


@query("select cast(sum(case when del then (case when coalesce(pd,true) then 0 else -1 end) else (case when coalesce(pd,true) then 1 else 0 end) end) as bigint) n from (select del, lag(del) over (partition by k order by seq) pd from log) t")
def c08_key_count_delta(spark, d):
    return latest.key_count_by_delta(kv_log(spark, d))


@query("select cast(count(*) as bigint) n from newest where not del")
def c08_key_count_spread(spark, d):
    return latest.key_count_by_delta(kv_log(spark, d), spread=True)


@query(f"select k,v,seq from (select *, row_number() over (partition by k order by tx desc) rn from log where tx<={_share_sql('tx', 45)}) t where rn=1 and not del")
def c07_snapshot_at(spark, d):
    log = kv_log(spark, d)
    return latest.snapshot_at(log, _share(log, "tx", 45)).select("k", "v", "seq")


ASOF = "select p.k as k,p.read_tx as read_tx, case when l.del then null else l.v end as v, l.tx as version from (select distinct k, tx-1 as read_tx from log) p left join (select k,v,del,tx,coalesce(lead(tx) over (partition by k order by tx), 9223372036854775807) as next_tx from log) l on p.k=l.k and l.tx<=p.read_tx and p.read_tx<l.next_tx"


@query(ASOF)
def c05_asof_get(spark, d):
    log = kv_log(spark, d)
    return mvcc.as_of_get(log, _probes(log))


@query(ASOF)
def c05_asof_get_union(spark, d):
    log = kv_log(spark, d)
    return mvcc.as_of_get_union(log, _probes(log))


@query(ASOF)
def c05_asof_get_spread(spark, d):
    log = kv_log(spark, d)
    return mvcc.as_of_get_union(log, _probes(log), spread=True)


@query(f"select a.k, a.read_tx, case when p.k is not null then (case when p.del then null else p.v end) else a.v end v, p.k is not null as own from ({ASOF}) a left join (select k, 'own' as v, db = 1 as del from newest where db < 2) p on a.k = p.k")
def c05_own_writes(spark, d):
    log = kv_log(spark, d)
    pending = latest.dedup_latest(log).where("db < 2").select("k", F.lit("own").alias("v"), (F.col("db") == 1).alias("del"))
    return mvcc.read_own_writes(log, _probes(log), pending)


@query("select p.pos, p.k, l.v from (values (0,'user:2'),(1,'user:1'),(2,'nobody'),(3,'user:2')) p(pos,k) left join (select k,v from newest where not del) l on p.k = l.k")
def c06_mget(spark, d):
    return mvcc.multi_get(kv_log(spark, d), ["user:2", "user:1", "nobody", "user:2"])


@query("select k,tx as valid_from, lead(tx) over (partition by k order by tx) as valid_to from log")
def c09_version_chain(spark, d):
    return latest.version_chain(kv_log(spark, d))


@query("select k,tx as valid_from, lead(tx) over (partition by k order by tx) as valid_to from log")
def c09_version_chain_spread(spark, d):
    return latest.version_chain(kv_log(spark, d), spread=True)


@query("select tx, cast(count(*) as bigint) statements, cast(count(distinct k) as bigint) kept from log0 group by tx")
def c10_tx_collapse(spark, d):
    return mvcc.tx_collapse_count(statements(spark, d))


@query("select cast(count(distinct x.k) as bigint) n from (select 'user:1' k union all select 'user:1' union all select 'user:2' union all select 'user:9999') x join (select k from newest where not del) l on l.k=x.k")
def c11_mdel_count(spark, d):
    keys = spark.createDataFrame([("user:1",), ("user:1",), ("user:2",), ("user:9999",)], "k string")
    return mvcc.delete_count(kv_log(spark, d), keys)


@query("select (select max(seq) from log) + row_number() over (order by k) as seq, (select max(tx) from log) + 1 as tx, k, cast(null as varchar) as v, true as del from (select k from newest where not del and db = 3)")
def c11_mdel_rows(spark, d):
    log = kv_log(spark, d)
    gone = latest.live_state(log).where("db = 3").select("k", F.lit(None).cast("string").alias("v"), F.lit(True).alias("del"))
    return mvcc.write_batch(log, gone)


@query("select cast(max(tx) as bigint) as tx, cast(max(seq) as bigint) as seq from (select tx, seq from log union all select 1000000, 5000000)")
def c12_apply_batch(spark, d):
    log = kv_log(spark, d)
    batch = spark.createDataFrame([(5_000_000, 1_000_000, "k", "v", False)], "seq bigint, tx bigint, k string, v string, del boolean")
    return mvcc.clocks(mvcc.apply_batch(log.select("seq", "tx", "k", "v", "del"), batch))


@query("select k, v, cast(77 as bigint) as seq, cast(9 as bigint) as tx from newest where not del")
def c14_restore_replay(spark, d):
    backup = kv_log(spark, d).select(F.col("seq").alias("pos"), "k", "v", "del")
    return mvcc.restore_replay(backup, tx=9, seq=77)


@query("select k, tx, file_id, seq as \"offset\", seq as op, del from log")
def c15_rebuild_index(spark, d):
    values = kv_log(spark, d).select("k", "tx", "file_id", F.col("seq").alias("offset"), F.col("seq").alias("op"), "del")
    return mvcc.rebuild_index(values)


@query("select seq, tx, k from log where tx > (select max(tx) from log where file_id < 3)")
def c16_wal_gap(spark, d):
    log = kv_log(spark, d)
    return mvcc.replay_gap(log, log.where("file_id < 3")).select("seq", "tx", "k")


@query("select x.k, l.v, l.tx from (select distinct k from log where db = 2) x left join (select k, v, tx from newest where not del) l on x.k = l.k")
def c18_get_latest(spark, d):
    log = kv_log(spark, d)
    return mvcc.get_latest(log, log.where("db = 2").select("k").distinct())


FOLD = "select k, st.seq as seq, st.v as v from (select k, list_reduce(list_prepend({'seq':cast(-1 as bigint),'v':cast(null as varchar),'del':true}, list({'seq':seq,'v':v,'del':del} order by ford)), lambda a,x: case when x.del then (case when a.seq>=0 and x.seq>a.seq then {'seq':cast(-1 as bigint),'v':cast(null as varchar),'del':true} else a end) else (case when a.seq<0 or x.seq>a.seq then x else a end) end) st from (select k,v,del,seq,ford,row_number() over (partition by k,ford order by seq desc) rn from (select *,(file_id*7)%10 as ford from log) a) b where rn=1 group by k) z where st.seq>=0"


@query(FOLD)
def c02c03_fold(spark, d):
    return merge.fold_files(kv_log(spark, d).withColumn("ford", (F.col("file_id") * 7) % 10), "ford")


@query("select k, seq as log_seq from newest where file_id < 5 and not del and 1=0 union all select o.k, o.seq from (select * from (select *, row_number() over (partition by k order by seq desc) rn from log where file_id < 5) z where rn=1 and not del) o where not exists (select 1 from (select * from (select *, row_number() over (partition by k order by seq desc) rn from log where file_id >= 5) z where rn=1 and del) b where b.k=o.k and b.seq>o.seq)")
def c02_conditional_delete(spark, d):
    log = kv_log(spark, d)
    state = latest.live_state(log.where("file_id < 5")).select("k", "v", F.col("seq").alias("log_seq"))
    return merge.conditional_delete(state, latest.dedup_latest(log.where("file_id >= 5"))).select("k", "log_seq")


@query("select coalesce(b.k,o.k) k, case when b.seq is not null and (o.seq is null or b.seq>o.seq) then b.seq else o.seq end log_seq, case when b.seq is not null and (o.seq is null or b.seq>o.seq) then b.v else o.v end v from (select * from (select *, row_number() over (partition by k order by seq desc) rn from log where file_id % 2 = 1) z where rn=1 and not del) o full join (select * from (select *, row_number() over (partition by k order by seq desc) rn from log where file_id % 2 = 0) z where rn=1 and not del) b on o.k=b.k")
def c03_conditional_upsert(spark, d):
    log = kv_log(spark, d).withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp")))
    state = merge.as_state(latest.live_state(log.where("file_id % 2 = 1")))
    return merge.conditional_upsert(state, latest.dedup_latest(log.where("file_id % 2 = 0"))).select("k", "log_seq", "v")


@query("select f.filename from (select distinct concat('cdc-0-', cast(file_id as varchar), '.jsonl') filename, file_id from log) f where file_id % 3 <> 0")
def b06_file_gate(spark, d):
    name = F.concat(F.lit("cdc-0-"), F.col("file_id").cast("string"), F.lit(".jsonl")).alias("filename")
    files = kv_log(spark, d).select("file_id", name).distinct()
    return merge.ungated(files.select("filename"), files.where("file_id % 3 = 0"))


@query(f"select seq,k from log where seq>={_share_sql('seq', 90)}")
def a05_scan_from(spark, d):
    log = kv_log(spark, d)
    return logfiles.scan_from(log, _share(log, "seq", 90)).select("seq", "k")


@query(f"select max(seq) as loc from log where seq<={_share_sql('seq', 43)}")
def a06_wal_floor(spark, d):
    log = kv_log(spark, d)
    return logfiles.floor_lookup(log, _share(log, "seq", 43))


@query("select concat('wal_', cast(db as varchar), '_', lpad(cast(file_id as varchar), 20, '0'), '.wal') as name, db as tli, file_id as start_offset from (select distinct db, file_id from log where db > 0) union all select concat(lpad(cast(file_id as varchar), 20, '0'), '.wal'), 0, file_id from (select distinct file_id from log)")
def a12_wal_names(spark, d):
    files = kv_log(spark, d).select("db", "file_id").distinct()
    offset = F.lpad(F.col("file_id").cast("string"), 20, "0")
    new = files.where("db > 0").select(F.concat(F.lit("wal_"), F.col("db").cast("string"), F.lit("_"), offset, F.lit(".wal")).alias("name"))
    return logfiles.parsed_names(new.unionByName(files.select(F.concat(offset, F.lit(".wal")).alias("name")).distinct()))


PURGED = f"""select file_id from (select *, max(stop) over (order by file_id rows unbounded preceding) ended from (select *,
    case when first_op is null then false when after is null then farther is null else after > {_share_sql('seq', 45)} end stop, first_op is null or coalesce(after <= {_share_sql('seq', 45)}, false) ok
  from (select *, lead(first_op) over w after, lead(1) over w place, lead(1, 2) over w farther from files window w as (order by file_id)) where place is not null)) where ok and not ended"""


@query(f"{PURGED.replace('from files', 'from (select file_id, min(seq) first_op from log group by file_id)')}")
def d01_wal_purge(spark, d):
    log = kv_log(spark, d)
    return logfiles.purgeable(logfiles.files_of(log), _share(log, "seq", 45))


@query(f"{PURGED.replace('from files', 'from (select file_id, case when file_id % 4 <> 1 then min(seq) end first_op from log group by file_id)')}")
def d01_wal_purge_empty(spark, d):
    """Every fourth file is empty."""
    log = kv_log(spark, d)
    files = logfiles.files_of(log).withColumn("first_op", F.when(F.col("file_id") % 4 != 1, F.col("first_op")))
    return logfiles.purgeable(files, _share(log, "seq", 45))


@query(f"select least({_share_sql('seq', 50)}, (select min(ack) from slots)) as safe")
def d02_retention(spark, d):
    log = kv_log(spark, d)
    return logfiles.retention_floor(_slots(log), _share(log, "seq", 50), None)


@query("select * from waste")
def d03_garbage(spark, d):
    return gc.garbage(kv_log(spark, d))


@query("select * from waste")
def d03_garbage_spread(spark, d):
    return gc.garbage(kv_log(spark, d), spread=True)


@query("select file_id, garbage as g from waste where file_id <> (select max(file_id) from log) and garbage>=1024 order by g desc, file_id limit 1")
def d04_compaction_pick(spark, d):
    return gc.compaction_pick(kv_log(spark, d), 1024)


@query("select file_id, cast(sum(case when rn=1 then 1 else 0 end) as bigint) alive, cast(sum(case when rn>1 then 1 else 0 end) as bigint) stale from (select file_id,row_number() over (partition by k order by tx desc) rn from log) t group by file_id")
def d05_liveness(spark, d):
    return gc.liveness(kv_log(spark, d))


@query("select seq, k, case when file_id in (1,2) then 99 else file_id end file_id from (select *, lead(tx) over (partition by k order by tx, seq) nxt from log) t where file_id not in (1,2) or nxt is null or nxt > 900")
def d05_rewrite(spark, d):
    return gc.compact(kv_log(spark, d), [1, 2], 99, horizon=900).select("seq", "k", "file_id")


@query("select file_id from (select file_id, max(tx) obsolete_at from log group by file_id) f where obsolete_at < (select min(tx) from log where tx >= (select max(tx) * 45 // 100 from log))")
def d06_deferred_delete(spark, d):
    """Every transaction of the log's newer part is a reader."""
    log = kv_log(spark, d)
    obsolete = log.groupBy("file_id").agg(F.max("tx").alias("obsolete_at"))
    return gc.deletable(obsolete, log.where(F.col("tx") >= _share(log, "tx", 45)).select(F.col("tx").alias("read_tx")), 0)


@query(f"select seq from (select *, min(seq) over (partition by tli, tx) as start from (select *, tx % 2 as tli from log)) l left join (select 0 as tli, {_share_sql('seq', 35)} + 1 as end_op) h on l.tli=h.tli where l.start<=coalesce(h.end_op,9223372036854775807)")
def d07_timeline_prune(spark, d):
    """Every second transaction is of a fork that ends within one."""
    log = kv_log(spark, d).withColumn("tli", F.col("tx") % 2)
    end = _share(log, "seq", 35) + 1
    return logfiles.prune_timelines(log, spark.createDataFrame([(0, 0, end)], "tli bigint, start_op bigint, end_op bigint")).select("seq")


@query("select file_id as tli, coalesce(lag(e) over (order by file_id), 0) as start_op, e as end_op from (select file_id, max(seq) e from log group by file_id)")
def d08_timeline_history(spark, d):
    return logfiles.timeline_history(kv_log(spark, d).groupBy(F.col("file_id").alias("tli")).agg(F.max("seq").alias("end_op")))


@query("select tli, coalesce(lag(e) over (order by file_id), 0) as start_op, e as end_op from (select file_id, greatest(1, coalesce(max(t) over (order by file_id rows between unbounded preceding and 1 preceding), 1)) tli, t, e from (select file_id, (file_id * 7) % 11 t, max(seq) e from log group by file_id)) where t > tli")
def d08_timeline_changes(spark, d):
    """Jumps forward, back and to the same timeline, of which only the first kind counts."""
    ends = kv_log(spark, d).groupBy(F.col("file_id").alias("at")).agg(F.max("seq").alias("last_op"))
    return logfiles.timeline_changes(ends.withColumn("tli", F.col("at") * 7 % 11))


@query("select cast(floor((cum-sz)/1024) as bigint) chunk, cast(count(*) as bigint) n from (select strlen(k)+coalesce(strlen(v),0) sz, sum(strlen(k)+coalesce(strlen(v),0)) over (order by k rows unbounded preceding) cum from newest where not del) u group by 1")
def d10_chunks(spark, d):
    return logfiles.chunked(latest.live_state(kv_log(spark, d)), 1024).groupBy("chunk").agg(F.count("*").alias("n"))


@query("select cast(floor((cum-sz)/1024) as bigint) chunk, cast(count(*) as bigint) n from (select strlen(k)+coalesce(strlen(v),0) sz, sum(strlen(k)+coalesce(strlen(v),0)) over (order by k rows unbounded preceding) cum from (select concat('é', k) k, case when db > 0 then v end v from newest)) u group by 1")
def d10_chunks_of_bytes(spark, d):
    """Chunks count bytes, and a missing value has none."""
    state = latest.dedup_latest(kv_log(spark, d)).select(F.concat(F.lit("é"), "k").alias("k"), F.when(F.col("db") > 0, F.col("v")).alias("v"))
    return logfiles.chunked(state, 1024).groupBy("chunk").agg(F.count("*").alias("n"))


@query("select packet, cast(count(*) as bigint) n, cast(sum(size) as bigint) bytes, cast(count(*) filter (where marker) as bigint) as commits from (select *, cast(floor((sum(size) over (order by seq, marker rows unbounded preceding) - size) / 4096) as bigint) packet from (select seq, false as marker, 25 + strlen(k) + coalesce(strlen(v), 0) as size from log union all select max(seq), true, 25 from log group by tx)) group by 1")
def d11_packets(spark, d):
    packets = logfiles.packed(kv_log(spark, d), 4096)
    return packets.groupBy("packet").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"), F.count_if("marker").alias("commits"))


@query("select tx, bytes from (select tx, cast(sum(25 + strlen(k) + coalesce(strlen(v), 0)) as bigint) bytes from log group by tx) where bytes > 100")
def d11_overflowing(spark, d):
    return logfiles.overflowing(logfiles.packed(kv_log(spark, d), 4096), 100)


@query("select tx, k from log where tx in (select tx from log group by tx having max(seq % 5) >= 4)")
def d11_committed(spark, d):
    log = kv_log(spark, d)
    markers = log.where("seq % 5 = 4").select("tx", F.lit("").alias("k"), F.lit(True).alias("marker"))
    return logfiles.committed_only(log.select("tx", "k", F.lit(False).alias("marker")).unionByName(markers)).select("tx", "k")


@query("select seq, k from log where db <> 2")
def d13_reset(spark, d):
    return gc.reset(kv_log(spark, d), 2).select("seq", "k")


CONFLICTS = "select r.txid as txid, cast(count(distinct r.k) as bigint) as bad_keys from (select tx as txid, tx-5 as read_tx, k from log) r where exists (select 1 from log c where c.k=r.k and c.tx>r.read_tx and c.tx<r.txid) group by r.txid"


def _snapshots(log: DataFrame) -> DataFrame:
    """Every transaction of the log as a request with a snapshot five transactions back."""
    return log.select(F.col("tx").alias("txid"), (F.col("tx") - 5).alias("read_tx"), "k")


@query(CONFLICTS)
def e03_conflicts(spark, d):
    log = kv_log(spark, d)
    return occ.conflicts(_snapshots(log), log, until="txid")


@query(CONFLICTS)
def e03_conflicts_spread(spark, d):
    log = kv_log(spark, d)
    return occ.conflicts(_snapshots(log), log, until="txid", spread=True)


@query("select r.txid as txid, cast(count(distinct r.k) as bigint) as bad_keys from (select tx as txid, tx+5 as read_tx, k from log) r join (select k, max(tx) top from log group by k) c on c.k=r.k and c.top>r.read_tx group by r.txid")
def e03_conflicts_now(spark, d):
    """Against all of the log, from snapshots five transactions on."""
    log = kv_log(spark, d)
    return occ.conflicts(log.select(F.col("tx").alias("txid"), (F.col("tx") + 5).alias("read_tx"), "k"), log)


@query("select distinct tx as txid, (select max(tx) from log) as read_tx from log")
def e01_begin(spark, d):
    log = kv_log(spark, d)
    return occ.begin(log.select(F.col("tx").alias("txid")).distinct(), log)


@query("select txid, cast(row_number() over (order by txid) as bigint) new_tx, cast(1+sum(n) over (order by txid rows unbounded preceding)-n as bigint) start_op from (select tx txid, cast(count(*) as bigint) n from log where tx%10<>3 group by tx) a")
def e05_numbering(spark, d):
    survivors = kv_log(spark, d).where("tx % 10 <> 3").groupBy(F.col("tx").alias("txid")).agg(F.count("*").alias("n"))
    return occ.numbering(survivors)


@query("select tx, cast((row_number() over (order by tx) - 1) // 128 as bigint) batch from (select distinct tx from log)")
def e06_group_commit(spark, d):
    return occ.batched(numbered(kv_log(spark, d).select("tx").distinct(), ["tx"], "arrival")).select("tx", "batch")


def requests(log: DataFrame) -> DataFrame:
    """Transaction requests of a log: each transaction reads what it writes, at a snapshot some transactions back."""
    keys = log.groupBy("db", F.col("tx").alias("txid")).agg(F.collect_set("k").alias("reads"))
    writes = F.transform("reads", lambda k: F.struct(k.alias("k"), F.lit("v").alias("v"), F.lit(False).alias("del")))
    return keys.select("db", (F.col("txid")).alias("arrival"), (F.col("txid") * 4 + F.col("db")).alias("txid"), (F.col("txid") + F.col("txid") % 50 * 40).alias("read_tx"), "reads", writes.alias("writes"))


def _outcomes_sql(size: int) -> str:
    """Each database's requests one after another: what is carried is the last writer of each key, its group and its number, counted from the log's head, as snapshots are."""
    row = "{{'txid': {0}, 'arrival': {1}, 'g': {2}, 'seen': {3}, 'stale': {4}, 'keys': {5}, 'n': {6}, 'last': {7}, 'done': {8}}}".format
    last, done = "struct(k varchar, n bigint, g bigint)[]", "struct(txid bigint, arrival bigint, outcome varchar, n_ops bigint)[]"
    none, nothing, one = f"cast([] as {last})", f"cast([] as {done})", lambda outcome, n: f"list_append(a.done, {{'txid': x.txid, 'arrival': x.arrival, 'outcome': '{outcome}', 'n_ops': {n}}})"
    own = [f"x.{c}" for c in ("txid", "arrival", "g", "seen", "stale", "keys")]
    first = row("cast(0 as bigint)", "cast(0 as bigint)", "cast(-1 as bigint)", "cast(0 as bigint)", "false", "cast([] as varchar[])", "cast(0 as bigint)", none, nothing)
    asked = row("r.tx * 4 + r.db", "r.tx", f"cast((r.tx - 1) // {size} as bigint)", "r.seen", "r.stale", "r.keys", "cast(0 as bigint)", none, nothing)
    written = "list_concat(list_filter(a.last, lambda e: not list_contains(x.keys, e.k)), list_transform(x.keys, lambda k: {'k': k, 'n': a.n + 1, 'g': x.g}))"
    met = "list_filter(a.last, lambda e: list_contains(x.keys, e.k) and (e.g = x.g or e.n > x.seen))"
    yes, no = row(*own, "a.n + 1", written, one("ok", "len(x.keys)")), row(*own, "a.n", "a.last", one("conflict", "0"))
    return f"""select u.txid, u.arrival, u.outcome, u.n_ops from (select unnest(list_reduce(list_prepend({first}, list({asked} order by r.tx)), lambda a, x: case when x.stale or len({met}) > 0 then {no} else {yes} end).done) as u from (
  select db, tx, tx + tx % 50 * 40 - (select max(tx) from log) as seen, list(distinct k) as keys, bool_or(top > tx + tx % 50 * 40) as stale from log join (select k, max(tx) top from log group by k) using (k) group by db, tx) r group by db)"""


@query()
def e04_group_outcomes(spark, d):
    log = kv_log(spark, d)
    return occ.commit(requests(log), log)


@query()
def e04_group_outcomes_of_4(spark, d):
    log = kv_log(spark, d)
    return occ.commit(requests(log), log, size=4)


@query()
def e04_group_outcomes_alone(spark, d):
    log = kv_log(spark, d)
    return occ.commit(requests(log), log, size=1)


for _name, _size in (("e04_group_outcomes", occ.GROUP), ("e04_group_outcomes_of_4", 4), ("e04_group_outcomes_alone", 1)):
    ORACLES[_name] = VIEWS + _outcomes_sql(_size)


@query("select event_id, ts < lead(ts) over (order by event_id) - interval 30 seconds as late from events where 1=0 union all select event_id, true from events where (user_id % 60) > 30")
def e07_timeouts(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("begin_ts"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("user_id") % 60).cast("decimal(18,6)"))).alias("commit_ts"))
    return occ.timed_out(e).select("event_id", F.lit(True).alias("late"))


@query("select s.state, s.r as can_read, s.w as can_write, s.b as can_begin from (values ('UNDEFINED',false,false,false),('REPLICA',true,false,true),('PRIMARY',true,true,true),('STEPPING_DOWN',true,true,false)) s(state,r,w,b)")
def e08_states(spark, d):
    return occ.state_table(spark)


@query("select r.role, o.op, r.role in ('admin','server') or (r.role='client' and (o.g=2 or o.op in ('ping','quit'))) or (r.role='cdc' and o.g=1) as allowed from (values ('admin'),('server'),('client'),('cdc')) r(role), (values ('ping',1),('quit',1),('hello',1),('begin',2),('commit',2),('abort',2),('get',2),('set',2),('del',2),('mget',2),('mset',2),('mdel',2),('select',2),('stat',2),('replicaof',3),('promote',3),('stepdown',3),('checkpoint',3),('flushdb',3)) o(op,g)")
def e09_roles(spark, d):
    return occ.role_table(spark)


@query("select o.op, o.op not in ('select','replicaof','stepdown','promote','flushdb','checkpoint','stat','quit') as allowed from (values ('ping'),('quit'),('hello'),('begin'),('commit'),('abort'),('get'),('set'),('del'),('mget'),('mset'),('mdel'),('select'),('stat'),('replicaof'),('promote'),('stepdown'),('checkpoint'),('flushdb')) o(op)")
def e10_in_tx(spark, d):
    return occ.in_tx_table(spark)


@query("select min(ack) m from slots")
def f01_min_slot(spark, d):
    return replication.min_slot(_slots(kv_log(spark, d)))


@query("select max(ack) as committed from (select ack, row_number() over (order by ack desc) rn from slots) t where rn=2")
def f02_quorum(spark, d):
    return replication.quorum(_slots(kv_log(spark, d)), 2)


@query("select cast(min(greatest((select max(seq) from log)-ack,0)) as bigint) lag, cast(max(greatest((select max(seq) from log)-ack,0)) as bigint) mx from slots")
def f03_lag(spark, d):
    log = kv_log(spark, d)
    return replication.lag(_slots(log), _head(log))


@query("select db from (select user_id % 4 db, max(event_id) + 1 ack, max(ts) filter (where user_id % 4 <> 1 or event_id < 300) seen from events group by 1) where ack < (select max(seq) from log) and seen < (select max(ts) from events) - interval 1 minute")
def f04_zombie(spark, d):
    """Slots that lag and were not heard of for a minute; one of them fell silent early."""
    e = table(spark, d, "events")
    db, at = F.col("user_id") % 4, F.col("ts").cast("timestamp")
    slots = e.groupBy(db.alias("db")).agg((F.max("event_id") + 1).alias("log_seq"), F.max(F.when((db != 1) | (F.col("event_id") < 300), at)).alias("last_seen"))
    now = F.lit(e.agg(F.max(at)).first()[0])
    return replication.zombies(slots, _head(kv_log(spark, d)), now).select("db")


@query("select db, cast(user_id as varchar) as replica_id, case when event_id % 2 = 0 then 'server' else 'cdc' end as role, m as log_seq, l as last_seen, gone is distinct from 'purchase' as connected from (select s.db, s.user_id, s.since as event_id, max(case when e.event_type <> 'signup' then e.event_id end) m, max(e.event_id) l, arg_max(e.event_type, e.event_id) gone from (select user_id % 4 db, user_id, max(event_id) since from events where event_type = 'signup' group by 1, 2) s join events e on e.user_id = s.user_id and e.event_id >= s.since group by 1, 2, 3)")
def f05_slots(spark, d):
    kind = F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "purchase", "unregister").otherwise("ack")
    role = F.when(F.col("event_id") % 2 == 0, "server").otherwise("cdc")
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("db"), F.col("user_id").cast("string").alias("replica_id"), F.col("event_id").alias("at"), kind.alias("kind"), role.alias("role"), F.when(F.col("event_type") != "signup", F.col("event_id")).alias("log_seq"))
    return replication.slots_of(e)


@query("select cast(sum(case when db>0 then 1 else 0 end) as bigint) n from slots")
def f06_healthy(spark, d):
    return replication.healthy(_slots(kv_log(spark, d)))


@query("select cast(db as varchar) as replica_id, db * 1500 as req, coalesce(db * 1500 < (select max(seq) from log where seq > 3000) and db * 1500 + 1 < (select min(seq) from log where seq > 3000), false) as snapshot from slots")
def f07_snapshot_required(spark, d):
    log = kv_log(spark, d)
    asked = _slots(log).select("replica_id", (F.col("db") * 1500).alias("req"))
    return replication.snapshot_required(asked, log.where("seq > 3000"))


@query("select db, list_reduce(list_prepend('UNDEFINED', list(event order by event_id)), lambda s, e: case when s = 'UNDEFINED' and e = 'replicaof' then 'REPLICA' when s in ('UNDEFINED', 'REPLICA') and e = 'promote' then 'PRIMARY' when s = 'PRIMARY' and e = 'stepdown' then 'STEPPING_DOWN' when s = 'REPLICA' and e = 'stepdown' then 'UNDEFINED' when s = 'STEPPING_DOWN' and e = 'drained' then 'UNDEFINED' when e = 'flushdb' then 'UNDEFINED' else s end) as state from (select user_id % 4 db, event_id, ['replicaof','promote','stepdown','drained','flushdb'][user_id % 5 + 1] as event from events) group by db")
def f09_states(spark, d):
    names = F.array(*map(F.lit, ("replicaof", "promote", "stepdown", "drained", "flushdb")))
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("db"), F.col("event_id").alias("at"), F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("event"))
    return replication.states(e)


@query("select false as drained from (select 1) where exists (select 1 from slots where ack < (select max(seq) from log)) union all select true from (select 1) where not exists (select 1 from slots where ack < (select max(seq) from log))")
def f12_drained(spark, d):
    log = kv_log(spark, d)
    return replication.drained(_slots(log), _head(log), 0)


@query("select seq, k, m.local_db from log join (values (1,10),(1,11),(2,20)) m(r,local_db) on log.db = m.r")
def f13_fan_out(spark, d):
    mapping = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "remote_db bigint, local_db int")
    return replication.fan_out(kv_log(spark, d), mapping).select("seq", "k", "local_db")


MS = "epoch_us(ts)//1000"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    log = kv_log(spark, d)
    return log.select("k", "v", "del", "seq", "tx", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))


@query(f"select seq, concat('{{\"k\":\"', k, '\"', case when del then ',\"del\":true' else concat(',\"v\":', cast(json(v) as varchar)) end, ',\"seq\":', cast(seq as varchar), ',\"tx\":', cast(tx as varchar), ',\"ts\":', cast({MS} as varchar), '}}') as line from log")
def b01_change_lines(spark, d):
    lines = cdc_json.encoded(_changes(spark, d))
    return lines.select(F.get_json_object("value", "$.seq").cast("bigint").alias("seq"), F.col("value").alias("line"))


@query(f"select k, case when del then null else cast(json(v) as varchar) end v, del, seq, tx, {MS} as ts from log")
def a01_change_records(spark, d):
    return cdc_json.decoded(cdc_json.encoded(_changes(spark, d))).where("not bad").drop("bad")


@query("select k, tx, op from (select k, tx, seq as op from log where (seq % 3 <> 0 or not del))")
def a02_bad_lines(spark, d):
    """Every third delete is cut off on its way and must not come back."""
    log = _changes(spark, d)
    lines = cdc_json.encoded(log).withColumn("seq0", F.get_json_object("value", "$.seq").cast("bigint"))
    cut = (F.col("seq0") % 3 == 0) & F.col("value").contains('"del":true')
    torn = lines.select(F.when(cut, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value")).alias("value"))
    return cdc_json.decoded(torn).where("not bad").select("k", "tx", F.col("seq").alias("op"))


@query("select min(seq) over w + row_number() over (w order by seq) - 1 as op, tx, k, v, del from log window w as (partition by file_id, tx)")
def a07_wal_decode(spark, d):
    """The log written as log files and read back. A frame has its first operation alone, and its entries follow from there."""
    found = binary.decoded(binary.wal_blobs(kv_log(spark, d)), "wal")
    return found.select("tx", "op", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "del")


@query("select file_id, cast(seq as bigint) as op, tx, k, v, del, 29 + strlen(k) + coalesce(strlen(v), 0) as size, cast(sum(29 + strlen(k) + coalesce(strlen(v), 0)) over (partition by file_id order by seq) as bigint) - (29 + strlen(k) + coalesce(strlen(v), 0)) as \"offset\" from log")
def a08_vlog_decode(spark, d):
    """The log written as value-log files and read back, with the places of its records."""
    found = binary.decoded(binary.vlog_blobs(kv_log(spark, d)), "vlog")
    return found.select("file_id", "offset", "tx", "op", F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"), "del", "size")


@query("select k, v from newest where not del")
def a09_backup_scan(spark, d):
    """The live state written as a backup in ranges of keys and read back."""
    found = binary.decoded(binary.backup_blobs(latest.live_state(kv_log(spark, d))), "backup")
    return found.select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query("select cast(sum(9 + strlen(k) + strlen(v)) as bigint) as bytes, sha256(string_agg(concat(upper(printf('%08x', strlen(k))), hex(k), upper(printf('%08x', strlen(v))), hex(v), '00'), '' order by k)) as digest from newest where not del")
def b08_backup_bytes(spark, d):
    """A backup's bytes: how many, and the checksum of their hexadecimal digits."""
    parts = binary.backup_blobs(latest.live_state(kv_log(spark, d))).select("name", F.hex("content").alias("digits"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digits"))), lambda x: x["digits"]), "")
    return parts.agg(whole.alias("digits")).select(F.floor(F.length("digits") / 2).cast("bigint").alias("bytes"), F.sha2("digits", 256).alias("digest"))


@query("select concat(cast(file_id as varchar), '.vlog') as name, file_id % 3 <> 1 as sound from (select distinct file_id from log) where file_id < (select max(file_id) from log)")
def d09_sweep(spark, d):
    """Every third value-log file has a wrong bit; the last one is not looked at."""
    blobs = binary.vlog_blobs(kv_log(spark, d))
    bad = F.concat(F.expr("substring(content, 1, 40)"), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.expr("substring(content, 41, 1)")), 16, 10).cast("int").bitwiseXOR(F.lit(64))), 2, "0")), F.expr("substring(content, 42)"))
    hit = F.regexp_extract("name", r"^(\d+)", 1).cast("int") % 3 == 1
    return binary.swept(blobs.withColumn("content", F.when(hit, bad).otherwise(F.col("content")))).select("name", "sound")


@query("select seq, to_base64(encode(v)) b from log where v is not null")
def g01_base64(spark, d):
    return kv_log(spark, d).where("v is not null").select("seq", codec.value_text(F.col("v"), "base64").alias("b"))


@query("select event_id, make_timestamp(epoch_us(ts)//1000*1000) t from events")
def g02_ts(spark, d):
    return table(spark, d, "events").select("event_id", codec.to_timestamp(F.unix_millis(F.col("ts").cast("timestamp"))).alias("t"))


@query("select k, regexp_full_match(k,'[\\x00-\\x7F]+') a from log")
def g03_ascii(spark, d):
    return kv_log(spark, d).select("k", codec.is_ascii(F.col("k")).alias("a"))


@query("select x, cast(regexp_extract(upper(x),'^ *([0-9]+)',1) as bigint)*case when upper(x) like '%GB' then 1073741824 when upper(x) like '%MB' then 1048576 when upper(x) like '%KB' then 1024 else 1 end b from (select '64MB' x union all select '1gb' union all select '12KB' union all select '77' union all select '5B') t")
def g04_bytes(spark, d):
    return spark.createDataFrame([(x,) for x in ("64MB", "1gb", "12KB", "77", "5B")], "x string").select("x", codec.parse_bytes(F.col("x")).alias("b"))


@query("select seq, sha256(v) s from log where v is not null")
def g05_sha256(spark, d):
    return kv_log(spark, d).where("v is not null").select("seq", F.sha2("v", 256).alias("s"))


@query("select seq, coalesce(cast(json_extract_string(v,'$.update_count') as bigint),0)+1 c from log")
def g09_counter(spark, d):
    return kv_log(spark, d).select("seq", codec.counter(F.col("v")).alias("c"))


@query("select coalesce(a.c,b.c) as c, cast(sum(case when a.p is not null and b.p is not null then 1 else 0 end) as bigint) upd, cast(sum(case when a.p is null then 1 else 0 end) as bigint) ad, cast(sum(case when b.p is null then 1 else 0 end) as bigint) rem from (select distinct o_custkey c, o_orderpriority p from orders where o_orderkey%2=0) a full outer join (select distinct o_custkey c, o_orderpriority p from orders where o_orderkey%2=1) b on a.c=b.c and a.p=b.p group by 1")
def h01_list_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return workload.list_diff(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"))


@query("select coalesce(l.k, i.k) k, cast(coalesce(case when not l.del then cast(json_extract_string(l.v,'$.k') as bigint) end, 0) + coalesce(i.m, 0) as bigint) as value from newest l full join (select k, count(*) m from log0 where not del group by k) i on l.k = i.k")
def h02_counters(spark, d):
    return workload.counters(kv_log(spark, d), statements(spark, d).where("not del").select("k"))


@query("select a.account, cast(1000 + coalesce((select sum(case when user_id % 10 = a.account then -1 else 0 end + case when event_id % 10 = a.account then 1 else 0 end) from events), 0) as bigint) as balance from (select unnest(range(10)) account) a")
def h03_bank(spark, d):
    moves = table(spark, d, "events").select((F.col("user_id") % 10).alias("src"), (F.col("event_id") % 10).alias("dst"), F.lit(1).alias("amount"))
    return workload.transfers_balance(moves, 10, 1000)


@query("select 'PRIMARY' as state, (select cast(count(*) as bigint) from newest where not del) key_count, (select cast(sum(garbage) as bigint) from waste) garbage_bytes, cast(7 as bigint) conflicts, cast(3 as bigint) active_connections, (select count(distinct file_id) from log) vlog_files, cast(2 as bigint) wal_files, cast(1 as bigint) active_txs, (select max(seq) from log) - (select min(ack) from slots) as replica_lag, '1h2m3s' as uptime, cast(2 as bigint) min_replicas")
def i01_stat(spark, d):
    """All eleven fields; what only a server counts is given."""
    log = kv_log(spark, d)
    return stats.stat(log, _slots(log), wal_files=2, state="PRIMARY", conflicts=7, connections=3, active_txs=1, uptime=3723, min_replicas=2)


SERIES = """select u.metric, cast(null as varchar) as db, u.value from (select unnest(['connections_active', 'connections_accepted_total', 'transactions_active']) metric, unnest([count(*) filter (where event_type = 'click'), count(*), count(*) filter (where event_type = 'signup')]) as value from events) u
union all select u.metric, cast(l.db as varchar), cast(u.value as bigint) from (select db, [coalesce(s.connections, 0), coalesce(s.active, 0), coalesce(s.conflicts, 0), m.head, m.head - m.least, m.wal_files, m.wal_bytes, m.vlog_files, m.vlog_bytes, coalesce(n.live, 0)] vals
  from (select db, max(seq) head, max(seq) filter (where file_id % 2 = 0) least, count(distinct file_id // 2) wal_files, sum(strlen(k) + coalesce(strlen(v), 0) + 9) + 28 * count(distinct tx) wal_bytes, count(distinct file_id) vlog_files, sum(29 + strlen(k) + coalesce(strlen(v), 0)) vlog_bytes from log group by db) m
  left join (select user_id % 4 db, count(*) filter (where event_type = 'click') connections, count(*) filter (where event_type = 'signup') active, count(*) filter (where event_type = 'error') conflicts from events group by 1) s using (db)
  left join (select db, count(*) live from newest where not del group by db) n using (db)) l, lateral (select unnest(['connections', 'active_txs', 'conflicts_total', 'offset', 'replica_lag', 'wal_files', 'wal_bytes', 'vlog_files', 'vlog_bytes', 'key_count']) metric, unnest(l.vals) as value) u"""


@query(SERIES)
def i02_collector(spark, d):
    """Thirteen series; events stand for sessions and transactions, and a slot follows each database's even files."""
    log = kv_log(spark, d).withColumn("wal_id", F.floor(F.col("file_id") / 2))
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("db"), "event_type")
    sessions = e.select("db", (F.col("event_type") == "click").alias("open"))
    transactions = e.select("db", (F.col("event_type") == "signup").alias("active"), (F.col("event_type") == "error").alias("conflict"))
    slots = log.where("file_id % 2 = 0").groupBy("db").agg(F.max("seq").alias("log_seq"))
    return stats.collector(log, slots, sessions, transactions)


@query("select 'last_seq' as metric, max(seq) as value from log")
def i04_cdc_metrics(spark, d):
    return stats.cdc_metrics(kv_log(spark, d))


@query("select case when del then 'delete' else 'upsert' end as type, cast(count(*) as bigint) as rows from log group by 1")
def i03_loader_counts(spark, d):
    return stats.loader_counts(kv_log(spark, d))


@query("select case when file_id % 2 = 0 then 'vlog' else 'wal' end as suffix, cast(count(*) as bigint) files, cast(sum(n) as bigint) bytes from (select file_id, count(*) n from log group by file_id) group by 1")
def i05_storage(spark, d):
    path = F.concat(F.lit("x/"), F.col("file_id").cast("string"), F.when(F.col("file_id") % 2 == 0, ".vlog").otherwise(".wal"))
    return stats.storage_stats(kv_log(spark, d).groupBy("file_id").agg(F.count("*").alias("length")).select(path.alias("path"), "length"))


@query("select (select max(tx) from log) as tx, (select max(seq) from log) as seq, (select cast(count(*) as bigint) from newest where not del) as key_count, (select cast(sum(garbage) as bigint) from waste) as garbage_bytes")
def b10_checkpoint(spark, d):
    log = kv_log(spark, d)
    return mvcc.clocks(log).crossJoin(stats.stat(log, _slots(log), 0, "PRIMARY").select("key_count", "garbage_bytes"))


@query(f"select file_id, max(seq) as last_seq, max({MS}) as updated from log group by file_id")
def b03_resume_state(spark, d):
    return loader.resume_state(_changes(spark, d).withColumn("file_id", F.floor((F.col("seq") - 1) / 1000).cast("bigint")), "file_id")


@query("select (select max(seq) from log) + row_number() over (order by k) as seq, (select max(tx) from log) + 1 as tx, k, 'set' as v, false as del from (select distinct k from log where db = 1) where (select count(*) from slots where db > 0) >= 3")
def c17_embedded_apply(spark, d):
    """A batch is written as one transaction if three replicas are connected."""
    log = kv_log(spark, d)
    writes = log.where("db = 1").select("k", F.lit("set").alias("v"), F.lit(False).alias("del")).distinct()
    enough = replication.healthy(_slots(log)).where("n >= 3").drop("n")
    return mvcc.write_batch(log, writes).join(F.broadcast(enough))


@query("select tx as txid, tx - 5 as read_tx, k from log")
def e02_read_set(spark, d):
    asked = kv_log(spark, d).groupBy(F.col("tx").alias("txid")).agg(F.collect_set("k").alias("reads")).withColumn("writes", F.transform("reads", lambda k: F.struct(k.alias("k"))))
    return occ.touched(asked.withColumn("read_tx", F.col("txid") - 5))


@query("select k, v, seq, tx from newest where not del and db = 1")
def e11_select_db(spark, d):
    return latest.live_state(kv_log(spark, d).where("db = 1")).select("k", "v", "seq", "tx")


@query("select least((select min(ack) from slots), (select min(ack) from slots where db > 1)) as safe")
def f08_safe_point(spark, d):
    """A follower's floor, below the leader's safe point as well."""
    log = kv_log(spark, d)
    return replication.min_slot(_slots(log)).crossJoin(logfiles.retention_floor(_slots(log).where("db > 1"), None, None)).select(F.least("m", "safe").alias("safe"))


@query("select k, v, cast(9999 as bigint) as seq, cast(3333 as bigint) as tx from newest where not del")
def f11_snapshot_apply(spark, d):
    state = latest.live_state(kv_log(spark, d))
    return replication.apply_snapshot(state.limit(0), state, 3333, 9999)


@query("select seq, concat(hex(k), '00', hex(cast(18446744073709551615 as ubigint) - cast(tx as ubigint))) as index_key from log")
def g06_index_key(spark, d):
    return kv_log(spark, d).select("seq", codec.index_key_column(F.col("k"), F.col("tx")).alias("index_key"))


@query()
def g05_crc32c(spark, d):
    return kv_log(spark, d).where("v is not null").select("seq", codec.crc32c_column(F.col("v").cast("binary")).alias("crc"))


@query("select cast(client as bigint) client, cast(idx as bigint) idx, rpad(concat('bench-', cast(client as varchar), '-', cast(idx as varchar)), 32, 'x') as k from (select unnest(range(50)) client), (select unnest(range(200)) idx)")
def g08_bench_keys(spark, d):
    return workload.bench_keys(spark, 50, 200)


@query()
def h04_devices(spark, d):
    return workload.devices(spark, 10_000)


@query()
def h04_applications(spark, d):
    return workload.applications(workload.devices(spark, 1_000))


@query("select cast(i*3333+1 as bigint) as first_key, cast(case when i = 2 then 10000 else (i+1)*3333 end as bigint) as last_key from (select unnest(range(3)) i)")
def h05_shards(spark, d):
    return spark.createDataFrame(workload.shards(10_000, 3), "first_key bigint, last_key bigint")


@query("select event_type as phase, cast(count(*) filter (where value > 10) as bigint) as ok, round(count(*) filter (where value > 10) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0), 6) as tps from events group by 1")
def h06_phase_stats(spark, d):
    at = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select(F.col("event_type").alias("phase"), at.alias("started"), at.alias("ended"), (F.col("value") > 10).alias("ok"))
    return workload.phase_stats(e).select("phase", "ok", F.round("tps", 6).alias("tps"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
