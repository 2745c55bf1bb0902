"""Canonical schemas, as DDL."""

KV_LOG = "db bigint, seq bigint, tx bigint, tli bigint, k string, v string, del boolean, ts timestamp"
CDC = "k string, v string, del boolean, seq bigint, tx bigint, ts bigint"
STATE = "k string, v string, log_seq bigint, tx_id bigint, updated_at timestamp"
STATE_TOMBSTONE = STATE + ", is_deleted boolean"
LOG_FILES = "db bigint, file_id bigint, tli bigint, start_offset bigint, first_op bigint, size bigint"
TX_REQUESTS = "db bigint, arrival bigint, txid bigint, read_tx bigint, reads array<string>, writes array<struct<k: string, v: string, del: boolean>>"
REPLICA_SLOTS = "db bigint, replica_id string, role string, log_seq bigint, last_seen timestamp, connected boolean"
TIMELINE_HISTORY = "tli bigint, start_op bigint, end_op bigint"
WAL = "file string, frame bigint, tx bigint, op bigint, k binary, v binary, del boolean"
VLOG = "file_id bigint, offset bigint, tx bigint, op bigint, k binary, v binary, del boolean, size bigint"
BACKUP = "file string, pos bigint, k binary, v binary, del boolean"
#: Where an unsigned 64-bit maximum stands for "no constraint", the engine has null, and this only within comparisons.
UNBOUNDED = (1 << 63) - 1
