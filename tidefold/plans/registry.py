"""All queries of the engine by name, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions.hashing import ring_hash
from tidefold.operators import bloom, commands, election, fold, handoff, replication, ring, tiers
from tidefold.plans.model import BLOOM_RATE, change_log, read
from tidefold.sources import binary, files
from tidefold.streaming import fold as streaming
from tidefold.streaming import hints as aged

NODES = ["node1", "node2", "node3"]
MORE_NODES = [f"node{i}" for i in range(1, 6)]
HINTS_KEPT = 1000
STREAM_FILES = 7
M, K = bloom.parameters()


def _log(spark, sf_dir) -> DataFrame:
    return change_log(read(spark, sf_dir, "events"))


def _runs(spark, sf_dir) -> DataFrame:
    return tiers.flush(_log(spark, sf_dir))


def _asked(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("k"))


def _orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"))


def _ring(spark, names=NODES, n=1) -> DataFrame:
    return ring.arcs(ring.vnodes(ring.nodes(spark, names)), n)


def _tried(spark, sf_dir) -> DataFrame:
    return replication.attempts(_log(spark, sf_dir))


def _replicas(spark, sf_dir) -> DataFrame:
    return replication.states(_tried(spark, sf_dir))


def _hints(spark, sf_dir) -> DataFrame:
    return handoff.generated(_tried(spark, sf_dir))


def _decided(spark, sf_dir) -> DataFrame:
    return election.decide(election.requests(read(spark, sf_dir, "events")))


def _responses(spark, sf_dir) -> DataFrame:
    return _tried(spark, sf_dir).where("success").select(
        "k", F.concat(F.lit("node"), F.col("n").cast("string")).alias("node_id"), F.expr("seq div 2").alias("ts"), F.col("seq").alias("version"), "v"
    )


def _registry(spark) -> ring.Registry:
    known = ring.Registry(spark)
    for i, name in enumerate(NODES):
        known.register(name, f"localhost:{50051 + i}")
    return known


def _key_addresses(spark, sf_dir) -> DataFrame:
    return _registry(spark).for_keys(_orders(spark, sf_dir), F.col("key")).select("key", "node_id", "address")


def _probed(spark, sf_dir) -> DataFrame:
    return bloom.probe(_runs(spark, sf_dir), _asked(spark, sf_dir), M, K)


def _bloom_params(spark, sf_dir) -> DataFrame:
    cases = spark.createDataFrame([(100, BLOOM_RATE), (1000, BLOOM_RATE), (10_000, BLOOM_RATE), (1_000_000, BLOOM_RATE)], "n long, p double")
    return bloom.parameter_table(cases)


def _stream(spark, sf_dir) -> DataFrame:
    """The log as several files in an order of its own: later files hold older and newer writes."""
    path = files.new_folder(spark, "shuffled")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(STREAM_FILES, F.xxhash64("event_id") % 1000).write.parquet(path)
    return streaming.latest(spark, path, change_log, files.new_folder(spark, "stream"))


def _stream_of_one_file(spark, sf_dir) -> DataFrame:
    return streaming.latest(spark, f"{sf_dir}/events.parquet", change_log, files.new_folder(spark, "stream"))


def _expired(spark, sf_dir) -> DataFrame:
    hints = _hints(spark, sf_dir)
    as_of = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return handoff.expired(hints, F.lit(as_of).cast("timestamp_ntz"))


def _rebalance(spark, sf_dir) -> DataFrame:
    return ring.rebalance(_orders(spark, sf_dir), F.col("key"), _ring(spark), _ring(spark, ["node1", "node3"]))


def _hints_cleaned(spark, sf_dir) -> DataFrame:
    folder, path = files.new_folder(spark, "cleaned"), f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    aged.clean(handoff.generated(replication.attempts(change_log(events))), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema("target_node string, opened timestamp, removed long").parquet(f"{folder}/out")
    return out.select("target_node", F.date_format("opened", "yyyy-MM-dd HH:mm").alias("opened"), "removed")


def _routed(spark, sf_dir) -> DataFrame:
    return replication.routed(_log(spark, sf_dir), _ring(spark, MORE_NODES, 3))


def _logged_tables(spark, sf_dir) -> DataFrame:
    """Runs written as table files with their filters, and read back."""
    path = files.new_folder(spark, "tables")
    binary.write_tables(_runs(spark, sf_dir), path, M, K).write.format("noop").mode("overwrite").save()
    return binary.read_tables(spark, f"{path}/*.db").select("tid", "k", "op", F.col("v").cast("string").alias("v"))


def _logs(spark, sf_dir) -> DataFrame:
    """The log written as log files, and read back: ts_ns holds the sequence number."""
    path = files.new_folder(spark, "logs")
    binary.write_logs(_log(spark, sf_dir).withColumn("ts_ns", F.col("seq")), path).write.format("noop").mode("overwrite").save()
    back = binary.read_logs(spark, f"{path}/*.log")
    return back.select(F.col("ts_ns").alias("seq"), "op", "k", F.col("v").cast("string").alias("v"))


def _hint_files(spark, sf_dir) -> DataFrame:
    path = files.new_folder(spark, "hints")
    binary.write_hints(_hints(spark, sf_dir), path, HINTS_KEPT)
    return binary.read_hints(spark, path).select("target_node", F.col("key").alias("k"), F.col("value").cast("string").alias("v"), F.col("version").alias("ver"))


def _filter_bytes(spark, sf_dir) -> DataFrame:
    whole = bloom.filters(bloom.bits(_runs(spark, sf_dir), M, K), M, K)
    return whole.select("tid", F.octet_length("filter").cast("long").alias("n_bytes"), F.md5("filter").alias("filter_md5"))


def _filter_reads(spark, sf_dir) -> DataFrame:
    """Every 64th customer's key asked of the filters as bytes."""
    asked = read(spark, sf_dir, "customer").where("c_custkey % 64 = 0").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("k"))
    parsed = bloom.read_filters(bloom.filters(bloom.bits(_runs(spark, sf_dir), M, K), M, K))
    return bloom.may_contain(parsed, asked.join(parsed.select("tid"))).select("tid", "k", "may_contain")


def _sent(spark, sf_dir) -> DataFrame:
    """Messages of leaders for trials: nodes by user, terms that rise with the log but for some late ones."""
    user, seq = F.col("user_id"), F.col("event_id")
    late = F.when(seq % 11 == 0, 2).otherwise(0)
    return read(spark, sf_dir, "events").select((user % 5).alias("node"), (F.expr("event_id div 500") - late).alias("term"), seq.alias("arrival"))


def _peers(spark) -> DataFrame:
    return spark.range(3).select(F.concat(F.lit("node"), F.col("id").cast("string")).alias("peer"))


def _calls(spark, sf_dir) -> DataFrame:
    return commands.parse(commands.script(_log(spark, sf_dir)), F.col("line")).select("seq", "verb", "key", "value")


def _distribution(spark, sf_dir) -> DataFrame:
    return ring.locate(_orders(spark, sf_dir), F.col("key"), _ring(spark)).groupBy("node_id").agg(F.count("*").alias("n"))


def _range(spark, sf_dir) -> DataFrame:
    return fold.range_scan(_log(spark, sf_dir), "user:1", "user:3")


QUERIES = {
    "latest_snapshot": lambda s, d: fold.latest(_log(s, d)),
    "latest_snapshot_maxby": lambda s, d: fold.latest_by_aggregates(_log(s, d)),
    "service_calls": lambda s, d: fold.service_calls(_calls(s, d)),
    "point_get": lambda s, d: fold.point_get(_log(s, d), "user:7"),
    "multi_get": lambda s, d: fold.multi_get(_log(s, d), _asked(s, d)),
    "missing_keys": lambda s, d: fold.missing(_log(s, d), _asked(s, d)),
    "deleted_keys": lambda s, d: fold.deleted(fold.newest(_log(s, d), "k")).select("k", "seq"),
    "wal_replay": lambda s, d: fold.newest(_log(s, d).select("k", "op", "v", "seq"), "k"),
    "wal_op_counts": lambda s, d: fold.record_stats(_log(s, d)).select("op", "n"),
    "wal_record_bytes": lambda s, d: fold.record_stats(_log(s, d)).select("op", "wal_bytes"),
    "memtable_size": lambda s, d: fold.memtable_size(fold.newest(_log(s, d), "k")),
    "range_scan": _range,
    "sstable_flush": lambda s, d: _runs(s, d).select("tid", "k", "op", "v"),
    "sstable_index": lambda s, d: tiers.index(_runs(s, d)),
    "sstable_footer": lambda s, d: tiers.footer(_runs(s, d), M),
    "tier_order": lambda s, d: tiers.tier_order(change_log(read(s, d, "events"), 500)),
    "compaction_merge": lambda s, d: tiers.merge(_runs(s, d)),
    "compaction_stats": lambda s, d: tiers.merge_stats(_runs(s, d)),
    "compaction_trigger": lambda s, d: tiers.compaction_trigger(_runs(s, d)),
    "read_amplification": lambda s, d: tiers.read_amplification(_runs(s, d)),
    "as_written_get": lambda s, d: tiers.as_written_get(_runs(s, d)),
    "bloom_params": _bloom_params,
    "bloom_bits": lambda s, d: bloom.bits(_runs(s, d), M, K),
    "bloom_stats": lambda s, d: bloom.stats(bloom.bits(_runs(s, d), M, K), M, K),
    "bloom_probe": _probed,
    "bloom_hit_miss": lambda s, d: bloom.hit_miss(_log(s, d), _asked(s, d), M, K),
    "bloom_bytes": _filter_bytes,
    "bloom_bytes_read": _filter_reads,
    "wal_files": _logs,
    "sstable_files": _logged_tables,
    "hint_files": _hint_files,
    "ring_nodes": lambda s, d: _registry(s).table().withColumn("n_nodes", F.lit(len(_registry(s)))),
    "ring_hash": lambda s, d: _orders(s, d).select("key", ring_hash(F.col("key")).alias("h")),
    "ring_vnodes": lambda s, d: ring.vnodes(ring.nodes(s, NODES)).select("node_id", "vhash"),
    "ring_vnode_counts": lambda s, d: ring.vnodes(ring.nodes(s, NODES)).groupBy("node_id").agg(F.count("*").alias("n")),
    "ring_owner": lambda s, d: ring.locate(_orders(s, d), F.col("key"), _ring(s)).select("key", "node_id"),
    "key_node_address": _key_addresses,
    "ring_key_distribution": _distribution,
    "preference_list": lambda s, d: ring.preference_list(_orders(s, d), F.col("key"), _ring(s, NODES, 3)).select("key", "pos", "node_id"),
    "ring_rebalance": _rebalance,
    "replica_placement": lambda s, d: replication.placement(ring.preference_list(_orders(s, d), F.col("key"), _ring(s, MORE_NODES, 3))),
    "write_quorum": lambda s, d: replication.write_quorum(_tried(s, d)),
    "quorum_read": lambda s, d: replication.quorum_read(_replicas(s, d)),
    "cluster_put": lambda s, d: replication.cluster_put(_routed(s, d)),
    "repaired_replicas": lambda s, d: replication.repaired(_replicas(s, d), replication.read_repair_writes(_replicas(s, d))).select("n", "k", "ver", "op", "v"),
    "lww_resolve": lambda s, d: replication.resolve(_responses(s, d), "k"),
    "needs_read_repair": lambda s, d: replication.needs_read_repair(_responses(s, d), "k"),
    "outdated_replicas": lambda s, d: replication.outdated(_replicas(s, d)).select("n", "k", "ver", "latest", "op", "v"),
    "read_repair_writes": lambda s, d: replication.read_repair_writes(_replicas(s, d)),
    "hints_generated": lambda s, d: _hints(s, d).select("target_node", "k", "ver"),
    "hint_counts": lambda s, d: handoff.counts(_hints(s, d)),
    "hints_capped": lambda s, d: handoff.capped(_hints(s, d), HINTS_KEPT).select("target_node", "k", "ver"),
    "hints_expired": _expired,
    "hints_cleaned": _hints_cleaned,
    "hint_remove_at": lambda s, d: handoff.remove_at(_hints(s, d), 1).select("target_node", "k", "ver"),
    "hint_replay": lambda s, d: handoff.replay(_replicas(s, d), _hints(s, d)),
    "raft_vote_decision": lambda s, d: _decided(s, d).select("voter", "term", "candidate", "arrival", "granted"),
    "raft_election_winner": lambda s, d: election.tally(_decided(s, d), 5),
    "raft_leaders_per_term": lambda s, d: election.leaders_per_term(election.tally(_decided(s, d), 5)),
    "raft_append_entries": lambda s, d: election.append_entries(_sent(s, d)).select("node", "term", "arrival", "success"),
    "raft_heartbeats": lambda s, d: election.heartbeats(election.tally(_decided(s, d), 5), _peers(s)),
    "raft_step_down": lambda s, d: election.step_down(_sent(s, d)),
    "raft_leader_state": lambda s, d: election.leader_state(_peers(s), 7),
    "raft_log_entries": lambda s, d: election.read_commands(election.log_entries(_log(s, d))),
    "store_stats": lambda s, d: tiers.store_stats(_log(s, d), _asked(s, d), M, K),
    "cluster_stats": lambda s, d: replication.node_stats(_replicas(s, d)),
    "cli_parse": _calls,
    "stream_latest": _stream,
    "stream_latest_of_one_file": _stream_of_one_file,
}

_CL = """cl AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS k, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, CASE WHEN event_type <> 'error' THEN props END AS v,
event_id AS seq, ts, event_id // 2000 AS tid FROM events)"""
_NEW = f"""WITH {_CL}, nw AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"""
_RUN = f"""WITH {_CL}, r AS (SELECT tid, k, op, v, seq FROM cl QUALIFY row_number() OVER (PARTITION BY tid, k ORDER BY seq DESC) = 1)"""
_SIZE = "(strlen(k) + coalesce(strlen(v), 13))"
_NEWEST_RUN = "SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY tid DESC) = 1"
_LATEST = f"{_NEW} SELECT k, v, seq FROM nw WHERE op = 1"


def _fnv(step: str) -> str:
    return f"list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')], lambda h, b: {step}, 2166136261)"


_POS = (
    f"list_distinct(list_transform(range(0, {K}), lambda i: (((h1 + i * h2) & 4294967295) % {M})))"
)
_HASHED = f"""SELECT *, {_fnv("xor((h * 16777619) & 4294967295, b)")} AS h1, {_fnv("(xor(h, b) * 16777619) & 4294967295")} AS h2"""
_BITS = f"{_RUN}, hr AS ({_HASHED} FROM r), bt AS (SELECT DISTINCT tid, unnest({_POS}) AS bit FROM hr)"
_PROBE = f"""{_BITS}, q AS (SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS k FROM customer), hq AS ({_HASHED} FROM q), ps AS (SELECT k, {_POS} AS ps FROM hq),
w AS (SELECT k, len(ps) AS n, unnest(ps) AS bit FROM ps), pass AS (SELECT tid, k FROM w JOIN bt USING (bit) GROUP BY tid, k, n HAVING count(*) = n),
pr AS (SELECT t.tid, q.k, pass.k IS NOT NULL AS may_contain, r.k IS NOT NULL AS present FROM (SELECT DISTINCT tid FROM r) t CROSS JOIN q
LEFT JOIN pass ON pass.tid = t.tid AND pass.k = q.k LEFT JOIN r ON r.tid = t.tid AND r.k = q.k)"""


def _names(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _vn(names: list[str]) -> str:
    return f"""(SELECT n AS node_id, CAST('0x' || substring(md5(n || '-vnode-' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) AS vhash
FROM (SELECT unnest({_names(names)}) AS n) CROSS JOIN (SELECT unnest(range(0, 256)) AS i))"""


_KEYS = "ok AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM orders)"


def _owner(names: list[str], out: str = "node_id") -> str:
    """Keys with their owner: the first place at or after, or the first of all."""
    return f"""(SELECT key, coalesce(v.node_id, (SELECT arg_min(node_id, vhash) FROM {_vn(names)})) AS {out} FROM ok ASOF LEFT JOIN {_vn(names)} v ON ok.h <= v.vhash)"""


def _pref(names: list[str], n: int) -> str:
    """By key, nodes ranked by the distance of their nearest place ahead: one ASOF join for each node."""
    parts = " UNION ALL ".join(
        f"""SELECT key, '{x}' AS node_id, coalesce(v.vhash, (SELECT min(vhash) FROM {_vn([x])}) + 4294967296) - h AS dist FROM ok ASOF LEFT JOIN {_vn([x])} v ON ok.h <= v.vhash""" for x in names
    )
    return f"(SELECT key, node_id, row_number() OVER (PARTITION BY key ORDER BY dist) AS pos FROM ({parts}) QUALIFY pos <= {n})"


_TRY = f"WITH {_CL}, tr AS (SELECT cl.*, n, (seq * 7 + n * 3) % 10 >= 3 AS success FROM cl CROSS JOIN (SELECT unnest([1, 2, 3]) AS n))"
_REP = f"{_TRY}, st AS (SELECT n, k, seq AS ver, op, v FROM tr WHERE success QUALIFY row_number() OVER (PARTITION BY n, k ORDER BY seq DESC) = 1)"
_HINT = f"{_TRY}, hi AS (SELECT 'node' || CAST(n AS VARCHAR) AS target_node, k, seq AS ver, op, v, ts AS created_at FROM tr WHERE NOT success)"
_RESP = f"{_TRY}, re AS (SELECT k, 'node' || CAST(n AS VARCHAR) AS node_id, seq // 2 AS ts, seq AS version, v FROM tr WHERE success)"
_BEHIND = "FROM st JOIN (SELECT k, max(ver) AS latest, count(*) AS c FROM st GROUP BY k) t ON st.k = t.k JOIN cl ON cl.seq = t.latest WHERE st.ver < t.latest AND t.c >= "
_OUTDATED, _REPAIR = f"SELECT st.n, st.k, st.ver, t.latest, cl.op, cl.v {_BEHIND}", f"SELECT st.n, st.k, t.latest AS ver, cl.op, cl.v {_BEHIND}"
_SENT = "WITH se AS (SELECT user_id % 5 AS node, event_id // 500 - CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS term, event_id AS arrival FROM events)"
_VOTE = """WITH rq AS (SELECT user_id % 5 AS voter, event_id // 500 + user_id % 3 AS term, 'node' || CAST(user_id % 3 AS VARCHAR) AS candidate, event_id AS arrival, event_id % 3 AS li, user_id % 4 AS lt FROM events),
a AS (SELECT *, term >= max(term) OVER (PARTITION BY voter ORDER BY arrival) AND (lt > 1 OR (lt = 1 AND li >= 1)) AS fit FROM rq),
f AS (SELECT voter, term, arg_min(candidate, arrival) AS chosen FROM a WHERE fit GROUP BY voter, term),
d AS (SELECT a.voter, a.term, candidate, arrival, coalesce(fit AND candidate = chosen, false) AS granted FROM a LEFT JOIN f ON a.voter = f.voter AND a.term = f.term),
t AS (SELECT term, candidate, count(DISTINCT voter) AS votes, count(DISTINCT voter) >= 3 AS won FROM d WHERE granted GROUP BY term, candidate)"""
_RECLAIM = f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS entries_in, count(*) AS keys, count(*) FILTER (lop = 2) AS keys_removed, CAST(coalesce(sum(total - CASE WHEN lop = 1 THEN last ELSE 0 END), 0) AS BIGINT) AS bytes_reclaimed
FROM (SELECT k, count(*) AS n, sum({_SIZE}) AS total, arg_max(op, tid) AS lop, arg_max({_SIZE}, tid) AS last FROM r GROUP BY k)"""

SQL = {
    "latest_snapshot": _LATEST,
    "stream_latest": _LATEST,
    "stream_latest_of_one_file": _LATEST,
    "latest_snapshot_maxby": _LATEST,
    "wal_files": f"WITH {_CL} SELECT seq, op, k, v FROM cl",
    "sstable_files": f"{_RUN} SELECT tid, k, op, v FROM r",
    "hint_files": f"{_HINT} SELECT target_node, k, CASE WHEN op = 2 THEN '__TOMBSTONE__' ELSE v END AS v, ver FROM hi QUALIFY row_number() OVER (PARTITION BY target_node ORDER BY created_at, ver) <= {HINTS_KEPT}",
    "service_calls": f"""WITH {_CL}, ca AS (SELECT seq, CASE WHEN op = 2 THEN 'DELETE' WHEN seq % 3 = 0 THEN 'GET' ELSE 'PUT' END AS verb, k AS key,
CASE WHEN op = 1 AND seq % 3 <> 0 THEN regexp_replace(coalesce(v, 'x'), '\\s+', ' ', 'g') || ' end' END AS value FROM cl),
lt AS (SELECT *, last_value(CASE WHEN verb <> 'GET' THEN struct_pack(there := verb = 'PUT', v := value) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM ca)
SELECT seq, verb, key, CASE WHEN verb <> 'GET' THEN true END AS success, CASE WHEN verb = 'GET' THEN coalesce(l.there, false) END AS found, CASE WHEN verb = 'GET' AND l.there THEN l.v END AS got FROM lt""",
    "bloom_bytes": f"""{_BITS}, byt AS (SELECT tid, bit // 8 AS i, sum(1 << (bit % 8)) AS x FROM bt GROUP BY tid, bit // 8),
al AS (SELECT t.tid, g.i, coalesce(byt.x, 0) AS x FROM (SELECT DISTINCT tid FROM bt) t CROSS JOIN (SELECT unnest(range(0, {-(-M // 8)})) AS i) g LEFT JOIN byt ON byt.tid = t.tid AND byt.i = g.i)
SELECT tid, CAST(8 + {-(-M // 8)} AS BIGINT) AS n_bytes, md5(unhex('{M.to_bytes(4, "little").hex()}{K.to_bytes(4, "little").hex()}' || string_agg(printf('%02x', CAST(x AS INTEGER)), '' ORDER BY i))) AS filter_md5 FROM al GROUP BY tid""",
    "bloom_bytes_read": f"""{_PROBE} SELECT tid, k, may_contain FROM pr WHERE CAST(substring(k, 6) AS BIGINT) % 64 = 0""",
    "ring_nodes": "SELECT 'node' || CAST(i AS VARCHAR) AS node_id, 'localhost:' || CAST(50050 + i AS VARCHAR) AS address, 3 AS n_nodes FROM (SELECT unnest([1, 2, 3]) AS i)",
    "cluster_put": f"""WITH {_CL}, ky AS (SELECT DISTINCT k AS key FROM cl), ok AS (SELECT key, CAST('0x' || substring(md5(key), 1, 8) AS BIGINT) AS h FROM ky), pf AS {_pref(MORE_NODES, 3)},
tr AS (SELECT seq, k, pos, node_id, (seq * 7 + CAST(substring(node_id, 5) AS INTEGER) * 3) % 10 >= 3 AS success FROM cl JOIN pf ON pf.key = cl.k)
SELECT seq, k, string_agg(node_id, ',' ORDER BY pos) AS replicas, count(*) FILTER (success) AS acks, CASE WHEN count(*) FILTER (success) >= 2 THEN 'ok' ELSE 'quorum_not_reached' END AS status,
coalesce(string_agg(node_id, ',' ORDER BY pos) FILTER (NOT success), '') AS hinted FROM tr GROUP BY seq, k""",
    "repaired_replicas": f"""{_REP}, tp AS (SELECT k, max(ver) AS ver, count(*) AS c FROM st GROUP BY k)
SELECT st.n, st.k, CASE WHEN c >= 2 THEN tp.ver ELSE st.ver END AS ver, CASE WHEN c >= 2 THEN cl.op ELSE st.op END AS op, CASE WHEN c >= 2 THEN cl.v ELSE st.v END AS v FROM st JOIN tp ON st.k = tp.k JOIN cl ON cl.seq = tp.ver""",
    "raft_append_entries": f"{_SENT} SELECT node, term, arrival, term >= max(term) OVER (PARTITION BY node ORDER BY arrival) AS success FROM se",
    "raft_step_down": f"{_SENT} SELECT node, max(term) AS term FROM se GROUP BY node",
    "raft_heartbeats": f"{_VOTE}, pe AS (SELECT 'node' || CAST(i AS VARCHAR) AS node FROM (SELECT unnest([0, 1, 2]) AS i)) SELECT node, term, candidate AS leader FROM t JOIN pe ON node <> candidate WHERE won",
    "raft_leader_state": "SELECT 'node' || CAST(i AS VARCHAR) AS peer, CAST(8 AS BIGINT) AS next_index, CAST(0 AS BIGINT) AS match_index FROM (SELECT unnest([0, 1, 2]) AS i)",
    "point_get": f"{_NEW} SELECT 'user:7' AS k, max(CASE WHEN op = 1 THEN v END) AS v, coalesce(bool_or(op = 1), false) AS found FROM nw WHERE k = 'user:7'",
    "multi_get": f"{_NEW} SELECT q.k, v, nw.k IS NOT NULL AS found FROM (SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS k FROM customer) q LEFT JOIN nw ON q.k = nw.k AND op = 1",
    "missing_keys": f"{_NEW} SELECT q.k FROM (SELECT 'user:' || CAST(c_custkey AS VARCHAR) AS k FROM customer) q WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.k = q.k AND op = 1)",
    "deleted_keys": f"{_NEW} SELECT k, seq FROM nw WHERE op = 2",
    "wal_replay": f"{_NEW} SELECT k, op, v, seq FROM nw",
    "wal_op_counts": f"WITH {_CL} SELECT op, count(*) AS n FROM cl GROUP BY op",
    "wal_record_bytes": f"WITH {_CL} SELECT op, CAST(sum(17 + strlen(k) + coalesce(strlen(v), 0)) AS BIGINT) AS wal_bytes FROM cl GROUP BY op",
    "memtable_size": f"{_NEW} SELECT CAST(coalesce(sum({_SIZE} + 8), 0) AS BIGINT) AS memtable_bytes, count(*) AS n_keys FROM nw",
    "range_scan": f"{_NEW} SELECT k, v, seq FROM nw WHERE op = 1 AND k >= 'user:1' AND k < 'user:3'",
    "sstable_flush": f"{_RUN} SELECT tid, k, op, v FROM r",
    "sstable_index": f"{_RUN} SELECT tid, k, CAST(sum(8 + {_SIZE}) OVER (PARTITION BY tid ORDER BY k ROWS UNBOUNDED PRECEDING) - (8 + {_SIZE}) AS BIGINT) AS data_offset FROM r",
    "sstable_footer": f"""{_RUN} SELECT tid, count(*) AS num_entries, CAST(sum(8 + {_SIZE}) AS BIGINT) AS index_offset, CAST(sum(8 + {_SIZE}) + sum(12 + strlen(k)) AS BIGINT) AS bloom_offset,
CAST(11990 AS BIGINT) AS bloom_len, CAST(sum(8 + {_SIZE}) + sum(12 + strlen(k)) + 11990 + 28 AS BIGINT) AS file_bytes FROM r GROUP BY tid""",
    "tier_order": """SELECT tid, row_number() OVER (ORDER BY tid DESC) AS tier_rank, row_number() OVER (ORDER BY 'sstable_' || CAST(tid AS VARCHAR) || '.db' DESC) AS lex_rank
FROM (SELECT DISTINCT event_id // 500 AS tid FROM events)""",
    "compaction_merge": f"{_RUN} SELECT k, v FROM ({_NEWEST_RUN}) WHERE op = 1",
    "compaction_stats": f"{_RUN} {_RECLAIM}",
    "compaction_trigger": f"{_RUN} SELECT count(DISTINCT tid) AS n_tables, count(DISTINCT tid) > 4 AS should_compact FROM r",
    "read_amplification": f"{_RUN} SELECT k, count(*) AS tables_with_key, max(tid) AS newest FROM r GROUP BY k",
    "as_written_get": f"{_RUN} SELECT k, v FROM (SELECT * FROM r WHERE op = 1 OR tid < (SELECT max(tid) FROM cl) QUALIFY row_number() OVER (PARTITION BY k ORDER BY tid DESC) = 1) WHERE op = 1",
    "bloom_params": """SELECT n, p, CAST(ceil(-n * ln(p) / pow(ln(2.0::DOUBLE), 2)) AS BIGINT) AS m, CAST(ceil(ceil(-n * ln(p) / pow(ln(2.0::DOUBLE), 2)) / n * ln(2.0::DOUBLE)) AS BIGINT) AS k
FROM (SELECT CAST(unnest([100, 1000, 10000, 1000000]) AS BIGINT) AS n, 0.01::DOUBLE AS p)""",
    "bloom_bits": f"{_BITS} SELECT tid, bit FROM bt",
    "bloom_stats": f"{_BITS} SELECT tid, count(*) AS bits_set, round(count(*)::DOUBLE / {M}::DOUBLE, 6) AS fill, round(pow(count(*)::DOUBLE / {M}::DOUBLE, {K}), 6) AS fpr FROM bt GROUP BY tid",
    "bloom_probe": f"{_PROBE} SELECT tid, k, present FROM pr WHERE may_contain",
    "bloom_hit_miss": f"""{_PROBE}, nt AS (SELECT k, max(tid) AS newest FROM pr WHERE present GROUP BY k), s AS (SELECT pr.* FROM pr LEFT JOIN nt ON pr.k = nt.k WHERE newest IS NULL OR tid >= newest)
SELECT count(*) FILTER (NOT may_contain) AS hits, count(*) FILTER (may_contain) AS misses, CASE WHEN count(*) > 0 THEN round((count(*) FILTER (NOT may_contain))::DOUBLE / count(*) * 100, 6) ELSE 0.0::DOUBLE END AS hit_rate FROM s""",
    "ring_hash": f"WITH {_KEYS} SELECT key, h FROM ok",
    "ring_vnodes": f"SELECT node_id, vhash FROM {_vn(NODES)}",
    "ring_vnode_counts": f"SELECT node_id, count(*) AS n FROM {_vn(NODES)} GROUP BY node_id",
    "ring_owner": f"WITH {_KEYS} SELECT key, node_id FROM {_owner(NODES)}",
    "key_node_address": f"WITH {_KEYS} SELECT key, node_id, 'localhost:' || CAST(50050 + CAST(substring(node_id, 5) AS INTEGER) AS VARCHAR) AS address FROM {_owner(NODES)}",
    "ring_key_distribution": f"WITH {_KEYS} SELECT node_id, count(*) AS n FROM {_owner(NODES)} GROUP BY node_id",
    "preference_list": f"WITH {_KEYS} SELECT key, pos, node_id FROM {_pref(NODES, 3)}",
    "ring_rebalance": f"WITH {_KEYS} SELECT old_node, new_node, count(*) AS n FROM {_owner(NODES, 'old_node')} a JOIN {_owner(['node1', 'node3'], 'new_node')} b ON a.key = b.key GROUP BY old_node, new_node",
    "replica_placement": f"WITH {_KEYS} SELECT node_id, pos, count(*) AS n FROM {_pref(MORE_NODES, 3)} GROUP BY node_id, pos",
    "write_quorum": f"{_TRY} SELECT seq, count(*) FILTER (success) AS acks, count(*) FILTER (success) >= 2 AS quorum_ok FROM tr GROUP BY seq",
    "quorum_read": f"""{_REP} SELECT k, CASE WHEN count(*) >= 2 THEN max(ver) END AS latest, CASE WHEN count(*) >= 2 AND arg_max(op, ver) = 1 THEN first(v ORDER BY ver DESC) END AS v, CASE WHEN count(*) >= 2 THEN arg_max(op, ver) = 1 END AS found, count(*) AS replicas, CASE WHEN count(*) >= 2 THEN 'ok' ELSE 'quorum_not_reached' END AS status,
count(*) >= 2 AND min(ver) <> max(ver) AS needs_repair FROM st GROUP BY k""",
    "lww_resolve": f"{_RESP} SELECT k, node_id, ts, version, v FROM re QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, version DESC, node_id DESC) = 1",
    "needs_read_repair": f"{_RESP} SELECT k, count(*) > 1 AND (min(ts) <> max(ts) OR min(version) <> max(version)) AS needs_repair FROM re GROUP BY k",
    "outdated_replicas": f"{_REP} {_OUTDATED} 1",
    "read_repair_writes": f"{_REP} {_REPAIR} 2",
    "hints_generated": f"{_HINT} SELECT target_node, k, ver FROM hi",
    "hint_counts": f"{_HINT} SELECT target_node, count(*) AS n FROM hi GROUP BY target_node",
    "hints_capped": f"{_HINT} SELECT target_node, k, ver FROM hi QUALIFY row_number() OVER (PARTITION BY target_node ORDER BY created_at, ver) <= {HINTS_KEPT}",
    "hints_expired": f"{_HINT}, m AS (SELECT max(ts) AS t FROM events) SELECT target_node, count(*) FILTER (created_at > t - INTERVAL 24 HOURS) AS kept, count(*) FILTER (NOT created_at > t - INTERVAL 24 HOURS) AS removed FROM hi CROSS JOIN m GROUP BY target_node",
    "hints_cleaned": f"""{_HINT}, m AS (SELECT max(created_at) AS t FROM hi) SELECT target_node, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M') AS opened, count(*) AS removed FROM hi CROSS JOIN m
WHERE date_trunc('hour', created_at) + INTERVAL 1 HOUR <= t - INTERVAL 24 HOURS GROUP BY target_node, date_trunc('hour', created_at)""",
    "hint_remove_at": f"{_HINT} SELECT target_node, k, ver FROM hi QUALIFY row_number() OVER (PARTITION BY target_node ORDER BY created_at, ver) <> 2",
    "hint_replay": f"{_REP} SELECT n, k, seq AS ver, op, v FROM tr QUALIFY row_number() OVER (PARTITION BY n, k ORDER BY seq DESC) = 1",
    "raft_vote_decision": f"{_VOTE} SELECT * FROM d",
    "raft_election_winner": f"{_VOTE} SELECT * FROM t",
    "raft_leaders_per_term": f"{_VOTE} SELECT term, count(*) FILTER (won) AS leaders FROM t GROUP BY term",
    "raft_log_entries": f"""WITH {_CL} SELECT seq AS "index", seq // 500 AS term, 'T' || CAST(seq // 500 AS VARCHAR) || ':I' || CAST(seq AS VARCHAR) AS label, CASE WHEN op = 2 THEN 'DELETE' ELSE 'PUT' END AS type, k AS key, v AS value FROM cl""",
    "store_stats": f"""{_PROBE}, l AS (SELECT max(tid) AS last FROM cl), c AS ({_RECLAIM}), nt AS (SELECT k, max(tid) AS newest FROM pr WHERE present GROUP BY k),
h AS (SELECT count(*) FILTER (NOT may_contain) AS hits, count(*) FILTER (may_contain) AS misses FROM pr LEFT JOIN nt ON pr.k = nt.k WHERE newest IS NULL OR tid >= newest)
SELECT CAST(coalesce(sum({_SIZE} + 8) FILTER (tid = last), 0) AS BIGINT) AS memtable_size, count(DISTINCT tid) FILTER (tid < last) AS num_sstables, any_value(h.hits) AS bloom_filter_hits, any_value(h.misses) AS bloom_filter_misses,
CAST(count(DISTINCT tid) FILTER (tid < last) > 4 AS BIGINT) AS total_compactions, any_value(c.keys_removed) AS keys_removed, any_value(c.bytes_reclaimed) AS bytes_reclaimed,
(SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') FROM events) AS last_compaction FROM r CROSS JOIN l CROSS JOIN c CROSS JOIN h""",
    "cluster_stats": f"{_REP} SELECT 'node' || CAST(n AS VARCHAR) AS node_id, count(*) AS n_keys, count(*) FILTER (op = 2) AS n_deleted, CAST(sum({_SIZE} + 8) AS BIGINT) AS memtable_size FROM st GROUP BY n",
    "cli_parse": f"""WITH {_CL} SELECT seq, CASE WHEN op = 2 THEN 'DELETE' WHEN seq % 3 = 0 THEN 'GET' ELSE 'PUT' END AS verb, k AS key,
CASE WHEN op = 1 AND seq % 3 <> 0 THEN regexp_replace(coalesce(v, 'x'), '\\s+', ' ', 'g') || ' end' END AS value FROM cl""",
}
