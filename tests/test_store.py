import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefold.functions.hashing import fnv1, fnv1a
from tidefold.operators import bloom, commands, election, fold, handoff, replication, ring, tiers
from tidefold.plans.engine import Engine
from tidefold.sources import binary
from tidefold.sources.runs import RunStore
from tidefold.streaming import fold as streaming

LOG = "k string, op int, v string, seq long"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def model(rows):
    """What a plain dict holds after replaying the log."""
    held = {}
    for k, op, v, _ in sorted(rows, key=lambda r: r[3]):
        held[k] = v if op == 1 else None
    return {k: v for k, v in held.items() if v is not None}


def random_log(seed, n=300, keys=40):
    r = random.Random(seed)
    return [(f"key_{r.randrange(keys)}", *((2, None) if r.random() < 0.3 else (1, f"v{i}")), i) for i in range(n)]


def test_put_get_delete(spark):
    rows = [("key1", 1, "value1", 0)]
    assert fold.point_get(log(spark, rows), "key1").first()["v"] == "value1"
    assert not fold.point_get(log(spark, [*rows, ("key1", 2, None, 1)]), "key1").first()["found"]
    assert not fold.point_get(log(spark, []), "key1").first()["found"]


def test_empty_value_is_present(spark):
    got = fold.point_get(log(spark, [("a", 1, "", 0)]), "a").first()
    assert got["found"] and got["v"] == ""


@pytest.mark.parametrize("seed", range(3))
def test_fold_is_replay_in_any_order(spark, seed):
    rows = random_log(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    for given_rows in (rows, shuffled):
        assert {r["k"]: r["v"] for r in fold.latest(log(spark, given_rows)).collect()} == model(rows)


def test_compaction_keeps_reads_and_is_idempotent(spark, tmp_path):
    rows, store = random_log(7), RunStore(spark, f"file://{tmp_path}/s")
    for i in range(0, 300, 50):
        store.append(log(spark, rows[i : i + 50]))
    before = {r["k"]: r["v"] for r in store.current().collect()}
    assert before == model(rows)
    assert store.compact() and not store.compact()
    once = sorted(map(tuple, store.read().collect()), key=str)
    assert {r["k"]: r["v"] for r in store.current().collect()} == before
    assert store.compact(force=True)
    assert sorted(map(tuple, store.read().collect()), key=str) == once
    assert store.manifest()["compactions"] == 2


def current(store):
    return {r["k"]: r["v"] for r in store.current().collect()}


def test_a_taken_version_is_not_overwritten(spark, tmp_path):
    one, two = (RunStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    state = one.manifest()
    one.append(log(spark, [("a", 1, "x", 0)]))
    assert not two._commit(state) and current(two) == {"a": "x"}


def test_of_two_writers_none_loses(spark, tmp_path, monkeypatch):
    """The second commits between the first one's look at the manifest and its commit."""
    one, two = (RunStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    write = one._write

    def slow(records, tid):
        run = write(records, tid)
        two.append(log(spark, [("b", 1, "B", 1), ("c", 1, "new", 7)]))
        return run

    monkeypatch.setattr(one, "_write", slow)
    assert one.append(log(spark, [("a", 1, "A", 0), ("c", 1, "old", 6)]))
    assert current(one) == {"a": "A", "b": "B", "c": "new"}
    assert sorted(r["tid"] for r in one.read().select("tid").distinct().collect()) == [0, 1]
    assert one.compact(force=True)  # another run is committed while it merges
    assert current(two) == {"a": "A", "b": "B", "c": "new"} and len(two.manifest()["runs"]) == 2


def test_order_of_arrival_does_not_count(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    store.append(log(spark, [("a", 1, "new", 10), ("d", 2, None, 10)]))
    store.append(log(spark, [("a", 1, "old", 5)]))
    assert current(store) == {"a": "new"}
    assert store.compact(force=True) and current(store) == {"a": "new"}
    store.append(log(spark, [("d", 1, "late", 5)]))
    assert current(store) == {"a": "new"}
    assert store.compact(force=True) and current(store) == {"a": "new"} and store.manifest()["removed"] == 0


def test_records_older_than_dropped_deletions_are_refused(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    store.append(log(spark, [("a", 1, "x", 1), ("d", 2, None, 9)]))
    assert store.compact(force=True, drop_deletions=True) and store.manifest()["removed"] == 1
    with pytest.raises(ValueError):
        store.append(log(spark, [("d", 1, "late", 5)]))
    assert store.append(log(spark, [("d", 1, "again", 10)])) and current(store) == {"a": "x", "d": "again"}
    assert len(list((tmp_path / "s" / "runs").iterdir())) == 3  # the refused run is gone, the merged one is kept for readers


def test_readers_keep_what_they_began_with(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    for i in range(3):
        store.append(log(spark, [(f"k{i}", 1, "x", i)]))
    before = store.read()
    assert store.compact(force=True) and before.count() == 3
    assert store.vacuum(0) >= 3 and len(store.manifest()["runs"]) == 1 and current(store) == {f"k{i}": "x" for i in range(3)}
    assert len([p for p in (tmp_path / "s" / "manifests").iterdir() if p.suffix == ".json"]) == 1


def test_two_streams_feed_one_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    for i, key in enumerate("ab"):
        log(spark, [(key, 1, key, i)]).write.parquet(f"file://{tmp_path}/in{i}")
        stream = spark.readStream.schema(LOG).parquet(f"file://{tmp_path}/in{i}")
        streaming.into_runs(stream, store, f"file://{tmp_path}/c{i}").awaitTermination()
    assert current(store) == {"a": "a", "b": "b"}
    stream = spark.readStream.schema(LOG).parquet(f"file://{tmp_path}/in0")
    streaming.into_runs(stream, store, f"file://{tmp_path}/anew").awaitTermination()
    assert current(store) == {"a": "a", "b": "b"} and len(store.manifest()["batches"]) == 3


def test_an_empty_batch_makes_no_run(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    assert store.append(log(spark, []), 0, "x") and not store.append(log(spark, [("a", 1, "x", 0)]), 0, "x")
    assert store.manifest()["runs"] == [] and store.read().count() == 0 and not store.compact(force=True)


def test_tombstones_count_as_removed(spark):
    rows = [(f"key_{i}", 1, "x", i, 0) for i in range(100)] + [(f"key_{i}", 2, None, 1000 + i, 1) for i in range(50)]
    runs = spark.createDataFrame(rows, LOG + ", tid long")
    got = tiers.merge_stats(runs).first()
    assert (got["entries_in"], got["keys"], got["keys_removed"]) == (150, 100, 50)
    assert tiers.merge(runs).count() == 50


def test_partial_merge_keeps_deletions(spark):
    runs = spark.createDataFrame([("a", 1, "old", 0, 0), ("a", 2, None, 1, 1), ("b", 1, "x", 2, 2)], LOG + ", tid long")
    merged = tiers.partial_merge(runs, [1, 2])
    assert [r["k"] for r in tiers.merge(merged).collect()] == ["b"]
    assert merged.where("op = 2").count() == 1


def test_exact_runs_follow_the_running_size(spark):
    rows = [(f"k{i % 4}", 1, "x" * 10, i) for i in range(40)]
    got = [r["tid"] for r in tiers.exact_runs(log(spark, rows), limit=60).orderBy("seq").collect()]
    assert got[:4] == [0, 0, 0, 1] and got == sorted(got)


def test_engine_and_command_lines(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    out = e.run(["put  a   1  2 ", "GET a", "delete a", "get a", "bogus", "compact", "stats", "get", "help", "quit", "get a"])
    assert [x.get("success") for x in out] == [True, None, True, None, None, True, None, None, None]
    assert (out[1]["found"], out[1]["value"], out[3]["found"], out[3]["value"]) == (True, "1 2", False, None)
    assert out[4]["error"] and out[7]["error"] == "usage: GET <key>" and "HELP" in out[8]["usage"]
    assert (out[6]["num_sstables"], out[6]["keys_removed"], out[6]["total_compactions"]) == (0, 1, 1) and out[6]["last_compaction"].endswith("Z")
    assert e.put("a", "again") == {"success": True, "error": None} and e.get("a")["value"] == "again"
    assert e.store.manifest()["last"] == 2  # numbers go on after the last deletion was dropped
    rows = spark.createDataFrame([("x", 1, "1", 0), ("x", 1, "2", 1), ("a", 2, None, 2)], "k string, op int, v string, at long")
    assert e.write_all(rows)["success"] and e.get("x")["value"] == "2" and not e.get("a")["found"] and len(e.store.manifest()["runs"]) == 2
    assert e.compact()["success"] and e.write_all(rows.withColumn("at", F.lit(-9).cast("long")))["error"]
    empty = Engine(spark, f"file://{tmp_path}/none")
    assert empty.compact()["success"] and not empty.get("a")["found"] and empty.stats()["num_sstables"] == 0


def test_parse(spark):
    lines = spark.createDataFrame([("  pUt k  v  w ",), ("",), (None,), ("get x y",), ("PUT k",)], "line string")
    got = [tuple(r)[1:] for r in commands.parse(lines, F.col("line")).collect()]
    assert got == [("PUT", "k", "v w"), (None, None, None), (None, None, None), ("GET", "x", None), ("PUT", "k", None)]


def _fnv(data, one):
    h = 2166136261
    for b in data:
        h = (h * 16777619 & 0xFFFFFFFF) ^ b if one else (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_fnv(spark):
    words = ["", "a", "user:17", "éß漢"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(fnv1(F.col("w")), fnv1a(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(_fnv(w.encode(), True), _fnv(w.encode(), False)) for w in words]


def test_bloom_rates(spark):
    m, k = bloom.parameters(10_000, 0.01)
    assert (m, k) == (95851, 7)
    runs = spark.range(2000).select(F.lit(0).alias("tid"), F.concat(F.lit("key_"), "id").alias("k"))
    small_m, small_k = bloom.parameters(2000, 0.01)
    keys = spark.range(4000).select(F.concat(F.lit("key_"), "id").alias("k"))
    got = {r["present"]: r["count"] for r in bloom.probe(runs, keys, small_m, small_k).groupBy("present").count().collect()}
    assert got[True] == 2000 and got.get(False, 0) < 60
    assert bloom.probe(runs.limit(0), keys, m, k).count() == 0
    assert tuple(bloom.hit_miss(runs.limit(0), keys, m, k).first()) == (0, 0, 0.0)


def test_bloom_bytes(spark):
    m, k = bloom.parameters(1000, 0.01)
    names = [f"test{i}" for i in range(1, 6)] + ["é漢"]
    runs = spark.createDataFrame([(7, n) for n in names] + [(200, "other")], "tid long, k string")
    whole = bloom.filters(bloom.bits(runs, m, k), m, k)
    own = bytearray(-(-m // 8))
    for n in names:
        h1, h2 = _fnv(n.encode(), True), _fnv(n.encode(), False)
        for i in range(k):
            bit = (h1 + i * h2 & 0xFFFFFFFF) % m
            own[bit // 8] |= 1 << bit % 8
    assert bytes({r["tid"]: r["filter"] for r in whole.collect()}[7]) == struct.pack("<II", m, k) + bytes(own)
    parsed = bloom.read_filters(whole.union(spark.createDataFrame([(9, b"short")], "tid long, filter binary")))
    asked = spark.createDataFrame([(t, n) for t in (7, 200) for n in [*names, "absent", "other"]], "tid long, k string")
    got = {(r["tid"], r["k"]): r["may_contain"] for r in bloom.may_contain(parsed, asked).collect()}
    assert got == {(t, n): n in (names if t == 7 else ["other"]) for t in (7, 200) for n in [*names, "absent", "other"]}


def test_bloom_over_more_than_64_runs(spark):
    r = random.Random(2)
    rows = [(t, f"k{r.randrange(60)}") for t in range(150) for _ in range(3)]
    runs = spark.createDataFrame(sorted(set(rows)), "tid long, k string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(80)], "k string")
    m, k = 40, 2
    own = {t: {b for x, n in rows if x == t for b in _bits(n, m, k)} for t in range(150)}
    passes = {(t, f"k{i}") for t in range(150) for i in range(80) if set(_bits(f"k{i}", m, k)) <= own[t]}
    got = bloom.probe(runs, keys, m, k).collect()
    assert {(x["tid"], x["k"]) for x in got} == passes and {(x["tid"], x["k"]) for x in got if x["present"]} == set(rows)
    hits = misses = 0
    for i in range(80):
        for t in range(149, -1, -1):
            hits, misses = hits + ((t, f"k{i}") not in passes), misses + ((t, f"k{i}") in passes)
            if (t, f"k{i}") in rows:
                break
    assert tuple(bloom.hit_miss(runs, keys, m, k).first())[:2] == (hits, misses)


def test_bloom_counters_of_odd_rows(spark):
    """Runs without a number, with numbers below 0 or without a key; repeated rows; a key that is null or asked twice."""
    r = random.Random(3)
    rows = [(t, f"k{r.randrange(40)}") for t in range(-70, 70, 3) for _ in range(4)] + [(t, None) for t in (5, 200)] + [(None, "k1"), (None, "alone"), (None, None)]
    asked = [*[f"k{i}" for i in range(60)], "alone", "k7", None]
    m, k = 50, 2
    own = {t: {b for x, n in rows if x == t and t is not None and n is not None for b in _bits(n, m, k)} for t in {t for t, _ in rows}}
    hits = misses = 0
    for name in asked:
        newest = max((t for t, n in rows if t is not None and name is not None and n == name), default=None)
        for t in own:
            if newest is None or t is not None and t >= newest:
                there = name is not None and set(_bits(name, m, k)) <= own[t]
                hits, misses = hits + (not there), misses + there
    runs = spark.createDataFrame(rows * 2, "tid long, k string")
    got = bloom.hit_miss(runs, spark.createDataFrame([(n,) for n in asked], "k string"), m, k).first()
    assert tuple(got) == (hits, misses, round(hits / (hits + misses) * 100, 6))


def test_bloom_probes_broadcast_nothing(spark):
    """Keys that look few in a plan may be many rows of bits: they must not go to the driver."""
    runs, keys = spark.range(1000).select(F.expr("id div 10").alias("tid"), F.concat(F.lit("k"), "id").alias("k")), spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    for out in (bloom.hit_miss(runs, keys, 100, 3), bloom.passing(runs, keys, 100, 3)):
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert rows and "CartesianProduct" in plan and "Broadcast" not in plan


def _bits(name, m, k):
    h1, h2 = _fnv(name.encode(), True), _fnv(name.encode(), False)
    return [(h1 + i * h2 & 0xFFFFFFFF) % m for i in range(k)]


def test_ring(spark):
    three = ring.vnodes(ring.nodes(spark, ["node1", "node2", "node3"]))
    keys = spark.range(10_000).select(F.concat(F.lit("key_"), "id").alias("key"))
    counts = {r["node_id"]: r["count"] for r in ring.locate(keys, F.col("key"), ring.arcs(three)).groupBy("node_id").count().collect()}
    assert counts == {"node1": 3401, "node2": 3096, "node3": 3503}
    two = spark.createDataFrame([("test_key",), ("consistent_key",)], "key string")
    lists = ring.preference_list(two, F.col("key"), ring.arcs(three, 10)).orderBy("pos").collect()
    assert [r["node_id"] for r in lists if r["key"] == "test_key"] == ["node3", "node2", "node1"]
    assert [r["node_id"] for r in lists if r["key"] == "consistent_key"] == ["node1", "node3", "node2"]
    less = ring.vnodes(ring.nodes(spark, ["node1", "node3"]))
    with pytest.raises(ValueError):
        ring.locate(keys, F.col("key"), ring.arcs(three.limit(0)))
    moved = ring.rebalance(keys.limit(1000), F.col("key"), ring.arcs(three), ring.arcs(less)).collect()
    assert all(r["old_node"] == "node2" or r["old_node"] == r["new_node"] for r in moved)


def test_registry(spark):
    r = ring.Registry(spark)
    with pytest.raises(ValueError):
        r.ring()
    r.register("node1", "localhost:50051")
    with pytest.raises(ValueError):
        r.register("node1", "x")
    with pytest.raises(KeyError):
        r.unregister("node9")
    assert r.address("node1") == "localhost:50051" and len(r) == 1


def test_replicas(spark):
    rows = [("a", "node1", 1000, 1, "old"), ("a", "node2", 2000, 2, "newer"), ("a", "node3", 0, 0, "oldest"), ("b", "node1", 5, 1, "x"), ("b", "node2", 5, 2, "y"), ("c", "node1", 1, 1, "z")]
    df = spark.createDataFrame(rows, "k string, node_id string, ts long, version long, v string")
    assert {r["k"]: r["node_id"] for r in replication.resolve(df, "k").collect()} == {"a": "node2", "b": "node2", "c": "node1"}
    assert {r["k"]: r["needs_repair"] for r in replication.needs_read_repair(df, "k").collect()} == {"a": True, "b": True, "c": False}


def test_hints(spark):
    rows = [("node2", f"key{i}", i, i) for i in range(1, 4)] + [("node3", "key9", 9, 9)]
    df = spark.createDataFrame(rows, "target_node string, k string, ver long, c long").withColumn("created_at", F.timestamp_seconds("c")).drop("c")
    assert sorted(r["k"] for r in handoff.remove_at(df, 1).collect()) == ["key1", "key3", "key9"]
    assert handoff.remove_at(df, 7).count() == 4
    assert handoff.capped(df, 2).count() == 3
    assert handoff.clear(df, "node2").count() == 1
    late = F.timestamp_seconds(F.lit(24 * 3600 + 2))
    assert {tuple(r) for r in handoff.expired(df, late).collect()} == {("node2", 1, 2), ("node3", 1, 0)}


def test_votes_follow_a_sequential_model(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), r.randrange(6) + i // 60, f"c{r.randrange(3)}", i, r.randrange(3), r.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "voter long, term long, candidate string, arrival long, last_log_index long, last_log_term long")
    want, state = set(), {}
    for voter, term, cand, at, index, log_term in rows:
        seen, voted = state.get(voter, (0, None))
        if term < seen:
            continue
        if term > seen:
            seen, voted = term, None
        if voted in (None, cand) and (log_term, index) >= (1, 1):
            voted = cand
            want.add(at)
        state[voter] = (seen, voted)
    assert {x["arrival"] for x in election.decide(df).where("granted").collect()} == want


def test_binary_formats(spark, tmp_path):
    records = [(5, 1, b"a", b"1"), (6, 2, b"b", b""), (7, 1, b"", b"\xff")]
    data = binary.encode_log(records)
    (tmp_path / "wal.log").write_bytes(data + b"\x01\x02")
    got = binary.read_logs(spark, f"file://{tmp_path}/wal.log").orderBy("seq").collect()
    assert [(r["ts_ns"], r["op"], r["k"], None if r["v"] is None else bytes(r["v"])) for r in got] == [(5, 1, "a", b"1"), (6, 2, "b", None), (7, 1, "", b"\xff")]
    with pytest.raises(ValueError):
        list(binary.decode_log(data[:-1], "fail"))
    for i, table in {9: [(b"a", b"old")], 10: [(b"a", binary.TOMBSTONE), (b"b", b"")]}.items():
        (tmp_path / f"sstable_{i}.db").write_bytes(binary.encode_table(table))
    runs = binary.read_tables(spark, f"file://{tmp_path}/sstable_*.db")
    assert [(r["k"], bytes(r["v"])) for r in tiers.merge(runs).collect()] == [("b", b"")]
    with pytest.raises(ValueError):
        list(binary.decode_table(struct.pack("<qqIII", 0, 0, 0, 0, 1)))


def test_log_and_table_files(spark, tmp_path):
    rows = random_log(5, n=80, keys=9)
    logs = f"file://{tmp_path}/wal"
    written = binary.write_logs(log(spark, rows).withColumn("ts_ns", F.col("seq") * 10).repartition(3), logs)
    assert sum(r["n"] for r in written.collect()) == 80
    got = binary.read_logs(spark, f"{logs}/*.log").collect()
    assert sorted((r["ts_ns"] // 10, r["k"], r["op"], None if r["v"] is None else bytes(r["v"]).decode()) for r in got) == [(s, k, op, v) for k, op, v, s in rows]
    binary.reset_logs(spark, logs)
    assert not (tmp_path / "wal").exists()
    runs = tiers.flush(log(spark, rows).withColumn("tid", F.expr("seq div 30")))
    m, k = bloom.parameters(100, 0.01)
    assert sorted(r["tid"] for r in binary.write_tables(runs, f"file://{tmp_path}/t", m, k).collect()) == [0, 1, 2]
    assert {r["k"]: bytes(r["v"]).decode() for r in tiers.merge(binary.read_tables(spark, f"file://{tmp_path}/t/*.db")).collect()} == model(rows)
    parsed = bloom.read_filters(binary.read_filters(spark, f"file://{tmp_path}/t/*.db"))
    assert {r["may_contain"] for r in bloom.may_contain(parsed, runs.select("tid", "k")).collect()} == {True}
    data = bytearray((tmp_path / "t" / "sstable_1.db").read_bytes())
    data[struct.unpack_from(binary.FOOTER, data, len(data) - 28)[0] + 5] ^= 1
    with pytest.raises(ValueError):
        list(binary.decode_table(bytes(data)))


def test_hint_files(spark, tmp_path):
    (tmp_path / "hints_node2.json").write_text('[\n {"target_node": "node2", "key": "k", "value": "dGV4dA==", "timestamp": 1, "version": 2, "created_at": "2024-01-01T00:00:00.1234567+01:00"}]')
    (tmp_path / "hints_bad.json").write_text("no json")
    got = binary.read_hints(spark, f"file://{tmp_path}/hints_*.json").where("key IS NOT NULL").collect()
    assert [(r["target_node"], bytes(r["value"])) for r in got] == [("node2", b"text")]


def test_hint_files_round_trip_by_node(spark, tmp_path):
    def hints(rows):
        return spark.createDataFrame([(n, k, i, op, v) for n, k, i, op, v in rows], "target_node string, k string, ver long, op int, v string").withColumn("created_at", F.timestamp_seconds("ver"))
    path = f"file://{tmp_path}/h"
    binary.write_hints(hints([("node2", "k1", 1, 1, "text"), ("node2", "k2", 2, 2, None), ("node2", "k3", 3, 1, "over"), ("node3", "k9", 9, 1, "é")]), path, cap=2)
    binary.write_hints(hints([("node3", "k8", 8, 1, "new")]), path)
    got = sorted((r["target_node"], r["key"], bytes(r["value"]).decode(), r["version"], r["timestamp"], r["created_at"].timestamp()) for r in binary.read_hints(spark, path).collect())
    want = [("node2", "k1", "text", 1), ("node2", "k2", "__TOMBSTONE__", 2), ("node3", "k8", "new", 8)]
    assert [x[:4] for x in got] == want and all(x[4] == x[3] * 10**6 and x[5] == x[3] for x in got)


def test_step_down_and_messages_of_leaders(spark):
    sent = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("a", 2, 2), ("a", 3, 3), ("b", 2, 4), ("b", 1, 5)], "node string, term long, arrival long")
    assert {r["arrival"]: r["success"] for r in election.append_entries(sent).collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
    assert {r["node"]: r["term"] for r in election.step_down(sent).collect()} == {"a": 3, "b": 2}
    peers = spark.createDataFrame([("a",), ("b",)], "peer string")
    assert [tuple(r) for r in election.leader_state(peers, 4).orderBy("peer").collect()] == [("a", 5, 0), ("b", 5, 0)]


def test_service_calls_follow_a_dict(spark):
    r, rows, held, want = random.Random(4), [], {}, {}
    for i in range(200):
        verb, key = r.choice(["PUT", "GET", "GET", "DELETE"]), f"k{r.randrange(8)}"
        rows.append((i, verb, key, f"v{i}" if verb == "PUT" else None))
        if verb == "PUT":
            held[key] = f"v{i}"
        elif verb == "DELETE":
            held.pop(key, None)
        want[i] = (None, key in held, held.get(key)) if verb == "GET" else (True, None, None)
    got = fold.service_calls(spark.createDataFrame(rows, "seq long, verb string, key string, value string")).collect()
    assert {x["seq"]: (x["success"], x["found"], x["got"]) for x in got} == want


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(11)
    for i in range(6):
        log(spark, rows[i * 50 : i * 50 + 50]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = streaming.latest(spark, f"file://{tmp_path}/in", lambda s: s, f"file://{tmp_path}/out")
    assert {r["k"]: r["v"] for r in got.collect()} == model(rows)


def test_stream_in_any_order_equals_batch_over_compactions(spark, tmp_path):
    """Later files hold older writes, so compaction must go by sequence number and deletions must outlive it."""
    rows = random_log(14, n=120, keys=15)
    store = RunStore(spark, f"file://{tmp_path}/s")
    for i in reversed(range(6)):
        log(spark, rows[i * 20 : i * 20 + 20]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    streaming.into_runs(stream, store, f"file://{tmp_path}/c").awaitTermination()
    state = store.manifest()
    assert state["compactions"] >= 1 and state["removed"] == 0 and state["last"] == 119
    assert {r["k"]: r["v"] for r in store.current().collect()} == model(rows)
    assert {r["k"] for r in store.read().where("op = 2").collect()}


def test_streaming_aggregate_equals_batch(spark, tmp_path):
    rows = random_log(12)
    log(spark, rows).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = streaming.state(stream).writeStream.outputMode("complete").format("memory").queryName("held").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.awaitTermination()
    assert {r["k"]: r["v"] for r in fold.live(spark.table("held")).collect()} == model(rows)


def test_a_batch_delivered_twice_counts_once(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    batch = log(spark, [("a", 1, "x", 0)])
    assert store.append(batch, 0) and not store.append(batch, 0) and store.append(batch, 1)
    assert len(store.manifest()["runs"]) == 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.sampled_from([1, 2]), st.binary(max_size=20), st.binary(max_size=20)), max_size=8), st.integers(0, 60))
def test_log_round_trip(records, cut):
    data = binary.encode_log(records)
    assert list(binary.decode_log(data)) == records
    whole = list(binary.decode_log(data[: max(0, len(data) - cut)]))
    assert whole == records[: len(whole)]
