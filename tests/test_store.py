"""Logs, snapshots, the store and the service."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import http, streaming
from nearfield.operators import shards
from nearfield.service import Client, Service, ServiceError, config_from_env
from nearfield.sources import oplog
from nearfield.sources.store import Config, QuantizerNotFitted, VectorStore


def sequential(ops, known=()):
    """What one operation after the other leaves: id -> (payload, deleted)."""
    state = {i: [p, d] for i, p, d in known}
    for op, i, p in ops:
        if op == "insert" and i not in state:
            state[i] = [p, False]
        elif op == "delete" and i in state:
            state[i][1] = True
    return {i: tuple(v) for i, v in state.items()}


def test_replay_is_sequential(spark):
    rng = np.random.default_rng(0)
    ops = [(("insert", "delete", "compact")[int(rng.choice(3, p=[0.5, 0.4, 0.1]))], int(rng.integers(0, 40)), k) for k in range(200)]
    log = spark.createDataFrame([(k, *o) for k, o in enumerate(ops)], "seq long, op string, id long, p long")
    known = [(100, -1, False), (5, -2, True), (6, -3, False)]
    snap = spark.createDataFrame(known, "id long, p long, deleted boolean")
    got = lambda df: {r["id"]: (r["p"], r["deleted"]) for r in df.collect()}
    assert got(oplog.replay(log)) == sequential(ops)
    assert got(oplog.replay(log, snap)) == sequential(ops, known)
    assert oplog.live(log).count() == sum(not d for _, d in sequential(ops).values())


def test_json_lines(spark, tmp_path):
    lines = ['{"op":"insert","ts":1.5,"id":0,"vector":[1.0,2.0],"metadata":{"a":1}}', "", '{"op":"delete","ts":2,"id":0}', '{"op":"compact","ts":3}']
    (tmp_path / "wal.jsonl").write_text("\n".join(lines) + "\n")
    rows = oplog.read_jsonl(spark, str(tmp_path / "wal.jsonl")).orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["id"]) for r in rows] == [(0, "insert", 0), (1, "delete", 0), (2, "compact", None)]
    assert json.loads(rows[0]["metadata"]) == {"a": 1}
    (tmp_path / "bad.jsonl").write_text("{not json")
    with pytest.raises(Exception):
        oplog.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "s"), Config(3, "euclidean", metadata={"kind": "string", "n": "int"}))


def test_write_read_delete_reopen(spark, store):
    assert store.insert_batch([[1, 0, 0], [0, 1, 0], [0, 0, 1]], [{"kind": "a"}, {"kind": "b", "n": 4}, {}]) == [0, 1, 2]
    assert store.delete(1, 7) == [True, False] and store.delete(1) == [False]
    assert store.insert([5, 5, 5]) == 3
    again = VectorStore(spark, store.files.root)
    assert [r["id"] for r in again.search([1, 0, 0], 10).orderBy("rank").collect()] == [0, 2, 3]
    assert again.search([1, 0, 0], 1, {"kind": {"$ne": "a"}}).first()["id"] == 2
    stats = again.stats()
    assert (stats["total"], stats["live"], stats["tombstoned"]) == (4, 3, 1)
    with pytest.raises(ValueError):
        VectorStore(spark, store.files.root, Config(4))


def test_refusals(store):
    for vectors, metadata in (([[1, 2]], None), ([[1, 2, 3]], [{}, {}])):
        with pytest.raises(ValueError):
            store.insert_batch(vectors, metadata)
    assert store.insert_batch([]) == []
    with pytest.raises(ValueError):
        store.search([1, 2])
    for wrong in ({"dim": 0}, {"dim": 2, "m": 1}, {"dim": 2, "metadata": {"_free": "string"}}):
        with pytest.raises(ValueError):
            Config(**wrong)


def test_undeclared_metadata_is_kept_and_filtered(spark, store):
    store.insert_batch([[1, 0, 0], [2, 0, 0], [3, 0, 0], [4, 0, 0]], [{"category": "finance", "score": 7, "kind": "a"}, {"category": "tech"}, {"category": "finance", "score": 3}, None])
    found = lambda spec: [r["id"] for r in store.search([0, 0, 0], 9, spec).orderBy("rank").collect()]
    for _ in range(2):
        assert found({"category": "finance"}) == [0, 2] and found({"category": "finance", "score": {"$gte": 5}}) == [0]
        assert found({"category": {"$ne": "finance"}}) == [1, 3] and found({"kind": "a", "score": 7}) == [0] and found({"score": "7"}) == []
        store.snapshot()
    assert json.loads(store.search([1, 0, 0], 1).first()["_free"]) == {"category": "finance", "score": 7}


def test_reads_leave_the_snapshot_in_place(spark, store):
    """With a log present, the snapshot isn't shuffled, and filters reach its files."""
    store.insert_batch([[i, 0, 0] for i in range(9)], [{"kind": "x" if i % 2 else "y"} for i in range(9)])
    store.snapshot()
    store.delete(1, 3)
    store.insert([9, 9, 9], {"kind": "x"})
    df = store.live().where("kind = 'x'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,x)" in plan and "SortMergeJoin" not in plan
    assert sorted(r["id"] for r in df.collect()) == [5, 7, 9]


def test_kept_indexes(spark, tmp_path):
    v = np.random.default_rng(5).random((300, 8))
    s = VectorStore(spark, str(tmp_path / "i"), Config(8, "euclidean", m=8, ef_construction=60))
    s.insert_frame(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, vector array<float>"), order_col="i")
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 300, 10)], "qid long, qvec array<double>")
    with pytest.raises(ValueError):
        s.approximate(queries)
    s.build_graphs(2)
    s.delete(10, 20)
    extra = s.insert(v[30].tolist())
    again = VectorStore(spark, s.files.root)
    assert again.stats()["max_layer"] >= 0 and again.stats()["index"] == "graphs"
    truth = {(r["qid"], r["id"]) for r in again.knn(queries, 5).collect()}
    recall = lambda ef: len(truth & {(r["qid"], r["id"]) for r in again.approximate(queries, 5, ef_search=ef).collect()}) / len(truth)
    assert recall(300) == 1.0 and recall(60) >= 0.9 and recall(60) >= recall(5)
    assert [r["id"] for r in again.search(v[30].tolist(), 2, ef_search=50).orderBy("rank").collect()] == [30, extra]
    again.build_cells(6)
    found = lambda n: {(r["qid"], r["id"]) for r in again.approximate(queries, 5, nprobe=n).collect()}
    assert found(6) == truth and len(found(1) & truth) < len(truth)
    again.compact()
    assert again.stats()["index"] is None


def test_compaction_keeps_or_renumbers_ids(spark, store):
    store.insert_batch([[i, 0, 0] for i in range(20)])
    store.delete(*range(0, 10, 2))
    store.compact()
    assert store.stats()["tombstoned"] == 0 and sorted(r["id"] for r in store.live().collect())[:3] == [1, 3, 5]
    mapping = {r["old_id"]: r["new_id"] for r in store.compact(renumber=True).collect()}
    assert len(mapping) == 15 and mapping[1] == 0 and mapping[19] == 14
    assert store.insert([9, 9, 9]) == 15
    assert store.search([19, 0, 0], 1).first()["id"] == 14


def test_readers_keep_their_version(spark, store):
    store.insert_batch([[i, 0, 0] for i in range(5)])
    reader = VectorStore(spark, store.files.root)
    before = reader.live()
    store.delete(0)
    store.compact()
    assert before.count() == 5 and store.live().count() == 4
    reader.refresh()
    assert reader.live().count() == 4
    store.vacuum()
    assert store.live().count() == 4


def test_uncommitted_files_do_not_count(spark, store):
    store.insert([1, 1, 1])
    store._log().write.parquet(store.files.at("log/000000000000000009-dead"))  # written, but never published
    store.files._fs.create(store.files._path(store.files.at("manifests/000000000099.json.tmp")), True).close()
    assert VectorStore(spark, store.files.root).live().count() == 1


def test_automatic_snapshot_and_close(spark, tmp_path):
    with VectorStore(spark, str(tmp_path / "s"), Config(2, snapshot_every=3)) as s:
        s.insert_batch([[1, 0], [0, 1], [1, 1]])
        assert s.manifest["snapshot"] and not s.manifest["log"]
        s.insert([2, 2])
        s.delete(0)
    assert not VectorStore(spark, str(tmp_path / "s")).manifest["log"]
    assert VectorStore(spark, str(tmp_path / "s")).live().count() == 3


def test_insert_frame(spark, store):
    df = spark.range(1000).select(F.array(*[F.col("id").cast("float")] * 3).alias("vector"), F.col("id").cast("string").alias("kind"), "id")
    assert store.insert_frame(df, order_col="id") == (0, 1000)
    assert store.live().where("cast(id as string) <> kind").count() == 0
    assert store.insert_frame(df.limit(0)) == (1000, 1000)
    with pytest.raises(ValueError):
        store.insert_frame(spark.createDataFrame([([1.0],), (None,)], "vector array<float>"))


def test_quantised_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "q"), Config(4, "euclidean", quantize=True))
    v = np.random.default_rng(1).random((50, 4))
    with pytest.raises(QuantizerNotFitted):
        s.insert(v[0].tolist())
    s.fit_quantizer(spark.createDataFrame([(x.tolist(),) for x in v], "vector array<float>"))
    s.insert_batch(v.tolist())
    s.close()
    again = VectorStore(spark, str(tmp_path / "q"))
    assert again.quantizer == s.quantizer
    assert again.search(v[7].tolist(), 1).first()["id"] == 7
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(5)], "qid long, qvec array<double>")
    assert [(r["qid"], r["id"]) for r in again.knn(queries, 1).orderBy("qid").collect()] == [(i, i) for i in range(5)]
    again.delete(*range(50))
    again.compact(refit=True)
    assert again.quantizer == s.quantizer and again.insert(v[0].tolist()) == 50


def test_service(spark, tmp_path):
    client = Client(Service(VectorStore(spark, str(tmp_path / "v"), Config(2, metadata={"kind": "string"}))))
    assert client.insert([1, 0], {"kind": "a"}) == 0 and client.insert_batch([[0, 1], [1, 1]]) == [1, 2]
    hits = client.search([1, 0], 2, filter={"kind": "a"})
    assert [h["id"] for h in hits] == [0] and hits[0]["metadata"] == {"kind": "a"}
    assert client.delete(0) and not client.delete(0) and not client.delete(99)
    assert client.health()["stats"]["live"] == 2 and client.compact()["tombstoned"] == 0
    for status, call in (
        (400, lambda: client.insert([1, 2, 3])), (422, lambda: client.insert([])), (422, lambda: client.search([1, 0], 0)), (422, lambda: client.search([1, 0], 1, ef_search=0)),
        (400, lambda: client.search([1], 1)), (400, lambda: client.service.fit_quantizer({"vectors": [[1, 2]]})), (400, lambda: client.insert_batch([[1, 2]], [{}, {}])),
    ):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.status == status
    quantised = Client(Service(VectorStore(spark, str(tmp_path / "vq"), Config(2, quantize=True))))
    with pytest.raises(ServiceError) as e:
        quantised.insert([1, 2])
    assert e.value.status == 409
    assert quantised.service.fit_quantizer({"vectors": [[0, 0], [1, 1]]}) == {"fitted_on": 2} and quantised.insert([1, 0.5]) == 0
    assert config_from_env({"VDB_DIM": "8", "VDB_METRIC": "dot", "VDB_QUANTIZE": "1"}) == ("data", Config(8, "dot", True))
    assert config_from_env({"VDB_M": "8", "VDB_EF_CONSTRUCTION": "90", "VDB_EF_SEARCH": "70"})[1] == Config(128, m=8, ef_construction=90, ef_search=70)


def test_requests_over_http(spark, tmp_path):
    server = http.serve(Service(VectorStore(spark, str(tmp_path / "h"), Config(2, "euclidean"))))
    try:
        client = http.RemoteClient(f"http://127.0.0.1:{server.server_address[1]}")
        assert client.insert([1, 0], {"category": "x", "n": [1, 2]}) == 0 and client.insert_batch([[0, 1], [1, 1]], [{}, {"category": "y"}]) == [1, 2]
        assert client.search([1, 0], 2, filter={"category": {"$in": ["x", "y"]}})[0] == {"id": 0, "distance": 0.0, "metadata": {"category": "x", "n": [1, 2]}}
        assert client.delete(0) and not client.delete(0) and client.health()["stats"]["live_nodes"] == 2 and client.compact()["tombstoned"] == 0
        for status, call in ((422, lambda: client.search([1, 0], 0)), (400, lambda: client.insert([1])), (404, lambda: client.service._ask("POST", "/nothing", {})), (422, lambda: client.service._ask("POST", "/insert_batch", {"vectors": [], "metadata": []})), (422, lambda: client.service._ask("POST", "/insert", [1]))):
            with pytest.raises(ServiceError) as e:
                call()
            assert e.value.status == status
    finally:
        server.shutdown()


def test_log_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"seq": 0, "op": "insert", "ts": 0.0, "id": 1, "vector": [1.0]}, {"seq": 1, "op": "insert", "ts": 1.0, "id": 2, "vector": [2.0]}, {"seq": 2, "op": "delete", "ts": 2.0, "id": 1}]
    for part, own in enumerate((rows[:2], rows[2:])):
        (folder / f"{part}.json").write_text("\n".join(json.dumps(r) for r in own))
        query = streaming.commit_log(streaming.read_log(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
        query.awaitTermination(120)
    assert [r["id"] for r in streaming.live_from(spark, str(tmp_path / "out")).collect()] == [2]
    counts = streaming.operation_counts(streaming.read_log(spark, str(folder)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("ops").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["op"], r["n"]) for r in spark.table("ops").collect()} == {("insert", 2), ("delete", 1)}


def test_sharded_delete_and_compact(spark, tmp_path):
    stores = [VectorStore(spark, str(tmp_path / f"s{k}"), Config(2, "euclidean")) for k in range(2)]
    for s in stores:
        s.insert_batch([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    assert shards.delete(stores, "1:2") and not shards.delete(stores, "1:2") and not shards.delete(stores, "0:7")
    assert [sorted(r["id"] for r in s.live().collect()) for s in stores] == [[0, 1, 2], [0, 1]]
    for wrong, error in (("2:0", IndexError), ("-1:0", IndexError), ("x", ValueError)):
        with pytest.raises(error):
            shards.delete(stores, wrong)
    assert shards.delete(stores, "0:0") and len(shards.compact(stores)) == 2
    renumbered = shards.compact(stores, renumber=True)
    assert [sorted(map(tuple, m.collect())) for m in renumbered] == [[(1, 0), (2, 1)], [(0, 0), (1, 1)]]


def test_shards_that_fail_late(spark):
    hits = spark.createDataFrame([(0, i, float(i)) for i in range(4)], "qid int, id long, distance double")

    def late():
        return hits.withColumn("distance", F.raise_error(F.lit("gone")).cast("double"))

    def slow():
        time.sleep(5)
        return hits

    found, errors = shards.fan_out([lambda: hits, late, lambda: hits], 3)
    assert list(errors) == [1] and [r["id"] for r in found.orderBy("rank").collect()] == ["0:0", "2:0", "0:1"]
    with pytest.raises(shards.AllShardsFailed):
        shards.fan_out([lambda: hits, late], 3, require_all=True)
    with pytest.raises(shards.AllShardsFailed):
        shards.fan_out([late, late], 3)
    _, errors = shards.fan_out([lambda: hits, slow], 3, timeout=3)
    assert list(errors) == [1] and "Timeout" in errors[1]


def test_health_degrades(spark):
    rows = spark.createDataFrame([(0, False), (0, True), (2, False)], "shard int, deleted boolean")
    assert [tuple(r) for r in shards.health(rows, 3).orderBy("shard").collect()] == [(0, 2, 1, True), (1, 0, 0, True), (2, 1, 1, True)]
    bad = shards.health(rows, 3, errors={2: "gone"})
    assert [tuple(r) for r in bad.orderBy("shard").collect()] == [(0, 2, 1, True), (1, 0, 0, True), (2, 0, 0, False)]
    assert tuple(shards.health_summary(bad).first()) == (1, 3, "degraded")
