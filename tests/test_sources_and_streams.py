"""Sources, sinks and the streaming queue."""

import hashlib

import pytest

from loomwell.sources import records
from loomwell.streaming import queue


def test_truth_csv(spark, tmp_path):
    (tmp_path / "1.csv").write_text("page_type;identification\ncle;statut;valeur\nage;CONNU;30\ngrossesse_desiree;CONNU;oui\nparite;ILLISIBLE;2?\n", encoding="utf-8")
    got = {r.key: (r.page_type, r.status, r.value, r.raw, r.checked) for r in records.truth_csv(spark, str(tmp_path)).collect()}
    assert got["age"] == ("identification", "CONNU", "30", "30", False)
    assert got["grossesse_desiree"][4] and got["parite"][2:4] == (None, "2?")


def test_images_and_recordings(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    found = records.images(spark, str(tmp_path)).collect()
    assert [(r.stem, r.sha256) for r in found] == [("a", hashlib.sha256(b"abc").hexdigest())]
    asked = spark.createDataFrame([("h", "k"), ("h", "z")], "sha256 string, key string")
    kept = spark.createDataFrame([("h", "k", "12", "ecrit")], "sha256 string, key string, text string, state string")
    assert {(r.key, r.state) for r in records.recorded_readings(asked, kept).collect()} == {("k", "ecrit"), ("z", "erreur")}


def test_sealed_payload(spark):
    rows = spark.createDataFrame([("1", "secret")], "id string, payload string")
    shut = records.sealed(rows, "payload", "1234")
    assert b"secret" not in bytes(shut.first().payload)
    assert records.opened(shut, "payload", "1234").first().payload == "secret"
    assert records.opened(shut, "payload", "9999").first().payload is None


def test_endpoint_guard(monkeypatch):
    assert records.local_endpoint("http://localhost:1") and records.local_endpoint("http://192.168.1.4") and records.local_endpoint("http://x.local")
    assert not records.local_endpoint("http://example.com") and not records.local_endpoint("http://localhost", "m-cloud")
    monkeypatch.setenv("LOOMWELL_URL", "http://example.com")
    with pytest.raises(ValueError):
        records.load_config()
    monkeypatch.setenv("LOOMWELL_URL", "http://127.0.0.1:5")
    monkeypatch.setenv("LOOMWELL_BATCH", "3")
    assert records.load_config().batch == 3


def test_upsert_is_idempotent_and_equals_batch(spark, tmp_path):
    shape = "id long, seq long, state string"
    rows = [(1, 1, "a"), (1, 3, "c"), (2, 2, "b"), (1, 2, "x")]
    source = tmp_path / "in"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(source))
    sink = queue.UpsertSink(spark, str(tmp_path / "sink"), "id", ["seq"])
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(source))
    queue.run_once(stream, sink, str(tmp_path / "ck"))
    want = {(1, 3, "c"), (2, 2, "b")}
    assert {tuple(r) for r in sink.read().select("id", "seq", "state").collect()} == want
    sink(spark.createDataFrame(rows[2:], shape), sink.versions()[-1])  # the last batch again
    assert {tuple(r) for r in sink.read().select("id", "seq", "state").collect()} == want


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    sink = queue.UpsertSink(spark, str(tmp_path / "sink"), "id", ["seq"], buckets=8)
    shape = "id long, seq long"
    sink(spark.createDataFrame([(i, 0) for i in range(100)], shape), 0)
    sink(spark.createDataFrame([(7, 1)], shape), 1)
    sink(spark.createDataFrame([], shape), 2)
    sink(spark.createDataFrame([(7, 0), (500, 3)], shape), 3)
    assert {tuple(r) for r in sink.read().collect()} == {(i, 1 if i == 7 else 0) for i in range(100)} | {(500, 3)}
    assert sink.versions() == [2, 3] and len(list((tmp_path / "sink" / "v=1").glob("bucket=*"))) <= 1


def test_retries_escalate(spark, tmp_path):
    shape = "rec_id long, seq long, online boolean, ok boolean"
    rows = [(1, i, True, False) for i in range(3)] + [(2, 0, False, False), (2, 1, True, True), (3, 0, True, False)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    states = queue.work(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
    query = states.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.rec_id, r.state, r.tries) for r in got} == {(1, "REVISION_MANUELLE_REQUISE", 3), (2, "TRAITE_IA", 0), (3, "ECHEC_TRAITEMENT", 1)}
