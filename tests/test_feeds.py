"""Truth files and the change feed as data sources."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

from loomwell.sources import feeds, records


def segment(folder, ids):
    rows = [json.dumps({"id": i, "kind": "a" if i % 2 else "b", "payload": {"n": i, "é": "ü"}}, ensure_ascii=False) for i in ids]
    (folder / "tmp").write_text("\n".join(rows) + "\n", encoding="utf-8")
    (folder / "tmp").rename(folder / feeds.segment_name(ids[0]))


@pytest.fixture
def feed(spark, tmp_path):
    feeds.register(spark)
    folder = tmp_path / "feed"
    folder.mkdir()
    for ids in ([1, 2, 5], [7, 8], [11, 12, 13]):
        segment(folder, ids)
    return folder


def test_feed_reads_all_rows_and_pushes_ids(spark, feed):
    rows = spark.read.format("change_feed").load(str(feed))
    assert [r.id for r in rows.orderBy("id").collect()] == [1, 2, 5, 7, 8, 11, 12, 13]
    assert json.loads(rows.where("id = 7").first().payload) == {"n": 7, "é": "ü"}
    assert sorted(r.id for r in rows.where("id > 5 AND id < 12 AND kind = 'a'").collect()) == [7, 11]
    assert rows.where("id >= 8").rdd.getNumPartitions() == 2 and rows.where("id > 13").count() == 0
    assert spark.read.format("change_feed").option("since", 11).load(str(feed)).count() == 2


def test_filters_choose_segments(feed):
    def parts(*filters):
        reader = feeds.ChangeReader(str(feed), 0)
        left = list(reader.pushFilters(list(filters)))
        return left, [int(p.name[-26:-6]) for p in reader.partitions() if p.name]

    assert parts(GreaterThan(("id",), 5)) == ([], [1, 7, 11])  # the first one may hold 6
    assert parts(GreaterThanOrEqual(("id",), 7)) == ([], [7, 11])
    assert parts(LessThan(("id",), 7)) == ([], [1])
    assert parts(EqualTo(("id",), 8)) == ([], [7])
    other = EqualTo(("kind",), "a")
    assert parts(other) == ([other], [1, 7, 11])


def test_stream_equals_batch_and_a_restart_reads_none_twice(spark, feed, tmp_path):
    got = []

    def run():
        stream = spark.readStream.format("change_feed").load(str(feed))
        query = stream.writeStream.foreachBatch(lambda b, _: got.append([r.id for r in b.collect()])).option("checkpointLocation", str(tmp_path / "ck"))
        query = query.trigger(processingTime="200 milliseconds").start()
        query.processAllAvailable()
        query.stop()

    run()
    assert sorted(sum(got, [])) == [1, 2, 5, 7, 8, 11, 12, 13]
    segment(feed, [20, 21])
    run()
    run()
    assert sorted(sum(got, [])) == [1, 2, 5, 7, 8, 11, 12, 13, 20, 21]


def test_an_empty_feed(spark, tmp_path):
    feeds.register(spark)
    assert spark.read.format("change_feed").load(str(tmp_path / "none")).count() == 0


def test_truth_files(spark, tmp_path):
    feeds.register(spark)
    (tmp_path / "1.csv").write_text("page_type;identification\ncle;statut;valeur\nage;CONNU;30\nparite;ILLISIBLE;2?\nnote;CONNU;a;b\n\n", encoding="utf-8")
    (tmp_path / "2.csv").write_text("page_type;couverture\ncle;statut;valeur\ncode;CONNU;K7\nvide;NON_FOURNI\n", encoding="utf-8")
    rows = spark.read.format("truth_files").load(str(tmp_path))
    got = {(r.page_type, r.key): (r.status, r.value, r.raw, r.file) for r in rows.collect()}
    assert got[("identification", "note")] == ("CONNU", "a;b", "a;b", "1.csv") and got[("couverture", "vide")] == ("NON_FOURNI", None, "", "2.csv")
    assert got[("identification", "parite")][1:3] == (None, "2?") and len(got) == 5
    assert {r.key for r in rows.where(F.col("page_type").isin("couverture", "x")).collect()} == {"code", "vide"}
    old = {(r.page_type, r.key): (r.status, r.value, r.raw) for r in records.truth_csv(spark, str(tmp_path / "1.csv")).collect()}
    assert old[("identification", "age")] == got[("identification", "age")][:3]


def test_truth_filter_opens_matching_pages_only(tmp_path):
    (tmp_path / "bad.csv").write_text("page_type;other\ncle;statut;valeur\n" + "x;y;z\n" * 3, encoding="utf-8")
    reader = feeds.TruthReader(str(tmp_path))
    assert list(reader.pushFilters([EqualTo(("page_type",), "couverture"), In(("page_type",), ("couverture", "b"))])) == []
    assert [row for part in reader.partitions() for row in reader.read(part)] == []
    (tmp_path / "bad.csv").write_text("nothing\n", encoding="utf-8")
    with pytest.raises(ValueError, match="page_type"):
        list(reader.read(reader.partitions()[0]))
