"""Record operators that no query calls: labels, page questions, deductions, sources, synthetic pages, the worker's legs."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.functions import labels, parse, text
from loomwell.operators import assembly, evaluate, freeform, fusion, imaging, lifecycle, manual, merge, model, questions, rules, synthetic
from loomwell.sources import records
from loomwell.streaming import queue

D = dt.date
FIELD = f"dossier_id string, page_type string, key string, value {model.VALUE}, status string, reasons array<string>"


def v(**k):
    return {**dict.fromkeys("b d n unit sys dia s".split()), **k}


def fields(spark, rows):
    return spark.createDataFrame([("d", *r, []) for r in rows], FIELD)


def test_boxes_agree_only_with_equal_boxes(spark):
    shape = "struct<marker:string,b:boolean,n:double,d:date,sys:int,dia:int,s:string>"
    none = dict.fromkeys("marker n d sys dia s".split())
    rows = spark.createDataFrame([({**none, "b": a}, {**none, "b": b}) for a in (True, False, None) for b in (True, False)], f"a {shape}, b {shape}")
    assert [r[0] for r in rows.select(parse.same_value(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False, False]


def test_rescan_keeps_changes_to_zero_and_false(spark):
    shape = "page string, k string, value string, safe boolean"
    old = spark.createDataFrame([("p", "a", "5", True), ("p", "b", "true", True), ("p", "c", None, False)], shape)
    new = spark.createDataFrame([("p", "a", "0", True), ("p", "b", "false", True), ("p", "c", "0", True), ("q", "z", "1", False)], shape)
    changes = merge.rescan_changes(old, new, ["page", "k"])
    assert {(r.k, r.kind, r.old_value, r.new_value) for r in changes.collect()} == {("a", "change", "5", "0"), ("b", "change", "true", "false")}
    merged = merge.rescan_merge(old, changes, F.col("k") == "a", ["page", "k"], new, ["page"])
    assert {(r.k, r.value, r.origin) for r in merged.collect()} == {("a", "0", "changed"), ("b", "true", "kept"), ("c", None, "kept"), ("z", "1", "page")}


def test_reapply_brings_validated_fields_back(spark):
    now = spark.createDataFrame([("a", "1", "A_REVISER", 0.2, None), ("b", "2", "CONNU", 0.9, "sf0")], "k string, value string, status string, confidence double, validated_by string")
    kept = spark.createDataFrame([("a", "9", "sf1"), ("gone", "7", "sf2")], "k string, value string, validated_by string")
    got = {r.k: (r.value, r.status, r.confidence, r.validated_by) for r in merge.reapply(now, kept, ["k"]).collect()}
    assert got == {"a": ("9", "CONNU", 1.0, "sf1"), "b": ("2", "CONNU", 0.9, "sf0"), "gone": ("7", "CONNU", 1.0, "sf2")}


def test_boxes_and_routes(spark):
    rows = spark.createDataFrame([(0.1, 1.0, 1.0), (0.4, 1.0, 1.0), (0.4, 1.0, 0.5)], "ink double, align double, visible double")
    box = fusion.checkbox_confidence(F.col("ink"))
    got = rows.select(box["checked"], box["confidence"], fusion.decide_checkbox(box["confidence"], F.col("align"), F.col("visible"))).collect()
    assert [r[0] for r in got] == [False, True, True] and got[0][1] == pytest.approx(0.5)
    assert [(r[2].status, r[2].confidence == 0) for r in got] == [("A_REVISER", False), ("CONNU", False), ("A_REVISER", True)]
    zones = spark.createDataFrame([(0.0, False, 0.0, 1.0), (0.1, False, 0.0, 1.0), (0.0, True, 0.0, 1.0), (0.0, False, 0.5, 1.0), (0.1, False, 0.0, 0.2)], "i double, d boolean, g double, v double")
    routes = [r[0] for r in zones.select(fusion.route(F.col("i"), F.col("d"), F.col("g"), F.col("v"))).collect()]
    assert routes == ["blank", "read", "read", "read", "off_frame"]


def test_labels_and_hints(spark):
    rows = spark.createDataFrame(
        [("vat_1", "x", None, None, "text"), ("ta__t1_v1", None, "TA :", "V1", "bp"), ("age", "AGE :", None, None, "int"), ("note", "Note libre", None, None, "text")],
        "key string, label string, row string, col string, type string",
    )
    c = F.col
    got = rows.select(labels.field_label(c("key"), c("label"), c("row"), c("col")), labels.hint(c("key"), c("type"), c("label"), c("row"), c("col"))).collect()
    assert [r[0] for r in got] == ["VAT 1", "TA (1er trimestre, visite 1)", "Age", "Note libre"]
    assert got[1][1] == "TA / V1 — tension SYS/DIA, ex. 110/70" and got[2][1] == "AGE — nombre entier"
    assert rows.select(labels.page_label(F.lit("accouchement")), labels.page_label(F.lit("?"))).first()[:] == ("Accouchement", "?")


def test_rules_name_their_fields(spark):
    rows = fields(spark, [
        ("identification", "gestation", v(n=1.0), "CONNU"), ("identification", "parite", v(n=4.0), "CONNU"), ("accouchement", "voie_basse_non_instrumen", v(b=True), "CONNU"),
        ("accouchement", "preciser_l_indication", None, "NON_FOURNI"), ("grossesse_actuelle", "rh_pos", v(b=True), "CONNU"), ("grossesse_actuelle", "rai_si_rh_negatif__t1", None, "NON_FOURNI"),
        ("pp_precoce_mere", "etat_de_la_cicatrice", None, "NON_FOURNI"), ("grossesse_actuelle", "ta__t1_v1", v(sys=70, dia=110), "CONNU"), ("identification", "age", v(n=60.0), "CONNU"),
    ])
    got = {r.key: (r.status, list(r.reasons)) for r in assembly.checked_fields(rows).collect()}
    assert got["gestation"] == ("A_REVISER", ["Gestité (1) < parité (4) + avortements (0) + grossesse en cours."])
    assert got["parite"][0] == "A_REVISER" and got["voie_basse_non_instrumen"] == ("CONNU", [])
    assert [got[k][0] for k in ("preciser_l_indication", "rai_si_rh_negatif__t1", "etat_de_la_cicatrice")] == ["NON_APPLICABLE"] * 3
    assert got["ta__t1_v1"][1] == ["Systolique ≤ diastolique : inversion ou erreur de lecture ?"] and got["age"][1] == ["Valeur 60 hors des bornes plausibles [12–55] : à confirmer."]
    visits = spark.createDataFrame([("d", 1, D(2025, 5, 1), D(2025, 1, 1), 30.0), ("d", 2, D(2025, 5, 1), D(2025, 1, 1), 17.0)], "dossier_id string, ord int, visit date, lmp date, weeks double")
    flag = rules.week_flags(visits).collect()
    assert [(f.rule, [x.key for x in f.fields]) for f in flag] == [("SA_VISITE", ["venue_le__t1_v1", "age_probable__t1_v1"])]
    late = spark.createDataFrame([("d", "pp_precoce_mere", D(2025, 5, 1), D(2025, 4, 20), D(2026, 4, 20))], "dossier_id string, page_type string, birth date, consult date, rdv date")
    assert {f.rule for f in rules.after_birth_flags(late).collect()} == {"DELAI_PP", "CHRONO", "DELAI_RDV_PP"}
    assert [f.key for f in rules.flagged_fields(rules.after_birth_flags(late).where("rule = 'CHRONO'")).collect()] == ["date_de_la_consultation"]


def test_questions_of_free_pages_and_state(spark):
    template = spark.createDataFrame([("identification", k) for k in ("age", "parite", "note")] + [("grossesse_actuelle", "ta__t1_v1"), ("grossesse_actuelle", "ddr")], "page_type string, key string")
    rows = spark.createDataFrame([("d", "identification", "age", True, "30", 1), ("d", "grossesse_actuelle", "ddr", True, "x", 2), ("e", "identification", "age", False, "3", 1)], "dossier_id string, page_type string, key string, free boolean, display string, seq int")
    asked = questions.page_questions(rows, template)
    assert {(q.dossier_id, q.page_type[:3], q.kind, q.key) for q in asked.collect()} == {("d", "ide", "confirmer_page", None), ("d", "ide", "manquant", "parite"), ("d", "gro", "confirmer_page", None), ("d", "gro", "reprendre_photo", None)}
    wanted = spark.createDataFrame([("d", "identification", 1), ("d", "accouchement", 2)], "dossier_id string, page_type string, seq int")
    gone = questions.missing_pages(wanted, rows)
    assert [q.page_type for q in gone.collect()] == ["accouchement"]
    every = questions.all_questions(asked, gone)
    settled = spark.createDataFrame([("d", "parite")], "dossier_id string, key string")
    keep = spark.createDataFrame([("d", "grossesse_actuelle")], "dossier_id string, page_type string")
    left = questions.without_settled(every.where("key IS NOT NULL OR kind = 'reprendre_photo'"), settled, keep)
    assert left.count() == 0
    status = spark.createDataFrame([("d", "CONNU"), ("e", "CONNU")], "dossier_id string, status string")
    nothing = spark.createDataFrame([], "dossier_id string")
    states = questions.record_state(status.select("dossier_id"), status, nothing, every.where("dossier_id = 'd'"))
    assert {(r.dossier_id, r.state) for r in states.collect()} == {("d", "A_REVISER"), ("e", "TRAITE_IA")}
    assert model.review_list(status).count() == 0
    secret = spark.createDataFrame([("p", "nom", True), ("p", "age", False)], "page_type string, key string, sensitive boolean")
    assert [r.key for r in model.without_sensitive(secret.select("page_type", "key"), secret).collect()] == ["age"]


def test_evaluation_helpers(spark):
    cells = spark.createDataFrame([("c", str(i % 2)) for i in range(6)] + [("d", str(i)) for i in range(6)], "col string, value string")
    assert [r.col for r in evaluate.degenerate_columns(cells, ["col"]).collect()] == ["c"]
    seen = spark.createDataFrame([("p", t, i) for i in (1, 2) for t in ("once", "twice", "twice")] + [("p", "one only", 1)], "page_type string, text string, patient int")
    assert [r.text for r in evaluate.anchor_labels(seen, 2).collect()] == ["once"]
    metrics = evaluate.quality_metrics(spark.createDataFrame([("a", "CONNU", True)], "g string, status string, ok boolean"), ["g"])
    lines = evaluate.report_lines(metrics)
    assert len(lines) == 4 and lines[1].startswith("|---")


def test_free_labels_and_cells(spark):
    pairs = spark.createDataFrame([("2ème trimestre visite 1",), ("poids kg",), ("zzzz",)], "label string")
    found = freeform.match_labels(pairs, {"t2_v1": "2e trimestre, visite 1", "poids_kg": "Poids (kg)"})
    assert [r.key for r in found.collect()] == ["t2_v1", "poids_kg", None]
    cells = spark.createDataFrame([("TA", "V1", "110/70"), ("X", "V1", "1")], "row_label string, col_label string, text string")
    keys = spark.createDataFrame([("TA", "V1", "ta__t1_v1")], "row_label string, col_label string, key string")
    assert {r.key for r in freeform.cells_to_keys(cells, keys).collect()} == {"ta__t1_v1", None}
    renamed = freeform.rename_keys(spark.createDataFrame([("p", "old__t1"), ("q", "old"), ("p", "older")], "page_type string, key string"), [("", "old", "new"), ("q", "new", "own")])
    assert [r.key for r in renamed.collect()] == ["new__t1", "own", "older"]
    boxes = spark.createDataFrame([("p", "k", 1, 10.0, 50.0), ("p", "k", 2, 11.0, 5.0)], "page_type string, key string, id int, y double, x double")
    assert {r.id: r.unique_key for r in freeform.dedupe_keys(boxes, lines=True).collect()} == {1: "k_2", 2: "k"}


def test_vocabulary_filter_never_loses_a_match(spark):
    words = ["Ferm", "neant", "Négatif", "negatlf", "ｆermé", "RAS", "R A S", "zzz", "", None, "Pos ++", "cesarienne", "Ouvertt", "normles", "cephalque", "Utérus"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select(text.vocabulary_match()(F.col("w")), text.near_vocabulary("w")).collect()
    assert all(near for entry, near in got if entry is not None) and not got[7][1] and sum(e is not None for e, _ in got) >= 8


def test_full_width_digits_are_read(spark):
    rows = spark.createDataFrame([("１２０／７０", "３，５ kg", "１２/０５/２０２２")], "bp string, q string, d string")
    r = rows.select(parse.parse_pressure(F.col("bp")), parse.parse_quantity(F.col("q")), parse.parse_date(text.tidy("d"))).first()
    assert (r[0].sys, r[0].dia, r[1].value, r[1].unit, r[2]) == (120, 70, 3.5, "kg", D(2022, 5, 12))


def test_manual_entry_takes_marks_and_names_itself(spark):
    shape = f"key string, type string, value {model.VALUE}, status string, confidence double, reasons array<string>, validated_by string, provenance struct<image_id:string,method:string>, entry string, entry_status string, entry_by string"
    r = manual.enter(spark.createDataFrame([("a", "int", None, "A_REVISER", 0.2, [], None, ("i", "vlm"), "?", None, "sf")], shape)).first()
    assert r.accepted and r.status == "CONNU" and r.value.n is None and r.provenance.method == "manuel" and r.provenance.image_id == "i"
    pairs = spark.createDataFrame([("ILLISIBLE", "x"), ("NON_FOURNI", "x"), ("INCONNU", "x"), ("CONNU", "x")], "s string, t string")
    assert [r[0] for r in pairs.select(manual.encoded_answer(F.col("s"), F.col("t"))).collect()] == ["<illisible>", "", "?", "x"]


def photo(spark, grey, quad=None):
    shape = "id long, pixels binary, photo_width int, quad array<array<double>>"
    metrics = imaging.measure_photos(spark.createDataFrame([(1, bytearray(grey.tobytes()), grey.shape[1], quad)], shape))
    return imaging.photo_verdicts(metrics).first()


def test_photo_quality(spark):
    r = np.random.default_rng(1)
    sharp = np.full((900, 900), 200, np.uint8)
    for y, x in [(y, x) for y in range(20, 860, 105) for x in range(20, 860, 105)]:
        sharp[y : y + 40, x : x + 40] = r.integers(20, 60)
    soft = imaging._smoothed(sharp.astype(float), 4.0).astype(np.uint8)
    assert imaging.blur_radius(sharp) < 1.2 < 3 < imaging.blur_radius(soft)
    good, bad = photo(spark, sharp), photo(spark, soft)
    assert good.accept and good.score > bad.score and bad.reasons == [imaging.REASONS["blur"]]
    assert imaging.REASONS["dark"] in photo(spark, np.full((900, 900), 20, np.uint8)).reasons
    part = sharp.copy()
    part[600:] = imaging._smoothed(sharp[600:].astype(float), 4.0).astype(np.uint8)
    assert photo(spark, part).reasons == [imaging.REASONS["tiles"]]
    flash = sharp.copy()
    flash[0:150, 60:210] = 255
    assert photo(spark, flash).reasons == [imaging.REASONS["glare"]]
    speckled = sharp.copy()
    speckled[::9, ::9] = 255
    assert imaging.REASONS["glare"] not in photo(spark, speckled).reasons
    near = photo(spark, sharp, [[2.0, 2.0], [880.0, 10.0], [880.0, 880.0], [10.0, 880.0]])
    assert near.reasons == [imaging.REASONS["border"]] and near.border
    small = photo(spark, sharp, [[100.0, 100.0], [500.0, 100.0], [500.0, 700.0], [100.0, 700.0]])
    assert imaging.REASONS["small"] in small.reasons and small.width == 400
    assert imaging.visible_share(np.array([[1, 0], [1, 1]])) == 0.75 and imaging.visible_share(np.zeros((0, 0))) == 0


@pytest.mark.parametrize("known", [1.0, 2.0, 3.0])
def test_blur_is_measured_in_pixels(known):
    edge = np.full((300, 300), 210.0)
    edge[:, 100:200] = 40
    edge[120:180] = 40
    assert imaging.blur_radius(imaging._smoothed(edge, known)) == pytest.approx(known, rel=0.15)


def test_ink_is_what_the_blank_form_lacks(spark):
    blank = np.full((60, 120), 225, np.uint8)
    blank[50:52, 8:112] = 60  # a printed line
    empty = np.roll(blank, 2, axis=0)  # off by two pixels
    written = empty.copy()
    written[25:28, 30:80] = 50
    shadow = (empty * np.linspace(0.5, 1, 120)[None, :]).astype(np.uint8)
    seen = np.ones_like(blank)
    seen[:, 60:] = 0
    cuts = [(1, written, None), (2, empty, None), (3, shadow, None), (4, written, seen), (5, None, None), (6, written[:20], None)]
    raw = lambda a: None if a is None else bytearray(np.ascontiguousarray(a).tobytes())
    rows = spark.createDataFrame([(k, 120, raw(a), raw(blank), raw(m)) for k, a, m in cuts], "id long, width int, pixels binary, blank binary, seen binary")
    out = {r.id: r for r in imaging.measure_zones(rows).collect()}
    assert out[1].ink == pytest.approx(3 * 50 / (42 * 102)) and out[2].ink == out[3].ink == 0
    assert out[4].ink == pytest.approx(3 * 30 / (42 * 102)) and out[4].visible == 0.5 and out[1].visible == 1
    assert out[5].ink == out[6].ink == 0 and out[6].contrast is None
    assert imaging.printed_contrast(blank, blank) == 165 and imaging.printed_contrast(np.full_like(blank, 225), blank) == 0


def test_sources(spark, tmp_path):
    for name in ("a.jpg", "a.png", "b.jpeg"):
        (tmp_path / name).write_bytes(name.encode())
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"patient": name}))
    photos, cards = records.images(spark, str(tmp_path)), records.sidecars(spark, str(tmp_path))
    assert {(r.stem, r.path.rpartition("/")[2]) for r in records.with_images(cards, photos).collect()} == {("a", "a.jpg"), ("b", "b.jpeg")}
    (tmp_path / "list.csv").write_text("image,patient,page_type\na.jpg,1,p\nz.jpg,2,p\n")
    there, missing = records.sidecar_csv(spark, str(tmp_path / "list.csv"), photos)
    assert [r.image for r in there.collect()] == ["a.jpg"] and [r.image for r in missing.collect()] == ["z.jpg"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "identification.json").write_text(json.dumps({"fields": [{"key": "age", "kind": "text", "type": "int", "bbox": [0, 0, 1, 1]}, {"key": "nom", "kind": "text", "sensitive": True}]}))
    template = records.templates(spark, str(tmp_path / "t"))
    assert {(r.page_type, r.key, r.sensitive) for r in template.collect()} == {("identification", "age", False), ("identification", "nom", True)}
    truth = spark.createDataFrame([("identification", "age")], "page_type string, key string")
    assert records.checked_truth(truth, template).count() == 1
    with pytest.raises(ValueError, match="identification.zzz"):
        records.checked_truth(truth.withColumn("key", F.lit("zzz")), template)
    assert [(r.key, r.checked) for r in records.truth_skeleton(template).collect()] == [("age", None)]
    got = spark.createDataFrame([("h1", "k", "12"), ("h2", "k", "13")], "sha256 string, key string, text string")
    path = str(tmp_path / "recorded")
    assert records.append_recordings(got.limit(1), path).schema == got.schema
    records.append_recordings(got, path)
    assert spark.read.json(path).count() == 2
    order = spark.createDataFrame([(2, 5), (1, 9), (3, 5)], "id int, received_at int")
    assert [r.id for r in records.received(order).collect()] == [2, 3, 1]
    assert [r.id for r in lifecycle.in_states(spark.createDataFrame([(1, "A", 2), (2, "B", 1), (3, "A", 1)], "id int, state string, created_at int"), ["A"]).collect()] == [3, 1]


def test_readers_and_sinks(spark, tmp_path):
    zones = spark.createDataFrame([("i", "k", "int"), ("i", "l", "text")], "image_id string, key string, type string")
    client = lambda: lambda rows: [(r["key"] * 2, "ecrit", 0.5) for r in rows]
    assert {(r.key, r.text) for r in records.read_zones(zones, client).collect()} == {("k", "kk"), ("l", "ll")}
    assert [r.key for r in records.second_readings(zones, client).collect()] == ["k"]
    truth = spark.createDataFrame([("i", str(n), "abc") for n in range(500)], "image_id string, key string, text string")
    noisy = records.noisy_reader(truth, 0.2)
    wrong = noisy.where("state = 'illisible' OR text <> 'abc'").count()
    assert 60 < wrong < 140 and noisy.exceptAll(records.noisy_reader(truth, 0.2)).count() == 0
    rows = spark.createDataFrame([("d", "p", "k", "1"), ("d", "q", "l", "2")], "dossier_id string, page_type string, key string, display string")
    records.write_records(rows, str(tmp_path / "out"))
    whole = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert whole["dossier_id"] == "d" and [p["page_type"] for p in whole["pages"]] == ["p", "q"]


def test_synthetic_pages(spark):
    shape = "page_type string, copy int, key string, type string, `table` string"
    keys = [("ta__t1_v1", "bp", "t"), ("poids_kg__t1_v1", "quantity", "t"), ("date_x", "date", None), ("sexe", "text", None)]
    rows = spark.createDataFrame([("p", i, *k) for i in range(300) for k in keys], shape)
    made = synthetic.synthetic_values(rows)
    assert made.exceptAll(synthetic.synthetic_values(rows.repartition(7))).count() == 0
    by = {(r.key, r.status): r.n for r in made.groupBy("key", "status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 120 < by["ta__t1_v1", "NON_FOURNI"] < 190 and 25 < by["sexe", "NON_FOURNI"] < 70
    known = made.where("status = 'CONNU'")
    assert known.where("key = 'ta__t1_v1'").where(~parse.parse_pressure(F.col("text"))["format_ok"]).count() == 0
    assert known.where("key = 'date_x'").where(parse.parse_date(F.col("text")).isNull()).count() == 0
    assert {r.text for r in known.where("key = 'sexe'").collect()} == {"F", "M"}
    photos = spark.createDataFrame([(i, s) for i in range(100) for s in synthetic.LEVELS], "id int, severity string")
    worst = {r.severity: (r.noise, r.jpeg) for r in synthetic.degradations(photos).groupBy("severity").agg(F.max("degradation.noise").alias("noise"), F.min("degradation.jpeg_quality").alias("jpeg")).collect()}
    assert worst["leger"][0] <= 3 < worst["fort"][0] <= 12 and worst["leger"][1] >= 85 > worst["fort"][1] >= 35
    parts = synthetic.split_chunks(spark.createDataFrame([(p, i) for p in (1, 8, 9) for i in range(10)], "patient int, i int"), F.col("patient"), "patient", "i")
    assert {(r.patient, r.part, r.chunk) for r in parts.select("patient", "part", "chunk").distinct().collect()} == {(p, s, c) for p, s in ((1, "train"), (8, "val"), (9, "test")) for c in (0, 1)}


def test_outages_and_the_sync_leg(spark, tmp_path):
    shape = "rec_id long, seq long, online boolean, ok boolean, outages int, saved boolean"
    rows = [(1, 0, True, True, 1, False), (2, 0, True, True, 0, False), (2, 1, True, True, 0, True), (2, 2, True, False, 0, False), (2, 3, True, True, 0, False), (3, 0, True, True, 0, True), (3, 1, False, True, 0, False)]
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    states = queue.work(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
    states.writeStream.outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.rec_id, r.state) for r in got} == {(1, "ECHEC_TRAITEMENT"), (2, "SYNCHRONISE"), (3, "ENREGISTRE")}
    now = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "rec_id int, state string")
    told = spark.createDataFrame([(1, "A"), (2, "A")], "rec_id int, state string")
    assert {r.rec_id for r in queue.notify(now, told).collect()} == {2, 3}
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    seen = []
    queue.run_once(queue.first_seen(stream, "rec_id"), lambda b, _: seen.extend(b.collect()), str(tmp_path / "ck2"))
    assert sorted(r.rec_id for r in seen) == [1, 2, 3]
