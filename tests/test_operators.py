"""Record operators on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.functions import parse
from loomwell.operators import evaluate, export, freeform, fusion, imaging, lifecycle, linkage, merge, model, questions, rules

D = dt.date


def zones(spark, rows):
    shape = "i int, visible double, ink double, contrast double, ai_down boolean, align double, quality double, glare double, read boolean, state string, text string, conf double, contradictory boolean, kind string, text2 string, odd2 boolean"
    base = dict(visible=1.0, ink=0.02, contrast=60.0, ai_down=False, align=1.0, quality=1.0, glare=0.0, read=True, state="ecrit", text="110/71", conf=0.98, contradictory=False, kind="bp", text2=None, odd2=False)
    df = spark.createDataFrame([tuple([i, *({**base, **r}).values()]) for i, r in enumerate(rows)], shape)
    df = df.withColumn("norm", parse.normalised(F.col("text"), F.col("kind"))).withColumn("norm2", parse.normalised(F.col("text2"), F.col("kind")))
    return [(r.status, round(r.confidence, 4), r.rule) for r in fusion.decide_text(df).orderBy("i").collect()]


def test_fusion_steps(spark):
    got = zones(spark, [
        {}, {"visible": 0.5}, {"read": False, "ink": 0.0}, {"read": False, "ink": 0.0, "contrast": 16.0}, {"read": False, "ai_down": True}, {"read": False},
        {"state": "erreur"}, {"state": "illisible"}, {"text": "?"}, {"state": "vide", "text": "", "ink": 0.02}, {"state": "vide", "text": "", "ink": 0.001},
        {"text": "٩٩٠/٧١"}, {"text": "70/110"}, {"conf": 0.5, "text2": "110/71"}, {"conf": 0.9, "text2": "120/71"}, {"glare": 0.5}, {"ink": 0.0},
    ])
    assert [g[0] for g in got] == [
        "CONNU", "A_REVISER", "NON_FOURNI", "A_REVISER", "A_REVISER", "A_REVISER", "A_REVISER", "ILLISIBLE", "INCONNU", "A_REVISER", "NON_FOURNI",
        "A_REVISER", "A_REVISER", "CONNU", "CONNU", "A_REVISER", "A_REVISER",
    ]
    assert got[13][1] == 0.97 and got[14][1] == 0.855 and got[2][2] == "blank" and got[9][2] == "empty_but_ink"


def test_fold_depends_on_order_and_demotes(spark):
    rows = [("a", 1, False, "CONNU", 0.9, "x"), ("a", 2, False, "CONNU", 0.9, "y"), ("a", 3, False, "CONNU", 0.95, "x"), ("b", 1, True, "CONNU", 0.99, "x"), ("b", 2, False, "A_REVISER", 0.2, "y")]
    df = spark.createDataFrame(rows, "k string, seq int, free boolean, status string, confidence double, value string")
    got = {r.k: (r.seq, r.status, r.value, r.conflict) for r in merge.fold_readings(df, ["k"]).collect()}
    assert got == {"a": (3, "CONNU", "x", True), "b": (2, "A_REVISER", "y", False)}


def test_rescan(spark):
    shape = "k string, value string, safe boolean"
    old = spark.createDataFrame([("weight", "55", True), ("gone", "1", True)], shape)
    new = spark.createDataFrame([("weight", "56", True), ("new", "7", True), ("zero", "0", True), ("unsafe", "3", False)], shape)
    changes = merge.rescan_changes(old, new, ["k"])
    assert {(r.k, r.kind) for r in changes.collect()} == {("weight", "change"), ("new", "addition")}
    none = {(r.k, r.value) for r in merge.rescan_merge(old, changes, F.lit(False), ["k"]).collect()}
    assert none == {("weight", "55"), ("gone", "1"), ("new", "7")}
    assert merge.rescan_changes(old, old, ["k"]).count() == 0


def test_rules(spark):
    rows = spark.createDataFrame([("identification", "age", 60.0, ""), ("accouchement", "poids_a_la_naissance", 3.2, "kg"), ("grossesse_actuelle", "hu_cm__t1_v1", 340.0, "cm"), ("grossesse_actuelle", "hu_cm__t1_v1", 30.0, "m"), ("x", "y", 1.0, "")], "p string, k string, n double, u string")
    assert [r[0] for r in rows.select(rules.plausibility(F.col("p"), F.col("k"), F.col("n"), F.col("u"))).collect()] == ["range", None, "range", "unit", None]
    visits = spark.createDataFrame([("d", 1, D(2025, 5, 1), D(2025, 6, 1), D(2025, 1, 1)), ("d", 2, D(2023, 5, 1), D(2023, 4, 1), D(2025, 1, 1)), ("d", 3, None, None, D(2025, 1, 1))], "dossier_id string, ord int, visit date, rdv date, lmp date")
    assert {(r.ord, r.rule) for r in rules.visit_flags(visits).collect()} == {(2, "ORDRE_VISITES"), (2, "DELAI_RDV"), (2, "VISITE_HORS_GROSSESSE")}
    fields = spark.createDataFrame([("d", "p", "k", "CONNU", ["a"]), ("d", "p", "l", "INCONNU", [])], "dossier_id string, page_type string, key string, status string, reasons array<string>")
    flags = spark.createDataFrame([("d", "p", "k", "b"), ("d", "p", "k", "b"), ("d", "p", "l", "c")], "dossier_id string, page_type string, key string, reason string")
    assert {(r.key, r.status, tuple(r.reasons)) for r in rules.apply_flags(fields, flags).collect()} == {("k", "A_REVISER", ("a", "b")), ("l", "INCONNU", ("c",))}


def test_linkage_equals_comparison_of_all(spark):
    codes = ["K7Q2", "K7O2", "K7Q3", "ZZZZ", "K7Q", "7KQ2", "", "AB", "AC"]
    people = spark.createDataFrame([(i, c, None, 30) for i, c in enumerate(codes)], "id int, code string, lmp date, age int")
    got = {(r.rec_id, r.patient_id) for r in linkage.candidates(people, people.withColumn("created_at", F.col("id")), 99).collect()}
    fold = str.maketrans("OQDILSZB", "00011528")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(i, j) for i, a in enumerate(codes) for j, b in enumerate(codes) if a and (a == b or a.translate(fold) == b.translate(fold) or len(a) >= 3 and edits(a, b) == 1)}
    assert got == want


def test_lifecycle(spark):
    with pytest.raises(lifecycle.IllegalTransition):
        lifecycle.check("CAPTURE", "SYNCHRONISE")
    with pytest.raises(lifecycle.IllegalTransition):
        lifecycle.check("EN_ATTENTE_IA", "VALIDE")
    assert lifecycle.check("TRAITE_IA", "VALIDE") == "VALIDE" and lifecycle.pairs(spark).count() == 24


def test_metrics_agree_with_recomputation(spark):
    rows = [("a", "x", "CONNU", True), ("a", "y", "CONNU", False), ("b", "x", "A_REVISER", False), ("b", "y", "NON_LU_MODE_LIBRE", False)]
    df = spark.createDataFrame(rows, "g string, h string, status string, ok boolean")
    got = {(r.g, r.h): r for r in evaluate.quality_metrics(df, ["g", "h"]).collect()}
    assert len(got) == 5 and got[None, None].n == 4 and got[None, None].silent_error == 0.6667
    assert got["a", None].review_rate == 0 and got["a", None].useful_review is None and got["b", None].useful_review == 1.0
    curve = evaluate.threshold_curve(spark.createDataFrame([(0.4, True, True), (0.6, True, False), (0.99, True, True), (0.9, False, True)], "conf double, filled boolean, ok boolean")).orderBy("point").collect()
    assert len(curve) == 11 and all(a.coverage >= b.coverage for a, b in zip(curve, curve[1:], strict=False)) and curve[0].coverage == 0.5
    empty = spark.createDataFrame([], "g string, h string, status string, ok boolean")
    empty = spark.createDataFrame([], "g string, h string, status string, ok boolean")
    assert evaluate.quality_metrics(empty, ["g", "h"]).count() == 0


def test_export_never_takes_a_doubtful_value(spark):
    def v(**k):
        return {**dict.fromkeys("b d n unit sys dia s".split()), **k}

    rows = [
        ("d", "age", v(n=30.0), "CONNU", None), ("d", "parite", v(n=9.0), "A_REVISER", None), ("d", "poids_a_la_naissance", v(n=3.2, unit="kg"), "CONNU", None),
        ("d", "ta__t1_v1", v(sys=150, dia=95), "A_REVISER", "sf1"), ("d", "serologie_vih__1", v(s="Négatif"), "CONNU", None), ("d", "hemoglobine__t1_v1", v(n=11.8), "CONNU", None),
    ]
    df = spark.createDataFrame(rows, f"dossier_id string, key string, value {model.VALUE}, status string, validated_by string")
    r = export.record_rows(df).first()
    assert (r.age, r.parity, r.birth_weight, r.mean_systolic, r.hiv, r.hemoglobin, r.hepatitis_c) == (30.0, None, 3200.0, 150.0, 0, 11.8, None)
    board = export.dashboard(export.record_rows(df)).first()
    assert board.records == 1 and board.hypertensive == 1 and board.hiv_tested == 1 and board.hiv_positive == 0


def test_questions_are_numbered_without_gaps(spark):
    fields = spark.createDataFrame([("d", "p", "age", "A_REVISER", True, 1), ("d", "p", "z", "ILLISIBLE", False, 2), ("d", "p", "w", "CONNU", True, 3)], "dossier_id string, page_type string, key string, status string, has_value boolean, seq int")
    images = spark.createDataFrame([("d", None, True, False, 1), ("d", "p", True, True, 2)], "dossier_id string, page_type string, accept boolean, unsure boolean, seq int")
    got = questions.all_questions(questions.field_questions(fields), questions.image_questions(images)).orderBy("number").collect()
    assert [(q.number, q.priority, q.kind) for q in got] == [(1, 1, "reprendre_photo"), (2, 2, "type_page"), (3, 4, "confirmer"), (4, 6, "saisir")]


def test_freeform(spark):
    values = spark.createDataFrame([("?", True), ("06 12 34 56 78", True), ("12", False)], "text string, sure boolean")
    assert {(r.text, r.status, r.confidence) for r in freeform.to_fields(values).collect()} == {("?", "INCONNU", 0.6), ("12", "A_REVISER", 0.4)}
    broken = spark.createDataFrame([("Ferm�",), ("c�t�",), ("ok",)], "text string")
    vocabulary = spark.createDataFrame([("Fermé",), ("Ouvert",)], "entry string")
    assert {r.text: r.repaired for r in freeform.repair_glyphs(broken, vocabulary).collect()} == {"Ferm�": "Fermé", "c�t�": "cété", "ok": "ok"}


def test_imaging(spark):
    grey = np.full((40, 40), 220, np.uint8)
    grey[10:14, 10:30] = 20
    assert imaging.ink_share(grey) == pytest.approx(80 / 1600) and imaging.glare_share(grey) == 0
    assert (imaging.masked(grey, [(10, 10, 30, 14)])[4:20, 4:36] == 0).all()
    rows = spark.createDataFrame([(1, 40, 40, bytearray(grey.tobytes()))], "id long, width int, height int, pixels binary")
    assert imaging.measure(rows).first().ink == pytest.approx(0.05)


def test_layout(spark):
    from loomwell.operators import layout

    levels = spark.createDataFrame([([10.0, 1.0, 3.0, 4.5, 14.0],)], "v array<double>").select(layout.distinct_levels(F.col("v"))).first()[0]
    assert levels == [1.0, 4.5, 10.0, 14.0]
    lines = spark.createDataFrame([("p", 1, 0.0, 0.0, 9.0, 0.0), ("p", 2, 9.0, 0.0, 9.0, 5.0), ("p", 3, 50.0, 0.0, 60.0, 0.0), ("p", 4, 9.0, 5.0, 20.0, 5.0)], "page string, line int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.line, r.component) for r in layout.touching_lines(lines, "page").collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [5.0, 5.0]), (4, [5.0, 6.0]), (5, [6.0, 5.0])], "id long, v array<double>")
    got = {(r.query, r.match) for r in layout.ratio_matches(vectors, vectors).collect()}
    assert got == {(1, 2), (2, 1), (4, 3), (5, 3)}
    anchors = spark.createDataFrame([("a", t) for t in "wxyz"] + [("b", t) for t in "wxyq"] + [("c", "w")], "page_type string, text string")
    twins = freeform.twin_pages(anchors, 0.5).collect()
    assert [(t.one, t.two, t.only_one, t.only_two) for t in twins] == [("a", "b", ["z"], ["q"])]


def test_manual_entries_and_answers(spark):
    from loomwell.operators import manual

    shape = f"key string, type string, value {model.VALUE}, status string, confidence double, reasons array<string>, validated_by string, entry string, entry_status string, entry_by string"
    rows = [("a", "date", None, "A_REVISER", 0.2, [], None, "12/05/2022", None, "sf"), ("b", "date", None, "A_REVISER", 0.2, [], None, "32/05/2022", None, "sf"), ("c", "bool", None, "A_REVISER", 0.2, [], None, "Oui", None, "sf"), ("d", "int", None, "CONNU", 0.9, [], None, None, "ILLISIBLE", "sf"), ("e", "int", None, "CONNU", 0.9, [], None, None, None, None)]
    got = {r.key: r for r in manual.enter(spark.createDataFrame(rows, shape)).collect()}
    assert got["a"].value.d == D(2022, 5, 12) and got["a"].status == "CONNU" and got["a"].confidence == 1.0
    assert not got["b"].accepted and got["b"].status == "A_REVISER" and got["c"].value.b is True
    assert got["d"].status == "ILLISIBLE" and got["d"].value is None and got["e"].confidence == 0.9
    answers = spark.createDataFrame([("x", 3, '{"values": ["1", null]}'), ("y", 2, '```json\n{"1": "a", "2": "b", "3": "c"}```'), ("z", 1, "sorry")], "call_id string, n int, raw string")
    slots = {(r.call_id, r.slot): r.text for r in manual.answer_slots(answers).collect()}
    assert slots == {("x", 1): "1", ("x", 2): None, ("x", 3): None, ("y", 1): "a", ("y", 2): "b", ("z", 1): None}


def test_best_reading_over_any_number_of_photos(spark):
    import random

    from loomwell.operators import merge

    r = random.Random(9)
    rows = [(i % 5, i, r.random() < 0.3, r.choice(["CONNU", "ILLISIBLE"]), r.randrange(9) / 10, r.choice("ab")) for i in range(60)]
    got = {x.k: (x.seq, x.status, x.confidence, x.value, x.conflict) for x in merge.fold_readings(spark.createDataFrame(rows, "k int, seq int, free boolean, status string, confidence double, value string"), ["k"]).collect()}
    for k in range(5):
        seq, free, status, confidence, value = next(x[1:] for x in rows if x[0] == k)
        conflict = False
        for new in [x[1:] for x in rows if x[0] == k][1:]:
            clash = status == new[2] == "CONNU" and value != new[4]
            if free if free != new[1] else new[3] > confidence:
                seq, free, status, confidence, value = new
            status, conflict = ("A_REVISER" if clash else status), conflict or clash
        assert got[k] == (seq, status, confidence, value, conflict)


def test_question_list_asks_about_fields_read_in_free_mode_too(spark, tmp_path):
    from loomwell.plans import registry

    rows = [(event, 1, "view", float(value), '{"k": %d}' % k) for event, value, k in ((11, 10, 30), (12, 10, 30), (22, 10, 15), (33, 200, 90))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["question_list"](spark, str(tmp_path)).orderBy("number").collect()
    assert [(r.seq, r.kind) for r in got] == [(33, "coherence"), (11, "confirmer"), (12, "confirmer"), (22, "saisir")]


def test_linkage_broadcasts_no_deletions_and_ranks_copies(spark):
    people = spark.range(600).selectExpr("id", "concat('P', id % 200) AS code", "CAST(NULL AS date) AS lmp", "CAST(id % 7 AS int) AS age", "id AS created_at")
    got = linkage.candidates(people.where("id % 50 = 0"), people)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    # 57 has copies 257 and 457; ages 1, 5, 2: the own age, then the age next to it, then the first of the rest
    of = linkage.candidates(people.where("id = 57"), people).orderBy("rank").collect()
    assert [(r.patient_id, r.score, r.how) for r in of] == [(57, 1.05, "same"), (457, 1.05, "same"), (257, 0.8, "same")]
