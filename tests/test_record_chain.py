"""A record from its fields: rules of all kinds reach the fields, alerts and questions follow, and so does the state."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from loomwell.operators import assembly, model, questions

DAY = datetime.date(2025, 1, 10)
PREGNANCY, DELIVERY = "grossesse_actuelle", "accouchement"


def value(d=None, n=None, b=None):
    return (None, b, d, n, None, None, None, None, True)


def fields(spark, rows):
    names = [f.name for f in spark.createDataFrame([], f"value {model.VALUE}").schema["value"].dataType.fields]
    made = []
    for k, (dossier, page, key, what) in enumerate(rows):
        full = {"b": None, "d": None, "n": None, **what}
        made.append((dossier, page, key, "text", tuple(full.get(n) for n in names), "CONNU", 0.9, [], k))
    return spark.createDataFrame(made, f"dossier_id string, page_type string, key string, type string, value {model.VALUE}, status string, confidence double, reasons array<string>, seq long")


def after(days):
    return {"d": DAY + datetime.timedelta(days=days)}


def test_visit_dates_flag_fields(spark):
    rows = [
        ("a", PREGNANCY, "ddr", after(0)), ("a", PREGNANCY, "venue_le__t1_v1", after(70)), ("a", PREGNANCY, "rendez_vous__t1_v1", after(70 - 730)),
        ("b", PREGNANCY, "ddr", after(0)), ("b", PREGNANCY, "venue_le__t1_v1", after(70)), ("b", PREGNANCY, "venue_le__t1_v3", after(70)), ("b", PREGNANCY, "age_probable__t1_v1", {"n": 20.0}),
        ("c", PREGNANCY, "ddr", after(0)), ("c", PREGNANCY, "venue_le__t2_v1", after(140)), ("c", PREGNANCY, "rendez_vous__t2_v1", after(170)), ("c", PREGNANCY, "age_probable__t2_v1", {"n": 20.0}),
        ("d", DELIVERY, "date_de_l_accouchement", after(0)), ("d", DELIVERY, "voie_basse", {"b": True}), ("d", "pp_precoce_mere", "date_de_la_consultation", after(-3)),
        ("d", "pp_precoce_mere", "prochain_rendez_vous_le", after(300)), ("e", DELIVERY, "date_de_l_accouchement", after(0)), ("e", "pp_precoce_mere", "date_de_la_consultation", after(8)),
    ]
    done = assembly.checked_fields(fields(spark, rows))
    status = {(r.dossier_id, r.key): r.status for r in done.collect()}
    assert status[("a", "venue_le__t1_v1")] == status[("a", "rendez_vous__t1_v1")] == "A_REVISER" and status[("a", "ddr")] == "CONNU"
    assert status[("b", "venue_le__t1_v1")] == status[("b", "venue_le__t1_v3")] == status[("b", "age_probable__t1_v1")] == "A_REVISER"
    assert all(v == "CONNU" for (d, _), v in status.items() if d == "c")
    assert status[("d", "date_de_la_consultation")] == status[("d", "prochain_rendez_vous_le")] == "A_REVISER"
    assert status[("e", "date_de_la_consultation")] == "CONNU"
    found = {(r.dossier_id, r.rule) for r in assembly.record_alerts(fields(spark, rows)).collect()}
    assert {("b", "SA_VISITE"), ("d", "DELAI_PP"), ("d", "CHRONO")} <= found and not any(rule in ("DELAI_RDV", "ORDRE_VISITES") for _, rule in found)


def test_questions_and_state_follow(spark):
    rows = [("b", PREGNANCY, "ddr", after(0)), ("b", PREGNANCY, "venue_le__t1_v1", after(70)), ("b", PREGNANCY, "age_probable__t1_v1", {"n": 20.0}), ("c", PREGNANCY, "ddr", after(0))]
    raw = fields(spark, rows)
    done, alerts = assembly.checked_fields(raw), assembly.record_alerts(raw)
    images = spark.createDataFrame([("c", PREGNANCY, False, False, 0)], "dossier_id string, page_type string, accept boolean, unsure boolean, seq long")
    asked = assembly.open_questions(done, alerts, images)
    got = {(r.dossier_id, r.number): (r.priority, r.kind, r.key) for r in asked.collect()}
    assert got[("c", 1)][:2] == (1, "reprendre_photo")
    assert [got[("b", n)][1] for n in (1, 2, 3)] == ["coherence", "confirmer", "confirmer"]
    states = questions.record_state(done.select("dossier_id").distinct(), done, alerts, asked)
    assert {(r.dossier_id, r.state) for r in states.collect()} == {("b", "A_REVISER"), ("c", "A_REVISER")}
    free = done.withColumn("free", F.col("key") == "ddr").withColumn("has_value", F.lit(True)).withColumn("status", F.lit("A_REVISER"))
    assert {r.key for r in questions.field_questions(free).collect()} == {"venue_le__t1_v1", "age_probable__t1_v1"}
    lost = spark.createDataFrame([("b", "ECHEC_TRAITEMENT", "1.jpg : page non reconnue", None, None, 1), ("b", "ECHEC_TRAITEMENT", "2.jpg : erreur", None, None, 2)], "dossier_id string, rule string, message string, page_type string, key string, seq long")
    assert [r.seq for r in questions.alert_questions(lost).collect()] == [2]
