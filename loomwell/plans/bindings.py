"""The driver's tables read as record-model tables, so that each operator has whole data to run on.

These are analogies: the tables hold no register fields. ``events`` stand for field readings of a
dossier (the user), ``orders`` and ``lineitem`` for dates and quantities, ``customer`` for patients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.sources.tables import table


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("int")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of fields: dossier, page_type, key, seq, free, confidence, status, ok, value."""
    e = table(spark, sf_dir, "events")
    k = k_of(F.col("props"))
    status = F.when(k >= 60, "CONNU").when(k >= 20, "A_REVISER").when(k >= 10, "ILLISIBLE").otherwise("NON_FOURNI")
    return e.select(
        "event_id", F.col("user_id").alias("dossier"), F.col("event_type").alias("page_type"), (F.col("event_id") % 7).alias("key"),
        F.col("ts"), F.col("event_id").alias("seq"), (F.col("event_id") % 11 == 0).alias("free"), (k / 100).alias("confidence"),
        status.alias("status"), (F.col("value") < 250).alias("ok"), F.floor(F.col("value") / 100).cast("string").alias("value"), F.col("value").alias("raw_value"), k.alias("k"),
    )


#: The same binding for DuckDB.
READINGS_SQL = """
readings AS (
  SELECT event_id, user_id AS dossier, event_type AS page_type, event_id % 7 AS key, ts, event_id AS seq, event_id % 11 = 0 AS free,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 AS confidence,
         CASE WHEN k >= 60 THEN 'CONNU' WHEN k >= 20 THEN 'A_REVISER' WHEN k >= 10 THEN 'ILLISIBLE' ELSE 'NON_FOURNI' END AS status,
         value < 250 AS ok, CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS value, value AS raw_value, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle states of records: rec_id, seq, state, ts."""
    e = table(spark, sf_dir, "events")
    names = ["CAPTURE", "EN_ATTENTE_IA", "ECHEC_TRAITEMENT", "TRAITE_IA", "A_REVISER", "VALIDE"]
    at = F.pmod(k_of(F.col("props")), F.lit(len(names)))
    return e.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*[F.lit(n) for n in names]), at + 1).alias("state"), "ts")


STATES_SQL = """
states AS (
  SELECT user_id AS rec_id, event_id AS seq, ts,
         ['CAPTURE','EN_ATTENTE_IA','ECHEC_TRAITEMENT','TRAITE_IA','A_REVISER','VALIDE'][CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 + 1] AS state
  FROM events
)"""


# Fields of the register that events stand for, by event_id % 15: page, key, then what the value is made of.
SLOTS = [
    ("identification", "age"), ("identification", "gestation"), ("identification", "parite"),
    ("grossesse_actuelle", "ta__t1_v1"), ("grossesse_actuelle", "poids_kg__t1_v1"), ("grossesse_actuelle", "taille"),
    ("grossesse_actuelle", "serologie_vih__t1_v1"), ("grossesse_actuelle", "bilan_glycemique__t1_v1"),
    ("accouchement", "urgence"), ("accouchement", "voie_basse_non_instrumen"), ("accouchement", "age_gestationnel"),
    ("accouchement", "sexe"), ("accouchement", "perimetre_cranien_a_la_naissance"),
    ("pp_tardif_nne", "perimetre_cranien"), ("pp_precoce_nne", "mixte"),
]


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of dossiers (users): the last event of each slot gives value and status."""
    from loomwell.operators.model import VALUE

    r = readings(spark, sf_dir).withColumn("slot", (F.col("event_id") % 15).cast("int"))
    last = r.groupBy(F.col("dossier").alias("dossier_id"), "slot").agg(F.max_by("k", "seq").alias("k"), F.max_by("status", "seq").alias("status"))
    k, slot = F.col("k"), F.col("slot")
    number = (
        F.when(slot == 0, k % 50 + 10).when(slot == 1, k % 8).when(slot == 2, k % 6).when(slot == 4, 40 + k).when(slot == 5, 150 + k % 40)
        .when(slot == 7, F.when(k % 2 == 0, k / 50).otherwise(60 + k)).when(slot == 10, 30 + k % 12).when(slot == 12, 30 + k % 8).when(slot == 13, 40 + k % 8)
    )
    box = F.when(slot == 8, k % 4 == 0).when(slot == 9, k % 2 == 0).when(slot == 14, k % 3 == 0)
    text = F.when(slot == 6, F.element_at(F.array(F.lit("Positif"), F.lit("Négatif"), F.lit("Non fait")), k % 3 + 1)).when(slot == 11, F.when(k % 2 == 0, "F").otherwise("Masculin"))
    pressure = slot == 3
    value = F.struct(
        box.alias("b"), F.lit(None).cast("date").alias("d"), number.cast("double").alias("n"), F.lit(None).cast("string").alias("unit"),
        F.when(pressure, 100 + k).alias("sys"), F.when(pressure, 50 + k * 3 % 120).alias("dia"), text.alias("s"),
    ).cast(VALUE)
    place = F.element_at(F.array(*[F.struct(F.lit(page).alias("page_type"), F.lit(key).alias("key")) for page, key in SLOTS]), slot + 1)
    return last.select("dossier_id", place["page_type"].alias("page_type"), place["key"].alias("key"), value.alias("value"), "status", F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("string").alias("validated_by"))


#: The same for DuckDB: one row per dossier and slot.
FIELDS_SQL = f"""{READINGS_SQL},
cells0 AS (SELECT dossier AS dossier_id, event_id % 15 AS slot, arg_max(k, seq) AS k, arg_max(status, seq) AS status FROM readings GROUP BY ALL),
flds AS (SELECT *, CAST(CASE slot WHEN 0 THEN k % 50 + 10 WHEN 1 THEN k % 8 WHEN 2 THEN k % 6 WHEN 4 THEN 40 + k WHEN 5 THEN 150 + k % 40 WHEN 7 THEN CASE WHEN k % 2 = 0 THEN k / 50 ELSE 60 + k END
    WHEN 10 THEN 30 + k % 12 WHEN 12 THEN 30 + k % 8 WHEN 13 THEN 40 + k % 8 END AS DOUBLE) AS n,
  CASE slot WHEN 8 THEN k % 4 = 0 WHEN 9 THEN k % 2 = 0 WHEN 14 THEN k % 3 = 0 END AS b, 100 + k AS sys, 50 + k * 3 % 120 AS dia, status = 'CONNU' AS ok FROM cells0)"""
