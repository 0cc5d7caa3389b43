"""States of a record, audit of its transitions, retries and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# States and the transitions that are allowed.
ALLOWED = {
    "CAPTURE": ["EN_ATTENTE_IA", "DOUBLON_SUSPECT", "REVISION_MANUELLE_REQUISE", "ANNULE"],
    "EN_ATTENTE_IA": ["TRAITE_IA", "ECHEC_TRAITEMENT", "DOUBLON_SUSPECT", "REVISION_MANUELLE_REQUISE"],
    "TRAITE_IA": ["A_REVISER", "VALIDE"],
    "A_REVISER": ["VALIDE", "EN_ATTENTE_IA"],
    "VALIDE": ["PATIENTE_LIEE"],
    "PATIENTE_LIEE": ["ENREGISTRE"],
    "ENREGISTRE": ["SYNCHRONISE", "ECHEC_SYNC"],
    "ECHEC_SYNC": ["ENREGISTRE"],
    "SYNCHRONISE": ["A_REVISER"],
    "ECHEC_TRAITEMENT": ["EN_ATTENTE_IA", "REVISION_MANUELLE_REQUISE"],
    "REVISION_MANUELLE_REQUISE": ["VALIDE", "EN_ATTENTE_IA"],
    "DOUBLON_SUSPECT": ["EN_ATTENTE_IA", "ANNULE"],
    "ANNULE": [],
}
MOST_TRIES = 3


class IllegalTransition(ValueError):
    """A record can't go from one state to the other."""


def check(old: str, new: str) -> str:
    if new not in ALLOWED.get(old, []):
        raise IllegalTransition(f"{old} -> {new}")
    return new


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in ALLOWED.items() for b in to], "`from` string, `to` string")


def allowed(old: Column, new: Column) -> Column:
    """Whether a transition is allowed, as one expression over the fixed table."""
    return F.concat_ws(">", old, new).isin([f"{a}>{b}" for a, to in ALLOWED.items() for b in to])


def transitions(states: DataFrame) -> DataFrame:
    """(rec_id, seq, from, to, ts) from the states (rec_id, seq, state, ts) of records."""
    by_time = Window.partitionBy("rec_id").orderBy("ts", "seq")
    return states.withColumn("from", F.lag("state").over(by_time)).where(F.col("from").isNotNull()).select("rec_id", "seq", "from", F.col("state").alias("to"), "ts")


def illegal(states: DataFrame) -> DataFrame:
    return transitions(states).where(~allowed(F.col("from"), F.col("to")))


def escalations(states: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """(rec_id, seq, tries): the failure with which a record has failed ``most`` times."""
    so_far = Window.partitionBy("rec_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.when(F.col("state") == "ECHEC_TRAITEMENT", 1).otherwise(0)
    counted = states.withColumn("tries", F.sum(failed).over(so_far))
    return counted.where((F.col("state") == "ECHEC_TRAITEMENT") & (F.col("tries") == most)).select("rec_id", "seq", "tries")


def in_states(records: DataFrame, states: list[str]) -> DataFrame:
    return records.where(F.col("state").isin(states)).orderBy("created_at")


def since(rows: DataFrame, last: int) -> DataFrame:
    """Rows after an id: the incremental read."""
    return rows.where(F.col("id") > last)


def last_entries(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).drop("_n")


def access(requests: DataFrame) -> DataFrame:
    """Every request (role, user, owner, ...) with ``granted`` and ``reason``: supervisors see all,
    midwives their own, analysts nothing. All attempts are kept, as the log."""
    own = F.col("user") == F.col("owner")
    granted = F.when(F.col("role") == "superviseur", True).when(F.col("role") == "sage_femme", F.coalesce(own, F.lit(False))).otherwise(False)
    reason = F.when(granted, "ok").when(F.col("role") == "sage_femme", "not_own").when(F.col("role") == "analyste", "no_images").otherwise("unknown_role")
    return requests.withColumn("granted", granted).withColumn("reason", reason)
