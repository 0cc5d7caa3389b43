"""The questions that a record leaves open, by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators.model import ILLEGIBLE, TO_REVIEW
from loomwell.operators.rules import essential

# Priorities of the kinds of question.
RETAKE, PAGE_TYPE, COHERENCE, CONFIRM_ESSENTIAL, MISSING_ESSENTIAL, OTHER, MISSING_PAGE = 1, 2, 3, 4, 5, 6, 9
SHAPE = ["dossier_id", "priority", "kind", "page_type", "key", "seq"]


def numbered(questions: DataFrame) -> DataFrame:
    """Number questions 1, 2, ... within each dossier, by priority, then in the order they came."""
    order = Window.partitionBy("dossier_id").orderBy("priority", "seq")
    return questions.withColumn("number", F.row_number().over(order).cast("long"))


def field_questions(fields: DataFrame) -> DataFrame:
    """confirm for a value in review, enter for a field without a usable one. ``fields``: + seq, has_value, maybe free.

    Fields that were read in free mode are confirmed as a page (:func:`page_questions`), not one by one.
    """
    if "free" in fields.columns:
        fields = fields.where(~F.coalesce("free", F.lit(False)))
    review = F.col("status") == TO_REVIEW
    kind = F.when(review & F.col("has_value"), "confirmer").otherwise("saisir")
    priority = F.when(essential(F.col("key")), CONFIRM_ESSENTIAL).otherwise(OTHER)
    asked = fields.where(review | (F.col("status") == ILLEGIBLE))
    return asked.select("dossier_id", priority.alias("priority"), kind.alias("kind"), "page_type", "key", "seq")


def image_questions(images: DataFrame) -> DataFrame:
    """Photos to take again and page types to confirm. ``images``: dossier_id, page_type, accept, unsure, seq."""
    bad = F.when(~F.col("accept") | F.col("page_type").isNull(), F.struct(F.lit(RETAKE).alias("priority"), F.lit("reprendre_photo").alias("kind")))
    unsure = F.when(F.col("page_type").isNotNull() & F.col("unsure"), F.struct(F.lit(PAGE_TYPE).alias("priority"), F.lit("type_page").alias("kind")))
    asked = images.withColumn("_q", F.explode(F.array_compact(F.array(bad, unsure))))
    return asked.select("dossier_id", "_q.priority", "_q.kind", "page_type", F.lit(None).cast("string").alias("key"), "seq")


def alert_questions(alerts: DataFrame) -> DataFrame:
    """What alerts ask. That a page wasn't recognised (``message``, if there is one, says so) is asked with its photo already."""
    if "message" in alerts.columns:
        alerts = alerts.where(~F.coalesce(F.col("message").contains("page non reconnue"), F.lit(False)))
    priority = F.when(F.col("rule") == "ECHEC_TRAITEMENT", RETAKE).otherwise(COHERENCE)
    kind = F.when(F.col("rule") == "ECHEC_TRAITEMENT", "saisir").otherwise("coherence")
    return alerts.select("dossier_id", priority.alias("priority"), kind.alias("kind"), "page_type", "key", "seq")


def page_questions(fields: DataFrame, template: DataFrame) -> DataFrame:
    """What a page that was read in free mode asks: one confirmation of all that was read, important fields
    that weren't found (not those of tables), and a new photo where no row of its table was recognised.

    ``fields``: dossier_id, page_type, key, free, display, seq. ``template`` (page_type, key) has some hundred rows.
    """
    table = F.col("key").contains("__")
    named = F.broadcast(template.groupBy("page_type").agg(F.bool_or(table).alias("_table"), F.collect_set(F.when(essential(F.col("key")) & ~table, F.col("key"))).alias("_wanted")))
    free = F.col("free")
    pages = fields.groupBy("dossier_id", "page_type").agg(
        F.bool_or(free).alias("_free"), F.bool_or(free & table).alias("_rows"), F.collect_set("key").alias("_found"), F.min("seq").alias("seq")
    )
    pages = pages.where("_free").join(named, "page_type", "left").withColumn("_table", F.coalesce("_table", F.lit(False)))
    none = F.lit(None).cast("string")
    retake = F.when(F.col("_table") & ~F.col("_rows"), F.struct(F.lit(PAGE_TYPE).alias("priority"), F.lit("reprendre_photo").alias("kind"), none.alias("key")))
    confirm = F.struct(F.lit(CONFIRM_ESSENTIAL).alias("priority"), F.lit("confirmer_page").alias("kind"), none.alias("key"))
    wanted = F.array_sort(F.array_except(F.coalesce("_wanted", F.array().cast("array<string>")), "_found"))
    gone = F.transform(wanted, lambda k: F.struct(F.lit(MISSING_ESSENTIAL).alias("priority"), F.lit("manquant").alias("kind"), k.alias("key")))
    asked = pages.withColumn("_q", F.explode(F.concat(F.array_compact(F.array(retake, confirm)), gone)))
    return asked.select("dossier_id", "_q.priority", "_q.kind", "page_type", "_q.key", "seq")


def missing_pages(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected pages (dossier_id, page_type, seq) that a dossier doesn't have yet."""
    gone = expected.join(present.select("dossier_id", "page_type"), ["dossier_id", "page_type"], "left_anti")
    return gone.select("dossier_id", F.lit(MISSING_PAGE).alias("priority"), F.lit("page_manquante").alias("kind"), "page_type", F.lit(None).cast("string").alias("key"), "seq")


def all_questions(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*SHAPE)
    for part in parts[1:]:
        out = out.unionByName(part.select(*SHAPE))
    return numbered(out)


def without_settled(questions: DataFrame, validated: DataFrame, kept_pages: DataFrame) -> DataFrame:
    """Drop questions about validated fields, and retakes of pages that a person has kept."""
    left = questions.join(validated.select("dossier_id", "key"), ["dossier_id", "key"], "left_anti")
    kept = kept_pages.select("dossier_id", "page_type", F.lit("reprendre_photo").alias("kind"))
    return left.join(kept, ["dossier_id", "page_type", "kind"], "left_anti")


def record_state(dossiers: DataFrame, fields: DataFrame, alerts: DataFrame, questions: DataFrame) -> DataFrame:
    """A_REVISER if any field is in review, or any alert or question is open; else TRAITE_IA: only the worker validates."""
    open_ids = (
        fields.where(F.col("status").isin(TO_REVIEW, ILLEGIBLE)).select("dossier_id").unionByName(alerts.select("dossier_id")).unionByName(questions.select("dossier_id"))
    ).distinct()
    return dossiers.join(open_ids.withColumn("_open", F.lit(True)), "dossier_id", "left").select(
        "dossier_id", F.when(F.col("_open"), TO_REVIEW).otherwise("TRAITE_IA").alias("state")
    )
