"""A record from its parts: template, zones, readers, decisions, rules, questions, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions.parse import normalised
from loomwell.functions.text import tidy
from loomwell.operators import fusion, questions, rules

#: Rows of a template that are broadcast at most; a larger one is joined by a shuffle.
TEMPLATE_ROWS = 10_000


def zones_to_read(template: DataFrame, zones: DataFrame) -> DataFrame:
    """The zones of each photo with their template fields; sensitive fields never leave.

    ``template``: page_type, key, kind, type, sensitive. ``zones``: image_id, dossier_id, page_type, key and the signals.
    """
    fields = template.where(~F.coalesce("sensitive", F.lit(False))).select("page_type", "key", "kind", "type")
    return zones.join(F.broadcast(fields) if fields.count() <= TEMPLATE_ROWS else fields, ["page_type", "key"])


def assemble(template: DataFrame, zones: DataFrame, readings: DataFrame, second: DataFrame) -> DataFrame:
    """One row per zone that isn't sensitive: its reading, the second reader's, and the decision.

    ``zones``: image_id, dossier_id, page_type, key, visible, ink, contrast, align, quality, glare, box_ink. ``readings``:
    image_id, key, state, text, conf, maybe contradictory (the reader's answers to one zone differ). ``second``: image_id, key, text. A zone that was to be read and has no
    reading lacked its reader. Readings are joined on (image_id, key), which a photo has once.
    """
    signals = zones_to_read(template, zones)
    signals = signals.withColumn("route", fusion.route(F.col("ink"), F.col("contrast") < fusion.Limits().contrast, F.col("glare"), F.col("visible")))
    contradictory = F.col("contradictory") if "contradictory" in readings.columns else F.lit(False)
    first = readings.select("image_id", "key", "state", "text", "conf", F.lit(True).alias("_got"), contradictory.alias("_contradictory"))
    other = second.select("image_id", "key", F.col("text").alias("text2"))
    text_zones = signals.where("kind <> 'checkbox'").join(first, ["image_id", "key"], "left").join(other, ["image_id", "key"], "left")
    wanted = F.col("route") == "read"
    text_zones = (
        text_zones.withColumn("read", wanted & F.coalesce("_got", F.lit(False)))
        .withColumn("ai_down", wanted & F.col("_got").isNull())
        .withColumn("contradictory", F.coalesce("_contradictory", F.lit(False)))
    )
    # generators keep tidy texts and normal forms whole: the optimiser would repeat their parsers for every use of every field
    said = F.struct(tidy(F.when(F.col("state") != "vide", F.col("text")).when(F.col("state").isNull(), F.col("text"))).alias("one"), tidy(F.col("text2")).alias("two"))
    text_zones = text_zones.select("*", F.explode(F.array(said)).alias("_said"))
    forms = F.struct(*[normalised(F.col(f"_said.{c}"), F.col("type"), tidied=True).alias(n) for c, n in (("one", "norm"), ("two", "norm2"))])
    text_zones = text_zones.select("*", F.explode(F.array(forms)).alias("_forms")).select("*", "_forms.norm", "_forms.norm2").drop("_said", "_forms")
    odd = rules.plausibility(F.col("page_type"), F.col("key"), F.col("norm2.n"), F.col("norm2.unit"))
    text_zones = fusion.decide_text(text_zones.withColumn("odd2", odd.isNotNull()))
    box = fusion.checkbox_confidence(F.col("box_ink"))
    boxes = signals.where("kind = 'checkbox'").withColumn("_box", box).withColumn("_d", fusion.decide_checkbox(F.col("_box.confidence"), F.col("align"), F.col("visible")))
    off = F.coalesce(F.col("visible") < fusion.Limits().visible, F.lit(False))
    unsure = F.array(F.format_string(fusion.REASONS["box_unsure"], F.col("box_ink")))
    nothing = F.array().cast("array<string>")
    reasons = F.when(off, F.array(F.lit(fusion.REASONS["box_off_frame"]))).when(F.col("_d.status") == "CONNU", nothing).otherwise(unsure)
    value = F.struct(
        F.lit(None).cast("string").alias("marker"), F.when(~off, F.col("_box.checked")).alias("b"), F.lit(None).cast("date").alias("d"), F.lit(None).cast("double").alias("n"),
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("sys"), F.lit(None).cast("int").alias("dia"), F.lit(None).cast("string").alias("s"), F.lit(True).alias("format_ok"),
    )
    ids = ["image_id", "dossier_id", "page_type", "key", "type", "route"]
    shown = F.when(off, None).when(F.col("_box.checked"), "☒").otherwise("☐")
    decided = [F.col("_d.status").alias("status"), F.col("_d.confidence").alias("confidence"), F.lit("box").alias("rule"), reasons.alias("reasons"), value.alias("value"), shown.alias("display"), F.lit("box").alias("method")]
    return text_zones.select(*ids, "status", "confidence", "rule", "reasons", "value", "display", "method").unionByName(boxes.select(*ids, *decided))


def checked_fields(fields: DataFrame) -> DataFrame:
    """Fields after all rules (ranges, the dossier, visits, weeks, pages after birth): known values that a rule names go to
    review, with the reasons; what can't apply is marked so. Rules flag and never correct, so their order doesn't matter."""
    facts = rules.dossier_facts(fields)
    found = rules.field_flags(fields).unionByName(rules.flagged_fields(rules.all_flags(fields, facts)))
    return rules.deductions(rules.apply_flags(fields, found), facts)


def record_alerts(fields: DataFrame) -> DataFrame:
    """The alerts of the records that fields make: dossier_id, rule, message, page_type, key, seq."""
    return rules.alerts(rules.all_flags(fields, rules.dossier_facts(fields)))


def open_questions(fields: DataFrame, alerts: DataFrame, images: DataFrame) -> DataFrame:
    """All numbered questions of the records: photos, alerts, fields."""
    asked = fields.withColumn("has_value", F.col("value").isNotNull())
    return questions.all_questions(questions.image_questions(images), questions.alert_questions(alerts), questions.field_questions(asked))
