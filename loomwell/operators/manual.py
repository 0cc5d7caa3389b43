"""Entries by hand, and the model's answers as typed slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions.parse import normalised
from loomwell.functions.text import json_answer
from loomwell.operators.model import KNOWN, add_reason

# Words that tick a box.
YES_WORDS = ["oui", "x", "coché", "coche", "1", "vrai"]


def enter(fields: DataFrame) -> DataFrame:
    """Apply manual entries: columns ``entry``, ``entry_status`` and ``entry_by`` beside a field.

    An explicit status empties the value; a box takes its words; other texts must have the format
    of their type or be a mark for empty or unknown (known, without a value), or the entry is rejected (``accepted``
    false) and the field stays as it is. Where a field has ``provenance`` (a struct with ``method``), it names the entry.
    """
    n = normalised(F.col("entry"), F.col("type"))
    box = F.col("type") == "bool"
    accepted = F.col("entry_status").isNotNull() | box | n["format_ok"]
    ticked = F.struct(
        F.lower(F.trim("entry")).isin(YES_WORDS).alias("b"), *[F.lit(None).cast(t).alias(c) for c, t in (("d", "date"), ("n", "double"), ("unit", "string"), ("sys", "int"), ("dia", "int"), ("s", "string"))]
    )
    typed = F.struct(*[n[c].alias(c) for c in ("b", "d", "n", "unit", "sys", "dia", "s")])
    value = F.when(F.col("entry_status").isNotNull(), None).when(box, ticked).otherwise(typed)
    asked = F.col("entry_by").isNotNull()
    hit = asked & accepted

    def new(column: str, to: Column) -> Column:
        return F.when(hit, to).otherwise(F.col(column))

    if "provenance" in fields.columns:
        fields = fields.withColumn("provenance", new("provenance", F.col("provenance").withField("method", F.lit("manuel"))))
    return (
        fields.withColumn("value", new("value", value))
        .withColumn("status", new("status", F.coalesce("entry_status", F.lit(KNOWN))))
        .withColumn("confidence", new("confidence", F.lit(1.0)))
        .withColumn("validated_by", new("validated_by", F.col("entry_by")))
        .withColumn("reasons", add_reason(F.col("reasons"), F.when(hit, F.lit("Saisi à la main."))))
        .withColumn("accepted", F.when(asked, accepted))
    )


def answer_slots(answers: DataFrame) -> DataFrame:
    """(call_id, slot, text): exactly ``n`` slots from each answer (call_id, n, raw).

    The answer is an object of a ``values`` array or of numbered members; what is missing is null.
    """
    parsed = answers.withColumn("_json", json_answer("raw"))
    listed = F.from_json(F.get_json_object("_json", "$.values"), "array<string>")
    numbered = F.from_json("_json", "map<string,string>")
    slots = parsed.select("call_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"), listed.alias("_list"), numbered.alias("_map"))
    text = F.coalesce(F.get("_list", F.col("slot") - 1), F.try_element_at("_map", F.col("slot").cast("string")))
    return slots.select("call_id", "slot", text.alias("text"))


def encoded_answer(status: Column, text: Column) -> Column:
    """The answer that a reader should have given, by the truth's status."""
    return F.when(status == "ILLISIBLE", "<illisible>").when(status == "NON_FOURNI", "").when(status == "INCONNU", "?").otherwise(text)
