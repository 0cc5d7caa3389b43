"""Schemas of the record model, statuses, and typed access to field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses of a field.
KNOWN, UNKNOWN, NOT_GIVEN, ILLEGIBLE, NOT_APPLICABLE, TO_REVIEW = "CONNU", "INCONNU", "NON_FOURNI", "ILLISIBLE", "NON_APPLICABLE", "A_REVISER"
STATUSES = [KNOWN, UNKNOWN, NOT_GIVEN, ILLEGIBLE, NOT_APPLICABLE, TO_REVIEW]

VALUE = "struct<b:boolean,d:date,n:double,unit:string,sys:int,dia:int,s:string>"
PROVENANCE = "struct<image_id:string,page_type:string,bbox:array<double>,method:string>"
FIELD = (
    f"dossier_id string, page_type string, key string, type string, value {VALUE}, display string, raw_text string, status string, "
    f"confidence double, reasons array<string>, signals map<string,string>, provenance {PROVENANCE}, validated_by string"
)
READING = "image_id string, key string, reader string, text string, state string, confidence double, extra map<string,string>"
IMAGE = (
    "image_id string, sha256 string, captured_at timestamp, midwife_id string, page_type string, "
    "quality struct<accept:boolean,reasons:array<string>,score:double>, alignment struct<ok:boolean,confidence:double,residual:double>, "
    "original_path string, masked_path string"
)
TEMPLATE_FIELD = (
    "page_type string, key string, kind string, type string, label string, `row` string, col string, `table` string, context string, "
    "origin string, sensitive boolean, bbox array<double>"
)
RECORD = "id string, state string, midwife_id string, patient_code string, tries int, created_at timestamp, changed_at timestamp"
TRANSITION = "rec_id string, seq long, `from` string, `to` string, ts timestamp, reason string"


def safe(status: Column, validated_by: Column) -> Column:
    """A value may be exported if its status is known or a person has validated it."""
    return F.coalesce(status == KNOWN, F.lit(False)) | (F.coalesce(validated_by, F.lit("")) != "")


def number_of(value: Column, status: Column) -> Column:
    """The number of a field in use: its own, or the first one in its text (a date gives its year)."""
    text = F.coalesce(value["s"], value["d"].cast("string"), F.concat_ws("/", value["sys"], value["dia"]))
    first = F.translate(F.regexp_extract(text, r"[0-9]+(?:[.,][0-9]+)?", 0), ",", ".").try_cast("double")
    return F.when(status.isin(KNOWN, TO_REVIEW), F.coalesce(value["n"], first))


def date_of(value: Column) -> Column:
    return F.coalesce(value["d"], F.try_to_date(value["s"], "yyyy-MM-dd"))


def checked(value: Column) -> Column:
    return F.coalesce(value["b"], F.lit(False))


def add_reason(reasons: Column, reason: Column) -> Column:
    """Append a reason that isn't there yet; a null reason changes nothing."""
    base = F.coalesce(reasons, F.array().cast("array<string>"))
    return F.when(reason.isNull() | F.array_contains(base, reason), base).otherwise(F.array_append(base, reason))


def status_counts(fields: DataFrame, *by: str) -> DataFrame:
    return fields.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def review_list(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("status").isin(TO_REVIEW, ILLEGIBLE))


def without_sensitive(fields: DataFrame, template: DataFrame) -> DataFrame:
    """Sensitive fields of a template never leave the scan."""
    secret = template.where("sensitive").select("page_type", "key")
    return fields.join(F.broadcast(secret), ["page_type", "key"], "left_anti")  # a template has some hundred fields
