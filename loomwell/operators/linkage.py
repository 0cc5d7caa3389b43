"""Linking records to patients, and duplicate photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.text import code_form, fold_confused


def _deletions(column):
    """A code and each form of it with one character left out: codes one edit apart share one."""
    n = F.length(column)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(column, F.lit(1), i - 1), F.substring(column, i + 1, n)))
    return F.array_distinct(F.when(n > 0, F.concat(F.array(column), cut)).otherwise(F.array(column)))


def candidates(records: DataFrame, patients: DataFrame, most: int = 3) -> DataFrame:
    """(rec_id, patient_id, score, how): up to ``most`` patients per record, best first.

    Both sides: id, code, lmp (date), age; patients also created_at. Codes that are equal, equal
    after folding characters that look alike, or one edit apart score 1, 0.8 or 0.6; period and age
    move the score. Keyed joins of different codes (the near ones by hashes of one-character deletions, then
    checked) replace the comparison of all with all. Patients alike in code, period and age score the same, so of
    each such class only the first ``most`` are kept. Deletions make a table many times its estimated size:
    the joins are by merge, never by broadcast.
    """
    new = records.select(F.col("id").alias("rec_id"), code_form("code").alias("code"), F.col("lmp").alias("lmp"), F.col("age").alias("age")).where("code <> ''")
    old = patients.select(F.col("id").alias("patient_id"), code_form("code").alias("p_code"), F.col("lmp").alias("p_lmp"), F.col("age").alias("p_age"), "created_at")
    alike = Window.partitionBy("p_code", "p_lmp", "p_age").orderBy("created_at", "patient_id")
    old = old.withColumn("_place", F.row_number().over(alike)).where(F.col("_place") <= most).drop("_place")
    mine, theirs = new.select("code").distinct(), old.select("p_code").distinct()
    folded = mine.withColumn("block", fold_confused("code")).join(theirs.withColumn("block", fold_confused("p_code")).hint("merge"), "block")

    def cuts(column: str):
        return F.explode(F.array_distinct(F.transform(_deletions(F.col(column)), lambda cut: F.xxhash64(cut))))

    near = mine.where(F.length("code") >= 3).withColumn("block", cuts("code"))
    near = near.join(theirs.withColumn("block", cuts("p_code")).hint("merge"), "block").where(F.levenshtein("code", "p_code", 1) == 1)
    pairs = folded.unionByName(near).select("code", "p_code").distinct()
    met = new.join(pairs.hint("merge"), "code").join(old.hint("merge"), "p_code")
    base = F.when(F.col("code") == F.col("p_code"), 1.0).when(fold_confused("code") == fold_confused("p_code"), 0.8).otherwise(0.6)
    how = F.when(F.col("code") == F.col("p_code"), "same").when(fold_confused("code") == fold_confused("p_code"), "alike").otherwise("one_edit")
    period = F.when(F.abs(F.datediff("lmp", "p_lmp")) <= 7, 0.1).when(F.col("lmp").isNotNull() & F.col("p_lmp").isNotNull(), -0.2).otherwise(0.0)
    age = F.when(F.abs(F.col("age") - F.col("p_age")) <= 1, 0.05).when(F.col("age").isNotNull() & F.col("p_age").isNotNull(), -0.2).otherwise(0.0)
    scored = met.withColumn("score", F.round((base + period + age).cast("decimal(6,3)"), 2).cast("double")).withColumn("how", how)
    best = Window.partitionBy("rec_id").orderBy(F.desc("score"), "created_at", "patient_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("rec_id", "patient_id", "score", "how", "rank")


def duplicate_photos(images: DataFrame) -> DataFrame:
    """(rec_id, image_id, n_records): photos whose content another record has too.

    Counting the records per content first keeps a content that very many share from being paired.
    """
    per = images.groupBy("sha256").agg(F.count_distinct("rec_id").alias("n_records")).where("n_records > 1")
    return images.join(per, "sha256").select("rec_id", "image_id", "sha256", "n_records")


def duplicate_records(images: DataFrame) -> DataFrame:
    """Records all of whose photos another record has too."""
    twice = duplicate_photos(images).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_twice"))
    every = images.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(twice, "rec_id").where("n = n_twice").select("rec_id", "n")
