"""Synthetic pages: values for a template's fields, and how much a photo of a page is degraded.

Draws are hashes of seed, page, copy and key, so they don't depend on partitions and can be made again.
Pixels aren't drawn here: there is no image library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shares of empty fields in and outside tables, of dashes in tables, and of unknown and illegible entries.
EMPTY_IN_TABLE, EMPTY, DASH, UNKNOWN_FROM, SCRIBBLE_FROM = 0.45, 0.15, 0.07, 0.985, 0.97
# Key pattern, least, most, decimals, and what follows the number.
NUMBERS = [
    ("^poids_kg__", 45, 98, 1, ""), ("^hu_cm__", 10, 38, 0, ""), ("^bcf__", 110, 170, 0, ""), ("^age_probable__|^age_gestationnel", 6, 42, 0, " SA"),
    ("hemoglobine", 8, 14, 1, " g/dL"), ("plaquettes", 150, 400, 0, "k"), ("bilan_glycemique", 0.6, 1.3, 2, " g/L"), ("^taille$", 145, 180, 0, " cm"),
    ("^age$", 15, 45, 0, ""), ("gestation", 1, 8, 0, ""), ("parite|enfants_vivants|nombre$", 0, 6, 0, ""), ("poids_a_la_naissance|poids_nouveau", 1800, 4500, 0, " g"),
    ("perimetre_cranien", 30, 38, 0, " cm"), ("temperature|^t$", 36.0, 38.5, 1, ""), ("pouls", 60, 110, 0, ""),
]
# Key pattern and the words written there; the last one is for all other keys.
WORDS = [
    ("conjonctives", ["Normales", "Pâles", "Normales"]), ("seins", ["Normaux", "Normaux", "RAS"]), ("oedemes|mouvements|relance|^fer__", ["Oui", "Non", "Non"]),
    ("glucosurie|albuminurie|syphilis|serologie_vih|ag_hbs|rai_si", ["Neg", "Neg", "Neg", "Pos +"]), ("rubeole__|toxoplasmose", ["Immune", "Non immune"]),
    ("etat_du_col", ["Fermé", "Ouvert", "Fermé"]), ("presentation", ["Céphalique", "Siège"]), ("modalite", ["Voie basse", "Césarienne"]),
    ("sexe", ["F", "M"]), ("niveau_d_instruction", ["Aucun", "Primaire", "Collège", "Lycée", "Supérieur"]), (".*", ["RAS", "Néant", "Aucun", "RAS"]),
]
# Rotation in degrees, share of perspective, least and most page scale, chance of a cropped side, then least and most defocus,
# motion, noise, JPEG quality and gamma.
LEVELS = {
    "leger": (4, 0.03, 0.80, 0.95, 0.0, 0, 1.0, 0, 2, 0, 3, 85, 95, 1.0, 1.2),
    "moyen": (10, 0.07, 0.65, 0.92, 0.15, 0, 2.5, 0, 6, 2, 7, 60, 90, 1.0, 1.6),
    "fort": (20, 0.12, 0.50, 0.90, 0.35, 1, 4.0, 0, 12, 4, 12, 35, 75, 1.2, 2.3),
}


def draw(seed: int, what: str, *by: str) -> Column:
    """A number in [0, 1) that hangs on seed, purpose and row only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *by), F.lit(1 << 40)) / float(1 << 40)


def synthetic_values(fields: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``text`` and the expected ``status`` to template fields (page_type, copy, key, type, table)."""
    by = ("page_type", "copy", "key")
    key, r, pick = F.col("key"), draw(seed, "kind", *by), draw(seed, "value", *by)
    in_table = F.coalesce(F.col("table"), F.lit("")) != ""
    empty = F.when(in_table, EMPTY_IN_TABLE).otherwise(EMPTY)
    day = F.date_add(F.lit("2015-01-01").cast("date"), F.floor(pick * 4400).cast("int"))
    shape = F.floor(draw(seed, "shape", *by) * 4)
    date = F.when(shape < 2, F.date_format(day, "dd/MM/yyyy")).when(shape == 2, F.date_format(day, "dd/MM/yy")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    high = 90 + F.floor(pick * 81).cast("int")
    low = 50 + F.floor(draw(seed, "low", *by) * (F.least(F.lit(110), high - 20) - 49)).cast("int")
    number = words = None
    for pattern, least, most, digits, unit in NUMBERS:
        shown = F.concat(F.format_string(f"%.{digits}f", F.lit(float(least)) + pick * float(most - least)), F.lit(unit))
        number = F.when(key.rlike(pattern), shown) if number is None else number.when(key.rlike(pattern), shown)
    for pattern, said in WORDS:
        one = F.element_at(F.array(*map(F.lit, said)), (F.floor(pick * len(said)) + 1).cast("int"))
        words = F.when(key.rlike(pattern), one) if words is None else words.when(key.rlike(pattern), one)
    is_date = (F.col("type") == "date") | key.contains("date") | key.rlike("^(rendez_vous|venue_le|prochain|revenir)")
    value = F.when(is_date, date).when((F.col("type") == "bp") | key.rlike("^ta(__|$)"), F.concat_ws("/", high, low)).otherwise(F.coalesce(number, words))
    kind = F.when(r < empty, "none").when(in_table & (r < empty + DASH), "dash").when(r > UNKNOWN_FROM, "unknown").when(r > SCRIBBLE_FROM, "scribble").otherwise("value")
    text = F.when(kind == "dash", "—").when(kind == "unknown", "?").when(kind == "value", value)
    status = F.when(kind.isin("none", "dash"), "NON_FOURNI").when(kind == "unknown", "INCONNU").when(kind == "scribble", "ILLISIBLE").otherwise("CONNU")
    return fields.withColumn("text", text).withColumn("status", status)


def degradations(photos: DataFrame, seed: int = 0) -> DataFrame:
    """Add the parameters of degradation to photos (id, severity): one struct of numbers per row."""
    spark: SparkSession = photos.sparkSession
    names = "rot persp scale0 scale1 crop_p focus0 focus1 motion0 motion1 noise0 noise1 jpeg0 jpeg1 gamma0 gamma1".split()
    levels = spark.createDataFrame([(k, *map(float, v)) for k, v in LEVELS.items()], "severity string, " + ", ".join(f"{n} double" for n in names))

    def u(what: str) -> Column:
        return draw(seed, what, "id")

    def between(what: str, low: str, high: str) -> Column:
        return F.col(low) + u(what) * (F.col(high) - F.col(low))

    upright, light = u("upright") < 0.85, F.col("severity") == "leger"
    crop = u("crop") < F.col("crop_p")
    made = F.struct(
        F.when(upright, 1500).otherwise(2000).alias("width"), F.when(upright, 2000).otherwise(1500).alias("height"),
        ((2 * u("rot") - 1) * F.col("rot") + F.when(~upright & (u("turn") < 0.5), 90).otherwise(0)).alias("rotation"), (u("persp") * F.col("persp")).alias("perspective"),
        between("scale", "scale0", "scale1").alias("scale"), F.when(crop, F.element_at(F.array(*map(F.lit, ["top", "bottom", "left", "right"])), (F.floor(u("side") * 4) + 1).cast("int"))).alias("crop_side"),
        F.when(crop, 0.04 + 0.11 * u("cropped")).otherwise(0.0).alias("crop_share"), between("focus", "focus0", "focus1").alias("defocus"), between("motion", "motion0", "motion1").alias("motion"),
        (u("angle") * 180).alias("motion_angle"), between("noise", "noise0", "noise1").alias("noise"), F.floor(between("jpeg", "jpeg0", "jpeg1")).cast("int").alias("jpeg_quality"),
        between("gamma", "gamma0", "gamma1").alias("gamma"), (u("shadow") < F.when(light, 0.2).otherwise(0.5)).alias("shadow"), (u("glare") < F.when(light, 0.05).otherwise(0.25)).alias("glare"), (u("fold") < 0.3).alias("fold"),
    )
    return photos.join(F.broadcast(levels), "severity").withColumn("degradation", made).select(*photos.columns, "degradation")  # three rows


def split_chunks(rows: DataFrame, group: Column, by: str, order: str, size: int = 8) -> DataFrame:
    """Add ``part`` (train up to 7, val 8, test above, by a patient's number) and ``chunk`` (every ``size`` rows of ``by``)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    part = F.when(group <= 7, "train").when(group == 8, "val").otherwise("test")
    return rows.withColumn("part", part).withColumn("chunk", F.floor((n - 1) / size).cast("long"))
