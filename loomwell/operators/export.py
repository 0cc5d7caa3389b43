"""One row per record for analysis, and the anonymous dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions.text import strip_accents
from loomwell.operators.model import checked, number_of, safe


# Levels of education, pages, and the keys of delivery modes.
EDUCATION = {"aucun": 0, "analphabete": 0, "primaire": 0, "college": 1, "lycee": 1, "secondaire": 1, "superieur": 2}
IDENTITY, PREGNANCY, DELIVERY, NEWBORN, NEWBORN_LATE = "identification", "grossesse_actuelle", "accouchement", "pp_precoce_nne", "pp_tardif_nne"
CESAREAN, VAGINAL = ("cesarienne_programmee", "urgence"), ("voie_basse_non_instrumen", "voie_basse_instrumentale")


def record_rows(fields: DataFrame) -> DataFrame:
    """One row of analytic columns per dossier (of all dossiers in ``fields``); only safe values count.

    ``fields``: dossier_id, page_type, key, value, status, validated_by. A column reads one page, as the
    register has keys of one name on several; without the column ``page_type`` all pages count as the right one. "First" is the first safe key in lexicographic order, even if it holds no
    number. Known boxes give 0 or 1, none null. The birth weight is
    in grams, as its column says, and an accented "Négatif" is negative. One aggregation, no join.
    """
    paged = "page_type" in fields.columns
    page, key, value = F.col("page_type"), F.col("key"), F.col("value")
    ok = safe(F.col("status"), F.col("validated_by"))
    usable = F.when(F.col("status").isin("CONNU", "A_REVISER"), F.lit("CONNU"))
    number = number_of(value, usable)
    said = F.when(value["s"].isNotNull(), F.lower(value["s"]))
    bare = strip_accents(said)

    def at(where: str | tuple, hit: Column, what: Column) -> Column:
        there = page.isin(*(where if isinstance(where, tuple) else (where,))) if paged else F.lit(True)
        return F.when(ok & there & hit, what)

    def one(where: str, name: str, what: Column = number) -> Column:
        return F.max(at(where, key == name, what))

    def first(where: str, begin: str) -> Column:
        hit = key.startswith(begin)
        return F.min_by(at(where, hit, F.struct(number.alias("n"))), at(where, hit, key))["n"]

    def mean(part: str) -> Column:
        # sums of whole numbers are exact, so the mean doesn't depend on the order of rows
        return F.round(F.avg(at(PREGNANCY, key.startswith("ta__"), value[part])), 1)

    def positive(begin: str) -> Column:
        seen = F.when(bare.startswith("pos"), True).when(bare.startswith("neg"), False)
        return F.bool_or(at(PREGNANCY, key.startswith(begin), seen)).cast("int")

    def box(where: str | tuple, *names: str) -> Column:
        return F.bool_or(at(where, key.isin(*names), checked(value))).cast("int")

    level = F.create_map(*[F.lit(x) for pair in EDUCATION.items() for x in pair])
    height, weight = one(PREGNANCY, "taille"), first(PREGNANCY, "poids_kg__")
    glucose = first(PREGNANCY, "bilan_glycemique__")
    initial = F.upper(F.substring(F.trim(value["s"]), 1, 1))
    birth_weeks = one(DELIVERY, "age_gestationnel")
    any_mode = F.count(at(DELIVERY, key.isin(*CESAREAN, *VAGINAL), F.lit(1)))
    out = fields.groupBy("dossier_id").agg(
        one(IDENTITY, "age").alias("age"),
        one(IDENTITY, "niveau_d_instruction", F.try_element_at(level, bare)).alias("education_level"),
        box(IDENTITY, "consanguinite").alias("consanguinity"),
        box(IDENTITY, "grossesse_desiree").alias("desired_pregnancy"),
        one(IDENTITY, "gestation").alias("gravidity"),
        one(IDENTITY, "parite").alias("parity"),
        one(IDENTITY, "nombre_d_enfants_vivants").alias("living_children"),
        one(IDENTITY, "avortement__nombre").alias("abortions"),
        F.bool_or(at(IDENTITY, key.startswith("modalite_d_extraction__"), F.coalesce(said.contains("sar"), F.lit(False)))).cast("int").alias("previous_cesarean"),
        F.when(height != 0, F.round(weight / F.pow(height / 100, 2), 2)).alias("bmi"),
        mean("sys").alias("mean_systolic"),
        mean("dia").alias("mean_diastolic"),
        F.round(first(PREGNANCY, "hemoglobine__"), 2).alias("hemoglobin"),
        F.round(F.when(glucose < 5, F.round(glucose * 100, 1)).otherwise(glucose), 2).alias("glucose"),
        positive("albuminurie__").alias("proteinuria"),
        positive("serologie_vih__").alias("hiv"),
        positive("syphilis_tpha_vdrl__").alias("syphilis"),
        positive("ag_hbs__").alias("hepatitis_b"),
        F.lit(None).cast("int").alias("hepatitis_c"),
        F.min(at(PREGNANCY, key.startswith("age_probable__"), number)).alias("weeks_at_enrolment"),
        birth_weeks.alias("weeks_at_birth"),
        (birth_weeks < 37).cast("int").alias("preterm"),
        F.when(any_mode > 0, F.coalesce(box(DELIVERY, *CESAREAN), F.lit(0))).alias("cesarean"),
        one(DELIVERY, "sexe", F.when(initial == "F", 0).when(initial == "M", 1)).alias("newborn_sex"),
        one(DELIVERY, "poids_a_la_naissance", F.when(value["unit"] == "kg", number * 1000).otherwise(number)).alias("birth_weight"),
        one(DELIVERY, "perimetre_cranien_a_la_naissance").alias("head_circumference"),
        box(NEWBORN, "exclusivement_au_sein", "mixte").alias("breastfeeding"),
        box((NEWBORN, NEWBORN_LATE), "transfert").alias("referral"),
    )
    return out


def dashboard(records: DataFrame) -> DataFrame:
    """One anonymous row: records, records without a usable value, mean pressure, hypertension, tests."""
    tests = [c for c in ("hiv", "syphilis", "hepatitis_b") if c in records.columns]
    empty = F.col("mean_systolic").isNull() & F.col("mean_diastolic").isNull()
    for t in tests:
        empty = empty & F.col(t).isNull()
    out = [
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(empty, 1)).alias("skipped"),
        F.round(F.avg("mean_systolic"), 1).alias("mean_systolic"),
        F.round(F.avg("mean_diastolic"), 1).alias("mean_diastolic"),
        F.count(F.when((F.col("mean_systolic") >= 140) | (F.col("mean_diastolic") >= 90), 1)).alias("hypertensive"),
    ]
    for t in tests:
        out += [F.count(t).alias(f"{t}_tested"), F.sum(F.coalesce(t, F.lit(0))).alias(f"{t}_positive")]
    return records.agg(*out)
