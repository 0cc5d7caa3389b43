"""Coherence rules: they flag, and never correct.

A rule set is small and fixed, so a first-match table becomes one CASE expression that
Catalyst sees whole. Dossier rules work on one row per dossier (a pivot of few fields) and give
rows (dossier_id, rule, message, fields); flags are applied in one aggregate per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators.model import KNOWN, NOT_APPLICABLE, NOT_GIVEN, TO_REVIEW, add_reason, checked, date_of, number_of

# Page pattern, key pattern, least, most; the first match holds.
RANGES = [
    ("identification", "^age$", 12, 55),
    ("identification", "^(gestation)$", 1, 20),
    ("identification", "^(parite|nombre_d_enfants_vivants)$", 0, 20),
    ("grossesse_actuelle", "^poids_kg__", 30, 200),
    ("grossesse_actuelle", "^hu_cm__", 4, 45),
    ("grossesse_actuelle", "^bcf__", 100, 180),
    ("grossesse_actuelle", "^hemoglobine__", 4, 20),
    ("grossesse_actuelle", "^age_probable__", 4, 44),
    ("grossesse_actuelle", "^taille$", 120, 200),
    ("accouchement", "^poids_a_la_naissance$", 400, 6500),
    ("accouchement", "^perimetre_cranien", 20, 45),
    ("accouchement", "^age_gestationnel$", 20, 45),
    ("_mere$", "^temperature$", 34, 42),
    ("_mere$", "^pouls$", 40, 160),
    ("_mere$", "^poids$", 30, 200),
    ("_nne$", "^temperature$", 34, 42),
    ("_nne$", "^poids$", 400, 9000),
    ("_nne$", "^(taille)$", 30, 75),
    ("_nne$", "^perimetre_cranien$", 20, 50),
]
# Page pattern, key pattern, accepted units ("" is always accepted).
UNITS = [
    ("grossesse_actuelle", "^(hu_cm__|taille$)", ["", "cm"]),
    ("grossesse_actuelle", "^poids_kg__", ["", "kg"]),
    ("grossesse_actuelle", "^age_probable__", ["", "SA"]),
    ("grossesse_actuelle", "^hemoglobine__", ["", "g/dL"]),
    ("accouchement", "^perimetre_cranien", ["", "cm"]),
    ("accouchement", "^poids_a_la_naissance$", ["", "g", "kg"]),
    ("accouchement", "^age_gestationnel$", ["", "SA"]),
    ("_nne$", "^(taille|perimetre_cranien)$", ["", "cm"]),
    ("_nne$", "^poids$", ["", "g", "kg"]),
    ("_mere$", "^poids$", ["", "kg"]),
]
# Keys that a record needs.
ESSENTIAL = "|".join(
    [
        "^(age|gestation|parite|nombre_d_enfants_vivants)$",
        "^(ddr|date_prevue_d_accouchement)$",
        "^(ta|poids_kg|age_probable|serologie_vih|syphilis_tpha_vdrl|ag_hbs|hemoglobine)__",
        "^(date_de_l_accouchement|sexe|poids_a_la_naissance|perimetre_cranien_a_la_naissance|age_gestationnel)$",
        "^(temperature|ta|poids|date_de_la_consultation)$",
    ]
)


def first_match(table: list[tuple], page: Column, key: Column, value) -> Column:
    """CASE over a rule table in its order; ``value`` makes a column of a table row."""
    out = None
    for row in table:
        hit = page.rlike(row[0]) & key.rlike(row[1])
        out = F.when(hit, value(row)) if out is None else out.when(hit, value(row))
    return out


def bounds(page: Column, key: Column, table: list[tuple] = RANGES) -> Column:
    """struct(low, high) of the first matching range, or null."""
    return first_match(table, page, key, lambda r: F.struct(F.lit(float(r[2])).alias("low"), F.lit(float(r[3])).alias("high")))


def plausibility(page: Column, key: Column, number: Column, unit: Column) -> Column:
    """unit, range, or null: why a value isn't plausible."""
    limits, units = bounds(page, key), first_match(UNITS, page, key, lambda r: F.array(*[F.lit(u) for u in r[2]]))
    unit = F.coalesce(unit, F.lit(""))
    x = F.when((unit == "kg") & (limits["low"] >= 100), number * 1000).otherwise(number)
    return F.when(number.isNull(), None).when(units.isNotNull() & ~F.array_contains(units, unit), "unit").when(
        limits.isNotNull() & ~x.between(limits["low"], limits["high"]), "range"
    )


def essential(key: Column) -> Column:
    return key.rlike(ESSENTIAL)


#: Columns of visits on the pregnancy page, in order.
VISITS = ["t1_v1", "t1_v2", "t1_v3", "t2_v1", "t2_v2", "t2_v3", "t3_m7", "t3_m8", "t3_m9"]
LONGEST_WAIT, LONGEST_PREGNANCY = 120, 44 * 7
IDENTITY, PREGNANCY, DELIVERY = "identification", "grossesse_actuelle", "accouchement"
MODES = ["voie_basse_non_instrumen", "voie_basse_instrumentale", "cesarienne_programmee", "urgence"]
# Pages after birth, and the first and last day on which each is due.
AFTER_BIRTH = {"pp_precoce_mere": (4, 14), "pp_tardif_mere": (30, 70), "pp_precoce_nne": (4, 14), "pp_tardif_nne": (30, 70)}


def _g(x: Column) -> Column:
    """A number without a fraction of zero."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def _fields(*names: tuple) -> Column:
    return F.array(*[F.struct(_lit(page).alias("page_type"), _lit(key).alias("key")) for page, key in names])


def _lit(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _found(rows: DataFrame, rules: list[tuple[str, Column, Column, Column]], *keep: str) -> DataFrame:
    """A row for each rule (name, condition, message, fields) that holds; null conditions don't."""
    hits = [
        F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("rule"), message.alias("message"), fields.alias("fields")))
        for name, hit, message, fields in rules
    ]
    return rows.select("dossier_id", *keep, F.explode(F.array_compact(F.array(*hits))).alias("_f")).select("dossier_id", *keep, "_f.*")


def visit_flags(visits: DataFrame) -> DataFrame:
    """(dossier_id, ord, rule, message, fields): date rules of ``visits`` (dossier_id, ord, visit, rdv, lmp; maybe col).

    A dated visit must lie after the dated one before it; an appointment 1 to 120 days after its
    visit; a visit 0 to 308 days after the last menstrual period. ``col`` names the column of a visit; without it, ``ord`` does.
    """
    by_order = Window.partitionBy("dossier_id").orderBy("ord")
    col = F.col("col") if "col" in visits.columns else F.coalesce(F.try_element_at(F.array(*map(F.lit, VISITS)), F.col("ord").cast("int")), F.col("ord").cast("string"))
    dated = visits.withColumn("_at", F.concat(F.lit("venue_le__"), col)).withColumn("_next", F.concat(F.lit("rendez_vous__"), col)).where("visit IS NOT NULL")
    dated = dated.withColumn("before", F.lag("visit").over(by_order)).withColumn("_before", F.lag("_at").over(by_order))
    wait, days = F.datediff("rdv", "visit"), F.datediff("visit", "lmp")
    at, late = (PREGNANCY, F.col("_at")), (PREGNANCY, F.col("_next"))
    return _found(
        dated,
        [
            ("ORDRE_VISITES", F.col("visit") <= F.col("before"), F.lit("Visites hors d'ordre chronologique : date mal lue ?"), _fields(at, (PREGNANCY, F.col("_before")))),
            ("DELAI_RDV", ~wait.between(1, LONGEST_WAIT), F.format_string("Rendez-vous à %+d j de la visite : date ou année mal lue ?", wait), _fields(at, late)),
            ("VISITE_HORS_GROSSESSE", ~days.between(0, LONGEST_PREGNANCY), F.lit("Visite hors de la grossesse d'après la DDR : date mal lue ?"), _fields(at, (PREGNANCY, "ddr"))),
        ],
        "ord",
    )


def week_flags(visits: DataFrame) -> DataFrame:
    """(dossier_id, ord, rule, message, fields): weeks written at a visit that differ from its date by over 2.5."""
    weeks = F.datediff("visit", "lmp") / 7
    col = F.col("col") if "col" in visits.columns else F.coalesce(F.try_element_at(F.array(*map(F.lit, VISITS)), F.col("ord").cast("int")), F.col("ord").cast("string"))
    message = F.format_string("Âge gestationnel %s SA incohérent avec la date de visite (%.1f SA d'après la DDR).", _g(F.col("weeks")), weeks)
    fields = _fields((PREGNANCY, F.concat(F.lit("venue_le__"), col)), (PREGNANCY, F.concat(F.lit("age_probable__"), col)))
    return _found(visits, [("SA_VISITE", F.abs(weeks - F.col("weeks")) > 2.5, message, fields)], "ord")


def pregnancy_visits(fields: DataFrame, facts: DataFrame) -> DataFrame:
    """(dossier_id, ord, col, visit, rdv, weeks, lmp): the visit columns of pregnancy pages; ``ord`` is 0 for a column that the form doesn't have."""
    value, parts = F.col("value"), F.split("key", "__", 2)
    named = fields.where(F.col("page_type") == PREGNANCY).withColumn("_what", parts[0]).withColumn("col", F.try_element_at(parts, F.lit(2))).where("col IS NOT NULL")

    def one(name: str, what: Column) -> Column:
        return F.max(F.when(F.col("_what") == name, what))

    visits = named.groupBy("dossier_id", "col").agg(
        one("venue_le", date_of(value)).alias("visit"), one("rendez_vous", date_of(value)).alias("rdv"), one("age_probable", number_of(value, F.col("status"))).alias("weeks")
    )
    order = F.array_position(F.array(*map(F.lit, VISITS)), F.col("col")).alias("ord")
    return visits.join(facts.select("dossier_id", "lmp"), "dossier_id").select("dossier_id", order, "col", "visit", "rdv", "weeks", "lmp")


def after_birth_visits(fields: DataFrame, facts: DataFrame) -> DataFrame:
    """(dossier_id, page_type, birth, consult, rdv): one row per page after birth."""

    def one(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, date_of(F.col("value"))))

    pages = fields.where(F.col("page_type").startswith("pp_")).groupBy("dossier_id", "page_type").agg(one("date_de_la_consultation").alias("consult"), one("prochain_rendez_vous_le").alias("rdv"))
    return pages.join(facts.select("dossier_id", "birth"), "dossier_id").select("dossier_id", "page_type", "birth", "consult", "rdv")


#: Rules about the dates of one page: they flag fields, but a record doesn't list them among its alerts.
PAGE_RULES = ("ORDRE_VISITES", "DELAI_RDV", "VISITE_HORS_GROSSESSE", "DELAI_RDV_PP")


def all_flags(fields: DataFrame, facts: DataFrame) -> DataFrame:
    """(dossier_id, rule, message, fields): what every rule over a dossier finds, visits and pages after birth included."""
    visits = pregnancy_visits(fields, facts)
    parts = [dossier_flags(facts), visit_flags(visits.where("ord > 0")), week_flags(visits), after_birth_flags(after_birth_visits(fields, facts))]
    out = None
    for part in parts:
        part = part.select("dossier_id", "rule", "message", "fields")
        out = part if out is None else out.unionByName(part)
    return out


def alerts(flags: DataFrame) -> DataFrame:
    """(dossier_id, rule, message, page_type, key, seq): the alerts of a record, as questions take them; one row each, with the first field named."""
    first = F.try_element_at("fields", F.lit(1))
    rows = flags.where(~F.col("rule").isin(*PAGE_RULES)).select("dossier_id", "rule", "message", first["page_type"].alias("page_type"), first["key"].alias("key"))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("dossier_id").orderBy("rule", "message", "page_type", "key")).cast("long"))


def field_flags(fields: DataFrame) -> DataFrame:
    """(dossier_id, page_type, key, reason): values out of range or with odd units, and pressures turned round."""
    value, used = F.col("value"), F.col("status").isin(KNOWN, TO_REVIEW)
    number = number_of(value, F.col("status"))
    why = plausibility(F.col("page_type"), F.col("key"), number, value["unit"])
    limits = bounds(F.col("page_type"), F.col("key"))
    unit = F.coalesce(value["unit"], F.lit(""))
    x = F.when((unit == "kg") & (limits["low"] >= 100), number * 1000).otherwise(number)
    said = F.when(why == "unit", F.concat(F.lit("Unité inattendue « "), unit, F.lit(" »."))).when(
        why == "range", F.concat(F.lit("Valeur "), _g(x), F.lit(" hors des bornes plausibles ["), _g(limits["low"]), F.lit("–"), _g(limits["high"]), F.lit("] : à confirmer."))
    )
    turned = F.when(F.coalesce(value["sys"], F.lit(0)) <= F.coalesce(value["dia"], F.lit(0)), "Systolique ≤ diastolique : inversion ou erreur de lecture ?")
    pressure = value["sys"].isNotNull() | value["dia"].isNotNull()
    reason = F.when(pressure, turned).when(used & value["b"].isNull(), said)
    return fields.select("dossier_id", "page_type", "key", reason.alias("reason")).where("reason IS NOT NULL")


def dossier_facts(fields: DataFrame) -> DataFrame:
    """One row per dossier with what the dossier rules read; one aggregation."""
    page, key, value = F.col("page_type"), F.col("key"), F.col("value")
    number = number_of(value, F.col("status"))

    def one(where: str, name: str, what: Column) -> Column:
        return F.max(F.when((page == where) & (key == name), what))

    def num(where: str, name: str) -> Column:
        return one(where, name, number)

    def day(where: str, name: str) -> Column:
        return one(where, name, date_of(value))

    def any_of(hit: Column) -> Column:
        return F.coalesce(F.bool_or(hit), F.lit(False))

    def boxed(*names: str) -> Column:
        return any_of((page == DELIVERY) & key.isin(*names) & checked(value))

    text = F.lower(value["s"])
    earlier = (page == IDENTITY) & key.startswith("modalite_d_extraction__") & text.isNotNull()
    return fields.groupBy("dossier_id").agg(
        num(IDENTITY, "gestation").alias("gravidity"), num(IDENTITY, "parite").alias("parity"),
        num(IDENTITY, "avortement__nombre").alias("abortions"), num(IDENTITY, "nombre_d_enfants_vivants").alias("living"),
        any_of(page.isin(PREGNANCY, DELIVERY)).alias("has_pregnancy_page"), any_of(page == DELIVERY).alias("has_delivery_page"),
        num(IDENTITY, "avortement__age_gestationnel_sa").alias("abortion_weeks"), day(PREGNANCY, "ddr").alias("lmp"),
        day(PREGNANCY, "date_prevue_d_accouchement").alias("due"), day(PREGNANCY, "date_de_depassement_de_terme").alias("overdue"),
        day(DELIVERY, "date_de_l_accouchement").alias("birth"), num(DELIVERY, "age_gestationnel").alias("birth_weeks"),
        boxed(*MODES[:2]).alias("vaginal"), boxed(*MODES[2:]).alias("cesarean"),
        any_of((page == DELIVERY) & (key == "preciser_l_indication") & text.contains("cicatriciel")).alias("scar"),
        any_of(earlier).alias("earlier_known"), any_of(earlier & text.contains("sar")).alias("earlier_cesarean"),
        any_of((page == PREGNANCY) & (key == "rh_pos") & checked(value)).alias("rh_positive"),
    )


def dossier_flags(records: DataFrame) -> DataFrame:
    """(dossier_id, rule, message, fields): rules over one row per dossier, as ``dossier_facts`` makes them.

    Columns: gravidity, parity, abortions, living, has_pregnancy_page, has_delivery_page, abortion_weeks, lmp, due, overdue,
    birth, birth_weeks, vaginal, cesarean, scar, earlier_known, earlier_cesarean.
    """
    c = F.col
    ab = F.coalesce(c("abortions"), F.lit(0))
    late = F.datediff("due", "lmp") - 280

    def of(page: str, *keys: str) -> Column:
        return _fields(*[(page, key) for key in keys])

    return _found(
        records,
        [
            (
                "G_P_AB", c("gravidity") < c("parity") + ab + F.when(c("has_pregnancy_page"), 1).otherwise(0),
                F.format_string("Gestité (%s) < parité (%s) + avortements (%s) + grossesse en cours.", _g(c("gravidity")), _g(c("parity")), _g(ab)), of(IDENTITY, "gestation", "parite"),
            ),
            ("G_P_AB_MANQUE", c("gravidity") > c("parity") + ab + 1.5, F.lit("Gestité > parité + avortements + 1 : antécédent manquant ?"), of(IDENTITY, "gestation", "avortement__nombre")),
            ("ENFANTS_VIVANTS", c("living") > c("parity") + 1, F.lit("Plus d'enfants vivants que d'accouchements."), of(IDENTITY, "nombre_d_enfants_vivants", "parite")),
            (
                "AVORTEMENT_TERME", c("abortion_weeks") >= 22, F.format_string("« Avortement » à %s SA : au-delà de 22 SA, accouchement prématuré / MFIU ?", _g(c("abortion_weeks"))),
                of(IDENTITY, "avortement__age_gestationnel_sa"),
            ),
            ("DPA", F.abs(late) > 3, F.format_string("DPA ≠ DDR + 280 j (écart %+d j).", late), of(PREGNANCY, "ddr", "date_prevue_d_accouchement")),
            ("TERME", F.abs(F.datediff("overdue", "due") - 7) > 2, F.lit("Date de dépassement ≠ DPA + 7 j."), of(PREGNANCY, "date_de_depassement_de_terme")),
            (
                "SA_NAISSANCE", F.abs(F.datediff("birth", "lmp") / 7 - c("birth_weeks")) > 2.5,
                F.lit("Âge gestationnel à la naissance incohérent avec DDR et date d'accouchement."), of(DELIVERY, "age_gestationnel", "date_de_l_accouchement"),
            ),
            ("MODE_ACC", c("has_delivery_page") & (c("vaginal") == c("cesarean")), F.lit("Mode d'accouchement absent ou contradictoire."), of(DELIVERY, *MODES)),
            (
                "UTERUS_CICATRICIEL", c("scar") & c("earlier_known") & ~c("earlier_cesarean"),
                F.lit("Indication « utérus cicatriciel » sans césarienne antérieure notée."), of(DELIVERY, "preciser_l_indication"),
            ),
        ],
    )


def after_birth_flags(visits: DataFrame) -> DataFrame:
    """(dossier_id, page_type, rule, message, fields): consultations after birth, one row per page of a dossier.

    ``visits``: dossier_id, page_type, birth, consult, rdv. A consultation must lie within its page's days after
    the birth and not before it; the next appointment 1 to 120 days after it.
    """
    offset, wait = F.datediff("consult", "birth"), F.datediff("rdv", "consult")
    page = F.col("page_type")
    days = F.try_element_at(F.create_map(*[x for name, (a, b) in AFTER_BIRTH.items() for x in (F.lit(name), F.array(F.lit(a), F.lit(b)))]), page)
    at = (page, "date_de_la_consultation")
    due = F.format_string("%s : consultation à J%d de l'accouchement (attendu J%d–J%d).", page, offset, days[0], days[1])
    return _found(
        visits,
        [
            ("DELAI_PP", ~offset.between(days[0], days[1]), due, _fields(at)),
            ("CHRONO", offset < 0, F.concat(page, F.lit(" : consultation avant l'accouchement.")), _fields(at)),
            (
                "DELAI_RDV_PP", ~wait.between(1, LONGEST_WAIT), F.format_string("Prochain rendez-vous à %+d j de la consultation : date mal lue ?", wait),
                _fields(at, (page, "prochain_rendez_vous_le")),
            ),
        ],
        "page_type",
    )


def deductions(fields: DataFrame, facts: DataFrame) -> DataFrame:
    """Fields that were left empty because they can't apply become not applicable, with the reason.

    The indication after a vaginal birth, antibodies with a positive rhesus, the scar without a cesarean.
    """
    known = facts.select("dossier_id", "rh_positive", "vaginal", "cesarean", "has_delivery_page")
    joined = fields.join(known, "dossier_id", "left")
    page, key = F.col("page_type"), F.col("key")
    hits = [
        ((page == DELIVERY) & (key == "preciser_l_indication") & F.col("vaginal") & ~F.col("cesarean"), "Pas de césarienne : indication sans objet."),
        ((page == PREGNANCY) & key.startswith("rai_si_rh_negatif__") & F.col("rh_positive"), "Rh positif : RAI sans objet."),
        (page.isin("pp_precoce_mere", "pp_tardif_mere") & (key == "etat_de_la_cicatrice") & F.col("has_delivery_page") & ~F.col("cesarean"), "Pas de césarienne : cicatrice sans objet."),
    ]
    status, reasons = F.col("status"), F.col("reasons")
    for hit, why in hits:
        status, reasons = not_applicable(status, reasons, hit, why)
    return joined.withColumn("reasons", reasons).withColumn("status", status).select(*fields.columns)


def flagged_fields(flags: DataFrame) -> DataFrame:
    """(dossier_id, page_type, key, reason) of rule rows, as ``apply_flags`` takes them."""
    return flags.select("dossier_id", F.explode("fields").alias("_f"), F.col("message").alias("reason")).select("dossier_id", "_f.page_type", "_f.key", "reason")


def apply_flags(fields: DataFrame, flags: DataFrame) -> DataFrame:
    """Add the reasons of ``flags`` (dossier_id, page_type, key, reason); known fields go to review."""
    keys = ["dossier_id", "page_type", "key"]
    per_field = flags.groupBy(*keys).agg(F.array_sort(F.collect_set("reason")).alias("_new"))
    joined = fields.join(per_field, keys, "left")
    reasons = F.array_union(F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>")))
    status = F.when(F.col("_new").isNotNull() & (F.col("status") == KNOWN), TO_REVIEW).otherwise(F.col("status"))
    return joined.withColumn("reasons", reasons).withColumn("status", status).drop("_new")


def not_applicable(status: Column, reasons: Column, condition: Column, why: str) -> tuple[Column, Column]:
    """A field that wasn't given becomes not applicable where the condition holds; the reason replaces others."""
    hit = F.coalesce(condition, F.lit(False)) & (status == NOT_GIVEN)
    return F.when(hit, NOT_APPLICABLE).otherwise(status), F.when(hit, F.array(F.lit(why))).otherwise(reasons)


def flag(status: Column, reasons: Column, condition: Column, reason: str) -> tuple[Column, Column]:
    hit = F.coalesce(condition, F.lit(False))
    return F.when(hit & (status == KNOWN), TO_REVIEW).otherwise(status), add_reason(reasons, F.when(hit, F.lit(reason)))
