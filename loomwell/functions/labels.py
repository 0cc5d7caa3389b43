"""Labels that a person reads for pages, columns and fields, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of pages.
PAGES = {
    "couverture": "Couverture",
    "identification": "Identification et antécédents",
    "grossesse_actuelle": "Grossesse actuelle",
    "accouchement": "Accouchement",
    "pp_precoce_mere": "Post-partum précoce (mère)",
    "pp_precoce_nne": "Post-partum précoce (nouveau-né)",
    "pp_tardif_mere": "Post-partum tardif (mère)",
    "pp_tardif_nne": "Post-partum tardif (nouveau-né)",
}
# Labels of the columns of a visit table.
COLUMNS = {
    "t1_v1": "1er trimestre, visite 1", "t1_v2": "1er trimestre, visite 2", "t1_v3": "1er trimestre, visite 3",
    "t2_v1": "2e trimestre, visite 1", "t2_v2": "2e trimestre, visite 2", "t2_v3": "2e trimestre, visite 3",
    "t3_m7": "7e mois", "t3_m8": "8e mois", "t3_m9": "9e mois",
}
# Keys whose printed label isn't clear by itself.
KEYS = {
    "date_vacc_rubeole": "Date du vaccin contre la rubéole", "date_vacc_hepatite_b": "Date du vaccin contre l'hépatite B",
    "rh_neg": "Rhésus négatif", "rh_pos": "Rhésus positif", "a": "Groupe A", "b": "Groupe B", "o": "Groupe O", "ab": "Groupe AB",
    "vat_1": "VAT 1", "vat_2": "VAT 2", "vat_3": "VAT 3", "vat_4": "VAT 4", "vat_5": "VAT 5", "temperature": "Température",
    "pf_motif_refus": "Motif du refus de contraception", "signes_graves_autres": "Autres signes de gravité",
    "traumatismes_autres": "Autres traumatismes / malformations",
}
# What a reader is told about the form of a value.
HINTS = {
    "date": "date JJ/MM/AAAA", "bp": "tension SYS/DIA, ex. 110/70", "int": "nombre entier",
    "quantity": "nombre, éventuellement suivi d'une unité (kg, g, cm, SA, g/dL...)", "text": "texte court",
}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _bare(label: Column) -> Column:
    """Without the colon that is printed behind a label."""
    return F.regexp_replace(label, "[ :]+$", "")


def page_label(page: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PAGES), page), page)


def field_label(key: Column, label: Column, row: Column, column: Column) -> Column:
    """The clear label of a key; else row and visit of a table cell; else the printed label, never all capitals."""
    suffix = F.when(F.instr(key, "__") > 0, F.regexp_extract(key, "__(.*)$", 1)).otherwise("")
    place = F.coalesce(F.try_element_at(_map(COLUMNS), suffix), F.nullif(column, F.lit("")), suffix)
    cell = F.when(F.coalesce(row, F.lit("")) != "", F.concat(_bare(row), F.lit(" ("), place, F.lit(")")))
    plain = _bare(F.coalesce(F.nullif(label, F.lit("")), F.nullif(column, F.lit("")), key))
    capitals = (plain == F.upper(plain)) & (plain != F.lower(plain))
    shown = F.when(capitals, F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 20)))).otherwise(plain)
    return F.coalesce(F.try_element_at(_map(KEYS), key), cell, shown)


def hint(key: Column, kind: Column, label: Column, row: Column, column: Column) -> Column:
    """What a reader is asked for one zone: row or label, column, and the form of the value."""
    first = F.coalesce(F.nullif(row, F.lit("")), F.nullif(label, F.lit("")))
    parts = F.concat_ws(" / ", _bare(first), _bare(F.nullif(column, F.lit(""))))
    name = F.coalesce(F.nullif(parts, F.lit("")), key)
    return F.concat(name, F.lit(" — "), F.coalesce(F.try_element_at(_map(HINTS), F.coalesce(kind, F.lit("text"))), F.lit("texte")))
