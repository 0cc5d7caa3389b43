"""Parsers of register values as Column builders; nothing raises, bad input keeps format_ok false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwell.functions.text import comparable, tidy

# Marks for an empty field (case matters), an examination not done, an unknown value.
EMPTY_MARKS = ["—", "-", "–", "--", "/", "ø", "x"]
NOT_DONE_MARKS = ["nf", "n.f", "n.f.", "non fait", "non faite", "nfait"]
UNKNOWN_MARKS = ["?", "??", "nsp", "ne sait pas", "inconnu", "inconnue", "non connu", "؟", "unknown"]
# Unit spellings and units.
UNITS = {
    "g": "g", "gr": "g", "kg": "kg", "cm": "cm", "sa": "SA", "s.a": "SA", "sem": "SA", "°c": "°C", "c": "°C",
    "g/dl": "g/dL", "g/l": "g/L", "k": "k", "000": "k", "jours": "jours", "j": "jours", "jour": "jours",
}
# Shapes of numbers, pressures, dates, abbreviated counts, and weeks with days.
NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"
_CM = r"([0-9]{1,2}(?:[.,][0-9])?)\s*[/\\|-]\s*([0-9]{1,2}(?:[.,][0-9])?)"
_MM = r"([0-9]{2,3})\s*[/\\|-]\s*([0-9]{2,3})"
_DATE = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})$"
_COUNT = r"^[0-9]{1,3}\s*(?:ans?|g|ème|e|x)?$"
_WEEKS = r"^([0-9]{1,2})\s*(?:sa|s\.a\.?|sem)\s*\+?\s*([0-9])\s*j(?:ours?)?$"


def _decimal(text: Column) -> Column:
    return F.translate(text, ",", ".").try_cast("double")


def marker(column: Column, tidied: bool = False) -> Column:
    """vide, inconnu, or null for a value; null and blank texts are vide."""
    text = column if tidied else tidy(column)
    low = F.lower(text)
    return (
        F.when(column.isNull() | (text == ""), "vide")
        .when(text.isin(EMPTY_MARKS) | low.isin(NOT_DONE_MARKS), "vide")
        .when(low.isin(UNKNOWN_MARKS), "inconnu")
    )


def parse_date(column: Column) -> Column:
    """Day, month, year with / . or -; two-digit years from 50 are 19xx; 1950 to 2040; else null."""
    text = F.regexp_replace(column, " ", "")
    day, month, year = (F.regexp_extract(text, _DATE, i) for i in (1, 2, 3))
    number = year.try_cast("int")
    whole = F.when(number < 50, number + 2000).when(number < 100, number + 1900).otherwise(number)
    made = F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    date = F.try_to_date(F.when(text.rlike(_DATE), made), "yyyy-MM-dd")
    return F.when(F.year(date).between(1950, 2040), date)


def parse_number(column: Column) -> Column:
    """The first signed decimal in the text, or null."""
    return _decimal(F.nullif(F.regexp_extract(column, NUMBER, 0), F.lit("")))


def parse_pressure(column: Column, tidied: bool = False) -> Column:
    """struct(sys, dia, format_ok): SYS/DIA in mmHg, or cmHg times ten; half-even rounding."""
    text = column if tidied else tidy(column)
    shape = F.when(text.rlike(f"^{_MM}$"), F.lit(1)).when(text.rlike(f"^{_CM}$"), F.lit(2))
    parts = [F.when(shape == 1, F.regexp_extract(text, f"^{_MM}$", i)).when(shape == 2, F.regexp_extract(text, f"^{_CM}$", i)) for i in (1, 2)]
    high, low = (_decimal(p) for p in parts)
    small = (high < 30) & (low < 20)
    high, low = (F.bround(F.when(small, v * 10).otherwise(v)).cast("int") for v in (high, low))
    ok = F.coalesce(high.between(60, 260) & low.between(30, 160) & (high > low), F.lit(False))
    return F.struct(high.alias("sys"), low.alias("dia"), ok.alias("format_ok"))


def parse_int(column: Column, tidied: bool = False) -> Column:
    """struct(value, format_ok): digits only, or a number with a usual abbreviation (21 ans, 1G, 2e)."""
    text = column if tidied else tidy(column)
    number = parse_number(text)
    plain = F.regexp_replace(text, " ", "").rlike("^[0-9]+$")
    short = F.lower(text).rlike(_COUNT)
    return F.struct(number.try_cast("long").alias("value"), F.coalesce(plain | short, F.lit(False)).alias("format_ok"))


def parse_quantity(column: Column, tidied: bool = False) -> Column:
    """struct(value, unit, format_ok): first number and unit; weeks and days become weeks."""
    text = column if tidied else tidy(column)
    low = F.lower(text)
    in_weeks = low.rlike(_WEEKS)
    w, d = (F.regexp_extract(low, _WEEKS, i).try_cast("double") for i in (1, 2))
    number = parse_number(text)
    at = F.regexp_instr(text, F.lit(r"[-0-9.,\s]+"))
    run = F.regexp_extract(text, r"[-0-9.,\s]+", 0)
    rest = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(run), F.length(text)))).otherwise(text)
    raw = F.lower(F.trim(rest))
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    unit = F.coalesce(F.try_element_at(known, raw), raw)
    return F.struct(
        F.when(in_weeks, F.bround(w + d / 7, 2)).otherwise(number).alias("value"),
        F.when(in_weeks, "SA").when(number.isNotNull(), unit).alias("unit"),
        number.isNotNull().alias("format_ok"),
    )


def normalised(column: Column, kind: Column, vocabulary: Column | None = None, tidied: bool = False) -> Column:
    """struct(marker, b, d, n, unit, sys, dia, s, format_ok) by field type; one branch is set.

    ``tidied``: the column is tidy already, so that the plan doesn't repeat that for every parser.

    ``vocabulary``: the matched canonical entry for texts, if a match was made.
    """
    text = column if tidied else tidy(column)
    mark = marker(column, tidied)
    date, number, pressure, amount = parse_date(text), parse_int(text, True), parse_pressure(text, True), parse_quantity(text, True)
    value = mark.isNull()
    is_kind = {k: value & (kind == k) for k in ("date", "int", "bp", "quantity", "text")}
    canonical = text if vocabulary is None else F.coalesce(vocabulary, text)
    ok = (
        F.when(mark.isNotNull(), True)
        .when(kind == "date", date.isNotNull())
        .when(kind == "int", number["format_ok"])
        .when(kind == "bp", pressure["format_ok"])
        .when(kind == "quantity", amount["format_ok"])
        .otherwise(True)
    )
    return F.struct(
        mark.alias("marker"),
        F.lit(None).cast("boolean").alias("b"),
        F.when(is_kind["date"], date).alias("d"),
        F.when(is_kind["int"], number["value"].cast("double")).when(is_kind["quantity"], amount["value"]).alias("n"),
        F.when(is_kind["quantity"], amount["unit"]).alias("unit"),
        F.when(is_kind["bp"], pressure["sys"]).alias("sys"),
        F.when(is_kind["bp"], pressure["dia"]).alias("dia"),
        F.when(is_kind["text"], canonical).when(value & ~ok, text).alias("s"),
        ok.alias("format_ok"),
    )


def same_value(a: Column, b: Column) -> Column:
    """Whether two normalised values agree; quantities by number alone, boxes and markers only with each other."""
    marked = a["marker"].isNotNull() | b["marker"].isNotNull()
    boxes = a["b"].isNotNull() | b["b"].isNotNull()
    numbers = a["n"].isNotNull() & b["n"].isNotNull()
    pressures = a["sys"].isNotNull() & b["sys"].isNotNull()
    plain = [comparable(F.coalesce(x["s"], x["d"].cast("string"), x["n"].cast("string"), F.lit(""))) for x in (a, b)]
    return (
        F.when(marked, a["marker"].eqNullSafe(b["marker"]))
        .when(boxes, a["b"].eqNullSafe(b["b"]))
        .when(numbers, F.abs(a["n"] - b["n"]) < 1e-6)
        .when(pressures, (a["sys"] == b["sys"]) & (a["dia"] == b["dia"]))
        .otherwise(plain[0] == plain[1])
    )
