"""Text functions as Column builders; Arrow functions only for Unicode forms and fuzzy scores.

Nulls give null unless a docstring says otherwise. Java's \\s, \\w and \\d are ASCII only, so
patterns that must see Unicode carry (?U).
"""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Arabic-Indic and Persian digits, and what they stand for.
EASTERN_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
# Letters that are read for digits in patient codes.
CONFUSED, CONFUSED_AS = "OQDILSZB", "00011528"
# Identity number and Moroccan telephone number.
IDENTITY_NUMBER = r"\b[A-Z]{1,2}\s?\d{5,7}\b"
TELEPHONE = r"(?:\+212|0)\s?[5-7](?:[\s.-]?\d{2}){4}"
# Scripts that a Latin register shouldn't hold.
UNEXPECTED_SCRIPT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0400}-\x{04FF}]"
# Accented Latin letters and their base letters (ß has none).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Canonical entries of the controlled vocabulary.
VOCABULARY = (
    "RAS", "Néant", "Aucun", "Aucune", "Neg", "Pos +", "Pos ++", "Oui", "Non", "Normal", "Normale", "Normales",
    "Normaux", "Pâles", "Fermé", "Ouvert", "Céphalique", "Siège", "Transverse", "Immune", "Non immune",
    "Voie basse", "Césarienne", "Cycles réguliers", "Cycles irréguliers", "Non fait", "Propre", "Propre, sèche",
    "Poursuivre l'allaitement exclusif", "Souffrance fœtale", "Utérus cicatriciel", "Pré-éclampsie sévère",
    "Sage-femme", "Lycée", "Collège", "Primaire", "Supérieur", "Analphabète",
    "Colorées", "Reçu", "Positif", "Négatif",
)


#: Characters whose NFKC form is one other ASCII character (full-width forms, superscripts, wide spaces).
COMPATIBLE = [(c, n) for c in map(chr, range(0xA0, 0x10000)) if (n := unicodedata.normalize("NFKC", c)) != c and len(n) == 1 and n.isascii()]


def _text(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode form NFKC; Spark has no function for it."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(values: pd.Series) -> pd.Series:
    """NFKD without combining marks."""

    def bare(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return values.map(lambda s: None if s is None else bare(s), na_action="ignore")


def tidy(column: Column | str, unicode_form: bool = False) -> Column:
    """Western digits, one space for white space, trimmed, in a compatible form.

    By default single characters take their ASCII form under NFKC, in the JVM; with ``unicode_form``
    all of NFKC is applied (ligatures and fractions, too), by an Arrow function.
    """
    text = nfkc(_text(column)) if unicode_form else _text(column)
    one, other = ("".join(part) for part in zip(*COMPATIBLE, strict=True))
    return F.trim(F.regexp_replace(F.translate(text, EASTERN_DIGITS + one, WESTERN_DIGITS + other), r"(?U)\s+", " "))


def strip_accents(column: Column | str) -> Column:
    """Base letters of the closed Latin set, in the JVM."""
    return F.translate(_text(column), ACCENTED, PLAIN)


def comparable(column: Column | str) -> Column:
    """The form in which texts are compared: tidy, without accents, lower case, decimal points."""
    return F.translate(F.lower(strip_accents(tidy(column))), ",", ".")


def slug(column: Column | str, longest: int = 40) -> Column:
    """Lower-case ASCII key with underscores, at most ``longest`` long, ``x`` if nothing is left."""
    text = F.lower(strip_accents(_text(column)))
    text = F.regexp_replace(F.regexp_replace(text, "œ", "oe"), "æ", "ae")
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    text = F.regexp_replace(F.substring(text, 1, longest), "_+$", "")
    return F.when(text == "", F.lit("x")).otherwise(text)


def code_form(column: Column | str) -> Column:
    """Upper-case letters and digits of a patient code; null counts as empty."""
    return F.regexp_replace(F.upper(F.coalesce(_text(column), F.lit(""))), r"[^\p{L}\p{N}]", "")


def fold_confused(column: Column | str) -> Column:
    return F.translate(_text(column), CONFUSED, CONFUSED_AS)


def has_personal_data(column: Column | str) -> Column:
    return _text(column).rlike(IDENTITY_NUMBER) | _text(column).rlike(TELEPHONE)


def has_unexpected_script(column: Column | str) -> Column:
    return F.coalesce(_text(column).rlike(UNEXPECTED_SCRIPT), F.lit(False))


def json_answer(column: Column | str) -> Column:
    """The JSON object in a model's answer: without a code fence, else the outermost braces, else ``{}``."""
    bare = F.regexp_replace(F.trim(_text(column)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)

    def if_object(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text)

    return F.coalesce(if_object(bare), if_object(inner), F.lit("{}"))


def answer_state(column: Column | str) -> Column:
    """erreur for a missing answer, vide for a blank one, illisible for the mark, else ecrit."""
    text = _text(column)
    return (
        F.when(text.isNull(), "erreur")
        .when(F.trim(text) == "", "vide")
        .when(F.lower(F.trim(text)).isin("<illisible>", "illisible"), "illisible")
        .otherwise("ecrit")
    )


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), by bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter text with a window of the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    ends = range(1, len(b) + len(a))
    return max(indel_ratio(a, b[max(0, e - len(a)) : e]) for e in ends)


def weighted_ratio(a: str, b: str) -> float:
    """The published weighted ratio: plain, token-sorted and token-set ratios, or partial ones for unlike lengths."""
    if not a or not b:
        return 0.0
    ta, tb = sorted(a.split()), sorted(b.split())
    both, only_a, only_b = (" ".join(sorted(s)) for s in (set(ta) & set(tb), set(ta) - set(tb), set(tb) - set(ta)))
    join_a, join_b = (both + " " + only_a).strip(), (both + " " + only_b).strip()
    long_share = max(len(a), len(b)) / min(len(a), len(b))
    base = indel_ratio(a, b)
    if long_share < 1.5:
        set_ratio = 100.0 if both and (not only_a or not only_b) else max(indel_ratio(join_a, join_b), *[indel_ratio(both, j) for j in (join_a, join_b) if both] or [0.0])
        return max(base, 0.95 * indel_ratio(" ".join(ta), " ".join(tb)), 0.95 * set_ratio)
    scale = 0.9 if long_share <= 8 else 0.6
    token = 100.0 if both else partial_ratio(only_a, only_b)
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * max(partial_ratio(" ".join(ta), " ".join(tb)), token))


def _compared(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).translate(str.maketrans(EASTERN_DIGITS, WESTERN_DIGITS))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(text.lower().replace(",", ".").split())


def near_vocabulary(column: Column | str, least: float = 88.0, entries: tuple[str, ...] = VOCABULARY) -> Column:
    """Whether a text can be like an entry at all, in the JVM: false only if :func:`vocabulary_match` gives null.

    An indel similarity of ``least`` leaves few edits for the lengths, and the edit distance never exceeds the
    indel distance. Texts with white space or letters beyond the closed Latin set aren't judged here.
    """
    text = _text(column)
    form, n = comparable(text), F.length(comparable(text))
    left = 1 - least / 100
    near = F.lit(False)
    for entry in sorted({_compared(e) for e in entries}):
        low, high = math.ceil(len(entry) * (1 - left) / (1 + left) - 1e-9), math.floor(len(entry) * (1 + left) / (1 - left) + 1e-9)
        most = math.floor((len(entry) + high) * left + 1e-9)
        near = near | (n.between(low, high) & (F.levenshtein(form, F.lit(entry), most) >= 0))
    judged = text.rlike(f"^[\\x21-\\x7E{ACCENTED}]*$")
    return F.coalesce(~judged | near, F.lit(False))


def vocabulary_match(least: float = 88.0, entries: tuple[str, ...] = VOCABULARY):
    """An Arrow function: the entry most like the text, or null below ``least``; ties go to the first entry."""
    import re

    gap = re.compile(r"\w \w")

    @F.pandas_udf(StringType())
    def match(values: pd.Series) -> pd.Series:
        forms = [(entry, _compared(entry)) for entry in entries]
        seen: dict[str, str | None] = {}

        def top(form: str, others: list[str]) -> tuple[float, int]:
            """Best score and entry. Entries that share too few characters with the text can't reach
            ``least`` and aren't compared."""
            near = []
            for i, f in enumerate(others):
                both = len(form) + len(f)
                if 200 * min(len(form), len(f)) >= least * both and 200 * sum(map(f.__contains__, form)) >= least * both:
                    near.append(i)
            return max(((indel_ratio(form, others[i]), -i) for i in near), default=(0.0, 0))

        def best(text: str) -> str | None:
            form = _compared(text)
            score, entry = top(form, [f for _, f in forms])
            if score < least and gap.search(text):
                score, entry = top(form.replace(" ", ""), [f.replace(" ", "") for _, f in forms])
            return forms[-entry][0] if score >= least else None

        for text in values.dropna().unique():
            seen[text] = best(text)
        return values.map(seen, na_action="ignore")

    return match


def without_ordinals(form: str) -> str:
    """French ordinals in one form: 2eme is 2e."""
    return form.replace("eme", "e")


def label_match(labels: list[str], least: float = 80.0):
    """An Arrow function: the label most like the text by weighted ratio, or null below ``least``."""

    @F.pandas_udf(StringType())
    def match(values: pd.Series) -> pd.Series:
        forms = [(label, without_ordinals(_compared(label))) for label in labels]
        seen = {}
        for text in values.dropna().unique():
            score, at = max(((weighted_ratio(without_ordinals(_compared(text)), f), -i) for i, (_, f) in enumerate(forms)), default=(0.0, 0))
            seen[text] = forms[-at][0] if score >= least else None
        return values.map(seen, na_action="ignore")

    return match
