"""From signals of a zone and readings of it to a status with a confidence.

All inputs are columns of one row per zone: ``visible, ink, contrast, ai_down, align, quality,
glare`` and the reading ``read`` (whether a reader was called), ``state, text, conf,
contradictory, norm`` (a normalised struct), and the second reader's ``norm2``, ``text2`` and ``odd2``
(its value is implausible). The order of the steps is part of the meaning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions.parse import same_value
from loomwell.functions.text import has_unexpected_script
from loomwell.operators.model import ILLEGIBLE, KNOWN, NOT_GIVEN, TO_REVIEW, UNKNOWN


@dataclass(frozen=True)
class Limits:
    """Thresholds of the decision."""

    known: float = 0.85
    ink_empty: float = 0.0005
    ink_written: float = 0.008
    visible: float = 0.90
    glare: float = 0.20
    contrast: float = 15.0
    default_confidence: float = 0.80
    # what each signal leaves of a reading's confidence
    contradictory: float = 0.9
    no_ink: float = 0.4
    script: float = 0.5
    format: float = 0.55
    disagrees: float = 0.95
    agrees: float = 0.97
    glared: float = 0.6
    align_base: float = 0.6
    quality_base: float = 0.7
    # confidence that an unread zone is blank
    blank_most: float = 0.97
    blank_base: float = 0.55
    blank_clarity: float = 0.42
    clear_contrast: float = 40.0
    blank_align_base: float = 0.7
    blank_quality_base: float = 0.8
    unsure_empty: float = 0.3
    illegible_most: float = 0.5


# What the midwife reads about each step that decided.
REASONS = {
    "off_frame": "Zone hors de la photo : reprendre la photo ou saisir à la main.",
    "blank": "Zone vide (aucune encre).",
    "blank_unsure": "Zone probablement vide, mais la photo est peu contrastée à cet endroit.",
    "ai_down": "Lecture IA indisponible : saisie manuelle.",
    "degraded": "Zone peu lisible sur la photo (reflet, ombre ou flou) : impossible d'affirmer qu'elle est vide. Reprendre la photo ou vérifier.",
    "error": "Lecture IA en échec. À relire ou saisir.",
    "illegible": "Le modèle n'arrive pas à lire cette écriture.",
    "unknown": "Noté « inconnu » sur le registre.",
    "empty_unsure": "Zone dégradée (reflet/ombre) : « vide » non confirmé.",
    "empty_but_ink": "Le modèle voit une zone vide mais il y a de l'encre : à vérifier.",
    "empty": "Zone vide.",
    "empty_mark": "Tiret : examen non fait.",
    "no_ink": "Valeur lue alors que la zone semble vide (hallucination possible).",
    "script": "Écriture inattendue dans la lecture (chiffres arabes-indiens ou cyrillique) : à vérifier.",
    "format": "Format inattendu.",
    "glare": "Reflet sur la zone.",
    "uncertain": "Lecture incertaine (confiance %.2f).",
    "box_off_frame": "Case hors de la photo.",
    "box_unsure": "Case ambiguë (encre %.2f).",
}


def route(ink: Column, degraded: Column, glare: Column, visible: Column, read_all: bool = False, limits: Limits = Limits()) -> Column:
    """Which zones a reader gets: ``off_frame``, ``read`` or ``blank``."""
    wanted = F.lit(read_all) | F.coalesce(degraded, F.lit(False)) | (ink >= limits.ink_empty) | (glare > limits.glare)
    return F.when(visible < limits.visible, "off_frame").when(wanted, "read").otherwise("blank")


def _leaves(base: float, signal: Column) -> Column:
    """The share of a confidence that a signal from 0 to 1 leaves: ``base`` at 0, all at 1."""
    return base + (1 - base) * signal


def decide_text(zones: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Add ``status``, ``confidence``, ``rule`` (the step that decided), ``reasons``, ``value``, ``display`` and ``method``."""
    c = F.col
    align, quality = F.coalesce(c("align"), F.lit(1.0)), F.coalesce(c("quality"), F.lit(1.0))
    visible, ink, glare = F.coalesce(c("visible"), F.lit(1.0)), F.coalesce(c("ink"), F.lit(0.0)), F.coalesce(c("glare"), F.lit(0.0))
    lm = limits
    clarity = F.when(c("contrast").isNull(), 1.0).otherwise(F.least(F.lit(1.0), c("contrast") / lm.clear_contrast))
    blank_align, blank_quality = _leaves(lm.blank_align_base, align), _leaves(lm.blank_quality_base, quality)
    blank = F.least(F.lit(lm.blank_most), (lm.blank_base + lm.blank_clarity * clarity) * blank_align * blank_quality)
    clear = c("contrast").isNull() | (c("contrast") >= limits.contrast)
    ai_down = F.coalesce(c("ai_down"), F.lit(False))
    given = F.coalesce(c("conf"), F.lit(limits.default_confidence))
    mark = F.when(c("state") == "vide", "vide").otherwise(c("norm.marker"))

    no_ink, odd_script, odd_format, glared = ink < lm.ink_empty, has_unexpected_script("text"), ~c("norm.format_ok"), glare > lm.glare
    second = c("text2").isNotNull() & (c("text2") != "") & c("norm2.format_ok") & ~F.coalesce(c("odd2"), F.lit(False))

    def times(hit: Column, share: float) -> Column:
        return F.when(hit, F.lit(share)).otherwise(F.lit(1.0))

    # every signal is one factor, in order; so the confidence stands once in the plan, not twice per signal
    conf = given * times(F.coalesce(c("contradictory"), F.lit(False)), lm.contradictory) * times(no_ink, lm.no_ink) * times(odd_script, lm.script) * times(odd_format, lm.format)
    conf = F.greatest(conf * times(second & ~c("_agrees"), lm.disagrees), F.when(second & c("_agrees"), F.lit(lm.agrees)))
    conf = conf * times(glared, lm.glared) * _leaves(lm.align_base, align) * _leaves(lm.quality_base, quality)
    zones = zones.withColumn("_agrees", same_value(c("norm"), c("norm2")))
    zones = zones.withColumn("_second", second).withColumn("_conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))
    conf, agrees, second = c("_conf"), c("_agrees"), c("_second")

    def out(rule: str, status: str | Column, confidence: Column | float, reasons: Column | None = None) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
        reasons = F.array(F.lit(REASONS[rule])) if reasons is None else reasons
        return F.struct(status.alias("status"), confidence.cast("double").alias("confidence"), F.lit(rule).alias("rule"), reasons.alias("reasons"))

    said = F.array_compact(
        F.array(*[F.when(F.coalesce(hit, F.lit(False)), REASONS[name]) for name, hit in (("no_ink", no_ink), ("script", odd_script), ("format", odd_format), ("glare", glared))])
    )
    uncertain = F.array(F.format_string(REASONS["uncertain"], conf))
    value_reasons = F.when((conf < lm.known) & (F.size(said) == 0), uncertain).otherwise(said)
    blank_reasons = F.array(F.when(blank >= lm.known, REASONS["blank"]).otherwise(REASONS["blank_unsure"]))
    empty_reasons = F.array(F.when(F.coalesce(c("text"), F.lit("")) != "", REASONS["empty_mark"]).otherwise(REASONS["empty"]))

    unread = ~F.coalesce(c("read"), F.lit(False))
    decided = (
        F.when(visible < limits.visible, out("off_frame", TO_REVIEW, 0.0))
        .when(
            unread & (ink < limits.ink_empty) & ~ai_down & clear,
            out("blank", F.when(blank >= limits.known, NOT_GIVEN).otherwise(TO_REVIEW), blank, blank_reasons),
        )
        .when(unread & ai_down, out("ai_down", TO_REVIEW, 0.0))
        .when(unread, out("degraded", TO_REVIEW, 0.0))
        .when(c("state") == "erreur", out("error", TO_REVIEW, 0.0))
        .when(c("state") == "illisible", out("illegible", ILLEGIBLE, F.least(given, F.lit(lm.illegible_most))))
        .when(mark == "inconnu", out("unknown", UNKNOWN, given))
        .when((mark == "vide") & (c("state") == "vide") & (c("contrast") < limits.contrast), out("empty_unsure", TO_REVIEW, lm.unsure_empty))
        .when((mark == "vide") & (c("state") == "vide") & (ink > limits.ink_written), out("empty_but_ink", TO_REVIEW, lm.unsure_empty))
        .when(mark == "vide", out("empty", NOT_GIVEN, given, empty_reasons))
        .otherwise(out("value", F.when(conf >= limits.known, KNOWN).otherwise(TO_REVIEW), conf, value_reasons))
    )
    # one generated row per zone: the optimiser keeps the decision whole instead of repeating it for every field
    found = zones.select("*", F.explode(F.array(decided)).alias("_decided")).select(*zones.columns, "_decided.*")
    # a value stands only where one was read; the second reader's agreement shows in the method
    value = F.when(F.col("rule") == "value", F.col("norm"))
    method = F.when((F.col("rule") == "value") & second & agrees, "vlm+second").otherwise("vlm")
    return found.withColumn("value", value).withColumn("display", F.when(F.col("rule").isin("value", "illegible", "unknown", "empty"), F.coalesce("text", F.lit("")))).withColumn("method", method).drop("_agrees", "_second", "_conf")


def decide_checkbox(conf: Column, align: Column, visible: Column | None = None, limits: Limits = Limits()) -> Column:
    """struct(status, confidence) of a checkbox; one outside the photo goes to review with confidence 0."""
    found = conf * (limits.align_base + (1 - limits.align_base) * F.coalesce(align, F.lit(1.0)))
    if visible is not None:
        found = F.when(F.coalesce(visible, F.lit(1.0)) < limits.visible, 0.0).otherwise(found)
    return F.struct(F.when(found >= limits.known, KNOWN).otherwise(TO_REVIEW).alias("status"), found.alias("confidence"))


def checkbox_confidence(ink: Column, threshold: float = 0.10, spread: float = 0.05) -> Column:
    """struct(checked, confidence): logistic in the distance of the ink share from the threshold."""
    distance = (ink - threshold) / spread
    return F.struct((ink > threshold).alias("checked"), (1 / (1 + F.exp(-2.2 * F.abs(distance)))).alias("confidence"))


def token_confidence(answers: DataFrame, tokens: DataFrame) -> DataFrame:
    """(answer_id, confidence): exp of the mean log-probability of the tokens that overlap an answer's span.

    ``answers``: call_id, answer_id, begin, end. ``tokens``: call_id, seq, text, logprob.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy("call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.withColumn("stop", F.sum(F.length("text")).over(so_far)).withColumn("start", F.col("stop") - F.length("text"))
    met = answers.join(placed, "call_id").where("start < end AND stop > begin")
    return met.groupBy("call_id", "answer_id").agg(F.exp(F.avg("logprob")).alias("confidence"))
