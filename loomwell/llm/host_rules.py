"""Quality rules by host: a document is judged by what it is and by where it comes from.

One pass counts words, symbols, repeated lines and repeated three-word windows of every whole text. Rule failures
are then added up by host. A host of three documents that all fail says little, so every rate is shrunk:
a beta prior is fitted to the rates of all hosts (method of moments for beta-binomial counts), and a host's
rate is the mean of its posterior, (failures + a) / (documents + a + b). Verdicts go back to the documents:

- a host is *blocked* when its shrunk rate of base failures is ``BLOCKED`` or more: none of its documents stay;
- a host is *strict* for a rule when its shrunk rate of that rule is ``STRICT`` or more: its documents that fail
  the rule go. Elsewhere such a failure is forgiven;
- a document that fails the base rule goes whatever its host.

Defined cases: a null text has no words and fails the base rule; so does any text of under ``LEAST_WORDS`` words; an empty
table gives no rows; texts of any length are read whole; a document without a host is judged by the base rule alone and
isn't counted for any host; repeated rows count and come out once each; rates that equal a limit reach it;
where no host or no failure exists, no prior is needed and no host is strict; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.llm.shared import materialise, small_batches, text_or_empty

LEAST_WORDS = 50
#: Per cent of words in repeated windows beyond which a text fails by itself.
MOST_REPEATED = 50
STRICT = 0.2
BLOCKED = 0.6
#: Bytes of host names, with 16 for each row, that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    kinds = len(number)
    # pairs get numbers below n, so a pair's number and the third word's fit in 64 bits
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, times = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    hit = times[which] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([counts_of(text) for text in batch.column(2).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        columns = [batch.column(0), batch.column(1)] + [pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", *COUNTS])


def text_counts(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host and COUNTS: one narrow row per document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def host_of(url: Column) -> Column:
    """The host of a URL, without a leading www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


#: Per rule, when a document fails it. All are comparisons of whole numbers.
RULES: dict[str, str] = {
    "base": f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}


@dataclass(frozen=True)
class Prior:
    """A beta distribution of failure rates, by its two parameters."""

    a: float
    b: float

    @staticmethod
    def fit(hosts: int, docs: int, squares: int, failures: int, spread: float) -> Prior:
        """Moments of beta-binomial counts: ``squares`` is the sum of n * n over hosts, ``spread`` that of f * f / n.

        With no overdispersion left over (or fewer than two hosts) the prior is as strong as all documents.
        """
        p = failures / docs if docs else 0.0
        if p in (0.0, 1.0):
            return Prior(p * max(docs, 1), (1 - p) * max(docs, 1))
        room = docs - squares / docs - (hosts - 1)
        between = (spread - p * p * docs - p * (1 - p) * (hosts - 1)) / (p * (1 - p) * room) if hosts > 1 and room > 0 else 0.0
        strength = 1 / min(max(between, 1 / (1 + docs)), 0.999) - 1
        return Prior(p * strength, (1 - p) * strength)


def host_rates(counts: DataFrame) -> DataFrame:
    """host, docs and for each rule its failures and shrunk rate (``rate_<rule>``), one row per host.

    The driver learns a few sums over hosts, no host.
    """
    fails = [F.sum(F.expr(rule).cast("long")).alias(f"fail_{name}") for name, rule in RULES.items()]
    hosts, _ = materialise(counts.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *fails), "host-failures", narrow=True)
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("docs")).alias("squares")]
    for name in RULES:
        f = F.col(f"fail_{name}")
        sums += [F.sum(f).alias(f"fail_{name}"), F.sum(f * f / F.col("docs")).alias(f"spread_{name}")]
    total = hosts.agg(*sums).first()
    rates = []
    for name in RULES:
        prior = Prior.fit(total["hosts"], total["docs"] or 0, total["squares"] or 0, total[f"fail_{name}"] or 0, total[f"spread_{name}"] or 0.0)
        rates.append(((F.col(f"fail_{name}") + F.lit(prior.a)) / (F.col("docs") + F.lit(prior.a + prior.b))).alias(f"rate_{name}"))
    return hosts.select("*", *rates)


def host_verdicts(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, COUNTS, base_failed, host_blocked, host_strict (rules of its host that it fails) and kept.

    Only hosts with a verdict against them are joined back: by broadcast while their names are few bytes, else by a
    shuffle in which adaptive execution splits a hot host.
    """
    counts, _ = materialise(text_counts(docs, host, id_col, text_col), "text-counts")
    strict = F.array_compact(F.array(*[F.when(F.col(f"rate_{name}") >= STRICT, F.lit(name)) for name in RULES]))
    verdicts = host_rates(counts).select("host", (F.col("rate_base") >= BLOCKED).alias("blocked"), strict.alias("strict")).where("blocked OR size(strict) > 0")
    verdicts, _ = materialise(verdicts, "host-verdicts", narrow=True)
    size = verdicts.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    failed = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]))
    judged = counts.join(F.broadcast(verdicts) if size <= BROADCAST_BYTES else verdicts.hint("merge"), "host", "left")
    return judged.select(
        "doc_id",
        "host",
        *COUNTS,
        F.expr(RULES["base"]).alias("base_failed"),
        F.coalesce("blocked", F.lit(False)).alias("host_blocked"),
        F.coalesce(F.array_intersect(failed, "strict"), F.array().cast("array<string>")).alias("host_strict"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_blocked") & (F.size("host_strict") == 0))


def _oracle() -> str:
    rates, prior, verdict = [], [], []
    for name, rule in RULES.items():
        rates.append(f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS f_{name}")
        p, k = f"(sum(f_{name}) / sum(docs))", "(count(*) - 1)"
        between = f"(sum(f_{name} * f_{name} / docs) - {p} * {p} * sum(docs) - {p} * (1 - {p}) * {k}) / ({p} * (1 - {p}) * (sum(docs) - sum(docs * docs) / sum(docs) - {k}))"
        strength = f"CASE WHEN {p} IN (0, 1) THEN sum(docs) WHEN count(*) < 2 THEN sum(docs) ELSE 1 / least(greatest({between}, 1 / (1 + sum(docs))), 0.999) - 1 END"
        prior += [f"{p} AS p_{name}", f"{strength} AS s_{name}"]
        verdict.append(f"(f_{name} + p_{name} * s_{name}) / (docs + s_{name}) AS r_{name}")
    strict = " OR ".join(f"(coalesce(r_{name}, 0) >= {STRICT} AND ({rule}))" for name, rule in RULES.items())
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), seq AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d
), tri AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM seq WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS times FROM tri WHERE w3 IS NOT NULL
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (VALUES (0), (1), (2)) o(k) WHERE times > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), c AS (
  SELECT d.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), h AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS docs, {", ".join(rates)} FROM c WHERE source IS NOT NULL GROUP BY source
), p AS (SELECT {", ".join(prior)} FROM h), v AS (SELECT source, {", ".join(verdict)} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES["base"]}) AS base_failed,
       NOT ({RULES["base"]}) AND coalesce(r_base, 0) < {BLOCKED} AND NOT ({strict}) AS kept
FROM c LEFT JOIN v USING (source)
"""


ORACLE = _oracle()
