"""The label most like a text by the weighted ratio, found through an index of letter pairs instead of comparing with every label.

A weighted ratio of 80 or more leaves few edits, so texts and labels that reach it share pairs of neighbouring letters; the join on pairs, with
the least count as a filter, loses nothing. What passes is scored exactly. Both sides are compared in their comparable form.

Why that is sound. Every part of the ratio is an indel ratio: of both texts with their words in some order (80 or more), or, once the longer one is half as long again, of
the shorter one and a window of the longer one that is no longer (88.9 or more). Let the shorter one have M characters in t words, so M - 1 - 2 (t - 1)
pairs within words, the longer one n, and let L characters stay in order. A character taken from the shorter one breaks two pairs at most, one put into it one
pair: 2 (M - L) + (n - L) together. With L >= 0.4 (M + n) at least 0.2 (M + n) - 1 - 2 (t - 1) pairs stay; with a window, 0.6 M - 1 - 2 (t - 1). That
is one or more from M = 5 t on, and for single words by cases from M = 3 on; shorter texts meet all labels that share a letter. Beyond eight times the
length no ratio reaches 80. Two texts of several words may also reach it by a word that they share whole: for them one pair is enough.

Few labels need no index: every text is held against all of them by the letters that both have, as matrices, and only what that leaves is scored.
A ratio of 80 needs C >= 0.4 (M + n) common characters, in any order, or with a window C >= 0.8 of the shorter one, or a word that both share whole; repeated
words of a text count once in its length. The same bound goes before the score of what the index finds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions.text import comparable, weighted_ratio

#: Labels that are broadcast at most, with their pairs; more are joined by a shuffle.
BROADCAST_LABELS = 20_000
#: Labels with which every text is compared by letters at most; more are found through the index of pairs.
COMPARED_LABELS = 1_000
#: Cells of a matrix of texts, labels and letters at once.
CELLS = 4_000_000


LEAST = 80.0


def _words(form: Column) -> Column:
    return F.size(F.split(form, " "))


def letter_pairs(form: Column) -> Column:
    """Pairs of neighbouring letters within words, with repeats."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(form) - 1, F.lit(1))), lambda i: F.substring(form, i, F.lit(2)))
    return F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.contains(" "))


def _weak(form: Column) -> Column:
    """Whether pairs can say nothing about a text: it is too short for its words, or a word is one letter."""
    return (F.length(form) < F.when(_words(form) == 1, 3).otherwise(5 * _words(form))) | F.exists(F.split(form, " "), lambda w: F.length(w) < 2)


def candidates(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_id, label_id) of all pairs that may reach a ratio of LEAST. ``texts``: text_id, form; ``labels``: label_id, form; forms are comparable ones."""
    few = labels.count() <= BROADCAST_LABELS
    near = lambda df: F.broadcast(df) if few else df
    form = F.col("form")
    shape = [_weak(form).alias("weak"), F.length(form).alias("n"), _words(form).alias("words")]
    t = texts.select("text_id", "form", *shape)
    lab = labels.select("label_id", "form", *[c.alias(f"l_{name}") for c, name in zip(shape, ("weak", "n", "words"), strict=True)])
    one = F.count(F.lit(1))
    mine = t.where("NOT weak").select("text_id", "n", "words", F.explode(letter_pairs(form)).alias("pair")).groupBy("text_id", "n", "words", "pair").agg(one.alias("c"))
    index = lab.where("NOT l_weak").select("label_id", "l_n", "l_words", F.explode(letter_pairs(form)).alias("pair")).groupBy("label_id", "l_n", "l_words", "pair").agg(one.alias("l_c"))
    met = mine.join(near(index), "pair").groupBy("text_id", "label_id").agg(F.sum("c").alias("c"), F.sum("l_c").alias("l_c"), *[F.first(c).alias(c) for c in ("n", "words", "l_n", "l_words")])
    mine_short = F.col("n") <= F.col("l_n")
    m, n, words = F.least("n", "l_n"), F.greatest("n", "l_n"), F.when(mine_short, F.col("words")).otherwise(F.col("l_words"))
    stay = F.when(n < 1.5 * m, 0.2 * (m + n)).otherwise(F.least(0.6 * m, 0.2 * (m + n)))
    need = F.greatest(F.lit(1), F.ceil(stay - 1 - 2 * (words - 1) - 1e-9))
    several = (F.col("words") > 1) & (F.col("l_words") > 1)
    enough = (n <= 8 * m) & (several | (F.when(mine_short, F.col("c")).otherwise(F.col("l_c")) >= need))
    shared = met.where(enough).select("text_id", "label_id")
    letters = F.explode(F.array_distinct(F.filter(F.split(form, ""), lambda x: (x != "") & (x != " ")))).alias("letter")
    one_letter, other = t.select("text_id", "weak", letters), lab.select("label_id", "l_weak", letters)
    loose = one_letter.where("weak").join(near(other), "letter").select("text_id", "label_id")
    loose = loose.unionByName(one_letter.where("NOT weak").join(near(other.where("l_weak")), "letter").select("text_id", "label_id"))
    return shared.unionByName(loose.distinct()).distinct()


def _plain(form: str) -> str:
    """A form with each different word once: as short as any text that the ratio compares."""
    return " ".join(dict.fromkeys(form.split()))


def _may_reach(a: str, b: str) -> bool:
    """The bound by common letters for one pair."""
    common, m, n = (Counter(" ".join(a.split())) & Counter(" ".join(b.split()))).total(), len(_plain(a)), len(_plain(b))
    return common >= min(0.8 * min(m, n), 0.4 * (m + n)) - 1e-9 or not set(a.split()).isdisjoint(b.split())


class Letters:
    """The letters of labels, as counts: finds the labels that may reach LEAST with a text."""

    def __init__(self, forms: list[str]):
        self.forms = forms
        self.alphabet = np.array(sorted({ord(c) for form in forms for c in " ".join(form.split())}), dtype=np.uint32)
        self.counts, self.short = self._counts(forms), np.array([len(_plain(f)) for f in forms])
        self.long = np.array([len(f) for f in forms])
        self.words: dict[str, list[int]] = {}
        for i, form in enumerate(forms):
            for word in set(form.split()):
                self.words.setdefault(word, []).append(i)

    def _counts(self, forms: list[str]) -> np.ndarray:
        tidy = [" ".join(f.split()) for f in forms]
        codes = np.frombuffer("".join(tidy).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(len(tidy)), [len(t) for t in tidy])
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        known = self.alphabet[at] == codes
        flat = np.bincount(row[known] * len(self.alphabet) + at[known], minlength=len(tidy) * len(self.alphabet))
        return flat.reshape(len(tidy), len(self.alphabet)).astype(np.int32)

    def near(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(text, labels) by place, for the texts with any label."""
        step = max(1, CELLS // max(1, self.counts.size))
        for start in range(0, len(texts), step):
            part = texts[start : start + step]
            counts, common = self._counts(part), np.zeros((len(part), len(self.forms)), dtype=np.int32)
            for letter in range(len(self.alphabet)):
                common += np.minimum(counts[:, letter, None], self.counts[None, :, letter])
            short, long = np.array([len(_plain(t)) for t in part])[:, None], np.array([len(t) for t in part])[:, None]
            most, least = np.maximum(long, self.long), np.minimum(long, self.long)
            window = (most >= 1.5 * least) & (common >= 0.8 * np.minimum(short, self.short) - 1e-9)
            may = window | (common >= 0.4 * (short + self.short) - 1e-9)
            for i, text in enumerate(part):
                if " " in text:
                    may[i, [label for word in text.split() for label in self.words.get(word, [])]] = True
            may &= most <= 8 * least
            for i in np.flatnonzero(may.any(axis=1)):
                yield start + int(i), np.flatnonzero(may[i]).tolist()


def _compared_with_all(mine: DataFrame, labels: list[tuple[str, str]], least: float) -> DataFrame:
    """(text, label, score) of ``mine`` (text, form) against ``labels`` (label, form), each text in its own task."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not labels:
            return
        letters = Letters([form for _, form in labels])
        for batch in batches:
            texts, forms, out = batch["text"].tolist(), batch["form"].tolist(), []
            for i, found in letters.near(forms):
                score, label = min((-weighted_ratio(forms[i], labels[j][1]), labels[j][0]) for j in found)
                if -score >= least:
                    out.append((texts[i], label, -score))
            yield pd.DataFrame(out, columns=["text", "label", "score"])

    return mine.select("text", "form").mapInPandas(best, "text string, label string, score double")


def best_labels(texts: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """(text, label, score): for each distinct text the label with the highest weighted ratio of at least ``least``; ties go to the
    smallest label. Texts without such a label don't come out. ``texts`` and ``labels`` have one column each, text and label; nulls are left out.
    """
    if least < LEAST:
        raise ValueError(f"the index needs a ratio of {LEAST:g} at least")
    mine = texts.select("text").dropna().distinct().withColumn("form", comparable(F.col("text"))).where("form <> ''").withColumn("text_id", F.col("form"))
    lab = labels.select("label").dropna().distinct().withColumn("form", comparable(F.col("label"))).where("form <> ''").withColumn("label_id", F.col("label"))
    few = lab.select("label_id", "form").limit(COMPARED_LABELS + 1).collect()
    if len(few) <= COMPARED_LABELS:
        return _compared_with_all(mine, [tuple(r) for r in few], least)
    forms = mine.select("text_id", "form").distinct()
    pairs = candidates(forms, lab.select("label_id", "form"))
    named = pairs.join(lab.select("label_id", F.col("form").alias("other")), "label_id")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = [weighted_ratio(a, b) if _may_reach(a, b) else 0.0 for a, b in zip(batch["text_id"], batch["other"], strict=True)]
            yield batch.loc[batch["score"] >= least, ["text_id", "label_id", "score"]]

    scored = named.select("text_id", "label_id", "other").mapInPandas(score, "text_id string, label_id string, score double")
    best = scored.groupBy("text_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("label_id").alias("label"))).alias("_b"))
    return mine.join(best, "text_id").select("text", F.col("_b.label").alias("label"), (-F.col("_b.s")).alias("score"))
