"""The label index against comparing every text with every label."""

from __future__ import annotations

import random

import pytest

from loomwell.functions.text import _compared, weighted_ratio
from loomwell.operators import fuzzy

LABELS = ["blue anvil", "hot gear", "small ring", "old bolt", "ECONOMY", "MIDDLE EAST", "Âge", "ab", "Tension artérielle", "date du prochain rendez-vous", "x", "ta", "ab cd ef", "gear"]


def plain(texts, labels):
    out = {}
    for text in set(texts) - {None}:
        scored = [(-weighted_ratio(_compared(text), _compared(label)), label) for label in labels if label and _compared(label)]
        best = min(scored, default=(0.0, ""))
        if _compared(text) and -best[0] >= 80:
            out[text] = (best[1], -best[0])
    return out


def noisy(rng, label):
    text = list(label)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(text) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            text.insert(at, rng.choice("abcdexyz "))
        elif kind == 1 and at < len(text):
            text.pop(at)
        elif kind == 2 and at < len(text):
            text[at] = rng.choice("abcdexyz ")
        else:
            words = "".join(text).split()
            rng.shuffle(words)
            text = list(" ".join(words))
    return "".join(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_full_comparison(spark, seed):
    rng = random.Random(seed)
    more = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 8))) + rng.choice(["", " " + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))]) for _ in range(60)]
    labels = LABELS + more
    texts = [noisy(rng, rng.choice(labels)) for _ in range(1500)] + ["", None, " ", "axb cxd exf", "blue", "BLUE ANVIL", "anvil, blue"]
    got = fuzzy.best_labels(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(v,) for v in [*labels, None, labels[0]]], "label string")).collect()
    want = plain(texts, labels)
    assert {r.text: r.label for r in got} == {t: v[0] for t, v in want.items()}
    assert all(abs(r.score - want[r.text][1]) < 1e-9 for r in got) and len(want) > 500


def test_index_compares_few_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(2000)]
    labels = ["".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(200)]
    pairs = fuzzy.candidates(spark.createDataFrame([(w, w) for w in set(words)], "text_id string, form string"), spark.createDataFrame([(v, v) for v in set(labels)], "label_id string, form string"))
    assert pairs.count() < 0.05 * 2000 * 200


def test_least_ratio_and_no_rows(spark):
    none = spark.createDataFrame([], "text string")
    labels = spark.createDataFrame([("a",)], "label string")
    assert fuzzy.best_labels(none, labels).count() == 0
    with pytest.raises(ValueError):
        fuzzy.best_labels(none, labels, 50)


def test_letters_leave_few_pairs_and_lose_none():
    rng = random.Random(4)
    forms = sorted({_compared(v) for v in LABELS + [f"{a} {b}" for a in ("hot", "old", "new", "cold") for b in ("gear", "rod", "bolt", "widget")]})
    texts = sorted({_compared(noisy(rng, rng.choice(forms))) for _ in range(2000)} - {""})
    found = {(i, j) for i, labels in fuzzy.Letters(forms).near(texts) for j in labels}
    reach = {(i, j) for i, t in enumerate(texts) for j, f in enumerate(forms) if weighted_ratio(t, f) >= 80}
    assert reach <= found and all(fuzzy._may_reach(texts[i], forms[j]) for i, j in reach)
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(9)) for _ in range(2000)})
    assert sum(len(labels) for _, labels in fuzzy.Letters(forms).near(words)) < 0.05 * len(words) * len(forms)


def test_index_of_pairs_equals_letters(spark, monkeypatch):
    rng = random.Random(5)
    texts = spark.createDataFrame([(noisy(rng, rng.choice(LABELS)),) for _ in range(300)], "text string")
    labels = spark.createDataFrame([(v,) for v in LABELS], "label string")
    few = sorted(map(tuple, fuzzy.best_labels(texts, labels).collect()))
    monkeypatch.setattr(fuzzy, "COMPARED_LABELS", 3)
    assert few and sorted(map(tuple, fuzzy.best_labels(texts, labels).collect())) == few
    assert fuzzy.best_labels(texts, labels.where("label = ''")).count() == 0
