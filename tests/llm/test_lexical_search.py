"""Lexical search against a plain version that scores every document, over layouts of many sizes."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.llm import bisection, lexical_search
from loomwell.llm.lexical_search import Layout

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag, size in bags:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:10], 1)]
    return sorted(out, key=str)


def corpus(rows=600):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice((3, 20, 90)))) + rng.choice(("", " É çà", " Straße", ". X-ray"))) for k in range(rows)]
    docs += [(rows + k, docs[5][1]) for k in range(40)] + [(5, docs[5][1])] * 3  # copies and repeated rows tie
    docs += [(None, docs[5][1]), (None, None), (90001, None), (90002, ""), (90003, "... --"), (90004, "w1 " * 30000)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(25)] + [(50, docs[9][1]), (51, "nowhere"), (52, None), (53, ""), (None, "w1 w2"), (54, "W1 W1 É straße STRASSE ray")]
    return docs, items + [items[0]]


@pytest.mark.parametrize("layout", [Layout(), Layout(4000, 64, 1 << 20, 8), Layout(20000, 200, 900, 16), Layout(1000, 10**6, 1 << 20, 5)])
def test_search_equals_plain_version(spark, layout):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("score", F.lit(1)).withColumn("shard", F.lit("x"))
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    spent: list = []
    index = lexical_search.build(frame, layout=layout)
    got = lexical_search.search(index, queries, spent=spent).select("item_id", "rank", "doc_id", "score").collect()
    want = plain(docs, items)
    assert sorted(map(tuple, got), key=str) == want
    if layout.cluster_docs == 8:
        assert spent[0][0] < spent[0][1]  # bounds spare visits


def test_items_are_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_CHARS", 200)
    docs, items = corpus(100)
    got = lexical_search.ranked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    some, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_documents(none, items).count() == 0
    assert lexical_search.ranked_documents(some, no_items).count() == 0
    assert lexical_search.ranked_documents(spark.createDataFrame([(1, None), (2, "?!")], "doc_id long, text string"), items).count() == 0


def test_bisection_balances_and_separates_topics():
    rng = random.Random(3)
    topic = [k % 4 for k in range(256)]
    doc, term = [], []
    for k, t in enumerate(topic):
        own = sorted(set(rng.choices(range(50 * t, 50 * t + 50), k=12) + rng.choices(range(200, 220), k=3)))
        doc += [k] * len(own)
        term += own
    doc, term = np.array(doc), np.array(term)
    part = bisection.bisect(doc, term, 256, 220, 2)
    assert np.bincount(part).tolist() == [64] * 4
    purity = sum(max(Counter(topic[k] for k in np.flatnonzero(part == p)).values()) for p in range(4)) / 256
    assert purity > 0.9
    prefers, limit = bisection.preferences(part, doc, term, 220, 2)
    routed = [bisection.route(prefers, limit, term[doc == k].tolist(), 2) for k in range(256)]
    assert np.mean(np.array(routed) == part) > 0.85


def test_tree_sends_a_corpus_to_several_parts(spark):
    docs, _ = corpus()
    texts = spark.createDataFrame([d for d in docs if d[1]], "doc_id long, text string")
    tree = lexical_search.Tree.learn(texts, lexical_search.totals(texts), 20_000)
    assert tree.levels > 2 and tree.prefers.shape == (1 << tree.levels, len(tree.rows)) and len(tree.rows) > 50
    assert sum(tree.splits) >= 1 << tree.levels
    parts = Counter(tree.part_of(set(lexical_search.terms_of(d[1].encode()))) for d in docs if d[1] and d[1] != docs[5][1])
    assert len(parts) > 1 << tree.levels - 1
