"""Odd input, repeated rows, crashes, and naive versions of what the corpus operators compute."""

import random
import threading
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_llm_operators import docs, labelled, words

from loomwell.llm import bpe, components, exact_dedup, language, packing, quality, shards, shingle_join, toxicity
from loomwell.llm.memory import Bounded, held

LONG = "word of a very long text " * 20_000


def test_rows_are_dropped_and_not_ids(spark):
    rows = [(0, "b c d e f g"), (1, "b c d e f g"), (1, "unique words stand in this text"), (2, "said twice in equal rows"), (2, "said twice in equal rows"), (None, "no id"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, digest string, n_bare int")
    want = sorted([(0, rows[0][1]), (1, rows[2][1]), (2, rows[3][1]), (3, None), (None, "no id")], key=str)
    exact = exact_dedup.keep_one(df)
    assert exact.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=str) == want
    near = sorted(((r.doc_id, r.text) for r in shingle_join.keep_first(df.where("doc_id IS NOT NULL")).collect()), key=str)
    assert near == sorted([w for w in want if w[0] is not None] + [(4, "")], key=str)


def test_the_longest_of_equal_texts_stays_and_heads_are_not_enough(spark):
    head = "x" * 200
    rows = [(5, head + "a"), (6, head + "b"), (7, head + " a"), (8, head + "a"), (9, "y" * 201)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.keep_one(df).collect()) == [6, 7, 9]


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError, match="settle"):
        components.components(chain, most_steps=1)


def test_sets_that_share_a_common_passage_are_no_candidates(spark, monkeypatch):
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(words(i, 60, 10**6) + passage) for i in range(120)]
    near = texts[3].split()
    near[10] = "changed"
    texts.append(" ".join(near))
    seen = []
    searched = shingle_join.links
    monkeypatch.setattr(shingle_join, "links", lambda t, candidates, k, p: seen.append(candidates.count()) or searched(t, candidates, k, p))
    got = {r.doc_id: r.component_id for r in shingle_join.shingle_groups(docs(spark, texts), 5, 80).collect()}
    assert got[120] == 3 and all(got[i] == i for i in range(120))
    assert seen[0] < 60  # most sets leave the passage's keys out


@pytest.fixture()
def store(spark, tmp_path):
    schema = "doc_id long, text string"
    rows = lambda n: spark.createDataFrame([(i, f"t{i}") for i in range(n)], schema)
    make = lambda **k: shards.Store(spark, f"file://{tmp_path}/store", rows(1).schema, **k)
    return make, rows


def test_a_writer_lost_between_claim_and_rename_blocks_nobody_for_long(store):
    make, rows = store
    one = make(lease=1.0)
    one.append(rows(3))
    one._claim(2)  # and the writer is gone
    with pytest.raises(shards.Conflict):
        one.commit(one.manifest(), 2)
    assert one.version() == 1 and one.read().count() == 3
    assert one.append(rows(2)) == 2 and one.read().count() == 5
    one.fs.create(one._path("tmp-left"), False).close()
    time.sleep(1.1)
    make(lease=0.0, keep_seconds=0).vacuum()
    assert not one._names("tmp-*") and one.read().count() == 5


def test_a_slow_writer_comes_second(store):
    make, rows = store
    slow, fast = make(lease=2.0), make(lease=2.0)
    claim, first = slow._claim, [True]

    def late(version):
        name = claim(version)
        if first and first.pop():
            time.sleep(2.1)  # the claim is over before the manifest is written
            fast.append(rows(4))
        return name

    slow._claim = late
    assert slow.append(rows(3)) == 2 and slow.read().count() == 7


def test_writers_at_once_lose_nothing_and_old_versions_stay(store):
    make, rows = store
    stores = [make() for _ in range(3)]
    threads = [threading.Thread(target=s.append, args=(rows(10 + i),)) for i, s in enumerate(stores)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    one = make()
    assert one.version() == 3 and one.read().count() == 33
    frame = one.read(2)
    n = frame.count()
    one.compact()
    assert one.version() > 3 and frame.count() == n and one.read(1).count() < 33 and one.read().count() == 33
    gone = one.manifest(1)[0].path
    with pytest.raises(shards.Conflict):
        one.change({gone}, [])
    make(keep_seconds=0).vacuum()
    assert len(one._names("manifest-*")) == 1 and one.read().count() == 33


def test_repeated_long_and_clashing_rows(spark):
    df, labels, *_ = labelled(spark, 60)
    odd = docs(spark, [LONG, LONG, None], first=900).selectExpr("*", "'x' AS score", "'x' AS held_out", "'x' AS n_tokens", "'x' AS lang_pred")
    twice = df.selectExpr("*", "'x' AS score", "'x' AS held_out", "'x' AS n_tokens", "'x' AS lang_pred").unionByName(odd).unionByName(odd)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for rows in (quality.quality_scores(twice, labels), toxicity.toxicity_scores(twice, labels), language.languages(twice), bpe.encode_documents(twice, ranks, public_tokenizers.PATTERN)):
        got = rows.where("doc_id >= 900").drop("spans", "evidence").collect()
        assert len(got) == 6 and len(set(got)) == 3  # a repeated row is scored each time, alike
        first, second = ({tuple(r)[1:] for r in got if r.doc_id == i} for i in (900, 901))
        assert {f[1:] if isinstance(f[0], bool) else f for f in first} == {f[1:] if isinstance(f[0], bool) else f for f in second}
    pieces = packing.pack(twice.where("doc_id >= 900"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert sum(p.length for p in pieces if p.doc_id == 900) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 900)


def test_additive_scores_equal_a_naive_sum():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y)
    for row, score in zip(x[:40], model.scores(x[:40]), strict=True):
        total = model.base
        for j, table in enumerate(model.tables):
            total += table[sum(value >= cut for cut, value in ((c, row[j]) for c in model.cuts[j]))]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(row[i] >= c for c in model.coarse[i]), sum(row[j] >= c for c in model.coarse[j])]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    g, h = r.normal(size=9), r.random(9) + 0.5
    tree = quality._shallow_tree(g, h, 1, 2.0, 0.1)
    gains = {at: g[:at].sum() ** 2 / (h[:at].sum() + 2) + g[at:].sum() ** 2 / (h[at:].sum() + 2) for at in range(1, 9)}
    at = max(gains, key=gains.get)
    if gains[at] > g.sum() ** 2 / (h.sum() + 2) + 1e-9:
        assert np.allclose(tree[:at], g[:at].sum() / (h[:at].sum() + 2)) and np.allclose(tree[at:], g[at:].sum() / (h[at:].sum() + 2))


def test_paths_equal_plain_viterbi():
    r = np.random.default_rng(6)
    model = language.Model.fit(["a b"] * 2, ["aa", "bb"])
    for n in (1, 2, 7, 40):
        for scale in (1, 4, 12):
            for _ in range(20):
                scores = (-r.random((n, 3)) * scale).round(1).astype(np.float32)
                best = [(float(s), None) for s in scores[0]]
                for row in scores[1:]:
                    top = max(v for v, _ in best)
                    best = [(max(v, top - language.SWITCH) + float(s), None) for (v, _), s in zip(best, row, strict=True)]
                path = model.path(scores)
                got = sum(float(scores[i, k]) for i, k in enumerate(path)) - language.SWITCH * (np.diff(path) != 0).sum()
                assert got == pytest.approx(max(v for v, _ in best), abs=1e-3)


def test_long_unspaced_han_and_thai():
    r = random.Random(5)
    glued = lambda low, n: "".join(chr(low + r.randrange(60)) for _ in range(n))
    pools = {"zh": 0x4E00, "ja": 0x5200, "th": 0x0E01}
    texts, langs = zip(*[(glued(low if k != "th" else 0x0E01, 300), k) for k, low in pools.items() for _ in range(15)], strict=True)
    found = language.Labeller(language.Model.fit(list(texts), list(langs)))
    assert found.label(glued(0x4E00, 5_000))[0] == "zh" and found.label(glued(0x0E01, 5_000))[0] == "th"
    assert found.label(glued(0x4E00, 45) + glued(0x5200, 5_000))[0] == "ja"


def test_votes_and_scores_by_definition():
    r = random.Random(3)
    texts = [" ".join(words(i, 25, 80) + r.sample(["bad", "worse", "awful"], 2) * (i % 4 == 0)) for i in range(160)]
    labels = [int(i % 4 == 0) for i in range(160)]
    model = toxicity.fit(texts, labels, list(range(160)))
    n = len(texts)
    terms = [[t for w in toxicity.words(text) for t in toxicity.terms_of(w)] for text in texts]
    seen = {t: sum(t in set(own) for own in terms) for own in terms for t in own}
    idf = {t: np.log((1 + n) / (1 + max(k, toxicity.RARE * n))) + 0.1 for t, k in seen.items()}

    def vector(own):
        v = {t: (1 + np.log(own.count(t))) * idf[t] for t in set(own) if t in idf}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    every = [vector(own) for own in terms]
    for i in range(0, 40):
        text = " ".join(words(1000 + i, 25, 80) + ["bad", "new"] * (i % 3 == 0))
        mine = vector([t for w in toxicity.words(text) for t in toxicity.terms_of(w)])
        cosine = sorted(((sum(x * v.get(t, 0) for t, x in mine.items()), k) for k, v in enumerate(every)), reverse=True)[: toxicity.NEIGHBOURS + 1]
        if cosine[-2][0] - cosine[-1][0] < 1e-4:
            continue  # a tie at the last place
        cosine = cosine[:-1]
        vote = (sum(c * c * labels[k] for c, k in cosine) + 0.1 * model.without) / (sum(c * c for c, _ in cosine) + 0.1)
        score, near = model.score(text)
        assert sorted(near) == sorted(k for _, k in cosine)
        assert score == pytest.approx(np.interp(vote, model.curve_x, model.curve_y), abs=1e-3)


def test_memory_is_bounded_in_bytes_and_one_operator_at_a_time():
    calls = []
    memory = Bounded(lambda key: calls.append(key) or key.encode() * 10, budget=20_000)
    assert all(memory.get(str(i)) == str(i).encode() * 10 for i in list(range(500)) * 2)
    assert len(calls) > 500 and memory.bytes <= 10_000
    made = []
    assert [held("a", lambda: made.append(1) or 1), held("a", lambda: 2), held("b", lambda: 3), held("a", lambda: 4)] == [1, 1, 3, 4]


def test_held_out_rows_never_teach(spark):
    df, labels, *_ = labelled(spark, 200)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one, other = ({r.doc_id: r.score for r in toxicity.toxicity_scores(df, x).collect()} for x in (labels, turned))
    assert one == other and any(zlib.crc32(str(i).encode()) % 5 == 0 for i in one)


def test_toxicity_keeps_common_terms_as_lists_and_finds_the_same_neighbours():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(900)]
    texts = [" ".join(vocabulary[int(900 * x**2)] for x in rng.random(60)) for _ in range(300)]
    model = toxicity.fit(texts, [i % 2 for i in range(300)], list(range(300)))
    assert model.lists.shape == (toxicity.MIDDLE, len(model.labels)) and not np.diff(model.starts[(model.heavy >= 0) | (model.middle >= 0)]).any()
    rows = np.zeros((len(model.labels), len(model.idf)))
    for at, i in enumerate(model.ids.tolist()):
        terms, weight = model.vector(texts[i])
        rows[at, terms] = weight
    for text in texts[:40]:
        terms, weight = model.vector(text)
        cosine = rows[:, terms] @ weight
        at, found = model.nearest(terms, weight, toxicity.NEIGHBOURS)
        assert np.allclose(found, np.sort(cosine)[::-1][: len(found)], atol=1e-5) and np.allclose(found, cosine[at], atol=1e-5)


def test_a_worker_forgets_words_once_the_next_step_of_the_join_or_another_operator_comes():
    from loomwell.llm import memory

    shingles = shingle_join.shingler(5)
    members = [shingles(text)[0].tobytes() for text in ("a b c d e f g h i j k", "a b c d e f g h i j k l")]
    group = pd.DataFrame({"node": [1, 2], "near": False, "asks": True, "members": members})
    assert len(shingle_join._search(80)(group)) and "shingles 5" not in memory._held
    shingle_join.shingler(5)
    model = type("Broadcast", (), {"value": toxicity.fit(["one two three"], [1], [1])})
    toxicity._examples(model)
    assert "shingles 5" not in memory._held
