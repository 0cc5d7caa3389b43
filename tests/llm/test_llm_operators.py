"""The corpus operators against brute force, round trips and held-out labels; odd input for each."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from loomwell.llm import bpe, embedding_dedup, exact_dedup, html_text, language, packing, quality, shards, shingle_join, toxicity
from loomwell.llm import signature_tree as tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, keys string"
ODD = [None, "", " \t\n", "a", "A a", "a  b", "\x0b\x0cx", "日本語 テキスト", "é" * 50, "word " * 20_000, "<|endoftext|>", "12 34", "!!!", "\x1c y"]


def docs(spark, texts, langs=None, first=0):
    rows = [(first + i, t, (langs or ["en"] * len(texts))[i], "s", None, "clash", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(seed, n, pool=400):
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


# ---------------------------------------------------------------- op4


def test_exact_groups(spark):
    texts = [*ODD, "a\tb", "ab", "A a", "a b ", None, "x" * 100 + "y", "x" * 100 + "z", "x" * 100 + " y"]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, texts)).collect()}
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    groups = defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append(i)
    for i, b in enumerate(bare):
        keep = min(groups[b], key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(groups[b]), i == keep)
        assert got[i].text_sha256 == hashlib.sha256(b.encode()).hexdigest()
    kept = exact_dedup.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and kept.count() == len(groups)


def test_exact_groups_of_repeated_rows_and_nothing(spark):
    twice = docs(spark, ["a", "b"]).unionAll(docs(spark, ["a", "b"]))
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(twice).orderBy("doc_id").collect()] == [(0, 0, 2, True)] * 2 + [(1, 1, 2, True)] * 2
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- op2


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_merges(spark, reference):
    r = random.Random(1)
    texts = [*ODD, *["".join(r.choice("abcdeéß 日\n'.,1") for _ in range(r.randrange(200))) for _ in range(200)]]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {x.doc_id: x for x in bpe.encode_documents(docs(spark, texts), path, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert bytes(got[i].ids) == ids, repr(t)
        assert got[i].n_tokens == len(ids) // 4 and got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


# ---------------------------------------------------------------- op9


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [*ODD, " ".join(words(2, 3000)), "said<|endoftext|>, and more", "(<|endoftext|>) <|endoftext|>"]
    rows = packing.pack(docs(spark, texts), path, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length <= 2048 and r.length & (r.length - 1) == 0 and r.bucket == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[i], key=lambda r: r.start)
        assert [x for p in parts for x in p.ids] == want and all(p.doc_tokens == len(want) for p in parts)
    assert packing.pack(docs(spark, []), path).count() == 0
    assert packing.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


# ---------------------------------------------------------------- op10


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    r = random.Random(seed)
    texts = [*ODD, "A A", "a a", "x y z", "X Y Z", "x y"]
    passage = words(99, 60)
    for base in range(12):
        w = words(base, r.choice([8, 30, 120, 400]), 3000)
        if base % 3 == 0:
            w[3:3] = passage
        for _ in range(r.randrange(1, 14)):
            c = list(w)
            for _ in range(r.randrange(0, max(2, len(c) // 25))):
                c[r.randrange(len(c))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(c) + "x" * (r.random() < 0.2))
    return texts


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 200), (5, 80, 200), (3, 90, 4)])
def test_shingle_join_loses_no_link(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)  # 4: components are searched in blocks
    texts = near_copies(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.shingle_groups(docs(spark, texts), k, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, percent)


def test_shingle_join_of_nothing_and_of_repeated_rows(spark):
    assert shingle_join.shingle_groups(docs(spark, []), 3, 90).count() == 0
    twice = docs(spark, ["a b c d", None]).unionAll(docs(spark, ["a b c d", None]))
    assert sorted((r.doc_id, r.component_id) for r in shingle_join.shingle_groups(twice, 3, 90).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_tree_traversal_equals_all_pairs():
    r = np.random.default_rng(0)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 2**63, r.integers(3, 300)).astype(np.uint64))
        sets += [np.unique(np.concatenate([base[r.random(len(base)) > 0.04], r.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(6)]
    maps = np.stack([tree.bitmap(s) for s in sets])
    forest, want = tree.Forest(len(sets)), tree.Forest(len(sets))
    root = tree.build(list(range(len(sets))), sets, maps)
    tree.traverse(root, root, sets, maps, 85, forest)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


# ---------------------------------------------------------------- op6


@pytest.mark.parametrize("block", [512, 8])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    rows, label = [], []
    for _ in range(25):
        base = r.normal(size=24)
        for _ in range(r.integers(1, 9)):
            rows.append((base + r.normal(size=24) * r.choice([0, 0.03, 0.12])).astype(np.float32).tolist())
            label.append(int(r.integers(0, 2)))
    rows += [None, [0.0] * 24, [float("nan")] * 24, [None] * 24, [], [float("inf")] * 24, rows[0], [1.0] * 20]
    label += [0] * 6 + [label[0], 0]
    rows.append(rows[0])
    label.append(None)
    df = spark.createDataFrame([(i, v, lab, 5) for i, (v, lab) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<float>, label int, n long")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_vectors(df).collect()}
    ok = [i for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v) and label[i] is not None]
    links, up = defaultdict(int), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ok:
        for j in ok:
            if i < j and label[i] == label[j] and len(rows[i]) == len(rows[j]):
                a, b = np.float32(rows[i]).astype(float), np.float32(rows[j]).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    found, true = sum(g[0] for g in got.values()), sum(links.values())
    assert true > 100 and found == true
    assert all(got[i] == (links[i], root(i), root(i) == i) for i in got)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>{title}</h1><p>First &amp; <b>bold</b>&nbsp;text.<br>more<p>Second &lt;p&gt;<div class="share">Share</div><form><input>Send</form></article>
<section id=comments><p>Nice!</p></section><aside>Side</aside><footer>&copy; x</footer><!-- <p>no</p> --></body></html>"""


def test_main_text(spark):
    plain = "<html><body><div>Welcome to Site</div><p>{0} story of many words</p><p>Common line</p><div>Contact Site</div></body></html>"
    rows = [(1, "http://a.x/p/1", PAGE.format(title="One")), (2, "http://a.x/p/2", PAGE.format(title="Two")), (3, None, None), (4, "odd", ""), (5, "http://b.x/1?q", "just text"), (5, "http://b.x/1?q", "just text")]
    rows += [(10 + i, f"http://c.x/s/{i}", plain.format(w)) for i, w in enumerate(["Apple", "Birch", "Cedar"])] + [(20, "http://c.x/s/1", plain.format("Birch"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).orderBy("page_id").collect()]
    by = {p: t for p, t, _ in got}
    assert by[1] == "One\nFirst & bold text. more\nSecond <p>" and by[2].startswith("Two")
    assert by[3] == by[4] == "" and len(got) == len(rows) and by[5] == "just text"
    assert by[10] == "Apple story of many words" and by[12] == "Cedar story of many words"
    assert all(len(t) == n for _, t, n in got)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_lines_of_articles_on_every_page_go(spark):
    page = "<body><article><h1>{0}</h1><p>Story of {0}, told at length.</p><p>Quoted by two.</p><p>Thanks for reading us.</p></article></body>"
    card = '<body><div>Body {0} in a plain element, with many words.</div><article class="related"><p>Card {0}</p></article></body>'
    rows = [(i, f"http://n.x/{i}", page.format(w)) for i, w in enumerate(["Ash", "Box", "Cob", "Dill"])]
    rows = [(i, u, h if i < 2 else h.replace("<p>Quoted by two.</p>", "")) for i, u, h in rows] + [(10 + i, f"http://k.x/{i}", card.format(i)) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Ash\nStory of Ash, told at length.\nQuoted by two." and got[3] == "Dill\nStory of Dill, told at length."
    assert got[10] == "Body 0 in a plain element, with many words."
    whole = '<article class="post has-comments"><p>The text.</p></article>'
    assert html_text.blocks(whole) == [("The text.", True, False)]


def test_shared_lines_is_a_longest_common_subsequence():
    r = np.random.default_rng(5)
    for _ in range(50):
        a, b = r.integers(0, 6, 12), r.integers(0, 6, 10)
        rows = np.zeros((13, 11), int)
        for i in range(12):
            for j in range(10):
                rows[i + 1, j + 1] = rows[i, j] + 1 if a[i] == b[j] else max(rows[i, j + 1], rows[i + 1, j])
        at = html_text.shared_lines(a, b)
        assert len(at) == rows[-1, -1] and at == sorted(set(at))
        it = iter(b.tolist())
        assert all(x in it for x in a[at].tolist())


# ---------------------------------------------------------------- op5


def test_shards(spark, tmp_path):
    df = docs(spark, [*ODD, *[" ".join(words(i, 50)) for i in range(300)]]).drop("digest", "node", "keys")
    store = shards.Store(spark, f"file://{tmp_path}/store", df.schema)
    assert store.version() == 0 and store.read().count() == 0
    store.append(df.repartition(9))
    store.append(df.limit(0))
    store.append(df.repartition(4))
    before = store.manifest()
    version = store.compact(target=60_000)
    after = store.manifest()
    assert version > 3 and len(after) < len(before) and sum(s.rows for s in after) == 2 * df.count()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.unionAll(df).collect()))
    with pytest.raises(Exception, match="exist"):
        store.commit(after, version)  # another writer's claim on a version that is there
    assert store.version() == version and store.compact(target=60_000) == version


# ---------------------------------------------------------------- op1, op7, op8


def labelled(spark, n=600):
    r = random.Random(4)
    texts, toxic, good, langs = [], [], [], []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        w = [r.choice(["the", "of", "and", "house", "tree"] if lang == "en" else ["der", "und", "ein", "haus", "baum"]) + r.choice(["", "ing", "ed"] if lang == "en" else ["", "ung", "keit"]) for _ in range(40)]
        bad, low = r.random() < 0.2, r.random() < 0.3
        if bad:
            w[5:5] = r.sample(["idiot", "moron", "scum", "trash"], 2)
        if low:
            w = [x + "$$$" for x in w] if i % 3 else [w[0]] * 40
        texts.append(" ".join(w))
        toxic.append(int(bad))
        good.append(int(not low))
        langs.append(lang)
    df = docs(spark, [*texts, *ODD], [*langs, *["en"] * len(ODD)])
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(n)] + [(10**6, None, None), (0, None, None)], "doc_id long, quality int, toxic int")
    return df, labels, good, toxic, langs


def test_classifiers_on_held_out_rows(spark):
    df, labels, good, toxic, langs = labelled(spark)
    for rows, truth, mod, rest in ((quality.quality_scores(df, labels), good, 4, 2), (toxicity.toxicity_scores(df, labels), toxic, 5, 0)):
        got = {r.doc_id: r for r in rows.collect()}
        assert len(got) == len(truth) + len(ODD) and all(0 <= r.score <= 1 for r in got.values())
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
        held = [i for i in range(len(truth)) if got[i].held_out]
        assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    got = {r.doc_id: r for r in language.languages(df).collect()}
    assert sum(got[i].lang_pred == lang for i, lang in enumerate(langs)) >= 0.99 * len(langs)
    n = len(langs)
    assert all(got[n + i].lang_pred == "und" for i in (0, 1, 2, 11, 12)) and got[n + 7].lang_pred != "und"


def test_classifiers_without_labels_or_rows(spark):
    df, labels, *_ = labelled(spark, 10)
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity_scores(df, none).collect()} == {0}
    one = labels.where("toxic = 0")
    assert all(0 <= r.score < 0.5 for r in toxicity.toxicity_scores(df, one).collect())
    for rows in (quality.quality_scores(df.limit(0), labels), toxicity.toxicity_scores(df.limit(0), labels), language.languages(df.limit(0))):
        assert rows.count() == 0
    unknown = df.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in language.languages(unknown).collect()} == {"und"}


def test_neighbours_are_exact():
    r = random.Random(8)
    texts = [" ".join(words(i, 30, 60) + (["bad", "worse"] if i % 4 == 0 else [])) for i in range(300)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(300)], list(range(300)))
    vectors = {}
    for term in range(len(model.vocabulary)):
        low, high = model.starts[term][0], model.starts[term][-1]
        for p, w in zip(model.postings[low:high], model.weights[low:high], strict=True):
            vectors.setdefault(int(p), {})[term] = w
    for i in r.sample(range(300), 40):
        terms, weight = model.vector(texts[i])
        at, cosine = model.nearest(terms, weight, 7)
        want = sorted((-sum(w * vectors[p].get(int(t), 0) for t, w in zip(terms, weight, strict=True)), p) for p in vectors)[:7]
        assert np.allclose([-c for c, _ in want if c < 0], cosine)


def test_spans_of_mixed_text():
    en, de = ["the", "of", "and", "house"], ["der", "und", "ein", "haus"]
    r = random.Random(2)
    texts = [" ".join(r.choice(pool) for _ in range(50)) for pool in (en, de) for _ in range(20)]
    found = language.Labeller(language.Model.fit(texts, ["en"] * 20 + ["de"] * 20))
    lang, _, spans = found.label(" ".join(r.choice(en) for _ in range(30)) + " " + " ".join(r.choice(de) for _ in range(50)))
    assert (lang, spans) == ("de", ["en", "de"])


def test_unspaced_text_is_read_to_its_end():
    r = random.Random(4)
    glued = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [" ".join(glued(pool, 6) for _ in range(60)) for pool in ("abcd", "wxyz") for _ in range(20)]
    found = language.Labeller(language.Model.fit(texts, ["aa"] * 20 + ["ww"] * 20))
    lang, _, spans = found.label(glued("abcd", 400) + glued("wxyz", 4_000))
    assert (lang, spans) == ("ww", ["aa", "ww"])
    run = "\u65e5\u672c" * 30 + "abc" + "\u0431" * 50
    assert "".join(language.pieces(run)) == run and [len(p) for p in language.pieces(run)] == [40, 20, 3, 40, 10]


def test_near_copy_of_an_example_with_rare_words_meets_it():
    texts = [" ".join(words(i, 40, 200) + (["bad", "worse"] if i % 5 == 0 else [])) for i in range(200)]
    rare = "zorgling quexed the marvit upon frondle yestermuck"
    model = toxicity.fit([*texts, rare], [int(i % 5 == 0) for i in range(200)] + [1], list(range(201)))
    score, near = model.score(rare + " indeed")
    assert near[0] == 200 and score >= 0.5
    assert model.nearest(*model.vector(rare), 3)[1][0] == pytest.approx(1)


def test_frames_go_though_most_lines_or_many_pages_are_the_same(spark):
    frame = "".join(f"<div>Frame line {i}</div>" for i in range(5))
    rows = [(i, f"http://f.x/{i}", f"<body>{frame}<div>Only line of {i}</div></body>") for i in range(4)]
    page = "<body><div>Site name</div><h1><a href=/{0}>Title {0}</a></h1><p>Text of {0}.</p></body>"
    rows += [(10 + i, f"http://r.x/{i:02d}", page.format("copies")) for i in range(12)] + [(30, "http://r.x/99", page.format("other"))]
    near = "<body>" + "".join(f"<p>Body line {i}</p>" for i in range(9)) + "<p>Seen {0}</p></body>"
    rows += [(40 + i, f"http://n.x/{i}", near.format(i)) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Only line of {i}" for i in range(4))
    assert all(got[10 + i] == "Title copies\nText of copies." for i in range(12)) and got[30] == "Title other\nText of other."
    assert len(got[40].split("\n")) == 10


def test_paths_are_the_best_even_if_the_best_sum_is_in_no_span():
    model = language.Model(["en", "fr", "de"], {}, {})
    assert model.path(np.array([[-3, 0, -6]] * 4 + [[-3, -6, 0]] * 4, np.float32)).tolist() == [1] * 4 + [2] * 4
    r = np.random.default_rng(3)
    total = lambda s, p: s[np.arange(len(s)), p].sum() - language.SWITCH * (np.diff(p) != 0).sum()
    every = np.array(np.meshgrid(*[range(3)] * 7)).reshape(7, -1).T
    for _ in range(60):
        scores = -r.choice([0, 3, 6, 6], (7, 3)).astype(np.float32)
        assert total(scores, model.path(scores)) == max(total(scores, p) for p in every)
