"""Host rules and tokenizer alignment against plain versions, with the odd cases of both."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwell.llm import host_rules, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (None, None), (1, ""), (2, None), (3, "a▁b"), (4, "<s> x </s><|endoftext|> <unk> <0x41>"), (5, " lead"), (6, "trail "), (7, "two  spaces"),
    (8, "a\n\nb"), (9, "a\nb it's 'tis\nn't"), (10, "日本語 текст 🎉🎉 x́"), (11, "x" * 5000), (12, "\n"), (13, " "), (14, "\t"), (15, "a\x00b c"),
    (16, "it's\n's it 12345 a_b"), (16, "it's\n's it 12345 a_b"), (17, "fin.\r\nNext"), (18, "the cat and the hat " * 300),
]


def plain_alignment(rows):
    """Every text encoded whole, every pair of tokens by comparing byte ranges."""
    both = token_alignment.Tokenizers(A, B)
    counts, made = Counter(), []
    for doc_id, text in rows:
        a, b = (both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(both.a_bytes[x] for x in a) != want or b"".join(both.b_bytes[x] for x in b) != want:
            a = b = []
        a_ends, b_ends = list(accumulate(len(both.a_bytes[x]) for x in a)), list(accumulate(len(both.b_bytes[x]) for x in b))
        groups, last = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            one = [",".join(str(x) for x, e in zip(ids, ends) if last < e <= end) for ids, ends in ((a, a_ends), (b, b_ends))] if len(a) < 300 else None
            groups.append("|".join(one) if one else "")
            last = end
        links = []
        for x, x_end in zip(a, a_ends):
            x_start = x_end - len(both.a_bytes[x])
            links += [(x, y) for y, y_end in zip(b, b_ends) if y_end > x_start and y_end - len(both.b_bytes[y]) < x_end]
        counts.update(links)
        made.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, a, b, groups, links in made:
        digest = None if len(a) >= 300 else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id or 0, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=lambda r: r[:7])


@pytest.mark.parametrize("chunk", [1 << 24, 40])
def test_alignment_equals_plain_version(spark, chunk):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").select("*", F.lit(1).alias("n_a"), F.lit("x").alias("chunk"), F.lit(2).alias("stripe"))
    got = token_alignment.align_documents(docs.repartition(3), A, B, stripes=16, chunk_chars=chunk).collect()
    got = sorted([(r[0] or 0, *r[1:]) for r in map(tuple, got)], key=lambda r: r[:7])
    want = plain_alignment([(r[0], r[1]) for r in ODD])
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))
    digests = {r[0]: r[7] for r in got}
    assert digests[3] == digests[1] == "" and len(digests[11]) == 64


def test_alignment_of_no_rows(spark):
    assert token_alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_long_groups_are_the_joined_groups_of_units():
    units = token_alignment.Units(A, B)
    text = "the cat and the hat " * 300
    (whole,) = units.learn([" " + text]).values()
    cut = token_alignment.units_of(text.strip())
    known = units.learn(cut)
    stripped = units.learn([" " + text.strip()])[" " + text.strip()]
    assert b";".join(known[u][0] for u in cut) == stripped[0] and whole is not None


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})


@pytest.mark.parametrize("text", ["", "a", "a a a", "a a a a", "a b c a b c", "a b c x a b c", "a b a b a b a", "x y z " * 500, " ".join(str(i * i % 17) for i in range(300))])
def test_repeated_words(text):
    words = text.split()
    assert host_rules.repeated_words(words) == plain_repeats(words)


def test_counts_of_a_text():
    assert host_rules.counts_of("a #b\n\n x \n x \na #b\v") == (6, 8, 2, 4, 1, 0)
    assert host_rules.counts_of("é x <&>") == (2, 6, 3, 1, 0, 0)


def hosts(spark, good, bad):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, clean, "good") for i in range(good)] + [(1000 + i, "short", "bad") for i in range(bad)] + [(2000, clean, "bad"), (3000, "short", "small"), (3001, clean, "small")]
    rows += [(4000, clean, None), (4001, None, None), (None, None, "good"), (5, clean, "good")]
    return spark.createDataFrame(rows, "doc_id long, text string, site string").withColumn("host", F.lit("clash")).withColumn("docs", F.lit(9))


def test_verdicts_of_hosts_come_back_to_documents(spark):
    out = host_rules.host_verdicts(hosts(spark, 300, 60), F.col("site")).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert len(out) == 300 + 60 + 7 and all(kept[i] for i in range(300))
    assert not kept[2000] and not kept[1000] and kept[3001] and kept[4000] and not kept[4001] and not kept[None]
    assert {r.doc_id: r.host_blocked for r in out}[2000]


def test_small_hosts_are_shrunk_towards_the_prior(spark):
    rates = {r.host: r for r in host_rules.host_rates(host_rules.text_counts(hosts(spark, 300, 60), F.col("site"))).collect()}
    raw = rates["small"].fail_base / rates["small"].docs
    pooled = sum(r.fail_base for r in rates.values()) / sum(r.docs for r in rates.values())
    assert pooled < rates["small"].rate_base < raw
    assert rates["bad"].rate_base > 0.9 and set(rates) == {"good", "bad", "small"}


def test_strict_hosts_drop_what_fails_their_rule(spark):
    plain, marked = " ".join(f"word{i}" for i in range(60)), " ".join(f"#word{i}" for i in range(60))
    rows = [(i, marked, "a") for i in range(50)] + [(100 + i, plain, "a") for i in range(50)] + [(200 + i, plain, "b") for i in range(100)] + [(300, marked, "b")]
    out = {r.doc_id: r for r in host_rules.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()}
    assert not any(out[i].kept for i in range(50)) and all(out[i].kept for i in range(100, 150))
    assert out[300].kept and out[0].host_strict == ["symbols"]


def test_prior_of_equal_hosts_is_strong_and_of_unequal_ones_weak():
    equal = host_rules.Prior.fit(10, 1000, 100_000, 100, 10 * 10 * 10 / 100)
    unequal = host_rules.Prior.fit(10, 1000, 100_000, 100, 100 * 100 / 100)
    assert equal.a + equal.b > 100 > 1 > unequal.a + unequal.b
    assert host_rules.Prior.fit(0, 0, 0, 0, 0.0) == host_rules.Prior(0.0, 1.0)


def test_hosts_of_no_rows_and_of_urls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_rules.host_verdicts(empty, F.col("source")).count() == 0
    urls = spark.createDataFrame([("https://www.Example.org/x",), ("no url",), (None,)], "u string")
    assert [r[0] for r in urls.select(host_rules.host_of(F.col("u"))).collect()] == ["example.org", None, None]


def test_units_aligned_together_equal_units_aligned_alone():
    units = token_alignment.Units(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    plain = [" plain", "\nline", " naïve", " 日本語", " 😀!", " x" * 1, " " + "unbrokenword" * 40, " <|endoftext|>", "\n'll", *[f" word{i}" for i in range(120)]]
    assert units.tokenizers.together(plain) is not None  # no unit needs to be aligned by itself
    assert units._make_all(plain) == [units._make(units.tokenizers.encode([u])[0]) for u in plain]
    for odd in ("  two  spaces ", " ", " a▁b", " \ud800", "\n\n", " tab\there"):
        assert units._make_all([*plain, odd]) == [units._make(units.tokenizers.encode([u])[0]) for u in [*plain, odd]]
    assert units._make_all([]) == []


def test_rows_between_the_steps_stay_small(spark, monkeypatch):
    """However many units a chunk has: Spark reads such rows back by thousands, and holds all of them at once."""
    widest, write = {}, token_alignment.materialise

    def looked_at(df, what, *args, **kwargs):
        written, path = write(df, what, *args, **kwargs)
        arrays = [c for c, kind in written.dtypes if kind.startswith("array")]
        if arrays:
            widest[what] = max(v or 0 for v in written.select([F.max(F.size(c)) for c in arrays]).first())
        return written, path

    monkeypatch.setattr(token_alignment, "materialise", looked_at)
    rows = [(k, " ".join(f"w{i * 37 % 911}" for i in range(k, k + 300))) for k in range(6)] + [(9, "x" * 500), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in token_alignment.align_documents(docs.coalesce(1), A, B, stripes=2).collect()}
    assert set(widest) == {"alignment-chunks", "alignment-counts"} and max(widest.values()) <= 512
    assert {r[:7] for r in got} == {r[:7] for r in plain_alignment(rows)}
