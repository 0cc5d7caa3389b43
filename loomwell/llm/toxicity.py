"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is the set of examples. Terms are the lower-case words and
word beginnings of all examples, whatever their labels, weighted (1 + ln tf) * idf, and normalised per text. A term
in fewer than ``RARE`` of the examples has the idf of one in that many, or chance matches of rare words would outweigh
all others. The inverted index holds every term: postings for most (example and weight in one word of 64 bits), a list with a
place for every example for the ``MIDDLE`` commoner ones, and whole rows for the ``HEAVY`` ones that stand in most
examples, with the largest weight of each in each block of neighbouring examples. A query adds up
its postings and lists and bounds what its heavy terms can add in a block; only examples whose bound reaches the
k-th best cosine get their heavy terms added, so the neighbours are exact. Their votes, weighted by cosine, become a
score by a monotone curve fitted to the examples' own leave-one-out votes. The neighbours'
ids are the evidence.

Bound: about ``FIT_ROWS`` labelled texts, chosen by a hash of the id, of ``FIT_CHARS`` characters in all
(a smaller share of the ids is taken if those would have more).

Defined cases: a null text counts as empty; a text of any length is read whole; terms that no example has are left out; a text without
any term gets the smoothed share of toxic ones among such examples; without examples every score is 0.5 * 0.1 = 0.05; an
empty table gives no rows; a repeated document is scored per row; other columns are not read.
Ties in cosine go to the example that stands first in the index.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.memory import Bounded, give_back, held_of
from loomwell.llm.sampling import bounded_texts, labelled_sample
from loomwell.llm.shared import crc_of_id, small_batches, text_or_empty

FIT_ROWS, FIT_CHARS = 6_000, 64_000_000
#: Share of the examples below which a term weighs no more for being rarer.
RARE = 0.03
#: Bytes of words that a worker remembers.
MEMORY = 32 << 20
NEIGHBOURS = 15
BLOCK = 64
#: Terms in most examples, whose weights are held for every example.
HEAVY = 128
#: Terms next to these, whose postings are lists over all examples: adding up such a list is cheaper than its postings one by one.
MIDDLE = 384
#: Texts whose middle terms are added up in one product.
TOGETHER = 32
#: Weights of middle terms are rounded to multiples of 1 / GRID; products of two of these add up in 64-bit floats without error.
GRID = float(1 << 24)
#: Examples whose lists are widened to 64 bits at a time.
WIDENED = 1024
#: Lengths of the word beginnings that are terms beside whole words.
STEMS = (4, 5, 6)
_words, _ascii_words = re.compile(r"[^\W\d_]+").findall, re.compile(r"[A-Za-z]+").findall


def words(text: str) -> list[str]:
    """Runs of letters; the narrower class is the faster one."""
    return _ascii_words(text) if text.isascii() else _words(text)


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; compounds and inflections share these."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def on_grid(weight: np.ndarray) -> np.ndarray:
    return np.rint(weight.astype(np.float64) * GRID) / GRID


@dataclass
class Examples:
    """The index: terms, block postings, labels, ids, and the curve from vote to score."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    starts: np.ndarray  # [terms, 2]: where the postings of a term begin and end
    postings: np.ndarray  # int64: weights, as bits of a float, above example numbers; of neither middle nor heavy terms
    middle: np.ndarray  # [terms]: row of a middle term, -1 for the others
    lists: np.ndarray  # [middle terms, examples]: weights
    heavy: np.ndarray  # [terms]: row of a heavy term, -1 for the others
    rows: np.ndarray  # [examples, heavy terms]: weights
    most: np.ndarray  # [heavy terms, blocks]: largest weight in a block
    labels: np.ndarray
    ids: np.ndarray
    without: float
    curve_x: np.ndarray
    curve_y: np.ndarray
    known: Callable[[str], bytes] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "vocabulary": "\n".join(self.vocabulary)}

    def __setstate__(self, state: dict) -> None:
        terms = state["vocabulary"]
        self.__dict__ = state | {"vocabulary": {term: i for i, term in enumerate(terms.split("\n") if terms else [])}}

    def numbers(self, word: str) -> bytes:
        """The numbers of a word's terms. No example has what is longer than a beginning that none has."""
        found, get = array("i"), self.vocabulary.get
        for k in STEMS:
            if len(word) <= k:
                break
            number = get(word[:k] + "*")
            if number is None:
                return found.tobytes()
            found.append(number)
        number = get(word)
        if number is not None:
            found.append(number)
        return found.tobytes()

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.known is None:
            self.known = Bounded(self.numbers, budget=MEMORY).get
        found = np.frombuffer(b"".join(map(self.known, words(text.lower()))), np.int32)
        if not len(found):
            return np.zeros(0, np.int64), np.zeros(0)
        terms, counts = np.unique(found, return_counts=True)
        weight = (1 + np.log(counts)) * self.idf[terms]
        return terms, weight / np.sqrt((weight**2).sum())

    def listed(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What middle terms add to each example, for up to TOGETHER vectors, in one product. Weights are multiples of 1 / GRID, so
        sums are exact and don't depend on what is added up first, nor on the other vectors."""
        own = np.zeros((len(vectors), len(self.lists)))
        for at, (terms, weight) in enumerate(vectors):
            middle = self.middle[terms]
            inside = middle >= 0
            own[at, middle[inside]] = on_grid(weight[inside])
        out = np.empty((len(vectors), self.lists.shape[1]))
        for at in range(0, out.shape[1], WIDENED):
            out[:, at : at + WIDENED] = own @ self.lists[:, at : at + WIDENED].astype(np.float64)
        return out

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int, but: int = -1, listed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a cosine above zero. ``listed``: this vector's row of :meth:`listed`."""
        n, row, own = len(self.labels), self.heavy[terms], weight.astype(np.float32)
        heavy = row[row >= 0]
        begin, end = self.starts[terms].T
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size)
        if len(at):
            at += np.arange(len(at))
            found = self.postings[at].view(np.int32).reshape(-1, 2)
            score = np.bincount(found[:, 0], found[:, 1].view(np.float32) * np.repeat(own, size), n)
        else:
            score = np.zeros(n)
        score += self.listed([(terms, weight)])[0] if listed is None else listed
        if len(heavy):
            over = np.zeros(self.rows.shape[1], np.float32)
            over[heavy] = weight[row >= 0]
            bound = score + np.repeat(over @ self.most, BLOCK)[:n]
        else:
            bound = score.copy()
        if but >= 0:
            bound[but] = 0
        if n > k:  # the least cosine of the k of highest bound: no better set can hold anything below
            first = np.argpartition(bound, n - k)[n - k :]
            least = (score[first] + self.rows[first] @ over).min() if len(heavy) else score[first].min()
            number = np.flatnonzero((bound >= least - 1e-5) & (bound > 0))
        else:
            number = np.flatnonzero(bound > 0)
        best = score[number] + self.rows[number] @ over if len(heavy) else score[number]
        number, best = number[best > 0], best[best > 0]
        top = np.lexsort((number, -best))[:k]
        return number[top], best[top]

    def vote(self, terms: np.ndarray, weight: np.ndarray, but: int = -1, listed: np.ndarray | None = None) -> tuple[float | None, np.ndarray]:
        at, cosine = self.nearest(terms, weight, NEIGHBOURS, but, listed)
        if not len(at):
            return None, at
        squared = cosine**2
        return float((squared @ self.labels[at] + 0.1 * self.without) / (squared.sum() + 0.1)), at

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], leave_out: bool = False) -> Iterator[tuple[float | None, np.ndarray]]:
        """The votes on all vectors; ``leave_out``: the vectors are those of the examples, which don't vote on themselves."""
        for begin in range(0, len(vectors), TOGETHER):
            part = vectors[begin : begin + TOGETHER]
            for at, (vector, listed) in enumerate(zip(part, self.listed(part), strict=False)):
                yield self.vote(*vector, begin + at if leave_out else -1, listed) if len(vector[0]) else (None, np.zeros(0, np.int64))

    def score(self, text: str) -> tuple[float, list[int]]:
        return next(self.scores([text]))

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[int]]]:
        for vote, at in self.votes([self.vector(text) for text in texts]):
            yield (self.without, []) if vote is None else (float(np.interp(vote, self.curve_x, self.curve_y)), self.ids[at].tolist())


def _rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone curve nearest to points (x, y): neighbours that fall are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([float(b), 1.0, float(a), float(a)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, n, low, high = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], high]
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [v for p in pools for v in [(p[0] + 0.5) / (p[1] + 1)] * 2]
    return np.array(xs), np.maximum.accumulate(ys)


def fit(texts: list[str], labels: list[int], ids: list[int]) -> Examples:
    """Choose terms, index the examples, and fit the curve."""
    seen: dict[tuple[str, int], int] = {}
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        seen.setdefault((text, label), i)  # copies of a text are one example
    chosen = sorted(seen.values())
    y = np.array([labels[i] for i in chosen], dtype=float)
    seen_in: Counter[str] = Counter()
    for i in chosen:
        seen_in.update(set(chain.from_iterable(map(terms_of, set(words(texts[i].lower()))))))
    kept = sorted(seen_in)
    vocabulary = {t: i for i, t in enumerate(kept)}
    counts = np.array([seen_in[t] for t in kept], dtype=np.int64)
    idf = np.log((1 + len(chosen)) / (1 + np.maximum(counts, RARE * len(chosen)))) + 0.1
    del seen_in
    none, cells = np.zeros(0, np.int64), np.zeros((0, 0))
    model = Examples(vocabulary, idf, cells, none, none, cells, none, cells, cells, np.zeros(0), none, 0.05, np.zeros(1), np.zeros(1))
    vectors = [(terms.astype(np.int32), weight.astype(np.float32)) for terms, weight in (model.vector(texts[i]) for i in chosen)]
    model.known = None
    bare = np.array([not len(v[0]) for v in vectors], dtype=bool)
    if len(chosen):
        model.without = float((y[bare].sum() + 0.5 * y.mean()) / (bare.sum() + 0.5))
    # neighbouring examples share their heaviest term, so that block bounds are tight
    order = sorted((i for i in range(len(chosen)) if not bare[i]), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), chosen[i]))
    model.labels, model.ids = y[order], np.array([ids[chosen[i]] for i in order], dtype=np.int64)
    sizes = [len(vectors[i][0]) for i in order]
    term_of = np.concatenate([vectors[i][0] for i in order]) if order else none
    weight_of = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0, np.float32)
    example_of = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
    by_term = np.argsort(term_of, kind="stable")
    numbers, weights = example_of[by_term], weight_of[by_term]
    del term_of, weight_of, example_of, by_term
    ends = np.cumsum(counts)
    starts = np.stack([ends - counts, ends], axis=1)
    common = np.lexsort((np.arange(len(kept)), -counts))[: HEAVY + MIDDLE]
    most, middle = common[:HEAVY], common[HEAVY:]
    model.heavy, model.middle = np.full(len(kept), -1, np.int16), np.full(len(kept), -1, np.int16)
    model.heavy[most], model.middle[middle] = np.arange(len(most)), np.arange(len(middle))
    model.rows = np.zeros((len(order), len(most)), np.float32)
    for at, (begin, end) in enumerate(starts[most]):
        model.rows[numbers[begin:end], at] = weights[begin:end]
    model.lists = np.zeros((len(middle), len(order)), np.float32)  # multiples of 1 / GRID up to 1 have 24 bits
    for at, (begin, end) in enumerate(starts[middle]):
        model.lists[at, numbers[begin:end]] = on_grid(weights[begin:end])
    few = counts.copy()
    few[common] = 0
    left = np.repeat(few > 0, counts)
    model.postings = np.stack([numbers[left], weights[left].view(np.int32)], axis=1).astype(np.int32).reshape(-1).view(np.int64)
    ends = np.cumsum(few)
    model.starts = np.stack([ends - few, ends], axis=1)
    del numbers, weights, starts
    model.most = np.stack([model.rows[i : i + BLOCK].max(0) for i in range(0, len(order), BLOCK)], axis=1) if order else np.zeros((len(most), 0))
    votes = np.array([model.without if vote is None else vote for vote, _ in model.votes([vectors[i] for i in order], leave_out=True)])
    if len(votes):
        model.curve_x, model.curve_y = _rising(votes, model.labels)
    return model


def _score_rows(model, with_evidence: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = _examples(model)
        for batch in batches:
            found = list(examples.scores(batch.column(1).to_pylist()))
            score = np.array([s for s, _ in found])
            columns = [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            names = ["doc_id", "score", "predicted"]
            if with_evidence:
                columns.append(pa.array([e for _, e in found], pa.list_(pa.int64())))
                names.append("evidence")
            yield pa.RecordBatch.from_arrays(columns, names)
            give_back()

    return run


def learn(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS):
    """The examples, as a broadcast of bounded size.

    ``labels`` (doc_id, toxic) teach only where crc32 of the id, modulo 5, is not 0.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_of_id("doc_id") % 5 != 0)).select("doc_id", "toxic")
    chosen = labelled_sample(known, "doc_id", bound)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    taught = bounded_texts(taught, "doc_id", FIT_CHARS)
    model = fit(*[taught.column(c).to_pylist() for c in ("text", "toxic", "doc_id")])
    model = docs.sparkSession.sparkContext.broadcast(model)
    del taught
    gc.collect()
    give_back()
    return model


def _examples(model) -> Examples:
    """The examples, with their memory of words, of a worker; what other operators have remembered there is dropped before."""
    return held_of("toxicity", model, lambda own: own)


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, with_evidence: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and the neighbours' ids for every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = learn(docs, labels, bound)
    schema = "doc_id long, score double, predicted int" + ", evidence array<long>" * with_evidence
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text"))
    scored = rows.mapInArrow(_score_rows(model, with_evidence), schema)
    held_out = F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", *["evidence"] * with_evidence)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't predicted to be toxic.

    Rows are judged and passed on in one pass: nothing is shuffled or joined.
    """
    small_batches(docs.sparkSession, 1 << 20)  # what a worker makes of a batch is many times its size
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = _examples(model)
        for batch in batches:
            keep = [score < 0.5 for score, _ in examples.scores([text or "" for text in batch.column("text").to_pylist()])]
            yield batch.filter(pa.array(keep, pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)
