"""Language identification: scripts narrow candidates, Viterbi labels spans.

Each word gets a score per language from its character n-grams. Only languages that are
written in the word's script take part. The best path through the words pays a penalty for
each change of language, so mixed texts fall into spans. A run of letters is cut into words where
its script changes and after every ``LONGEST`` letters, so that unspaced text is read to its end. The language of a text is the one
whose spans hold the most letters; the score is its share of them.

Bound: about ``FIT_ROWS`` texts in all, spread over the languages, chosen by a hash of the id, of ``FIT_CHARS``
characters in all (fewer texts, if those would have more). Of more than ``FIT_ROWS`` languages, those with most texts are learned. Of
each language the ``KEPT_GRAMS`` commonest n-grams are kept; a rarer one says nothing for any language.

Defined cases: a text of any length is read whole; a null text, or one without letters, is ``und`` with score 0 (spans: none), as
is every text if no language was learned; an empty table gives no rows; a repeated document is
labelled per row; other columns are not read; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.memory import ENTRY, give_back, held_of
from loomwell.llm.sampling import bounded_texts, hash_order
from loomwell.llm.shared import crc_of_id, small_batches, text_or_empty

FIT_ROWS, FIT_CHARS = 6_000, 64_000_000
UNDECIDED = "und"
#: n-grams kept per language, those in most words first.
KEPT_GRAMS = 30_000
#: Log-probability that a change of language costs; most that one word can say for or against.
SWITCH, MOST_PER_WORD = 14.0, 6.0
#: Letters of a word; longer runs are several words.
LONGEST = 40
runs = re.compile(r"[^\W\d_]+").findall
#: A letter that isn't latin.
_foreign = re.compile(r"[^\W\d_\u0000-\u036f\u1e00-\u1eff]").search

# First code points of script ranges and their scripts.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
_EDGES, _NAMES = [a for a, _ in SCRIPT_STARTS], [b for _, b in SCRIPT_STARTS]


def script(letter: str) -> str:
    return _NAMES[bisect_right(_EDGES, ord(letter)) - 1]


def pieces(run: str) -> list[str]:
    """A run of letters, cut where its script changes and after every LONGEST letters."""
    out = []
    for _, letters in groupby(run, script):
        part = "".join(letters)
        out += [part[i : i + LONGEST] for i in range(0, len(part), LONGEST)]
    return out


def words(text: str) -> list[str]:
    found = runs(text)
    if max(map(len, found), default=0) <= LONGEST and not _foreign(text):
        return found
    return [piece for run in found for piece in (pieces(run) if len(run) > LONGEST or _foreign(run) else (run,))]


def grams(word: str) -> list[str]:
    """The trigrams of a word with its ends marked, its letters, and the word itself."""
    marked = f"<{word}>"
    return [marked[i : i + 3] for i in range(len(word))] + [*set(word), marked + "="]


class Model:
    """Per-language n-gram scores, and the languages written in each script."""

    def __init__(self, langs: list[str], table: dict[str, np.ndarray], scripts: dict[str, np.ndarray]):
        self.langs, self.scripts = langs, scripts
        self.place = {gram: i for i, gram in enumerate(table)}
        self.rows = np.array([*table.values()], np.float32).reshape(len(table), len(langs))

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Model:
        counts: dict[str, Counter] = defaultdict(Counter)
        letters: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(texts, langs, strict=True):
            counts[lang].update(words(text.lower()))
        names = sorted(k for k in counts if counts[k])
        kept: dict[str, Counter] = {}
        for name in names:
            found: Counter[str] = Counter()
            for word, n in counts[name].items():
                letters[script(word[0])][name] += n * len(word)
                weight = min(n, 50)
                for gram in grams(word):
                    found[gram] += weight
            kept[name] = Counter(dict(found.most_common(KEPT_GRAMS)))
        totals = np.array([sum(kept[name].values()) for name in names], dtype=float)
        table = {}
        for gram in set().union(*kept.values()) if kept else ():
            share = (np.array([kept[name][gram] for name in names]) + 0.5) / (totals + 0.5 * KEPT_GRAMS)
            table[gram] = np.log(share / share.mean()).astype(np.float32)
        masks = {}
        for kind, by in letters.items():
            of = np.array([by[name] / max(sum(counts[name][w] * len(w) for w in counts[name]), 1) for name in names])
            masks[kind] = np.where(of >= 0.01, 0, -4 * MOST_PER_WORD).astype(np.float32)
        return cls(names, table, masks)

    def words(self, found: list[str]) -> np.ndarray:
        """[words, languages]: scores of many words at once, each word's best at zero."""
        places: list[int] = []
        ends = np.zeros(len(found) + 1, np.int64)
        get = self.place.get
        for at, word in enumerate(found):
            places += [i for i in map(get, grams(word)) if i is not None]
            ends[at + 1] = len(places)
        so_far = np.zeros((len(places) + 1, len(self.langs)))
        np.cumsum(self.rows[places], axis=0, out=so_far[1:], dtype=np.float64)
        total = so_far[ends[1:]] - so_far[ends[:-1]]
        score = np.maximum(total - total.max(axis=1, keepdims=True), -MOST_PER_WORD)
        masked = [(at, mask) for at, word in enumerate(found) if (mask := self.scripts.get(script(word[0]))) is not None]
        if masked:
            score[[at for at, _ in masked]] += np.stack([mask for _, mask in masked])
        return score.astype(np.float32)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word, when each change costs SWITCH.

        One language throughout is best if against it no other gains more than SWITCH over
        any run of words, and the best of the others at each word don't gain that together (a path
        without it pays one switch less than it has spans). Other texts need the full dynamic
        programme.
        """
        best = int(scores.sum(0).argmax())
        lead = scores - scores[:, best : best + 1]
        gain = lead.T.cumsum(1)
        lead[:, best] = -np.inf
        before = np.zeros_like(gain)
        before[:, 1:] = gain[:, :-1]
        if (gain - np.minimum.accumulate(before, axis=1)).max() <= SWITCH and lead.max(1).sum() <= SWITCH:
            return np.full(len(scores), best, np.int32)
        state = scores[0].astype(np.float64)
        back = np.empty(scores.shape, np.int32)
        own = np.arange(scores.shape[1], dtype=np.int32)
        for i in range(1, len(scores)):
            top = int(state.argmax())
            stay = state >= state[top] - SWITCH
            back[i] = np.where(stay, own, top)
            state = np.where(stay, state, state[top] - SWITCH) + scores[i]
        out = np.empty(len(scores), np.int32)
        out[-1] = int(state.argmax())
        for i in range(len(scores) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


class Labeller:
    """Labels texts; remembers the scores of words up to a bound in bytes."""

    MOST = 48 << 20

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.bytes = 0
        self.long: list[str] = []  # words that are forgotten after their batch

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them scored."""
        if not self.model.langs:
            return [[] for _ in texts]
        split = [words(text.lower()) for text in texts]
        for word in self.long:
            self.known.pop(word, None)
        if self.bytes > self.MOST:
            self.known.clear()
            self.bytes = 0
        new = [word for word in set().union(*split) if word not in self.known]
        self.long = [word for word in new if len(word) == LONGEST]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            scores = self.model.words(part).tobytes()
            width = len(scores) // len(part)
            self.bytes += sum(map(len, part)) + len(part) * (width + ENTRY)
            self.known.update((word, scores[i * width : (i + 1) * width]) for i, word in enumerate(part))
        return split

    def labels(self, texts: list[str]) -> list[tuple[str, float, list[str]]]:
        return [self.of_words(found) for found in self.split(texts)]

    def label(self, text: str) -> tuple[str, float, list[str]]:
        return self.labels([text])[0]

    def of_words(self, found: list[str]) -> tuple[str, float, list[str]]:
        """Language, share of letters in its spans, and the languages in order of their spans."""
        if not any(word.isalpha() for word in found) and not any(map(str.isalpha, "".join(found))):
            return UNDECIDED, 0.0, []
        scores = np.frombuffer(b"".join(map(self.known.__getitem__, found)), np.float32).reshape(len(found), -1)
        path = self.model.path(scores)
        if (path == path[0]).all():
            return self.model.langs[path[0]], self.sure(scores, path[0]), [self.model.langs[path[0]]]
        letters = np.bincount(path, [len(word) for word in found], len(self.model.langs))
        top = int(letters.argmax())
        spans = path[np.flatnonzero(np.diff(path, prepend=-1))]
        return self.model.langs[top], float(letters[top] / letters.sum()) * self.sure(scores[path == top], top), [self.model.langs[i] for i in spans]

    @staticmethod
    def sure(scores: np.ndarray, top: int) -> float:
        """Probability of the language against the others over all these words, tempered."""
        total = scores.sum(0, dtype=np.float64)
        total = (total - total[top]) / np.sqrt(len(scores))
        return float(1 / np.exp(np.minimum(total, 50)).sum())


def _label_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(model)
        for batch in batches:
            found = own.labels(batch.column(1).to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "spans"])
            give_back()

    return run


def _labeller(model) -> Labeller:
    """One labeller, with its memory of words, per worker and model."""
    return held_of("language", model, Labeller)


def learn(docs: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Fit on texts whose crc32 of the id, modulo 4, is not 2, about ``bound`` in all."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id("doc_id") % 4 != 2))
    counts = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(bound).collect()}
    if not counts:
        return Model.fit([], [])
    each = max(bound // len(counts), 1)
    shares = [int(min(each / n, 1.0) * ((1 << 62) - 1)) for n in counts.values()]
    # from Arrow: rows of Python objects go through workers of another kind, which would stay beside those of the operators
    limits = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(counts, pa.string()), "most": pa.array(shares, pa.int64())})))
    taken = usable.join(limits, "lang").where(hash_order("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) <= F.col("most")).select("doc_id", "lang", "text")
    taken = bounded_texts(taken, "doc_id", FIT_CHARS)
    return Model.fit(taken.column("text").to_pylist(), taken.column("lang").to_pylist())


def languages(docs: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the spans' languages for every row of ``docs``."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, bound))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text"))
    labelled = rows.mapInArrow(_label_rows(model), "doc_id long, lang_pred string, score double, spans array<string>")
    held_out = F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return labelled.select("doc_id", held_out, "lang_pred", "score", "spans")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language, in one pass."""
    small_batches(docs.sparkSession, 1 << 20)  # what a worker makes of a batch is many times its size
    model = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(model)
        for batch in batches:
            keep = [lang != UNDECIDED for lang, *_ in own.labels([text or "" for text in batch.column("text").to_pylist()])]
            yield batch.filter(pa.array(keep, pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)
