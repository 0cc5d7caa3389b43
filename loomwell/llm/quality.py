"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; boosting goes through the features in turn and adds one shallow
tree over a feature's bins at a time, so a feature ends as one lookup table. The strongest
pairs of features then get two-way tables in the same manner. A score is the sum of table
entries of a row's bins, through the logistic function.

Bound: at most about ``FIT_ROWS`` labelled rows, chosen by a hash of the id, are used to fit.

Defined cases: a null text counts as empty and is scored like any other; without labelled rows
every score is 0.5, with one class only it is that class's smoothed share; an empty table gives
no rows; a repeated document is scored once per row; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.sampling import labelled_sample
from loomwell.llm.shared import crc_of_id, materialise, small_batches, text_or_empty

FIT_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "bars", "shouts", "non_ascii",
    "distinct", "top_word", "twice", "pairs_seen", "lines_seen", "log_line", "capital_words", "mark_ends", "control", "links",
)
_LINK = re.compile(rb"https?:|www\.|@\w")


def _classes() -> np.ndarray:
    """Byte value -> membership in the character classes that are counted."""
    table = np.zeros((256, 9))
    groups = (
        range(65, 91), range(48, 58), [c for c in range(33, 127) if not chr(c).isalnum()], map(ord, "#$%&*@^~<>{}[]\\"),
        [ord("|")], [ord("!")], range(192, 256), [*range(0, 9), *range(14, 32), 127], [*range(97, 123), *range(65, 91), *range(192, 256)],
    )
    for k, group in enumerate(groups):
        table[list(group), k] = 1
    return table


def features(text: str, classes: np.ndarray) -> list[float]:
    """The features of a whole text."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    upper, digits, marks, symbols, bars, shouts, wide, control, letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ classes
    words = raw.split()
    count = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [line for line in raw.split(b"\n") if line]
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / count,
        upper / max(letters, 1),
        digits / n,
        marks / n,
        symbols / n,
        bars / count,
        shouts / count,
        wide / max(letters, 1),
        len(seen) / count,
        max(seen.values(), default=0) / count,
        sum(map(eq, words, words[1:])) / count,
        len(set(zip(words, words[1:], strict=False))) / max(count - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))),
        sum(map(bytes.istitle, words)) / count,
        sum(1 for word in words if word[-1] < 48) / count,
        control / n,
        len(_LINK.findall(raw)) / count,
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = _classes()
    for batch in batches:
        rows = [features(text, classes) for text in batch.column(1).to_pylist()]
        flat = pa.array(np.array(rows, dtype=np.float32).reshape(-1), pa.float32())
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])


@dataclass
class Additive:
    """Cut points of each feature, lookup tables, and two-way tables over coarse bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        fine, rough = self.bins(x, self.cuts), self.bins(x, self.coarse)
        for j, table in enumerate(self.tables):
            total += table[fine[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[rough[:, i], rough[:, j]]
        return 1 / (1 + np.exp(-total))


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf value of each bin: the bins of one feature are split ``depth`` times at the best place."""
    if depth:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        all_g, all_h = g.sum(), h.sum()
        gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge)
        gain[(left_h < least) | (all_h - left_h < least)] = -1
        if len(gain) and gain.max() > all_g**2 / (all_h + ridge) + 1e-9:
            at = int(gain.argmax()) + 1
            return np.concatenate([_shallow_tree(x[0], x[1], depth - 1, ridge, least) for x in ((g[:at], h[:at]), (g[at:], h[at:]))])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best pair of cuts over a two-way histogram: its gain, and the value of every cell."""
    corner_g, corner_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a, row, column, every = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, row - a, column - a, every - row - column + a]

    pg, ph = parts(corner_g), parts(corner_h)
    gain = sum(a**2 / (b + ridge) for a, b in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [a[i, j] / (b[i, j] + ridge) for a, b in zip(pg, ph, strict=True)]
    cells = np.empty_like(g)
    cells[: i + 1, : j + 1], cells[: i + 1, j + 1 :], cells[i + 1 :, : j + 1], cells[i + 1 :, j + 1 :] = value
    return float(gain[i, j] - corner_g[-1, -1] ** 2 / (corner_h[-1, -1] + ridge)), cells


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 5, ridge: float = 2.0) -> Additive:
    """Cyclic boosting under logistic loss: features in turn, then the strongest pairs in turn."""
    width = len(FEATURES)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))), [np.zeros(0)] * width, [np.zeros(1)] * width, [np.zeros(0)] * width, [], [])
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])) for j in range(width)]
    model.coarse = [np.unique(np.quantile(x[:, j], [0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98])) for j in range(width)]
    fine, rough = model.bins(x, model.cuts), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(fine[:, j], g, len(table)), np.bincount(fine[:, j], h, len(table)), 2, ridge, 1.0)
            table += step
            total += step[fine[:, j]]

    def histogram(i: int, j: int, of: np.ndarray) -> np.ndarray:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(rough[:, i] * shape[1] + rough[:, j], of, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    open_pairs = [(i, j) for i in range(width) for j in range(i) if len(model.coarse[i]) and len(model.coarse[j])]
    ranked = sorted(open_pairs, key=lambda p: -_quadrants(histogram(*p, g), histogram(*p, h), ridge)[0])
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _quadrants(histogram(i, j, g), histogram(i, j, h), 4 * ridge)[1]
            table += step
            total += step[rough[:, i], rough[:, j]]
    return model


def _score_rows(model: Additive, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features; the only pass over the texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col))
    return rows.mapInArrow(_feature_rows, "doc_id long, x array<float>")


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.7, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``labels`` (doc_id, quality) teach only where crc32 of the id, modulo 4, is not 2.
    The features (about 90 bytes a document) are written to the shared folder once, then read
    for the fit's sample and again for the scores.
    """
    rows, _ = materialise(feature_table(docs), "quality-features")
    known = labels.where(F.col("quality").isin(0, 1) & (crc_of_id("doc_id") % 4 != 2)).select("doc_id", "quality")
    chosen = labelled_sample(known, "doc_id", bound)
    taught = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("x").alias("x"), F.first("quality").alias("y")).orderBy("doc_id").toArrow()
    x = np.array(taught.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    model = fit(x, np.array(taught.column("y").to_pylist(), dtype=float))
    scored = rows.mapInArrow(_score_rows(model, cut), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")
