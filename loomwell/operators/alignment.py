"""Alignment of photos to page templates: robust homographies over match tables, anchor refinement, page classification.

A homography takes template points (x, y) to photo points (u, v); it is an array of nine numbers, row by row. Fits go by hypothesis and
verification. Hypotheses are drawn from a bounded, hash-chosen pool of a group's matches; verification and refinement
read all matches, as aggregates over Catalyst expressions, so a group of any size spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.sources.scratch import written

#: Matches of a group that hypotheses are drawn from, draws, and how many of the best go on to all matches.
POOL, DRAWS, KEPT = 64, 256, 8


@dataclass(frozen=True)
class Limits:
    """What counts as an aligned page."""

    least_matches: int = 12
    inlier: float = 6.0
    anchor_inlier: float = 3.0
    least_area: float = 0.05
    most_area: float = 4.0
    anchor_score: float = 0.55
    least_anchors: int = 6
    residual: float = 4.0
    confidence: float = 0.25
    anchor_pad: tuple[int, int] = (4, 3)
    twins: float = 0.6
    twin_margin: float = 0.04
    margin: float = 0.1


LIMITS = Limits()


def projected(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(u, v) of a template point; NULL on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    some = F.when(F.abs(w) > 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / some, (h[3] * x + h[4] * y + h[5]) / some


def composed(a: Column, b: Column) -> Column:
    """The homography that applies ``b``, then ``a``."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def determinant(h: Column) -> Column:
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def plausible(h: Column, width: Column, height: Column, photo_width: Column, photo_height: Column, limits: Limits = LIMITS) -> Column:
    """Whether the page stays a convex quadrilateral of a sensible size: neither mirrored into itself, nor flat, tiny or huge."""
    zero = F.lit(0.0)
    corners = [projected(h, x, y) for x, y in ((zero, zero), (width, zero), (width, height), (zero, height))]
    turns, area = [], F.lit(0.0)
    for k in range(4):
        (ax, ay), (bx, by), (cx, cy) = corners[k], corners[(k + 1) % 4], corners[(k + 2) % 4]
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
        area = area + ax * by - bx * ay
    share = F.abs(area) / 2 / (photo_width * photo_height)
    convex = (F.least(*turns) > 0) | (F.greatest(*turns) < 0)
    finite = F.forall(h, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300))
    good = finite & (F.abs(determinant(h)) >= 1e-9) & convex & (share > limits.least_area) & (share < limits.most_area)
    return F.coalesce(good, F.lit(False))


def _exact(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies (n, 9) through four point pairs each (n, 4, 2), by direct linear transform; NaN where points are degenerate."""
    n = len(src)
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, none = np.ones_like(x), np.zeros_like(x)
    top = np.stack([x, y, one, none, none, none, -u * x, -u * y], axis=-1)
    low = np.stack([none, none, none, x, y, one, -v * x, -v * y], axis=-1)
    a, b = np.concatenate([top, low], axis=1), np.concatenate([u, v], axis=1)
    out = np.full((n, 9), np.nan)
    good = np.abs(np.linalg.det(a)) > 1e-9
    if good.any():
        out[good, :8] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
        out[good, 8] = 1.0
    return out


def _frame(points: np.ndarray) -> tuple[np.ndarray, float]:
    centre = points.mean(axis=0)
    return centre, float(np.abs(points - centre).mean()) or 1.0


def _unframed(h: np.ndarray, src: tuple[np.ndarray, float], dst: tuple[np.ndarray, float]) -> np.ndarray:
    """Homographies between centred and scaled points, for the points themselves."""
    (sc, ss), (dc, ds) = src, dst
    into = np.array([[1 / ss, 0, -sc[0] / ss], [0, 1 / ss, -sc[1] / ss], [0, 0, 1]])
    back = np.array([[ds, 0, dc[0]], [0, ds, dc[1]], [0, 0, 1]])
    full = (back @ h.reshape(-1, 3, 3) @ into).reshape(-1, 9)
    norm = np.where(np.abs(full[:, 8:]) > 1e-12, full[:, 8:], 1.0)
    return full / norm


def _errors(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Squared distances (hypotheses, points)."""
    p = np.einsum("nij,pj->npi", h.reshape(-1, 3, 3), np.column_stack([src, np.ones(len(src))]))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((p[..., :2] / p[..., 2:]) - dst) ** 2
    return np.nan_to_num(d.sum(axis=2), nan=np.inf, posinf=np.inf)


def hypotheses(points: np.ndarray, seed: int, threshold: float) -> np.ndarray:
    """The KEPT homographies with the least truncated error over a pool of (x, y, u, v), from draws of four."""
    src, dst = points[:, :2], points[:, 2:]
    if len(points) < 4:
        return np.zeros((0, 9))
    frames = _frame(src), _frame(dst)
    a, b = (src - frames[0][0]) / frames[0][1], (dst - frames[1][0]) / frames[1][1]
    order = np.argsort(np.random.default_rng(seed & (1 << 62) - 1).random((DRAWS, len(points))), axis=1)[:, :4]
    found = _exact(a[order], b[order])
    found = _unframed(found[np.isfinite(found).all(axis=1)], *frames)
    cost = np.minimum(_errors(found, src, dst), threshold**2).sum(axis=1)
    return found[np.argsort(cost, kind="stable")[:KEPT]]


#: Names of the sums that make the normal equations of a refinement.
_SUMS = [(i, j) for i in range(8) for j in range(i, 8)]


def _normal_sums(x: Column, y: Column, u: Column, v: Column, use: Column) -> list[Column]:
    one, none = F.lit(1.0), F.lit(0.0)
    top = [x, y, one, none, none, none, -u * x, -u * y]
    low = [none, none, none, x, y, one, -v * x, -v * y]
    sums = [F.sum(F.when(use, top[i] * top[j] + low[i] * low[j])).alias(f"_a{i}{j}") for i, j in _SUMS]
    return sums + [F.sum(F.when(use, top[i] * u + low[i] * v)).alias(f"_b{i}") for i in range(8)]


def fit_homographies(matches: DataFrame, by: list[str], threshold: float = LIMITS.inlier, least: int = LIMITS.least_matches, refinements: int = 2) -> DataFrame:
    """(by, n, h, inliers, residual): one robust fit per group of matches (by, x, y, u, v).

    ``residual`` is the median distance of inliers. ``h`` is NULL for groups of fewer than ``least`` matches, and where
    no four of the pool's points fit. Matches with a null coordinate don't count. Ties go to the earlier hypothesis; copies of a match count each.
    """
    points = ["x", "y", "u", "v"]
    rows = written(matches.select(*by, *[F.col(c).cast("double").alias(c) for c in points]).dropna(subset=points), "matches")
    hashed = F.xxhash64(F.lit("pool"), *points)
    pool = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(hashed, *points))).where(F.col("_k") <= POOL)
    pool = pool.groupBy(*by).agg(F.sort_array(F.collect_list(F.array(*points))).alias("_pool"))
    pool = pool.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by).withColumn("_seed", F.xxhash64(*[F.col(c).cast("string") for c in by]))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, frames = [], []
            for pts, n, seed in zip(batch["_pool"], batch["n"], batch["_seed"], strict=True):
                pts = np.array([list(p) for p in pts], dtype=float)
                out.append(hypotheses(pts, int(seed), threshold).tolist() if n >= least else [])
                (sc, ss), (dc, ds) = _frame(pts[:, :2]), _frame(pts[:, 2:])
                frames.append([*sc, ss, *dc, ds])
            yield pd.DataFrame({**{c: batch[c] for c in by}, "n": batch["n"], "hs": out, "frame": frames})

    guessed = written(pool.mapInPandas(guess, f"{kinds}, n long, hs array<array<double>>, frame array<double>"), "hypotheses")

    def distance2(h: Column) -> Column:
        u, v = projected(h, F.col("x"), F.col("y"))
        return F.coalesce((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2, F.lit(float("inf")))

    tried = rows.join(guessed, by).select(*by, *points, F.posexplode("hs").alias("k", "h"))
    cost = tried.groupBy(*by, "k").agg(F.sum(F.least(distance2(F.col("h")), F.lit(threshold**2))).alias("cost"))
    best = cost.groupBy(*by).agg(F.min_by("k", F.struct("cost", "k")).alias("k"))
    fits = written(guessed.join(best, by, "left").select(*by, "n", "frame", F.try_element_at("hs", F.col("k") + 1).alias("h")), "fits")
    for _ in range(refinements):
        fits = written(_refined(rows, fits, by, kinds, distance2, threshold), "fits")
    d2 = distance2(F.col("h"))
    close = d2 <= threshold**2
    shown = rows.join(fits.select(*by, "h").where("h IS NOT NULL"), by).groupBy(*by).agg(
        F.count_if(close).alias("inliers"), F.percentile_approx(F.when(close, F.sqrt(d2)), 0.5, 10_000).alias("residual")
    )
    return fits.join(shown, by, "left").select(*by, "n", "h", F.coalesce("inliers", F.lit(0).cast("long")).alias("inliers"), "residual")


def _refined(rows: DataFrame, fits: DataFrame, by: list[str], kinds: str, distance2, threshold: float) -> DataFrame:
    """Least squares over the inliers of each fit: sums over all rows, then one small system per group."""
    f = F.col("frame")
    x, y = (F.col("x") - f[0]) / f[2], (F.col("y") - f[1]) / f[2]
    u, v = (F.col("u") - f[3]) / f[5], (F.col("v") - f[4]) / f[5]
    use = distance2(F.col("h")) <= threshold**2
    sums = rows.join(fits.where("h IS NOT NULL"), by).groupBy(*by).agg(F.count_if(use).alias("_n"), *_normal_sums(x, y, u, v, use))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            better = []
            for row in batch.to_dict("records"):
                a, b = np.zeros((8, 8)), np.array([row[f"_b{i}"] for i in range(8)], dtype=float)
                for i, j in _SUMS:
                    a[i, j] = a[j, i] = row[f"_a{i}{j}"]
                h = list(row["h"])
                if row["_n"] > 4 and np.isfinite(a).all() and np.linalg.cond(a) < 1e14:
                    fr = row["frame"]
                    h = _unframed(np.append(np.linalg.solve(a, b), 1.0)[None], (np.array(fr[:2]), fr[2]), (np.array(fr[3:5]), fr[5]))[0].tolist()
                better.append(h)
            yield pd.DataFrame({**{c: batch[c] for c in by}, "_h": better})

    solved = sums.join(fits.select(*by, "frame", "h"), by).mapInPandas(solve, f"{kinds}, _h array<double>")
    return fits.join(solved, by, "left").select(*by, "n", "frame", F.coalesce("_h", "h").alias("h"))


def correlation(window: np.ndarray, patch: np.ndarray) -> tuple[float, int, int]:
    """The best normalised cross-correlation of a patch within a window, and where: (score, column, row); -1 if it doesn't fit."""
    ph, pw = patch.shape
    wh, ww = window.shape
    if wh <= ph or ww <= pw or not patch.size:
        return -1.0, 0, 0
    w, p = window.astype(float), patch.astype(float)
    p = p - p.mean()
    shape = (wh + ph - 1, ww + pw - 1)
    crossed = np.fft.irfft2(np.fft.rfft2(w, shape) * np.fft.rfft2(p[::-1, ::-1], shape), shape)[ph - 1 : wh, pw - 1 : ww]

    def sums(a: np.ndarray) -> np.ndarray:
        total = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return total[ph:, pw:] - total[:-ph, pw:] - total[ph:, :-pw] + total[:-ph, :-pw]

    spread = np.sqrt(np.maximum(sums(w * w) - sums(w) ** 2 / p.size, 0) * (p * p).sum())
    score = np.where(spread > 1e-6 * p.size, crossed / np.maximum(spread, 1e-12), 0.0)
    row, column = np.unravel_index(int(score.argmax()), score.shape)
    return float(np.clip(score[row, column], -1, 1)), int(column), int(row)


def locate_anchors(windows: DataFrame) -> DataFrame:
    """(image_id, page_type, anchor, score, dx, dy) from grey windows of a straightened photo around each anchor.

    ``windows``: image_id, page_type, anchor, pad_x, pad_y (where the anchor begins in the window), window, window_width, patches: array of
    (pixels, width), the template's anchor in its softened forms, of which the best counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                window = np.frombuffer(row["window"], np.uint8).reshape(-1, row["window_width"])
                tried = [correlation(window, np.frombuffer(p["pixels"], np.uint8).reshape(-1, p["width"])) for p in row["patches"]]
                score, column, line = max(tried, default=(-1.0, 0, 0))
                out.append((row["image_id"], row["page_type"], row["anchor"], score, float(column - row["pad_x"]), float(line - row["pad_y"])))
            yield pd.DataFrame(out, columns=["image_id", "page_type", "anchor", "score", "dx", "dy"])

    return windows.mapInPandas(run, "image_id long, page_type string, anchor string, score double, dx double, dy double")


def visible_anchors(fits: DataFrame, anchors: DataFrame, photos: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(image_id, page_type, anchor) of anchors (page_type, anchor, x0, y0, x1, y1) whose padded corners all lie in the photo
    (image_id, photo_width, photo_height) by the fit (image_id, page_type, h). Templates are a handful, so anchors are few."""
    px, py = limits.anchor_pad
    x0, y0, x1, y1 = F.col("x0") - px, F.col("y0") - py, F.col("x1") + px, F.col("y1") + py
    inside = F.lit(True)
    for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)):
        u, v = projected(F.col("h"), x, y)
        inside = inside & (u >= 0) & (u < F.col("photo_width")) & (v >= 0) & (v < F.col("photo_height"))
    return fits.where("h IS NOT NULL").join(photos, "image_id").join(anchors, "page_type").where(inside).select("image_id", "page_type", "anchor")


def align_pages(fits: DataFrame, anchors: DataFrame, photos: DataFrame, templates: DataFrame, found: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row per fit: h (refined by anchors), inliers, anchors_total, anchors_visible, anchors_found, residual, confidence, ok.

    ``found``: where anchors were seen on the straightened photo (image_id, page_type, anchor, score, dx, dy). Those that are visible and score
    enough give three points each; their robust fit corrects the first one. Under four anchors, or if the corrected fit isn't plausible, it
    stays and no residual is known (99). Ok: enough anchors, a small residual and confidence.
    """
    key = ["image_id", "page_type"]
    fits = written(fits.select(*key, "h", "inliers"), "first-fits")
    visible = written(visible_anchors(fits, anchors, photos, limits), "visible")
    seen = visible.join(found.where(F.col("score") >= limits.anchor_score), [*key, "anchor"]).join(anchors, ["page_type", "anchor"])
    px, py = limits.anchor_pad
    x0, y0, x1, y1 = F.col("x0") - px, F.col("y0") - py, F.col("x1") + px, F.col("y1") + py
    three = F.array(F.struct(x0.alias("x"), y0.alias("y")), F.struct(x1.alias("x"), y1.alias("y")), F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y")))
    points = seen.withColumn("p", F.explode(three)).select(*key, "p.x", "p.y", (F.col("p.x") + F.col("dx")).alias("u"), (F.col("p.y") + F.col("dy")).alias("v"))
    fixed = fit_homographies(points, key, limits.anchor_inlier, 12).select(*key, F.col("h").alias("hc"))
    off = points.join(fixed, key).withColumn("_d", F.sqrt(sum((a - b) ** 2 for a, b in zip(projected(F.col("hc"), F.col("x"), F.col("y")), (F.col("u"), F.col("v"))))))
    residual = off.groupBy(*key).agg(F.percentile_approx("_d", 0.5, 10_000).alias("_residual"))
    counts = visible.groupBy(*key).agg(F.count(F.lit(1)).alias("anchors_visible"))
    hits = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("anchors_found"))
    total = anchors.groupBy("page_type").agg(F.count(F.lit(1)).alias("anchors_total"))
    all_ = fits.join(photos, "image_id").join(templates, "page_type").join(total, "page_type", "left")
    for more in (counts, hits, fixed, residual):
        all_ = all_.join(more, key, "left")
    better = composed(F.col("h"), F.col("hc"))
    use = F.coalesce(F.col("hc").isNotNull() & plausible(better, F.col("width"), F.col("height"), F.col("photo_width"), F.col("photo_height"), limits), F.lit(False))
    zero = F.lit(0).cast("long")
    out = all_.select(
        *key, F.when(use, better).otherwise(F.col("h")).alias("h"), "inliers", *[F.coalesce(c, zero).alias(c) for c in ("anchors_total", "anchors_visible", "anchors_found")],
        F.when(use, F.col("_residual")).otherwise(F.lit(99.0)).alias("residual"),
    )
    ratio = F.col("anchors_found") / F.greatest(F.lit(1), F.col("anchors_visible"))
    confidence = F.least(F.lit(1.0), ratio) * F.exp(-F.greatest(F.lit(0.0), F.col("residual") - 1) / 4) * F.least(F.lit(1.0), F.col("anchors_found") / 8)
    ok = (F.col("anchors_found") >= limits.least_anchors) & (F.col("residual") <= limits.residual) & (F.col("confidence") >= limits.confidence)
    return out.withColumn("confidence", confidence).withColumn("ok", ok)


def classify_pages(aligned: DataFrame, anchors: DataFrame, scores: DataFrame, k: int = 3, limits: Limits = LIMITS) -> DataFrame:
    """One row per image: the page type that finds the largest part of its anchors, and how sure that is.

    ``aligned``: image_id, page_type, inliers, anchors_total, anchors_visible, anchors_found, ok; ``scores``: image_id, page_type, anchor, score. The ``k``
    types with most inliers compete (those without any only if nothing else does). An alignment that isn't ok ranks behind. If
    the best two are twins (Jaccard of their anchors above ``limits.twins``), the mean scores on the anchors that only one of them has decide.
    Ties: page type in order of name.
    """
    by_inliers = Window.partitionBy("image_id").orderBy(F.desc("inliers"), "page_type")
    top = aligned.withColumn("_n", F.row_number().over(by_inliers)).where((F.col("_n") == 1) | (F.col("_n") <= k) & (F.col("inliers") > 0))
    share = F.col("anchors_found") / F.greatest(F.lit(1), F.col("anchors_total")) + 0.5 * F.col("anchors_found") / F.greatest(F.lit(1), F.col("anchors_visible"))
    scored = top.withColumn("_score", F.when(F.col("ok"), share).otherwise(share / 10 - 1))
    by_score = Window.partitionBy("image_id").orderBy(F.desc("_score"), "page_type")
    two = scored.withColumn("_r", F.row_number().over(by_score)).where("_r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c)))
    pairs = written(two.groupBy("image_id").agg(pick("page_type", 1).alias("one"), pick("page_type", 2).alias("two"), pick("_score", 1).alias("s1"), pick("_score", 2).alias("s2")), "best-two")
    sets = anchors.groupBy("page_type").agg(F.collect_set("anchor").alias("ids"))  # a handful of types
    both = pairs.join(sets.select(F.col("page_type").alias("one"), F.col("ids").alias("t1")), "one", "left").join(sets.select(F.col("page_type").alias("two"), F.col("ids").alias("t2")), "two", "left")
    alike = F.size(F.array_intersect("t1", "t2")) / F.greatest(F.lit(1), F.size(F.array_union("t1", "t2")))
    both = both.withColumn("twins", F.coalesce(alike > limits.twins, F.lit(False)))
    own = scores.join(both.where("twins"), "image_id")
    only = lambda name, mine, other: F.avg(F.when((F.col("page_type") == F.col(name)) & F.array_contains(mine, F.col("anchor")) & ~F.array_contains(other, F.col("anchor")), F.col("score")))
    means = own.groupBy("image_id").agg(F.coalesce(only("one", "t1", "t2"), F.lit(0.0)).alias("m1"), F.coalesce(only("two", "t2", "t1"), F.lit(0.0)).alias("m2"))
    judged = both.join(means, "image_id", "left").withColumn("_m", F.coalesce(F.col("m2") - F.col("m1"), F.lit(0.0)))
    swap = F.col("twins") & (F.col("_m") > 0)
    sure = F.when(F.col("two").isNull(), 1.0).when(F.col("twins"), F.abs("_m") / limits.twin_margin).otherwise((F.col("s1") - F.col("s2")) / limits.margin)
    return judged.select("image_id", F.when(swap, F.col("two")).otherwise(F.col("one")).alias("page_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("certainty"), "twins")
