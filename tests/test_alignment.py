"""Alignment: known warps recovered among outliers, anchors located and refined, pages told apart."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.operators import alignment

WIDTH, HEIGHT = 1240.0, 1754.0
TRUE = np.array([[0.62, 0.05, 140.0], [-0.04, 0.6, 160.0], [2e-5, -3e-5, 1.0]])


def project(h, p):
    q = np.column_stack([p, np.ones(len(p))]) @ np.asarray(h).reshape(3, 3).T
    return q[:, :2] / q[:, 2:]


def match_rows(group, n, wrong, noise, seed=0, h=TRUE):
    rng = np.random.default_rng(seed)
    src = rng.uniform((0, 0), (WIDTH, HEIGHT), (n, 2))
    dst = project(h, src) + rng.normal(0, noise, (n, 2)) if noise else project(h, src)
    bad = rng.permutation(n)[: int(wrong * n)]
    dst[bad] = rng.uniform((0, 0), (1200, 1600), (len(bad), 2))
    return [(group, *map(float, s), *map(float, d)) for s, d in zip(src, dst)]


SCHEMA = "image_id long, x double, y double, u double, v double"
CORNERS = np.array([(0, 0), (WIDTH, 0), (WIDTH, HEIGHT), (0, HEIGHT)])


def test_warps_are_recovered_among_outliers(spark):
    rows = match_rows(1, 400, 0.4, 0.7) + match_rows(2, 60, 0.4, 0.3, 1) + match_rows(3, 9, 0, 0, 2) + match_rows(4, 40, 0, 0, 3) + [(5, 1.0, 1.0, 1.0, 1.0)] * 30 + [(1, None, 1.0, 1.0, 1.0)]
    out = {r.image_id: r for r in alignment.fit_homographies(spark.createDataFrame(rows, SCHEMA).repartition(4), ["image_id"]).collect()}
    assert set(out) == {1, 2, 3, 4, 5}
    for image in (1, 2, 4):
        off = np.linalg.norm(project(out[image].h, CORNERS) - project(TRUE, CORNERS), axis=1).max()
        assert off < 4, (image, off)
    assert out[1].n == 400 and 235 <= out[1].inliers <= 250 and out[1].residual < 1.5
    assert out[4].inliers == 40 and out[4].residual < 1e-6
    assert out[3].h is None and out[3].inliers == 0 and out[5].h is None


def test_one_hot_image_over_many_partitions(spark):
    rows = match_rows(7, 20_000, 0.4, 0.5)
    (out,) = alignment.fit_homographies(spark.createDataFrame(rows, SCHEMA).repartition(8), ["image_id"]).collect()
    assert np.linalg.norm(project(out.h, CORNERS) - project(TRUE, CORNERS), axis=1).max() < 0.5
    assert out.n == 20_000 and out.inliers >= 12_000


def test_fit_of_no_matches(spark):
    assert alignment.fit_homographies(spark.createDataFrame([], SCHEMA), ["image_id"]).count() == 0


@pytest.mark.parametrize(
    "h,good",
    [
        (TRUE, True), (np.eye(3), True), (np.diag([0.1, 0.1, 1.0]), False), (np.diag([3.0, 3.0, 1.0]), False), (np.diag([0.7, 1e-9, 1.0]), False),
        ([[1, 0, 0], [0, 1, 0], [-0.0012, 0, 1]], False), ([[0.7, 0, 0], [0, 0.7, 0], [-0.0016, 0, 1]], False),
    ],
)
def test_plausible(spark, h, good):
    row = spark.createDataFrame([([float(v) for v in np.asarray(h).ravel()],)], "h array<double>")
    size = [F.lit(v) for v in (WIDTH, HEIGHT, 1200.0, 1600.0)]
    assert row.select(alignment.plausible(F.col("h"), *size)).first()[0] is good
    assert row.select(alignment.plausible(F.lit(None).cast("array<double>"), *size)).first()[0] is False


def test_composed(spark):
    a, b = np.arange(9.0).reshape(3, 3) + np.eye(3), np.arange(9.0)[::-1].reshape(3, 3)
    row = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    assert np.allclose(row.select(alignment.composed(F.col("a"), F.col("b"))).first()[0], (a @ b).ravel())


def plain_correlation(window, patch):
    best = (-2.0, 0, 0)
    p = patch - patch.mean()
    for r in range(window.shape[0] - patch.shape[0] + 1):
        for c in range(window.shape[1] - patch.shape[1] + 1):
            w = window[r : r + patch.shape[0], c : c + patch.shape[1]]
            w = w - w.mean()
            d = np.sqrt((w * w).sum() * (p * p).sum())
            best = max(best, (float((w * p).sum() / d) if d else 0.0, c, r), key=lambda t: t[0])
    return best


def test_correlation_equals_sliding_it():
    rng = np.random.default_rng(0)
    window = rng.integers(0, 255, (40, 50)).astype(float)
    patch = window[11:21, 7:30] * 0.5 + 20
    assert alignment.correlation(window, patch)[1:] == (7, 11) and alignment.correlation(window, patch)[0] > 0.999
    other = rng.integers(0, 255, (8, 9)).astype(float)
    got, want = alignment.correlation(window, other), plain_correlation(window, other)
    assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9
    assert alignment.correlation(window[:5], patch)[0] == -1.0
    assert alignment.correlation(np.zeros((30, 30)), other)[0] == 0.0


def test_anchors_are_located(spark):
    rng = np.random.default_rng(1)
    window = rng.integers(0, 255, (60, 70)).astype(np.uint8)
    patch = window[20:32, 31:51].copy()
    noise = rng.integers(0, 255, patch.shape).astype(np.uint8)
    rows = [(1, "p", "a", 28, 18, window.tobytes(), 70, [(noise.tobytes(), 20), (patch.tobytes(), 20)])]
    frame = spark.createDataFrame(rows, "image_id long, page_type string, anchor string, pad_x int, pad_y int, window binary, window_width int, patches array<struct<pixels binary, width int>>")
    out = alignment.locate_anchors(frame).first()
    assert (out.anchor, out.dx, out.dy) == ("a", 3.0, 2.0) and out.score > 0.999


def pages(spark, shift, count):
    """Two photos of type p: the first fit is off by a small warp that anchors show; ``count`` anchors are found."""
    spots = [(120.0 + 250 * (k % 4), 150.0 + 300 * (k // 4)) for k in range(20)]
    anchors = spark.createDataFrame([("p", f"a{k}", x, y, x + 80, y + 14) for k, (x, y) in enumerate(spots)], "page_type string, anchor string, x0 double, y0 double, x1 double, y1 double")
    fits = spark.createDataFrame([(1, "p", TRUE.ravel().tolist(), 30)], "image_id long, page_type string, h array<double>, inliers long")
    photos = spark.createDataFrame([(1, 1200.0, 1600.0)], "image_id long, photo_width double, photo_height double")
    templates = spark.createDataFrame([("p", WIDTH, HEIGHT)], "page_type string, width double, height double")
    found = spark.createDataFrame([(1, "p", f"a{k}", 0.9 if k < count else 0.3, *shift(k)) for k in range(20)], "image_id long, page_type string, anchor string, score double, dx double, dy double")
    return alignment.align_pages(fits, anchors, photos, templates, found).first()


def test_anchors_refine_a_fit(spark):
    out = pages(spark, lambda k: (3.0, -2.0), 20)
    assert out.ok and out.anchors_total == out.anchors_visible == out.anchors_found == 20 and out.residual < 1e-6 and abs(out.confidence - 1) < 1e-6
    want = project(TRUE, CORNERS + (3.0, -2.0))
    assert np.abs(project(out.h, CORNERS) - want).max() < 1e-6


@pytest.mark.parametrize("count,ok", [(3, False), (5, False), (6, False), (8, True)])
def test_enough_anchors_make_an_alignment(spark, count, ok):
    out = pages(spark, lambda k: (1.0, 0.0), count)
    assert out.ok is ok and out.anchors_found == count
    assert (out.residual == 99.0) == (count < 4)


def test_anchors_that_disagree_are_no_alignment(spark):
    rng = np.random.default_rng(3)
    assert not pages(spark, lambda k: tuple(map(float, rng.uniform(-28, 28, 2))), 20).ok


def test_pages_are_told_apart(spark):
    aligned = [
        (1, "a", 50, 20, 20, 18, True), (1, "b", 30, 20, 20, 9, True), (1, "c", 90, 20, 10, 10, False), (1, "d", 1, 1, 1, 1, True),
        (2, "a", 0, 20, 0, 0, False), (2, "b", 0, 20, 0, 0, False), (3, "x", 40, 10, 10, 9, True), (3, "y", 41, 10, 10, 10, True),
    ]
    frame = spark.createDataFrame(aligned, "image_id long, page_type string, inliers long, anchors_total long, anchors_visible long, anchors_found long, ok boolean")
    ids = {"a": range(20), "b": range(10, 30), "c": range(50, 70), "d": [99], "x": range(200, 210), "y": [*range(200, 209), 300]}
    anchors = spark.createDataFrame([(t, str(i)) for t, own in ids.items() for i in own], "page_type string, anchor string")
    scores = spark.createDataFrame([(3, "x", "209", 0.9), (3, "y", "300", 0.87), (3, "x", "200", 0.1), (3, "y", "200", 0.99)], "image_id long, page_type string, anchor string, score double")
    out = {r.image_id: r for r in alignment.classify_pages(frame, anchors, scores).collect()}
    assert out[1].page_type == "a" and not out[1].twins and out[1].certainty == 1.0
    assert out[2].page_type == "a" and out[2].certainty == 1.0
    assert out[3].page_type == "x" and out[3].twins and abs(out[3].certainty - 0.75) < 1e-9
