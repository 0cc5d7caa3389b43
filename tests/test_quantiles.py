"""Sketches against sorted numbers."""

import math
import random

import pytest

from loomwell.operators import quantiles

ODD = [0.0, -0.0, 1.0, 2.0, 0.5, -1.0, math.nextafter(2, 1), math.nextafter(1, 2), 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -3e-310, math.inf, -math.inf, 8.0, 1023.999999, 1024.0, 3e-17]


def test_every_number_lies_in_its_bucket_and_buckets_rise(spark):
    draw = random.Random(2)
    numbers = sorted(ODD + [draw.choice([-1, 1]) * draw.random() * 10 ** draw.randrange(-300, 300) for _ in range(2_000)] + [2.0**e for e in range(-1074, 1024)])
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for bits in (3, 7):
        bucket = quantiles.bucket_of(df.x, bits)
        low, high = quantiles.bucket_ends(bucket, bits)
        rows = df.select("x", bucket.alias("b"), low.alias("low"), high.alias("high")).orderBy("x").collect()
        for row in rows:
            if row.x == 0 or math.isinf(row.x):
                assert row.low == row.high == row.x
            elif abs(row.x) >= 1e-290:  # numbers without all their bits lie as near as they can
                assert row.low <= row.x <= row.high and (row.high - row.low if row.high < math.inf else 0) <= abs(row.x) * 2**-bits * (1 + 2**-bits)
        assert all(a.b <= b.b for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("bits", [4, 7])
def test_merged_tiles_give_the_bucket_of_the_exact_value(spark, bits):
    draw = random.Random(4)
    rows = [("a", draw.randrange(5), draw.gauss(0, 50)) for _ in range(3_000)] + [("hot", 1, 7.0)] * 2_000 + [("one", 0, -2.5), ("one", 0, None), ("one", 1, math.nan), ("none", 1, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, tile int, v double, n string")
    tiles = quantiles.sketch(df, ["k", "tile"], "v", bits)
    asked = [0, 1, 250, 500, 501, 999, 1000]
    got = {(r.k, r.permille): r for r in quantiles.quantiles(quantiles.merged(tiles, ["k"]), ["k"], asked, bits).collect()}
    assert len(got) == 3 * len(asked)
    for k in ("a", "hot", "one"):
        known = sorted(v for key, _, v in rows if key == k and v is not None and not math.isnan(v))
        for p in asked:
            row, exact = got[k, p], known[max(-(-len(known) * p // 1000), 1) - 1]
            assert row.n == len(known) and row.low <= exact <= row.high and abs(row.estimate - exact) <= abs(exact) * 2.0 ** -(bits + 1) * (1 + 2.0**-bits)
    whole = quantiles.sketch(df, ["k"], "v", bits)
    assert sorted(whole.collect()) == sorted(quantiles.merged(tiles, ["k"]).select(*whole.columns).collect())
    with pytest.raises(ValueError):
        quantiles.quantiles(whole, ["k"], [1001])
    assert quantiles.quantiles(whole.limit(0), ["k"], [500]).count() == 0
