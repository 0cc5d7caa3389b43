"""Quantile sketches that merge: counts per bucket of a number's exponent and leading bits.

A bucket holds the numbers of one sign that agree in their power of two and the first ``bits`` bits after it, so it is at most
2**-bits of its numbers wide, and every quantile is known within its bucket, whatever the data. Sketches are rows (by, bucket, n);
those of tiles, days or files merge by adding counts, in any order, and give what one sketch of all rows gives. A key
holds 2**bits buckets per power of two that occurs, however many rows it has, and counts are combined before the shuffle.

Defined cases: null and NaN count nowhere; zero and either infinity are buckets of their own, as wide as nothing; a key without a number has no row; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7
#: Added to exponents so that buckets of positive numbers are positive, and the buckets of infinity.
_SHIFT, _ENDLESS = 1100, 1 << 40


def bucket_of(number: Column, bits: int = BITS) -> Column:
    """A long that rises with the number; null for null and NaN."""
    x, size = number.cast("double"), F.abs(number.cast("double"))
    guess = F.floor(F.log2(size)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)  # logarithms round
    place = (exponent + _SHIFT).cast("long") * (1 << bits) + F.floor((size / power(exponent) - 1) * (1 << bits)) + 1
    place = F.when(size == float("inf"), F.lit(_ENDLESS)).otherwise(place)
    return F.when(x.isNull() | F.isnan(x), None).when(x == 0, F.lit(0).cast("long")).when(x < 0, -place).otherwise(place)


def bucket_ends(bucket: Column, bits: int = BITS) -> tuple[Column, Column]:
    """The least number of a bucket, and its end: above all its numbers if positive, (least, end) mirrored if negative."""
    place = F.abs(bucket) - 1
    exponent = F.floor(place / (1 << bits)) - _SHIFT
    part = place - (exponent + _SHIFT) * (1 << bits)

    def side(step: Column | int) -> Column:
        value = F.pow(F.lit(2.0), exponent) * (1 + (part + step) / (1 << bits))
        return F.when(F.abs(bucket) == _ENDLESS, F.lit(float("inf"))).when(bucket == 0, F.lit(0.0)).otherwise(value)

    near, far = side(0), side(1)
    return F.when(bucket < 0, -far).otherwise(near), F.when(bucket < 0, -near).otherwise(far)


def sketch(rows: DataFrame, by: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(by, bucket, n): the sketch of a column per key."""
    return rows.select(*by, bucket_of(F.col(value), bits).alias("bucket")).where("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch per key ``by`` of sketches over finer keys, or of several tables of them in one."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], permille: list[int], bits: int = BITS) -> DataFrame:
    """(by, permille, n, low, high, estimate): for each asked share the bucket that holds the exact value, and its middle.

    The exact value is the one in place ceil(n * permille / 1000) of the sorted numbers, the first one for 0. The estimate is
    off by half the bucket's width at most, so by 2**-(bits + 1) of the value. A window over a key sees its buckets and not its rows.
    """
    if not permille or any(not 0 <= p <= 1000 for p in permille):
        raise ValueError("shares are given in thousandths, from 0 to 1000")
    order = Window.partitionBy(*by).orderBy("bucket")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = sketches.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    asked = counted.withColumn("permille", F.explode(F.array(*[F.lit(p) for p in sorted(set(permille))])))
    place = F.greatest(F.lit(1), F.ceil((F.col("_all") * F.col("permille")).cast("decimal(38,0)") / 1000))
    low, high = bucket_ends(F.col("bucket"), bits)
    held = asked.where((place <= F.col("_upto")) & (place > F.col("_upto") - F.col("n")))
    middle = F.when(low == high, low).otherwise(low + (high - low) / 2)
    return held.select(*by, "permille", F.col("_all").alias("n"), low.alias("low"), high.alias("high"), middle.alias("estimate"))
