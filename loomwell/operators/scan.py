"""Prefix scans over keys of any size: running values along an order, without one task per key.

A window over a key runs in one task, which a key with a third of all rows doesn't fit. Here a key's rows are cut into
buckets by their order, at quantiles of the order over the whole table. A first pass scans each bucket and sums it up in
one row; the summaries of a key, at most one per bucket, are scanned in turn; a second pass adds to
each row what the buckets before it carry. Keys below ``hot`` rows are scanned directly.

Every running value is a monoid (sum, max, min, last), so that carrying is exact: the same rows come out as from one window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.sources.scratch import written

BUCKETS = 64
#: Rows of a key above which it may be cut into buckets, and how many keys are cut at most: at a larger table a key must hold
#: more than one row in MOST_KEYS. So hot keys and their carries (MOST_KEYS times BUCKETS rows) are small enough to broadcast.
HOT = 100_000
MOST_KEYS = 10_000


@dataclass(frozen=True)
class Running:
    """A running value ``name`` of ``column`` by ``kind``: sum, max, min, or last (the value of the row before or at hand).

    ``exclusive``: of the rows before this one only; so an exclusive ``last`` is the row before (lag).
    ``last`` passes over nulls when ``skip_nulls`` is set.
    """

    name: str
    column: str
    kind: str
    exclusive: bool = False
    skip_nulls: bool = False

    def over(self, window, frame: tuple[int, int]) -> Column:
        spec = window.rowsBetween(*frame)
        value = F.col(self.column)
        if self.kind == "last":
            # a struct tells "no row" from a row whose value is null
            return F.last(F.struct(value.alias("v")) if not self.skip_nulls else F.when(value.isNotNull(), F.struct(value.alias("v"))), ignorenulls=self.skip_nulls).over(spec)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value).over(spec)

    def join(self, before: Column, here: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(here, before)
        if self.kind == "sum":
            return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
        return F.greatest(before, here) if self.kind == "max" else F.least(before, here)

    def shown(self, value: Column) -> Column:
        return value["v"] if self.kind == "last" else value


def quantile_bucket(rows: DataFrame, order: str, buckets: int = BUCKETS) -> Column:
    """A column that cuts rows at quantiles of ``order`` (a number, date or timestamp); equal values share a bucket."""
    kind, value = dict(rows.dtypes)[order], F.col(order)
    if kind == "timestamp_ntz":  # in seconds by the clock, whatever the session's zone
        number = (F.unix_date(value.cast("date")) * 86_400.0) + F.hour(value) * 3_600 + F.minute(value) * 60 + F.second(value)
    else:
        number = (F.unix_date(value) if kind == "date" else value).cast("double")
    cuts = rows.agg(F.percentile_approx(number, [k / buckets for k in range(1, buckets)], 10_000).alias("c")).first()["c"] or []
    cut = sorted(set(cuts))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: c < number)), F.lit(0)) if cut else F.lit(0)


def running(rows: DataFrame, by: list[str], order: list[str], values: list[Running], hot: int = HOT, buckets: int = BUCKETS, bucket: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """``rows`` with a column for each of ``values``, scanned per key ``by`` in the order of ``order`` (nulls first).

    ``order`` should be unique within a key. The first of ``order`` decides about buckets, unless ``bucket`` makes a column that rises with
    the order. Keys with more than ``hot`` rows are found by a count and joined back.
    """
    kept = rows.columns
    hot = max(hot, rows.count() // MOST_KEYS)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot).select(*by, F.lit(True).alias("_hot"))
    hot_keys = written(sizes, "hot-keys")
    if hot_keys.isEmpty():
        return _direct(rows, by, order, values).select(*kept, *[v.name for v in values])
    match = [rows[c].eqNullSafe(hot_keys[c]) for c in by]
    condition = match[0]
    for more in match[1:]:
        condition = condition & more
    marked = rows.join(F.broadcast(hot_keys.select(*by, "_hot")), condition, "left").select(*[rows[c] for c in kept], F.coalesce("_hot", F.lit(False)).alias("_hot"))
    cold = _direct(marked.where("NOT _hot"), by, order, values)
    crowded = marked.where("_hot")
    place = bucket(crowded) if bucket else quantile_bucket(crowded, order[0], buckets)
    crowded = crowded.withColumn("_bucket", place)
    done = _carried(crowded, by, order, values)
    names = [v.name for v in values]
    return cold.select(*kept, *names).unionByName(done.select(*kept, *names))


def _direct(rows: DataFrame, by: list[str], order: list[str], values: list[Running]) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.select("*", *[v.shown(v.over(window, (Window.unboundedPreceding, -1 if v.exclusive else 0))).alias(v.name) for v in values])


def _carried(rows: DataFrame, by: list[str], order: list[str], values: list[Running]) -> DataFrame:
    keys = [*by, "_bucket"]
    window = Window.partitionBy(*keys).orderBy(*order)
    local = rows.select("*", *[v.over(window, (Window.unboundedPreceding, -1 if v.exclusive else 0)).alias(f"_here_{v.name}") for v in values])
    totals = []
    for v in values:
        value = F.col(v.column)
        if v.kind == "last":
            some = F.struct(value.alias("v"))
            at = F.struct(*order)
            totals.append((F.max_by(some, at) if not v.skip_nulls else F.max_by(F.when(value.isNotNull(), some), F.when(value.isNotNull(), at))).alias(f"_sum_{v.name}"))
        else:
            totals.append({"sum": F.sum, "max": F.max, "min": F.min}[v.kind](value).alias(f"_sum_{v.name}"))
    summary = written(rows.groupBy(*keys).agg(*totals), "bucket-sums")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for v in values:
        total = F.col(f"_sum_{v.name}")
        carried = F.last(total, ignorenulls=True) if v.kind == "last" else {"sum": F.sum, "max": F.max, "min": F.min}[v.kind](total)
        carry.append(carried.over(earlier).alias(f"_before_{v.name}"))
    before = written(summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *carry), "bucket-carries")
    condition = F.col("_bucket").eqNullSafe(F.col(f"_k{len(by)}"))
    for i, k in enumerate(by):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(before), condition)
    return joined.select("*", *[v.shown(v.join(F.col(f"_before_{v.name}"), F.col(f"_here_{v.name}"))).alias(v.name) for v in values])
