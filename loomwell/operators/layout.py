"""Geometry of page layouts as relational operators: containment, islands, clusters, nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.sources.scratch import written

#: Pairs of values and zones compared in one part of a cell and in one task of :func:`values_in_zones`, about, and its tasks at most.
CELL_PAIRS, TASK_PAIRS, MOST_TASKS = 2_000_000, 20_000_000, 10_000


def values_in_zones(values: DataFrame, zones: DataFrame, page: str = "page_type", cell: float = 64.0) -> DataFrame:
    """Values (id, page, x, y: centres) with the zones (zone, page, x0, y0, x1, y1) that contain them.

    A zone covers a few grid cells and a value lies in one, so containment is a keyed join. Cells are counted first: one with
    many pairs is dealt out by its values (its zones go to each part), and the number of tasks follows the number of pairs, since
    neither the bytes of the inputs nor of the shuffle tell how much a task of the join makes.
    """
    v = values.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    z = zones.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))))
    z = z.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    key, one = [page, "_cx", "_cy"], F.count(F.lit(1))
    pairs = v.groupBy(*key).agg(one.alias("_n")).join(z.groupBy(*key).agg(one.alias("_m")), key).select(*key, (F.col("_n") * F.col("_m")).alias("_pairs"))
    pairs = written(pairs, "cells")
    total = pairs.agg(F.sum("_pairs").alias("n")).first()["n"] or 0
    if total > TASK_PAIRS:
        parts = pairs.select(*key, F.ceil(F.col("_pairs") / CELL_PAIRS).alias("_parts"))
        tasks = min(MOST_TASKS, total // TASK_PAIRS + 1)
        v = v.join(parts, key).withColumn("_part", F.pmod(F.xxhash64("id", "x", "y"), "_parts")).drop("_parts")
        z = z.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
        # one number deals both sides out; the keys are compared as ranges, so that Spark doesn't join by them and shuffle anew into few tasks
        deal = F.xxhash64(*key, "_part").alias("_deal")
        v = v.select("id", "x", "y", *key, deal).repartition(tasks, "_deal")
        z = z.select("zone", "x0", "y0", "x1", "y1", *[F.col(k).alias(f"_z_{i}") for i, k in enumerate(key)], deal).repartition(tasks, "_deal")
        same = " AND ".join(f"{k} <= _z_{i} AND {k} >= _z_{i}" for i, k in enumerate(key))
        met = v.join(z.hint("merge"), "_deal").where(same)
    else:
        met = v.join(z.hint("merge"), key)
    met = met.where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
    return met.select(page, "id", "zone")


def merged_intervals(intervals: DataFrame, by: str, start: str, end: str, bucket: Column | None = None) -> DataFrame:
    """(by, island, starts, ends, n): overlapping or touching intervals as one.

    ``bucket``, a column that rises with the start (its month, say), has the intervals of each bucket merged first, so that the
    window over a whole key meets islands and not rows.
    """
    rows = intervals.select(by, start, end, F.lit(1).cast("long").alias("_n"))
    if bucket is not None:
        inner = _islands(rows.withColumn("_bucket", bucket), [by, "_bucket"], start, end)
        rows = inner.select(by, F.col("starts").alias(start), F.col("ends").alias(end), F.col("n").alias("_n"))
    return _islands(rows, [by], start, end)


def _islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    numbered = rows.withColumn("_new", first).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("starts"), F.max(end).alias("ends"), F.sum("_n").alias("n"))


def distinct_levels(values: Column, tolerance: float = 3.0) -> Column:
    """An array's values in order, each more than ``tolerance`` above the last one kept."""
    start = F.array().cast("array<double>")

    def step(kept: Column, v: Column) -> Column:
        return F.when((F.size(kept) == 0) | (v > F.element_at(kept, -1) + tolerance), F.array_append(kept, v)).otherwise(kept)

    return F.aggregate(F.array_sort(values.cast("array<double>")), start, step)


def touching_lines(lines: DataFrame, by: str) -> DataFrame:
    """(by, line, component): ruling lines (line, x0, y0, x1, y1) of a page that touch, over any chain.

    Pages are small groups, so each is solved in one call.
    """
    import pandas as pd

    def solve(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("line").reset_index(drop=True)
        up = list(range(len(page)))

        def root(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(page)):
            a = page.loc[i]
            near = page[(page.x0 <= a.x1) & (page.x1 >= a.x0) & (page.y0 <= a.y1) & (page.y1 >= a.y0)].index
            for j in near:
                x, y = root(i), root(int(j))
                up[max(x, y)] = min(x, y)
        return pd.DataFrame({by: page[by], "line": page["line"], "component": [page["line"][root(i)] for i in range(len(page))]})

    kind = dict(lines.dtypes)
    return lines.groupBy(by).applyInPandas(solve, f"{by} {kind[by]}, line {kind['line']}, component {kind['line']}")


def best_with_margin(scores: DataFrame, by: str, item: str, score: str, k: int = 3) -> DataFrame:
    """The k best items per key, with the lead of each over the next one, clipped to [0, 1]."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_next", F.lead(score).over(order))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) - F.coalesce("_next", F.lit(0.0))))
    return ranked.where(F.col("rank") <= k).select(by, item, score, "rank", margin.alias("margin"))


def ratio_matches(queries: DataFrame, rows: DataFrame, ratio: float = 0.75, most: int = 100_000) -> DataFrame:
    """(query, match, distance): nearest row of each query vector if it is clearly nearer than the second.

    ``queries`` and ``rows``: id, v (array<double>), vectors of one length. The query set is stated
    and of checked size. Each batch of rows meets it as one matrix product and gives two rows
    per query at most, which a second step reduces to the two nearest.
    """
    import numpy as np
    import pandas as pd

    asked = queries.orderBy("id").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} query vectors")
    shared = queries.sparkSession.sparkContext.broadcast(([r["id"] for r in asked], np.array([r["v"] for r in asked], dtype=float)))

    def run(batches):
        ids, q = np.array(shared.value[0]), shared.value[1]
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            own, v = batch["id"].to_numpy(), np.array(batch["v"].to_list(), dtype=float)
            for at in range(0, len(ids), 512):
                part = q[at : at + 512]
                d = np.maximum((part**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * part @ v.T, 0)
                d[ids[at : at + 512, None] == own[None, :]] = np.inf
                # the product rounds; what may be among the two nearest is measured again
                second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else d[:, 0]
                i, j = np.nonzero(np.isfinite(d) & (d <= (np.where(np.isfinite(second), second, np.inf) + 1e-9 * (1 + np.abs(part).max() ** 2 * part.shape[1]))[:, None]))
                d[:] = np.inf
                for k in range(0, len(i), 65_536):
                    a, b = i[k : k + 65_536], j[k : k + 65_536]
                    d[a, b] = np.sqrt(((part[a] - v[b]) ** 2).sum(1))
                for _ in range(2):
                    j = d.argmin(1)
                    best = d[np.arange(len(d)), j]
                    ok = np.isfinite(best)
                    yield pd.DataFrame({"query": ids[at : at + 512][ok], "match": own[j[ok]], "distance": best[ok]})
                    d[np.arange(len(d)), j] = np.inf

    found = rows.select("id", "v").mapInPandas(run, "query long, match long, distance double")
    order = Window.partitionBy("query").orderBy("distance", "match")
    two = found.withColumn("rank", F.row_number().over(order)).where("rank <= 2").withColumn("second", F.lead("distance").over(order))
    return two.where((F.col("rank") == 1) & (F.col("distance") < ratio * F.col("second"))).select("query", "match", "distance")
