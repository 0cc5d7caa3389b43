"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step moves edges towards smaller ids; the number of steps is about the square of the
logarithm of the largest component at most, a handful in practice. Links stay distributed;
the driver only sees a count and a checksum per step. Minima are pre-aggregated before their
shuffle and written before they are joined back, so that adaptive execution can split the join
at a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.shared import forget, materialise


def components(edges: DataFrame, most_steps: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node
    that is reachable. Nulls and loops are left out; an empty input gives no rows. Links that don't
    settle in ``most_steps`` steps raise an error."""
    spark = edges.sparkSession
    now, path = materialise(_tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links", narrow=True)
    seen = None
    for _ in range(most_steps):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now, path = _step(both, True, path)
        now, path = _step(now, False, path)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").distinct()


def _step(edges: DataFrame, larger: bool, path: str) -> tuple[DataFrame, str]:
    """Link the larger (or the smaller) neighbours of every node to its smallest neighbour."""
    spark = edges.sparkSession
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least, least_path = materialise(least, "minima", narrow=True)
    met = edges.join(least.hint("merge"), "u")
    if larger:
        links = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        links = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    now, new_path = materialise(_tidy(links), "links", narrow=True)
    forget(spark, path)
    forget(spark, least_path)
    return now, new_path
