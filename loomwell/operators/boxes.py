"""Boxes that touch: connected groups of them, and their union to a fixpoint, as spatial joins over a quadtree.

Boxes are rows (by, id, x0, y0, x1, y1) of a page ``by``; two of one page touch when the gap between them is at most ``gap``
in both directions. Cells of a grid make that a keyed join, and three rules keep it linear where boxes crowd:

- a cell that one box covers has all its boxes joined to the smallest id (a star, no pairs);
- any other cell with more than ``crowd`` boxes is cut into four, down to ``LEVELS`` times;
- what is left is compared in pairs, at most ``crowd`` per cell unless cells of the last level hold more.

Equal boxes are one until the end, so copies of a box cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.operators.graph import components
from loomwell.sources.scratch import written

LEVELS = 8
CROWD = 64
SIDES = ("x0", "y0", "x1", "y1")


def _cells(low: str, high: str, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))


def touching_pairs(boxes: DataFrame, gap: float = 2.0, cell: float = 256.0, crowd: int = CROWD) -> DataFrame:
    """(by, a, b): edges that connect boxes (by, id, x0, y0, x1, y1) exactly as touching does; not all touching pairs."""
    half = gap / 2
    grown = boxes.select("by", "id", *[(F.col(s) + (half if s.endswith("1") else -half)).alias(s) for s in SIDES])
    size = F.lit(float(cell))
    now = grown.withColumn("cx", _cells("x0", "x1", size)).withColumn("cy", _cells("y0", "y1", size))
    key = ["by", "cx", "cy"]
    edges = []
    for level in range(LEVELS + 1):
        s = cell / 2**level
        covers = (F.col("x0") <= F.col("cx") * s) & (F.col("x1") >= (F.col("cx") + 1) * s) & (F.col("y0") <= F.col("cy") * s) & (F.col("y1") >= (F.col("cy") + 1) * s)
        now = written(now.withColumn("covers", covers), "cells")
        stats = now.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("covers").alias("star"), F.min("id").alias("least")).where("n > 1")
        marked = now.drop("covers").join(stats, key)
        edges.append(marked.where("star AND id <> least").select("by", F.col("least").alias("a"), F.col("id").alias("b")))
        last = level == LEVELS
        few = marked.where("NOT star" if last else f"NOT star AND n <= {crowd}")
        other = few.select(*key, *[F.col(c).alias("_" + c) for c in ("id", *SIDES)])
        met = few.join(other, key).where("id < _id AND x0 <= _x1 AND _x0 <= x1 AND y0 <= _y1 AND _y0 <= y1")
        edges.append(met.select("by", F.col("id").alias("a"), F.col("_id").alias("b")))
        rest = marked.where(f"NOT star AND n > {crowd}").select("by", "id", *SIDES, "cx", "cy")
        if last or rest.isEmpty():
            break
        child = F.lit(s / 2)
        parts = rest.withColumn("kx", F.explode(F.array(F.col("cx") * 2, F.col("cx") * 2 + 1)))
        parts = parts.withColumn("ky", F.explode(F.array(F.col("cy") * 2, F.col("cy") * 2 + 1)))
        inside = (F.col("x0") < (F.col("kx") + 1) * child) & (F.col("x1") >= F.col("kx") * child) & (F.col("y0") < (F.col("ky") + 1) * child) & (F.col("y1") >= F.col("ky") * child)
        now = parts.where(inside).select("by", "id", *SIDES, F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


def touching_components(boxes: DataFrame, gap: float = 2.0, cell: float = 256.0, crowd: int = CROWD) -> DataFrame:
    """(by, id, component): the smallest id of the boxes that a chain of touching ones leads to. Ids are unique per page."""
    rows = written(boxes.select("by", "id", *SIDES), "boxes")
    first = written(rows.groupBy("by", *SIDES).agg(F.min("id").alias("first")), "firsts")
    alone = first.select("by", F.col("first").alias("id"), *SIDES)
    node = lambda c: F.struct("by", F.col(c).alias("id"))
    pairs = touching_pairs(alone, gap, cell, crowd).select(node("a").alias("a"), node("b").alias("b"))
    found = components(alone.select(node("id").alias("id")), pairs)
    found = found.select(F.col("id.by").alias("by"), F.col("id.id").alias("first"), F.col("component.id").alias("component"))
    # merge joins: a broadcast table is held by every task, whatever the number of tasks
    member = rows.join(first.hint("merge"), ["by", *SIDES]).select("by", "id", "first")
    return member.join(found.hint("merge"), ["by", "first"]).select("by", "id", "component")


def merged_boxes(boxes: DataFrame, gap: float = 1.0, cell: float = 256.0, crowd: int = CROWD) -> DataFrame:
    """(by, id, x0, y0, x1, y1, n): boxes that touch become the box around them, which may meet others, until none do.

    The end: a round that merges nothing. Every other round leaves fewer boxes, and which boxes end up together doesn't
    depend on the order, since merging never separates. ``id`` is the smallest member, ``n`` the number of members.
    """
    now = written(boxes.select("by", "id", *SIDES, F.lit(1).cast("long").alias("n")), "boxes")
    count = now.count()
    while True:
        group = touching_components(now, gap, cell, crowd)
        around = [(F.min(s) if s.endswith("0") else F.max(s)).alias(s) for s in SIDES]
        merged = now.join(group, ["by", "id"]).groupBy("by", "component").agg(*around, F.sum("n").alias("n"))
        now = written(merged.select("by", F.col("component").alias("id"), *SIDES, "n"), "boxes")
        before, count = count, now.count()
        if count == before:
            return now
