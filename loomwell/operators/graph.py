"""Connected components by local contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.sources.scratch import written

#: Rounds after which an unsettled graph is an error. A path of n nodes takes about log3(n).
MOST_ROUNDS = 60


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for ``nodes`` (id) and ``edges`` (a, b): component is the smallest id that edges lead to.

    Each round every node takes the neighbour (or itself) that a hash of the round ranks first as its label, and all nodes
    with one label become one node. A node's neighbours are reduced by an aggregate, so a node
    with many edges is no hot spot, and only the number of edges left reaches the driver. Each round's labels also get the
    smallest id below them. Answers go back round by round, the last and smallest first: all nodes are joined once, by
    their label of the first round, and never by the few labels that large components end in.
    """
    links = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    maps, least = [], []
    for turn in range(MOST_ROUNDS):
        if links.isEmpty():
            break
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64(F.lit(turn), "n"), "n")
        seen = both.select("a", F.col("b").alias("n")).unionByName(links.select("a", F.col("a").alias("n"))).unionByName(links.select(F.col("b").alias("a"), F.col("b").alias("n")))
        label = written(seen.groupBy("a").agg(F.min_by("n", rank).alias("label")), "labels")
        known = label.withColumn("m", F.col("a")) if not least else label.join(least[-1].hint("merge"), "a")
        maps.append(label)
        least.append(written(known.groupBy("label").agg(F.min("m").alias("m")).withColumnRenamed("label", "a"), "least"))
        left = links.join(label, "a").select(F.col("label").alias("x"), "b")
        moved = left.join(label.withColumnRenamed("a", "b"), "b").select("x", F.col("label").alias("y")).where("x <> y")
        links = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components unsettled after {MOST_ROUNDS} rounds")
    found = None  # (label, component) of the labels that a round has made
    for turn in reversed(range(len(maps))):
        own = least[turn].select(F.col("a").alias("label"), "m")
        found = own.select("label", F.col("m").alias("component")) if found is None else own.join(found.hint("merge"), "label", "left").select("label", F.coalesce("component", "m").alias("component"))
        found = written(maps[turn].join(found.hint("merge"), "label").select(F.col("a").alias("label"), "component"), "found")
    if found is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(found.withColumnRenamed("label", "id").hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
