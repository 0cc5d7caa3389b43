"""N-gram Jaccard join with signature trees.

1. One pass over the texts makes, per document, the size and digest of its shingle set, and
   the hashes of its first shingles in a fixed order (longest first). By the prefix principle, two linked sets share
   several of those; each set leaves out as many, the commonest of all sets, as they share beyond one.
2. Documents with a first shingle left that a different set has left too are read again. Their sets are
   cut into regions of the hash range, 1.3 times as many as two linked sets can differ in, so that
   linked sets have several regions in common. A region's key is the sum of its hashes. Each set
   leaves out as many of its keys, the commonest of all sets, as linked sets share beyond one (prefix principle
   again), so that a passage which many documents share makes no candidates by itself.
3. Documents that share region keys form candidate components. Each is searched by signature
   trees, dual traversal and exact comparison (``signature_tree``). A component of more than
   ``BLOCK`` sets is searched in chunks of that size, first each against itself and the first chunk, then
   what is still apart from its largest group against all.
4. The links' connected components are the result. Equal sets are one set from step 1 on.

Nothing is capped or sampled: steps 1 and 2 lose no linked pair.

Defined cases: a text of any length is read whole; null, empty and blank texts have no shingle, size 0, and link with nothing;
with fewer than k words the whole sequence is one shingle; an empty table gives no rows;
rows that repeat a ``doc_id`` are one node and each is reported; other columns are ignored.
a group is named by its smallest id, so ties don't matter. Shingles are compared by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwell.llm import signature_tree as tree
from loomwell.llm.components import components
from loomwell.llm.memory import Bounded, give_back, held
from loomwell.llm.shared import BROADCAST_IDS, TEXT_KEY, forget, materialise, release, small_batches, text_key, text_or_empty, without

#: Sets that one task searches at most (twice as many where two blocks meet).
BLOCK = 200
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted shingle hashes and the lengths of the shingles."""

    def __init__(self, k: int):
        self.k = k
        self.hashes = Bounded(lambda word: xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")).get

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k = min(self.k, len(words))
        of_word = np.frombuffer(b"".join(map(self.hashes, words)), np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = len(words) - k + 1
        total = np.full(n, k, np.uint64)
        length = np.zeros(n, np.int64)
        for j in range(k):
            total = (total ^ of_word[j : j + n]) * _MIX[0]
            total ^= total >> np.uint64(32)
            length += sizes[j : j + n]
        found, first = np.unique(_mixed(total), return_index=True)
        return found, length[first]


def shingler(k: int) -> Shingler:
    return held(f"shingles {k}", lambda: Shingler(k))


def first_shingles(hashes: np.ndarray, lengths: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's first shingles, and how many of them it may leave out.

    The prefix is one more than can be missing from a linked set, and a tenth of the set longer than that, so
    linked sets share more than a tenth of the smaller one's size among their first shingles. Each may then leave out a tenth
    of the least size that a linked set can have, at the end of an order that is the same for all.
    """
    n = len(hashes)
    most = n - -(-percent * n // 100) + 1 + n // 10
    return hashes[np.lexsort((hashes, -lengths))[:most]], -(-percent * n // 100) // 10


class Regions:
    """Size classes and their numbers of regions for one similarity."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def size_class(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def differ(self, level: int) -> int:
        """Most elements by which linked sets differ if the smaller one is of class ``level``."""
        small = self.edges[level + 1] - 1
        return (100 - self.percent) * (small + small * 100 // self.percent) // (100 + self.percent)

    def keys(self, hashes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(level, spare, keys) for both levels at which a linked set may be met: its own class and the one below.

        Linked sets have at least ``spare`` + 1 of the keys of a level in common, so in any order that is the
        same for all sets, ``spare`` keys at the end can be left out: the first key that both have stays with
        both. Keys of regions without elements are odd, others even. A set with more full regions
        than it can differ in lists only these; the order must have odd keys last.
        """
        n = len(hashes)
        if not n:
            return []
        own, out = self.size_class(n), []
        for level in (own, own - 1)[: 1 + (own > 0)]:
            differ = self.differ(level)
            m = (differ + 1) * 13 // 10 + 1
            region = (_mixed(hashes + np.uint64(level)) % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, region, _mixed(hashes ^ _MIX[1]))
            keys = _mixed(_mixed(sums + np.uint64(level)) + np.arange(m, dtype=np.uint64))
            full = np.bincount(region, minlength=m) > 0
            keys = (keys & ~np.uint64(1)) | ~full
            if full.sum() > differ:
                keys = keys[full]
            out.append((level, len(keys) - differ - 1, keys))
        return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _scan(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(k)
        for batch in batches:
            sizes, digests, keys, spare = [], [], [], []
            for text in batch.column(1).to_pylist():
                found, lengths = shingles(text)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                first, out = first_shingles(found, lengths, percent)
                keys.append(first)
                spare.append(out)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(spare, pa.int64()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", TEXT_KEY, "n_shingles", "digest", "spare", "keys"])
            give_back()

    return run


def _region_keys(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, regions = shingler(k), Regions(percent)
        for batch in batches:
            rows = [(node, *found) for node, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for found in regions.keys(shingles(text)[0])]
            nodes, levels, spare = (pa.array([row[i] for row in rows], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([nodes, levels, spare, _lists([row[3] for row in rows])], ["node", "level", "spare", "keys"])
            give_back()

    return run


def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(k)
        for batch in batches:
            members = pa.array([shingles(text)[0].tobytes() for text in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("component"), batch.column("n"), members], ["node", "component", "n", "members"])
            give_back()

    return run


def _with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of some documents (``rows`` has doc_id): by broadcast up to BROADCAST_IDS, else by shuffle."""
    return texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows.hint("merge"), "doc_id")


def _shared_rows(rows: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Rows (key, node) whose key has another node, with the smallest node of the key."""
    met = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return materialise(met.select("key", "least"), what)


def _kept(rows: DataFrame, owner: list[str], what: str) -> tuple[DataFrame, str]:
    """(key, node) of the keys that other nodes have too, without the ``spare`` commonest of each owner.

    ``rows``: node, spare, key and the owner's columns. The commonest keys are last in the order; of
    regions, the odd ones come after all others. A passage that many
    documents share so makes no candidates by itself.
    """
    spark = rows.sparkSession
    counts, path = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{what}-counts")
    release(spark)
    order = [F.desc("n"), "key"] if owner == ["node"] else [F.col("key").bitwiseAND(F.lit(1)).desc(), F.desc("n"), "key"]
    place = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
    kept = rows.join(counts.hint("merge"), "key").withColumn("place", place).where("place > spare").select("key", "node")
    kept, kept_path = materialise(kept, f"{what}-kept")
    forget(spark, path)
    release(spark)
    return kept, kept_path


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _search(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        held("shingle search", dict)  # lets go of the words that the worker has remembered
        group = group.sort_values(["node", "asks"], kind="stable").drop_duplicates(["node", "members"], keep="last")
        nodes, sets = group["node"].tolist(), [_as_set(m) for m in group["members"]]
        maps = np.stack([tree.bitmap(s) for s in sets])
        forest = tree.Forest(len(nodes))
        core = -1
        for i, near in enumerate(group["near"]):
            if near:  # all of these are linked to the component's smallest set
                core = i if core < 0 else core
                forest.join(core, i)
        start = [forest.root(i) for i in range(len(nodes))]
        asking = [i for i, asks in enumerate(group["asks"]) if asks]
        own = tree.build(asking, sets, maps)
        if len(asking) == len(nodes):
            tree.traverse(own, own, sets, maps, percent, forest)
        else:
            tree.traverse(own, own, sets, maps, percent, forest)
            tree.traverse(own, tree.build([i for i in range(len(nodes)) if not group["asks"].iat[i]], sets, maps), sets, maps, percent, forest)
        found = [(nodes[i], nodes[r]) for i in range(len(nodes)) if (r := forest.root(i)) != start[i] or r != i and start[i] == i]
        found += [(nodes[start[i]], nodes[forest.root(i)]) for i in range(len(nodes)) if forest.root(i) != start[i]]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def links(texts: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that give the components of all linked pairs among candidate components.

    ``texts``: doc_id, text. ``candidates``: node, component. Small components are one task
    each. A large one is dealt into chunks; each task searches one chunk by itself and against the first
    chunk. Of what that leaves apart from the component's largest group (by then all near copies are in it),
    each task gets one block, with one block of all sets.
    """
    spark = texts.sparkSession
    sizes, sizes_path = materialise(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(f"n > {BLOCK}"), "join-large", narrow=True)
    placed, placed_path = materialise(candidates.join(sizes.hint("merge"), "component", "left").withColumnRenamed("node", "doc_id"), "join-placed", narrow=True)
    members = _with_texts(texts, placed).select("doc_id", "text", "component", "n").mapInArrow(_members(k), "node long, component long, n long, members binary")
    members, members_path = materialise(members, "join-members")
    shape, row = "a long, b long", ["component", "x", "y", "node", "near", "asks", "members"]

    def searched(rows: DataFrame) -> DataFrame:
        return rows.select(*row).groupBy("component", "x", "y").applyInPandas(_search(percent), shape)

    alone = members.withColumn("y", F.lit(0)).withColumn("near", F.lit(False)).withColumn("asks", F.lit(True))
    found = searched(alone.where("n IS NULL").withColumn("x", F.lit(0)))
    if sizes.isEmpty():
        found, _ = materialise(found, "join-links", narrow=True)
    else:
        chunks = alone.where("n IS NOT NULL").withColumn("nx", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("x", F.pmod(F.xxhash64("node"), F.col("nx")).cast("int"))
        first = chunks.where("x = 0").withColumn("x", F.explode(F.sequence(F.lit(1), F.col("nx") - 1))).withColumn("asks", F.lit(False))
        found, _ = materialise(found.unionByName(searched(chunks.unionByName(first))), "join-links", narrow=True)
        release(spark)
        groups = components(found)
        labels = chunks.select("component", "node", "nx", "x").join(groups.select("node", F.col("component").alias("label")).hint("merge"), "node", "left")
        labels, labels_path = materialise(labels.withColumn("label", F.coalesce("label", "node")), "join-labels", narrow=True)
        by_label = labels.groupBy("component", "label").agg(F.count(F.lit(1)).alias("m"))
        largest = by_label.groupBy("component").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("n_all"))
        largest, largest_path = materialise(largest.where("n_all > top.m").select("component", "top", F.ceil((F.col("n_all") - F.col("top.m")) / BLOCK).cast("int").alias("ny")), "join-largest", narrow=True)
        dealt = labels.join(largest.hint("merge"), "component").withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ny")).cast("int"))
        dealt = dealt.select("node", "nx", "ny", "x", "y", (F.col("label") == F.col("top.label")).alias("near"))
        rows, rows_path = materialise(members.where("n IS NOT NULL").select("component", "node", "members").join(dealt.hint("merge"), "node"), "join-blocks")
        asked = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("asks", F.lit(False))
        asks = rows.where(~F.col("near")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("asks", F.lit(True))
        met, _ = materialise(searched(asked.unionByName(asks)), "join-met", narrow=True)
        found = found.unionByName(met)
        for path in (labels_path, largest_path, rows_path):
            forget(spark, path)
    for path in (sizes_path, placed_path, members_path):
        forget(spark, path)
    return found


def shingle_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: documents link when the
    Jaccard similarity of their k-word shingle sets is ``percent`` / 100 or more."""
    return _grouped(docs, k, percent, id_col, text_col).drop(TEXT_KEY)


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The same with TEXT_KEY, which tells apart texts of one id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scanned, _ = materialise(texts.withColumn(TEXT_KEY, text_key("text")).mapInArrow(_scan(k, percent), f"doc_id long, {TEXT_KEY} long, n_shingles long, digest binary, spare long, keys array<long>"), "join-scan")
    same, same_path = materialise(scanned.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "join-same")
    # the set stands for its copies: its first document's id is its node
    nodes = scanned.where("digest IS NOT NULL").select("doc_id", "digest", "spare", "keys").join(same.select("digest", "node").hint("merge"), ["digest"])
    firsts, firsts_path = materialise(nodes.where("doc_id = node").select("node", "spare", F.explode("keys").alias("key")), "join-first-rows")
    release(spark)
    kept, kept_path = _kept(firsts, ["node"], "join-first")
    forget(spark, firsts_path)
    met, met_path = _shared_rows(kept, "join-first-keys")
    live, live_path = materialise(kept.join(met.select("key").hint("merge"), "key", "left_semi").select("node").distinct(), "join-live", narrow=True)
    forget(spark, kept_path)
    forget(spark, met_path)
    release(spark)
    ids = live.select(F.col("node").alias("doc_id"))
    regions, regions_path = materialise(_with_texts(texts, ids).mapInArrow(_region_keys(k, percent), "node long, level long, spare long, keys array<long>"), "join-regions")
    keyed = regions.select("node", "level", "spare", F.explode("keys").alias("key"))
    kept, kept_path = _kept(keyed, ["node", "level"], "join-region")
    met, met_path = _shared_rows(kept, "join-region-keys")
    release(spark)
    pairs = kept.join(met.hint("merge"), "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    candidates, candidates_path = materialise(components(pairs), "join-candidates", narrow=True)
    for path in (live_path, regions_path, kept_path, met_path):
        forget(spark, path)
    release(spark)
    found = components(links(texts, candidates, k, percent))
    forget(spark, candidates_path)
    named = same.join(found.hint("merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "node", "copies")
    named, _ = materialise(named.where("copies > 1 OR component <> node").select("digest", "component"), "join-named", narrow=True)
    forget(spark, same_path)
    return (
        scanned.select("doc_id", TEXT_KEY, "n_shingles", "digest")
        .join(named.hint("merge"), "digest", "left")
        .select("doc_id", TEXT_KEY, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the first of its group; of rows
    with equal id and text one stays."""
    groups, _ = materialise(_grouped(docs, k, percent, id_col, text_col), "join-groups")
    dropped, _ = materialise(groups.where("doc_id <> component_id").select("doc_id", TEXT_KEY).distinct(), "join-dropped", narrow=True)
    return without(docs, dropped, groups, id_col, text_col)
