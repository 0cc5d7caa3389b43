"""Ranked lexical search over a clustered index whose documents are ordered by recursive graph bisection.

Index: a bisection tree learned on a bounded sample deals all documents out to parts; each part is cut into shards of a bounded
size, and within a shard graph bisection goes on down to clusters. A cluster's row holds its postings and for
each of its terms the highest impact in the cluster; a shard's row holds the same maxima over the shard. An impact is
the part of a score that doesn't depend on the query, in whole numbers.

Search: weights come from document frequencies, added up over shard rows. A shard's bound for an item is the sum of weight times maximum. The
shards with the best bounds are visited first; the tenth score found there is a floor. Then every shard whose bound reaches the
floor is visited, in it the clusters by falling bound, until no bound reaches what is needed. A bound equal to the tenth
score is still visited unless all its doc_ids come later, so that ties go to the smallest doc_id. Stopping is
exact: the result doesn't depend on the order, the sample, or the sizes of shards and clusters.

Defined cases: null texts and texts without a term aren't counted and never found; empty tables (documents or items) give no
rows; texts of any length are indexed whole; repeated rows are documents of their own, and repeated items are
answered each; rows that tie in score and doc_id are ranked in any order; a null doc_id comes after all others at equal scores;
items without a known term have no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.llm.bisection import bisect, preferences, route
from loomwell.llm.shared import forget, new_folder, small_batches

#: Runs of ASCII letters and digits and of all characters beyond ASCII, in UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
JAVA_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds of the sample that the tree is learned on. They decide about the layout only.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TERMS = 2048, 8 << 20, 8192
MOST_LEVELS = 6
#: Characters of items that are searched for at a time; more items are searched for in blocks.
ITEM_CHARS = 4 << 20
#: Shards per item that are visited before the floor is known.
PROBES = 2
#: (Shard, item) pairs, of 12 bytes, that are broadcast at most; more are joined by a shuffle.
BROADCAST_VISITS = 500_000
TOP = 10
LAST_ID = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # bytes.lower changes A-Z alone


@dataclass(frozen=True)
class Totals:
    """Documents with a term, all terms with repeats, and characters."""

    docs: int
    terms: int
    chars: int

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 10 + 90 * n * self.docs // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def totals(texts: DataFrame) -> Totals:
    """One pass over the texts, in the JVM."""
    n = F.regexp_count("text", F.lit(JAVA_TERM))
    row = texts.select(n.alias("n"), F.length("text").alias("c")).agg(F.count_if(F.col("n") > 0), F.sum("n"), F.sum("c")).first()
    return Totals(row[0] or 0, row[1] or 0, row[2] or 0)


@dataclass(frozen=True)
class Layout:
    """Sizes of an index: characters of text in one part, about; documents and postings of a shard; documents of a cluster."""

    part_chars: int = 8 << 20
    shard_docs: int = 4096
    shard_postings: int = 1 << 20
    cluster_docs: int = 128


@dataclass(frozen=True)
class Tree:
    """A bisection tree: rows of known terms, how each node's halves draw them, and into how many splits each part is dealt."""

    levels: int
    rows: dict[bytes, int]
    prefers: np.ndarray
    limit: np.ndarray
    splits: list[int]

    def part_of(self, bag) -> int:
        return route(self.prefers, self.limit, [self.rows[t] for t in bag if t in self.rows], self.levels)

    @staticmethod
    def learn(texts: DataFrame, all_: Totals, part_chars: int) -> Tree:
        levels = min(MOST_LEVELS, max(0, math.ceil(math.log2(max(1, all_.chars / part_chars)))))
        if not levels:
            return Tree(0, {}, np.zeros((1, 0), np.float32), np.zeros(1, np.float32), [1])
        share = int(min(1, SAMPLE_DOCS / all_.docs, SAMPLE_CHARS / all_.chars) * (1 << 62))
        mask = F.lit((1 << 62) - 1)
        taken = texts.where((F.length("text") <= SAMPLE_CHARS // 64) & (F.xxhash64(F.lit("bisection"), "doc_id", "text").bitwiseAND(mask) <= share))
        drawn = Counter(taken.select(F.col("text").cast("binary")).limit(2 * SAMPLE_DOCS).toArrow().column(0).to_pylist())
        docs = sorted(drawn)
        bags = [set(terms_of(text)) for text in docs]
        seen = Counter(t for bag in bags for t in bag)
        known = sorted((t for t, n in seen.items() if 4 <= n < len(docs)), key=lambda t: (-seen[t], t))[:SAMPLE_TERMS]
        rows = {t: k for k, t in enumerate(known)}
        kept = [np.array(sorted(rows[t] for t in bag if t in rows), dtype=np.int64) for bag in bags]
        doc = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
        term = np.concatenate([*kept, np.zeros(0, np.int64)])
        part = bisect(doc, term, len(kept), len(known), levels)
        tree = Tree(levels, rows, *preferences(part, doc, term, len(known), levels), [])
        # copies count here, so a part that many rows share gets as many splits as its share of the sample asks for
        chars = np.zeros(1 << levels)
        for text, bag in zip(docs, bags, strict=True):
            chars[tree.part_of(bag)] += drawn[text] * len(text)
        share = chars / max(1.0, chars.sum())
        return replace(tree, splits=[max(1, math.ceil(s * all_.chars / part_chars)) for s in share])


def _bags(tree: Tree):
    """Per document its part, and its distinct terms with their numbers in two binary values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                bag = Counter(found)
                for column, value in zip(out, (tree.part_of(bag), doc_id, len(found), b" ".join(bag), array("I", bag.values()).tobytes()), strict=True):
                    column.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["part", "doc_id", "n", "terms", "tfs"])

    return run


INDEX = "kind int, shard long, cluster int, least_id long, doc_ids array<long>, lengths array<long>, terms binary, dfs binary, tops binary, post_docs binary, post_tfs binary"
#: Kinds of index rows.
SHARD, CLUSTER = 0, 1


def _joined(values: list[bytes]) -> bytes:
    return b" ".join(values)


def _summary(kind: int, shard: int, cluster: int, ids: np.ndarray, names: list[bytes], term: np.ndarray, impact: np.ndarray, **more) -> pa.RecordBatch:
    """An index row over postings that are sorted by term."""
    kinds, starts, counts = np.unique(term, return_index=True, return_counts=True)
    values = {
        "kind": kind, "shard": shard, "cluster": cluster, "least_id": int(ids.min()), "terms": _joined([names[t] for t in kinds]),
        "dfs": counts.astype("<u4").tobytes(), "tops": np.maximum.reduceat(impact, starts).astype("<u4").tobytes(), **more,
    }
    fields = [f.split(" ") for f in INDEX.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([pa.array([values.get(f)], types[t]) for f, t in fields], [f for f, _ in fields])


def _shard_rows(shard: int, rows: list[tuple], all_: Totals, cluster_docs: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its own and one for each cluster."""
    number: dict[bytes, int] = {}
    per_doc = [np.fromiter((number.setdefault(t, len(number)) for t in row[2].split(b" ")), np.int64) for row in rows]
    ids = np.array([LAST_ID if row[0] is None else row[0] for row in rows], dtype=np.int64)
    n = np.array([row[1] for row in rows], dtype=np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(p) for p in per_doc])
    term, tf = np.concatenate(per_doc), np.frombuffer(b"".join(row[3] for row in rows), "<u4").astype(np.int64)
    shared = np.bincount(term, minlength=len(number)) > 1
    keep = shared[term]  # a term of one document says nothing about its neighbours
    levels = max(0, math.ceil(math.log2(len(rows) / cluster_docs)))
    compact = np.cumsum(shared) - 1
    part = bisect(doc[keep], compact[term[keep]], len(rows), int(shared.sum()), levels)
    impact = all_.impacts(tf, n[doc])
    names = list(number)
    by_term = np.argsort(term, kind="stable")
    yield _summary(SHARD, shard, -1, ids, names, term[by_term], impact[by_term])
    order = np.lexsort((doc, term, part[doc]))
    ends = np.searchsorted(part[doc][order], np.arange((1 << levels) + 1))
    for c in range(1 << levels):
        own, members = order[ends[c] : ends[c + 1]], np.flatnonzero(part == c)
        if len(own):
            local = np.searchsorted(members, doc[own]).astype("<u2")
            yield _summary(
                CLUSTER, shard, c, ids[members], names, term[own], impact[own], doc_ids=ids[members], lengths=n[members],
                post_docs=local.tobytes(), post_tfs=tf[own].astype("<u4").tobytes(),
            )


def _build(all_: Totals, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        rows, postings, part = [], 0, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for now, doc_id, n, terms, tfs in zip(*columns, strict=True):
                if rows and (now != part or len(rows) >= layout.shard_docs or postings + len(tfs) // 4 > layout.shard_postings):
                    yield from _shard_rows(shard, rows, all_, layout.cluster_docs)
                    shard += 1
                    rows, postings = [], 0
                part = now
                rows.append((doc_id, n, terms, tfs))
                postings += len(tfs) // 4
        if rows:
            yield from _shard_rows(shard, rows, all_, layout.cluster_docs)

    return run


@dataclass(frozen=True)
class Index:
    """A built index: its folder and the totals that its impacts are made with."""

    path: str
    totals: Totals


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = Layout()) -> Index:
    """Index every row of ``docs``. A part with many documents is split by hash, so that no task gets more than its share."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    all_ = totals(texts)
    tree = Tree.learn(texts, all_, layout.part_chars)
    bags = texts.select("doc_id", F.col("text").cast("binary")).mapInArrow(_bags(tree), "part int, doc_id long, n long, terms binary, tfs binary")
    split = F.pmod(F.xxhash64("doc_id", "terms"), F.element_at(F.lit(tree.splits), F.col("part") + 1))
    parts = max(2 * sum(tree.splits), int(spark.conf.get("spark.sql.shuffle.partitions"))) if tree.levels else 1
    dealt = bags.withColumn("split", split).repartition(parts, "part", "split").sortWithinPartitions("part", "split").drop("split")
    path = new_folder(spark, "lexical-index")
    dealt.mapInArrow(_build(all_, layout), INDEX).write.partitionBy("kind").parquet(path)
    return Index(path, all_)


@dataclass(frozen=True)
class Block:
    """Items that are searched for together: ids, all their distinct terms, and per item the places of its terms."""

    ids: list[int | None]
    terms: list[bytes]
    places: list[np.ndarray]

    @staticmethod
    def of(items: list[tuple]) -> Block:
        bags = [(item_id, sorted(set(terms_of((text or "").encode())))) for item_id, text in items]
        bags = [(item_id, bag) for item_id, bag in bags if bag]
        number: dict[bytes, int] = {}
        places = [np.array([number.setdefault(t, len(number)) for t in bag], dtype=np.int64) for _, bag in bags]
        return Block([item_id for item_id, _ in bags], list(number), places)

    def matches(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each row: its number, the places of the block's terms that it holds, and where they stand in the row."""
        if not hasattr(self, "_values"):
            object.__setattr__(self, "_values", {t: k for k, t in enumerate(self.terms)})
        of = self._values
        for k, blob in enumerate(batch.column(batch.schema.get_field_index("terms")).to_pylist()):
            pairs = [(of[t], at) for at, t in enumerate(blob.split(b" ")) if t in of]
            both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            yield k, both[:, 0], both[:, 1]


def _numbers(batch: pa.RecordBatch, name: str, k: int, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_py(), kind).astype(np.int64)


def _frequencies(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.terms), dtype=np.int64)
        for batch in batches:
            for k, place, at in block.matches(batch):
                df[place] += _numbers(batch, "dfs", k)[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["place", "df"])

    return run


class Weighted:
    """A block with weights: bounds of all items at once."""

    def __init__(self, block: Block, weights: np.ndarray, all_: Totals):
        self.block, self.weights, self.totals = block, weights, all_
        self.flat = np.concatenate(block.places)
        self.starts = np.cumsum([0, *[len(p) for p in block.places]])[:-1]

    def bounds(self, place: np.ndarray, tops: np.ndarray) -> np.ndarray:
        most = np.zeros(len(self.weights), dtype=np.int64)
        most[place] = self.weights[place] * tops
        return np.add.reduceat(most[self.flat], self.starts)


#: For each item the score that a row must reach, and the doc_id that it must not exceed at that score.
Floors = tuple[np.ndarray, np.ndarray]


def _shard_bounds(weighted: Weighted, floors: Floors):
    """(shard, item, bound) where the bound reaches the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, least = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, place, at in weighted.block.matches(batch):
                bound = weighted.bounds(place, _numbers(batch, "tops", k)[at])
                item = np.flatnonzero((bound > floors[0]) | (bound > 0) & (bound == floors[0]) & (least[k] <= floors[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), shards[k])), pa.array(item.astype(np.int32)), pa.array(bound[item])], ["shard", "item", "bound"])

    return run


class Best:
    """The best rows of every item so far, and what a further row needs."""

    def __init__(self, floors: Floors):
        self.score, self.last_id = floors[0].copy(), floors[1].copy()
        self.rows: list[list[tuple[int, int]]] = [[] for _ in self.score]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero((scores > self.score[item]) | (scores > 0) & (scores == self.score[item]) & (ids <= self.last_id[item]))
        if len(good):
            rows = sorted(self.rows[item] + [(-int(scores[g]), int(ids[g])) for g in good])[:TOP]
            self.rows[item] = rows
            if len(rows) == TOP and (rows[-1][0], rows[-1][1]) < (-self.score[item], self.last_id[item]):
                self.score[item], self.last_id[item] = -rows[-1][0], rows[-1][1]


def _visit(weighted: Weighted, floors: Floors):
    """Visit the clusters of a batch by falling bound; rows have the items that their shard is visited for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, visited, seen = Best(floors), 0, 0
        places = weighted.block.places
        for batch in batches:
            todo = []
            held_rows = {}
            for k, place, at in weighted.block.matches(batch):
                items = batch.column(batch.schema.get_field_index("items"))[k].values.to_numpy()
                bound = weighted.bounds(place, _numbers(batch, "tops", k)[at])[items]
                held_rows[k] = (place, at)
                seen += len(items)
                todo += [(-int(b), k, int(i)) for b, i in zip(bound, items, strict=True) if b > 0]
            matrices: dict[int, np.ndarray] = {}
            for minus, k, item in sorted(todo):
                least = batch.column(batch.schema.get_field_index("least_id"))[k].as_py()
                if -minus < best.score[item] or -minus == best.score[item] and least > best.last_id[item]:
                    continue
                if k not in matrices:
                    matrices[k] = _matrix(batch, k, *held_rows[k], weighted)
                row_of, matrix, ids = matrices[k]
                rows = row_of[places[item]]
                rows = rows[rows >= 0]
                visited += 1
                best.add(item, matrix[rows].sum(axis=0), ids)
        out = [(i, None if d == LAST_ID else d, -s) for i, rows in enumerate(best.rows) for s, d in rows]
        out.append((-1, visited, seen))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def _matrix(batch: pa.RecordBatch, k: int, place: np.ndarray, at: np.ndarray, weighted: Weighted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each place (or -1), weight times impact by row and document, and the doc_ids."""
    ids, n = (batch.column(batch.schema.get_field_index(c))[k].values.to_numpy() for c in ("doc_ids", "lengths"))
    counts = _numbers(batch, "dfs", k)
    starts = np.cumsum(counts) - counts
    size = counts[at]
    own = np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
    docs, tf = _numbers(batch, "post_docs", k, "<u2")[own], _numbers(batch, "post_tfs", k)[own]
    matrix = np.zeros((len(place), len(ids)), dtype=np.int64)
    row = np.repeat(np.arange(len(place)), size)
    matrix[row, docs] = weighted.weights[place][row] * weighted.totals.impacts(tf, n[docs])
    row_of = np.full(len(weighted.weights), -1, dtype=np.int64)
    row_of[place] = np.arange(len(place))
    return row_of, matrix, ids


FOUND = "item int, doc_id long, score long"


def _search_block(index: Index, clusters: DataFrame, shards: DataFrame, items: list[tuple]) -> tuple[DataFrame, Block] | None:
    block = Block.of(items)
    if not block.ids or not index.totals.docs:
        return None
    spark = clusters.sparkSession
    found = shards.select("terms", "dfs").mapInArrow(_frequencies(block), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(block.terms), dtype=np.int64)
    for row in found:  # as many rows as the block has terms, at most
        weights[row["place"]] = index.totals.weight(row["df"])
    weighted = Weighted(block, weights, index.totals)
    floors: Floors = (np.zeros(len(block.ids), dtype=np.int64), np.full(len(block.ids), LAST_ID))

    def bounded(floors: Floors) -> DataFrame:
        return shards.select("shard", "least_id", "terms", "tops").mapInArrow(_shard_bounds(weighted, floors), "shard long, item int, bound long")

    def visited(pairs: DataFrame, few: bool) -> DataFrame:
        visits = pairs.groupBy("shard").agg(F.collect_list("item").alias("items"))
        rows = clusters.join(F.broadcast(visits) if few else visits.hint("merge"), "shard")
        return rows.mapInArrow(_visit(weighted, floors), FOUND)

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    first = bounded(floors).withColumn("k", F.row_number().over(order)).where(F.col("k") <= PROBES).select("shard", "item")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda rows: rows.where("item >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    for row in ranked(visited(first, PROBES * len(block.ids) <= BROADCAST_VISITS)).where(F.col("rank") == TOP).collect():  # one row per item
        floors[0][row["item"]], floors[1][row["item"]] = row["score"], LAST_ID if row["doc_id"] is None else row["doc_id"]
    pairs_path = new_folder(spark, "lexical-visits")
    bounded(floors).select("shard", "item").write.parquet(pairs_path)
    pairs = spark.read.parquet(pairs_path)
    # rows of the probed shards reach the floors again, so the second visit alone is complete
    return visited(pairs, pairs.count() <= BROADCAST_VISITS), block


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", spent: list | None = None) -> DataFrame:
    """item_id, rank, doc_id and score: the TOP best documents of every item.

    Items are read in blocks of ITEM_CHARS characters, so what a task and the driver hold is bounded.
    ``spent`` gets (clusters visited, clusters of visited shards) summed over items, for each block.
    """
    spark = items.sparkSession
    stored = spark.read.schema(INDEX).parquet(index.path)
    fields = [f.split(" ")[0] for f in INDEX.split(", ")]
    clusters, shards = (stored.where(F.col("kind") == kind).select(*fields[1:]) for kind in (CLUSTER, SHARD))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items_now in _blocks(items.select(F.col(item_col).cast("long"), F.col(text_col))):
        made = _search_block(index, clusters, shards, items_now)
        if made is None:
            continue
        found, block = made
        path = new_folder(spark, "lexical-found")
        found.write.parquet(path)
        found = spark.read.schema(FOUND).parquet(path)
        if spent is not None:
            spent.append(tuple(found.where("item < 0").agg(F.sum("doc_id"), F.sum("score")).first()))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.where("item >= 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame([(k, v) for k, v in enumerate(block.ids)], "item int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in lists of about ITEM_CHARS characters, read one partition after the other."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(tuple(row))
        size += len(row[1] or "")
        if size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def ranked_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index ``docs`` and search for ``items``; the index is deleted once the result stands."""
    index = build(docs)
    found = search(index, items)
    forget(docs.sparkSession, index.path)
    return found


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{JAVA_TERM}')) AS term FROM documents WHERE text IS NOT NULL
), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{JAVA_TERM}')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
