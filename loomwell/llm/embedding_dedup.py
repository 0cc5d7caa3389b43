"""Near-duplicate vectors by cross-polytope hashing, with multiprobe and exact verification.

A vector is rotated by random signs and fast Hadamard transforms; the nearest signed axis is
one hash, ``HASHES`` of them make a key, and ``TABLES`` keys are made. Beside the best key of a
table come the ones that take the second nearest axis where that costs least (``PROBES`` keys
in all). Vectors of one label that share a key are compared by cosine in double precision. A
pair is counted where it shares its first key, so it counts once. Equal vectors are one vector
with a number of copies. A bucket of more than ``BLOCK`` vectors is compared block by block,
each pair of blocks in one task; only per-vector counts and the edges of a local forest leave
a task, never all pairs.

Defined cases: a vector that is null, empty, zero, or holds a null, NaN or infinity, and any
vector with a null label, has n_links 0 and itself as component; vectors of different length
never link; an empty table gives no rows; rows that repeat a ``vec_id`` are each reported;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.components import components
from loomwell.llm.shared import forget, materialise

TABLES, HASHES, PROBES = 7, 3, 4
BLOCK = 512
#: Rows that one call of the comparison gets at about.
CELL = 2000


def _clean(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, raw = [], []
            for vector, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = None
                if vector and label is not None and None not in vector:
                    v = np.array(vector, dtype=np.float64) + 0.0  # one zero, not two
                    size = np.abs(v).max()
                    v = v if np.isfinite(size) and size > 0 else None
                raw.append(None if v is None else v.astype(kind).tobytes())
                digests.append(None if v is None else xxhash.xxh3_128_digest(v.tobytes()))
            columns = [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "digest", "v"])

    return run


def unit(raw: bytes, kind: str = "f8") -> np.ndarray:
    """The vector of length 1, in double precision; ``kind`` is how its components are held."""
    v = np.frombuffer(raw, kind).astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def keys(units: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """[rows, tables * probes] bucket keys; the table's number is part of a key."""
    n, dim = units.shape
    width = 1 << max(dim - 1, 0).bit_length()
    padded = np.zeros((n, width))
    padded[:, :dim] = units
    signs = np.random.default_rng((seed, width)).choice([-1.0, 1.0], (tables, hashes, 3, width))
    flips = np.arange(1 << hashes)
    out = []
    for table in range(tables):
        first, second, cost = [], [], []
        for j in range(hashes):
            x = padded
            for step in range(3):
                x = hadamard(x * signs[table, j, step])
            size = np.abs(x)
            top = np.argsort(-size, axis=1, kind="stable")[:, :2]
            top = np.concatenate([top, top], axis=1)[:, :2]
            value = np.take_along_axis(x, top, 1)
            code = 2 * top + (value < 0)
            first.append(code[:, 0])
            second.append(code[:, 1])
            cost.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
        total = np.stack([sum((cost[j] for j in range(hashes) if flip >> j & 1), np.zeros(n)) for flip in flips], axis=1)
        for flip in np.argsort(total, axis=1, kind="stable")[:, :probes].T:
            key = np.full(n, table * 1_000_003 + width, np.int64)
            for j in range(hashes):
                key = key * (2 * width + 1) + np.where(flip >> j & 1, second[j], first[j])
            out.append(key)
    return np.stack(out, axis=1)


def _hash(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(raw, kind) for raw in batch.column("v").to_pylist()]
            found = np.zeros((len(units), TABLES * PROBES), np.int64)
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                found[at] = keys(np.stack([units[i] for i in at]))
                found[at] += np.int64(dim) << 52
            # keys travel with every vector: 32 mixed bits do, as equal ones only add candidates
            short = ((found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            offsets = pa.array(np.arange(len(units) + 1, dtype=np.int32) * found.shape[1])
            columns = [batch.column(c) for c in ("node", "label", "copies", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(short.reshape(-1)))], ["node", "label", "copies", "v", "keys"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the first that each pair of rows (of table-ordered keys) shares."""
    earlier = np.zeros(len(a), bool)
    for table in range(TABLES):
        own = slice(table * PROBES, (table + 1) * PROBES)
        shared = np.full(len(a), np.iinfo(np.int64).max)
        for i in range(own.start, own.stop):
            same = (a[:, i : i + 1] == b[:, own]).any(axis=1)
            np.minimum(shared, a[:, i], out=shared, where=same)
        hit = shared == key
        if table == 0:
            found = hit & ~earlier
        else:
            found |= hit & ~earlier
        earlier |= shared != np.iinfo(np.int64).max
    return found


def _compare(least: float, kind: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, links = [], [], []
        for (_, key, x, y), group in rows.groupby(["label", "key", "x", "y"], sort=True):
            if len(group) < 2:
                continue
            group = group.drop_duplicates("node").sort_values("node")
            side = group["side"].to_numpy()
            left = np.flatnonzero(side == 0)
            right = left if x == y else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            units, own = np.stack([unit(v, kind) for v in group["v"]]), np.stack(group["keys"].to_list()).astype(np.int64)
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            i, j = np.nonzero(units[left] @ units[right].T >= least)
            i, j = left[i], right[j]
            if x == y:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            counted = _first_shared(own[i], own[j], key)
            i, j = i[counted], j[counted]
            total = np.zeros(len(group), np.int64)
            np.add.at(total, i, copies[j])
            np.add.at(total, j, copies[i])
            at = np.flatnonzero(total)
            a += node[at].tolist()
            b += [None] * len(at)
            links += total[at].tolist()
            root = np.arange(len(group))
            while True:  # smallest label over the links, until nothing moves
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            moved = np.flatnonzero(root != np.arange(len(group)))
            a += node[moved].tolist()
            b += node[root[moved]].tolist()
            links += [0] * len(moved)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": pd.array(links, "Int64")})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"), "label")
    kind = dict(rows.dtypes)["label"]
    # components that came as floats are held as such, which loses nothing
    held_as = "f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "f8"
    base, _ = materialise(rows.mapInArrow(_clean(held_as), f"vec_id long, label {kind}, digest binary, v binary"), "vectors")
    same = base.where("digest IS NOT NULL").groupBy("label", "digest").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")
    )
    same, same_path = materialise(same, "vectors-distinct")
    hashed, hashed_path = materialise(
        same.select("node", "label", "copies", "v").mapInArrow(_hash(held_as), f"node long, label {kind}, copies long, v binary, keys array<int>"), "vectors-hashed"
    )
    keyed = hashed.select("label", "node", F.explode("keys").alias("key"))
    live = keyed.groupBy("label", "key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    live, live_path = materialise(live.select("label", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "vectors-buckets")
    met = hashed.select("*", F.explode("keys").alias("key")).join(live.hint("merge"), ["label", "key"])
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select(
        "label", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "copies", "v", "keys",
    )
    met, met_path = materialise(met, "vectors-met")
    cells = max(met.count() // CELL, 1)
    cell = F.pmod(F.xxhash64("label", "key", "x", "y"), F.lit(cells))
    found = met.groupBy(cell.alias("cell")).applyInPandas(_compare(least, held_as), "a long, b long, links long")
    found, found_path = materialise(found, "vectors-found")
    for path in (hashed_path, live_path, met_path):
        forget(vectors.sparkSession, path)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    known = same.select("label", "digest", "node", "copies").join(counts.hint("merge"), "node", "left").join(linked.hint("merge"), "node", "left")
    known = known.where("copies > 1 OR links > 0").select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component")
    )
    known, _ = materialise(known, "vectors-known")
    for path in (same_path, found_path):
        forget(vectors.sparkSession, path)
    out = base.select("vec_id", "label", "digest").join(known.hint("merge"), ["label", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
