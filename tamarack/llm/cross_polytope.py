"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one and turned by fast pseudo-rotations (three rounds of random signs and a Hadamard
transform). In each table a vector lies in the bucket of the signed axis nearest to it; a query looks into the buckets
of its nearest axes. What it finds is ranked by exact distances of the vectors as they were. A query that finds fewer
than it asks for is held against all rows.

Buckets stand in a file beside the vectors. Queries go to the tasks in blocks of bounded size, one block after the
other, so that no vector is shuffled and no full bucket meets in one task; what is shuffled are the nearest of each task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import durable, numbered
from tamarack.llm.vectors import matrix, ranked, usable

#: Tables, and buckets that a query looks into in each: so many, and so large a part of the axes at least.
TABLES, PROBES, SHARE = 5, 12, 7 / 16
#: Bytes of the queries of a block, and rows and queries that are held against each other at once.
BLOCK_BYTES, ROWS, QUERIES = 4 << 20, 16384, 256
#: A scan of one of so many rows comes first; its k-th distance bounds what the whole scan hands on.
SAMPLE = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, table: int, seed: int = 1) -> np.ndarray:
    """How far each row reaches along each signed axis of a table's rotation."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    y = np.zeros((len(x), width))
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square is too large or too small
    y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for s in signs:
        y = hadamard(y * s)
    return np.hstack([y, -y])


def _bucketed(tables: int):
    """Rows with the number of their bucket in each table, two bytes each."""

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column("v"), dim)
                buckets = np.stack([axes(x, t).argmax(1) for t in range(tables)], 1).astype("<u4") if len(x) else np.zeros((0, tables), "<u4")
                yield pa.RecordBatch.from_arrays([part.column("dim"), part.column("id"), pa.array([b.tobytes() for b in buckets], pa.binary()), part.column("v")], ["dim", "id", "buckets", "v"])

    return bucketed


def probed(q: np.ndarray, tables: int, probes: int, share: float) -> np.ndarray:
    """Which buckets each query looks into: (tables, queries, buckets)."""
    out = []
    for t in range(tables):
        reach = axes(q, t)
        width = reach.shape[1]
        k = min(max(probes, math.ceil(share * width)), width)
        look = np.zeros(reach.shape, bool)
        np.put_along_axis(look, np.argpartition(-reach, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (len(q), 1)), True, 1)
        out.append(look)
    return np.stack(out)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows; where squares would leave the range of doubles, by way of the largest part."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt(((x - q) ** 2).sum(1))
    odd = np.flatnonzero(~((out > 1e-140) & (out < 1e140)))
    if len(odd):
        half = x[odd] / 2 - q[odd] / 2
        largest = np.abs(half).max(1)
        part = half / np.where(largest > 0, largest, 1)[:, None]
        with np.errstate(over="ignore"):  # a distance above all doubles is infinite
            out[odd] = 2 * (largest * np.sqrt((part * part).sum(1)))
    return out


class Nearest:
    """The k nearest rows of each of some queries among the rows of a task that share a bucket with them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, look: np.ndarray, reach: np.ndarray, k: int):
        self.rows, self.ids, self.q, self.look, self.k = rows, ids, q, look, k
        self.reach = reach.copy()  # no row farther than this can count
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.size = np.abs(q).max(1, initial=0)

    def add(self, ids: np.ndarray, buckets: np.ndarray, x: np.ndarray) -> None:
        size = np.abs(x).max(1, initial=0)
        norm = (x * x).sum(1) if (size < 1e70).all() and (size > 1e-70).all() else None
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
        found = [self.kept]
        for at in range(0, len(self.q), QUERIES):
            stop = min(at + QUERIES, len(self.q))
            met = np.zeros((stop - at, len(ids)), bool)
            for t, look in enumerate(self.look):
                met |= look[at:stop][:, buckets[:, t]]
            for i in range(at, stop):
                met[i - at, order[first[i] : last[i]]] = False  # a query's own row
            q = self.q[at:stop]
            if norm is not None and (self.size[at:stop] < 1e70).all():
                own = (q * q).sum(1)
                rough = norm - 2 * q @ x.T + own[:, None]
                rough[~met] = np.inf
                limit = self.reach[at:stop] ** 2
                if len(ids) > self.k:
                    limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1])
                with np.errstate(invalid="ignore"):
                    limit = limit + 1e-9 * (1 + np.abs(limit) + own)
                met = (rough <= limit[:, None]) & np.isfinite(rough)
            who, which = np.nonzero(met)
            for cut in range(0, len(who), 1 << 16):
                w, r = who[cut : cut + (1 << 16)], which[cut : cut + (1 << 16)]
                found.append((w + at, ids[r], distances(q[w], x[r])))
        self.kept = self._best(*(np.concatenate(c) for c in zip(*found)))

    def _best(self, who: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple:
        """The k nearest of different ids of each query, ties to the smaller id."""
        order = np.lexsort((d, ids, who))
        who, ids, d = who[order], ids[order], d[order]
        one = np.ones(len(who), bool)
        one[1:] = (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])
        who, ids, d = who[one], ids[one], d[one]
        order = np.lexsort((ids, d, who))
        who, ids, d = who[order], ids[order], d[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kth = place == self.k - 1
        self.reach[who[kth]] = np.minimum(self.reach[who[kth]], d[kth])
        near = place < self.k
        return who[near], ids[near], d[near]


def _scan(blocks: dict[int, tuple], k: int):
    """blocks: for each dimension the numbers, ids and vectors of queries, where they look, and how far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = {dim: Nearest(*block, k) for dim, block in blocks.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in near:
                    part = batch.filter(pa.array(dims == dim))
                    for at in range(0, part.num_rows, ROWS):
                        some = part.slice(at, ROWS)
                        buckets = np.frombuffer(b"".join(some.column("buckets").to_pylist()), "<u4").reshape(some.num_rows, -1)
                        near[dim].add(some.column("id").to_numpy(), buckets, matrix(some.column("v"), dim))
        for n in near.values():
            who, ids, d = n.kept
            yield pa.RecordBatch.from_arrays([pa.array(n.rows[who]), pa.array(ids), pa.array(d)], ["query", "vec_id", "score"])

    return scan


def _search(file: DataFrame, asked: DataFrame, k: int, look: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, vec_id, score of what each query of (query, id, dim, v) finds, its nearest in every task at least."""
    parts, kinds = [], "query long, vec_id long, score double"
    dim = asked.agg(F.max("dim")).first()[0] or 1
    block = max(1, BLOCK_BYTES // (8 * dim))
    ends = asked.agg(F.min("query"), F.max("query")).first()
    for first in range(ends[0] or 0, (ends[1] if ends[1] is not None else -1) + 1, block):
        blocks: dict[int, list] = {}
        # block queries at most
        for r in asked.where(F.col("query").between(first, first + block - 1)).collect():
            blocks.setdefault(r.dim, []).append((r.query, r.id, r.v))
        arrays = {}
        for d, held in blocks.items():
            n, ids, v = zip(*held)
            q = np.array(v, np.float64)
            arrays[d] = (np.array(n, np.int64), np.array(ids, np.int64), q, look(q))
        unknown = {d: (*a, np.full(len(a[0]), np.inf)) for d, a in arrays.items()}
        some = file.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(_scan(unknown, k), kinds)
        order = Window.partitionBy("query").orderBy("score")
        nth = some.groupBy("query", "vec_id").agg(F.min("score").alias("score")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        # a number for each query of the block
        sure = {r.query: r.score for r in nth.where(F.col("nth") == k).collect()}
        known = {d: (*a, np.array([sure.get(n, np.inf) for n in a[0].tolist()])) for d, a in arrays.items()}
        parts.append(durable(file.mapInArrow(_scan(known, k), kinds)))
    found = reduce(DataFrame.union, parts) if parts else file.sparkSession.createDataFrame([], kinds)
    return found.join(asked.select("query", F.col("id").alias("query_id")), "query").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The k nearest rows that each query finds: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Vectors that are null, empty, all zero or hold null or non-finite components, and null ids, take no part; only
    vectors of one length are compared. A row with the query's own id is no candidate. Ties go to the smaller id; of
    rows with one id the nearest counts, once. A query has fewer than k rows only if there are no more candidates.
    Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    nonzero = F.exists("v", lambda x: x != 0)
    rows, asked = (usable(x, id_col, vector_col).where(nonzero) for x in (vectors, queries))
    file = durable(rows.mapInArrow(_bucketed(tables), f"dim int, id long, buckets binary, v {rows.schema['v'].dataType.simpleString()}"))
    # equal queries ask once
    asked = numbered(asked.dropDuplicates(["id", "v"]).withColumn("hash", F.xxhash64("v")), ["id", "hash"], "query").select("query", "id", "dim", "v")
    found = ranked(_search(file, asked, k, lambda q: probed(q, tables, probes, SHARE)), k, F.col("score"))
    found = durable(found)
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    if short.isEmpty():
        return found
    # a query may have found all there is; then this finds the same
    short = numbered(short.select("id", "dim", "v").withColumn("hash", F.xxhash64("v")), ["id", "hash"], "query").select("query", "id", "dim", "v")
    kept = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    everywhere = ranked(_search(file, short, k, lambda q: np.ones((1, len(q), 2 << max(0, q.shape[1] - 1).bit_length()), bool)), k, F.col("score"))
    return kept.unionByName(everywhere)
