"""Exact top-k inner products by a vector-approximation file.

Components are whole numbers. The approximation file holds for each vector the numbers of the cells that its components
lie in, one byte each; every dimension has its own grid of 2**BITS cells of one width. A block of queries is scanned
against the file where it lies: the cells bound each product from both sides, and what may be among a query's k best is
kept, first in a task, then over all tasks. Exact vectors are read for those alone, in the order of their upper bounds:
first as many as are likely to do, then whatever an upper bound still lets reach the k-th best product found.

Queries go to the tasks in blocks of bounded size, one block after the other, so that neither vectors nor cells are
shuffled; what is shuffled are candidates. A scan of one of SAMPLE rows comes first: its k-th best lower bound holds for
all rows, so in the whole scan a query's candidates don't grow with the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import durable, numbered
from tamarack.llm.vectors import matrix, ranked, usable

SCALE, BITS = 64, 8
#: Bytes of the queries of a block, rows and queries that are bounded at once, and chunks after which a task sifts.
BLOCK_BYTES, ROWS, QUERIES, CHUNKS = 8 << 20, 16384, 256, 16
SAMPLE = 4


class Cells:
    """Whole numbers of each dimension, from low to high, in 2**BITS cells of one width."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.low, self.cells = low, 1 << bits
        # a cell is as wide as it must be for the last number to have one
        self.width = np.array([max(1, -(-(int(b) - int(a) + 1) // self.cells)) for a, b in zip(low, high)], np.int64)

    def approximate(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.low) // self.width).astype(np.uint8)

    def kind(self, q: np.ndarray) -> tuple[type, float]:
        """The numbers that bounds are computed in, and how far rounding may take them."""
        most = float(np.abs(q).astype(np.float64).max(initial=0)) * float((np.abs(self.low).astype(np.float64) + self.width.astype(np.float64) * self.cells).sum())
        return (np.float32, 0.0) if most < 1 << 24 else (np.float64, 0.0 if most < 1 << 53 else most * 2.0**-44)

    def bounds(self, q: np.ndarray, cells: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of queries (whole numbers) with the lower corners of cells, and what a product may lie below and above."""
        f = q.astype(kind)
        corner = (f * self.width.astype(kind)) @ cells.T.astype(kind) + (f @ self.low.astype(kind))[:, None]
        spread = (self.width - 1).astype(kind)
        return corner, np.minimum(f, 0) @ spread, np.maximum(f, 0) @ spread


class Sieve:
    """What may be among the k best of each of some queries, of all the rows of a task seen so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, cells: Cells, repeated: bool):
        self.rows, self.ids, self.q, self.k, self.cells, self.repeated = rows, ids, q, k, cells, repeated
        self.kind, self.slack = cells.kind(q)
        self.reach = reach.copy()
        self.kept: list[tuple] = []
        self.chunks = 0

    def add(self, ids: np.ndarray, cells: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
        for at in range(0, len(self.q), QUERIES):
            corner, below, above = self.cells.bounds(self.q[at : at + QUERIES], cells, self.kind)
            for i in np.flatnonzero(last[at : at + QUERIES] > first[at : at + QUERIES]).tolist():
                corner[i, order[first[at + i] : last[at + i]]] = -np.inf  # a query's own row
            reach = self.reach[at : at + QUERIES]
            if not self.chunks and not self.repeated and len(ids) > self.k:
                least = np.partition(corner, len(ids) - self.k, axis=1)[:, len(ids) - self.k] + below
                reach = np.maximum(reach, least - self.slack)
                self.reach[at : at + QUERIES] = reach
            who, which = np.nonzero(corner >= np.maximum(reach - above - self.slack, np.finfo(self.kind).min)[:, None])
            c = corner[who, which].astype(np.float64)
            self.kept.append((who + at, ids[which], c + below[who] - self.slack, c + above[who] + self.slack))
        self.chunks += 1
        if self.chunks % CHUNKS == 0:
            self.sift()

    def sift(self) -> tuple:
        """Raises each query's reach to the k-th best lower bound of different ids, and drops what lies below."""
        who, ids, lower, upper = (np.concatenate(x) for x in zip(*self.kept)) if self.kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        order = np.lexsort((-lower, who))
        who, ids, lower, upper = who[order], ids[order], lower[order], upper[order]
        counts = np.ones(len(who), bool)
        if self.repeated:  # an id counts once, with its best row
            _, first = np.unique(np.stack([who, ids]), axis=1, return_index=True)
            counts = np.zeros(len(who), bool)
            counts[first] = True
        place = np.cumsum(counts)
        start = np.searchsorted(who, who)
        nth = place - place[start] + counts[start]
        kth = counts & (nth == self.k)
        self.reach[who[kth]] = np.maximum(self.reach[who[kth]], lower[kth])
        stay = upper >= self.reach[who]
        out = (who[stay], ids[stay], lower[stay], upper[stay])
        self.kept = [out]
        return out


def _approximated(grids: dict[int, Cells]):
    def approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cells = grids[dim].approximate(matrix(part.column("v"), dim, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("dim"), part.column("id"), pa.array([c.tobytes() for c in cells], pa.binary()), part.column("v")], ["dim", "id", "cells", "v"])

    return approximated


def _scan(blocks: dict[int, tuple], grids: dict[int, Cells], k: int, repeated: bool):
    """blocks: for each dimension the numbers, ids and vectors of queries, and what their k-th products reach at least."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = {dim: Sieve(*block, k, grids[dim], repeated) for dim, block in blocks.items() if dim in grids}
        waiting: dict[int, list] = {dim: [] for dim in sieves}

        def take(dim: int) -> None:
            ids, cells = zip(*waiting[dim])
            waiting[dim] = []
            ids, cells = np.concatenate(ids), np.concatenate(cells)
            for at in range(0, len(ids), ROWS):
                sieves[dim].add(ids[at : at + ROWS], cells[at : at + ROWS])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in sieves:
                    part = batch.filter(pa.array(dims == dim))
                    raw = b"".join(part.column("cells").to_pylist())
                    waiting[dim].append((part.column("id").to_numpy(), np.frombuffer(raw, np.uint8).reshape(-1, dim)))
                    if sum(len(x) for x, _ in waiting[dim]) >= ROWS:
                        take(dim)
        for dim, sieve in sieves.items():
            if waiting[dim]:
                take(dim)
            who, ids, lower, upper = sieve.sift()
            yield pa.RecordBatch.from_arrays([pa.array(sieve.rows[who]), pa.array(ids), pa.array(lower), pa.array(upper)], ["query", "vec_id", "lower", "upper"])

    return scan


def _limits(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions the lowest and the highest component of each; a row for each of them, whatever the table."""
    found = rows.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out = {dim: (np.zeros(dim, np.int64), np.zeros(dim, np.int64)) for dim in {r.dim for r in found}}
    for r in found:
        out[r.dim][0][r.pos], out[r.dim][1][r.pos] = r.low, r.high
    return out


def _exact(pairs: DataFrame, asked: DataFrame, file: DataFrame) -> DataFrame:
    """query, vec_id and the best exact product of each pair."""
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    both = pairs.join(file.select(F.col("id").alias("vec_id"), "dim", "v"), "vec_id").join(asked, ["query", "dim"])
    return both.select("query", "vec_id", product.alias("score")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))


def _kth(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k-th highest value of each query that has so many."""
    order = Window.partitionBy("query").orderBy(F.col(by).desc())
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).where(F.col("nth") == k).select("query", F.col(by).alias("kth"))


def _best(candidates: DataFrame, asked: DataFrame, file: DataFrame, k: int) -> DataFrame:
    """Products of candidates (query, vec_id, lower, upper), read in the order of their upper bounds until they do."""
    merged = durable(candidates.groupBy("query", "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper")))
    reach = _kth(merged, "lower", k)
    near = durable(merged.join(reach, "query", "left").where("kth is null or upper >= kth").select("query", "vec_id", "upper"))
    order = Window.partitionBy("query").orderBy(F.col("upper").desc(), "vec_id")
    first = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * k).drop("nth")
    found = durable(_exact(first.select("query", "vec_id"), asked, file))
    # what was not read is certain not to count if its bound lies below the k-th product
    rest = near.join(_kth(found, "score", k), "query", "left").where("kth is null or upper >= kth").select("query", "vec_id")
    rest = durable(rest.join(found.select("query", "vec_id"), ["query", "vec_id"], "left_anti"))
    return found.union(_exact(rest, asked, file))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of floor(scale * component) vectors: query_id, rank (from 1), vec_id, score.

    Vectors that are null, empty or hold null or non-finite components, and null ids, take no part; only vectors of
    one length are compared. A row with the query's own id is no candidate. Ties go to the smaller id; of rows with one
    id the best counts, once. A query without candidates has no rows. Other columns, whatever their names, are not
    looked at. No rows give no rows. Components or products that 64 bits can't hold raise an OverflowError.
    """
    usable_rows, usable_asked = (usable(x, id_col, vector_col) for x in (vectors, queries))
    most = F.max(F.array_max(F.transform("v", F.abs))).alias("most")
    for x in (usable_rows, usable_asked):
        if (x.agg(most).first().most or 0) * abs(scale) >= 2.0**62:
            raise OverflowError("a scaled component needs more than 64 bits")
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows, asked = (x.select("dim", "id", whole.alias("v")) for x in (usable_rows, usable_asked))
    limits, asked_limits = _limits(rows), _limits(asked)
    for dim, (low, high) in asked_limits.items():
        if dim in limits:
            largest = sum(max(abs(int(a)), abs(int(b))) * max(abs(int(c)), abs(int(d))) for a, b, c, d in zip(low, high, *limits[dim]))
            if largest >= 1 << 63:
                raise OverflowError(f"products of vectors with {dim} components may need more than 64 bits")
    grids = {dim: Cells(*x) for dim, x in limits.items()}
    file = durable(rows.mapInArrow(_approximated(grids), "dim int, id long, cells binary, v array<long>"))
    repeated = not file.groupBy("id").count().where("count > 1").isEmpty()
    # equal queries ask once
    asked = numbered(asked.where(F.col("dim").isin(list(grids))).distinct().withColumn("hash", F.xxhash64("v")), ["id", "hash"], "query")
    block = max(1, BLOCK_BYTES // (8 * max(grids, default=1)))
    parts = []
    for first in range(0, asked.count(), block):
        # block queries at most
        here = asked.where(F.col("query").between(first, first + block - 1))
        blocks: dict[int, list] = {}
        for r in here.select("query", "id", "dim", "v").collect():
            blocks.setdefault(r.dim, []).append((r.query, r.id, r.v))
        arrays = {dim: tuple(np.array(x, np.int64) for x in zip(*held)) for dim, held in blocks.items()}
        cells, kinds = file.select("dim", "id", "cells"), "query long, vec_id long, lower double, upper double"
        unknown = {dim: (*held, np.full(len(held[0]), -np.inf)) for dim, held in arrays.items()}
        some = cells.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(_scan(unknown, grids, k, repeated), kinds)
        # a number for each query of the block
        sure = {r.query: r.kth for r in _kth(some.groupBy("query", "vec_id").agg(F.max("lower").alias("lower")), "lower", k).collect()}
        known = {dim: (*held, np.array([sure.get(q, -np.inf) for q in held[0].tolist()])) for dim, held in arrays.items()}
        candidates = cells.mapInArrow(_scan(known, grids, k, repeated), kinds)
        parts.append(durable(_best(candidates, here.select("query", "dim", F.col("v").alias("q")), file, k)))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.union, parts).join(asked.select("query", F.col("id").alias("query_id")), "query")
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, F.col("score").desc())
