"""Shared helpers of the corpus operators: durable intermediate tables and byte-level text views."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a folder of its own; a session with other machines raises, as
    they could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tamarack-')}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back; later work doesn't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tamarack/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, keys: list[str], name: str = "row") -> DataFrame:
    """df with the place of each row (from 0) in the order of the keys, by counts of range partitions; a table."""
    dealt = durable(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the exchange above, whatever the data
    firsts = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*keys)
    placed = dealt.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(firsts), "part")
    return durable(placed.select(*df.columns, (F.col("first") + F.col("inside") - 1).alias(name)))


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals out both sides, whatever it is thought to hold.

    Spark knows a table by the size of its files; some MB of packed ids are a hundred MB and more as a broadcast table,
    which the driver builds and keeps. So only what has a bound is broadcast, by name, and all else is dealt.
    """
    return df.hint("merge")


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], how: str, weight: str, total: int, most: int = 1000) -> DataFrame:
    """rows joined (inner or left) with one row for each group, where a group may hold any part of the rows.

    Groups with at least one of ``most`` parts of ``total`` by their ``weight`` (never more than ``most`` rows in
    groups, if the weights add up to total) are broadcast, so that their rows stay where they are; the others shuffle.
    Both sides are read twice and should be tables. The column ``weight`` is dropped.
    """
    full = F.col(weight) * most >= max(1, total)
    hot, others = groups.where(full).drop(weight), groups.where(~full).drop(weight)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(others, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def bundled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and all columns as they are in one struct named row, so that no name can clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*docs.columns).alias("row"))


def unbundled(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the struct named row, with some replaced."""
    return rows.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def utf8_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and where each begins (with the end of the last); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # combine_chunks keeps a chunked type for no rows in some versions
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, starts, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(starts, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def slices(offsets: np.ndarray, most: int = 1 << 21):
    """Cuts rows into runs of at most ``most`` bytes (one row at least); yields (first row, row after the last)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


class OpenTable:
    """Numbers by 64-bit hash, with open addressing; looked up and filled for whole arrays at once."""

    def __init__(self, slots: int = 1 << 16):
        self.hash, self.at, self.used = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is not known."""
        most = len(self.at) - 1
        slot = (h & np.uint64(most)).astype(np.int64)
        at = self.at[slot]
        open_ = np.flatnonzero((at >= 0) & (self.hash[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & most
            at[open_] = self.at[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.hash[slot[open_]] != h[open_])]
        return at

    def put(self, h: np.ndarray, number: np.ndarray) -> None:
        """Adds hashes that are not there, each once."""
        if 2 * (self.used + len(h)) > len(self.at):
            full = self.at >= 0
            old = self.hash[full], self.at[full]
            slots = len(self.at)
            while 2 * (self.used + len(h)) > slots:
                slots *= 2
            self.__init__(slots)
            self.put(*old)
        self.used += len(h)
        most = len(self.at) - 1
        slot = (h & np.uint64(most)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.hash[slot[placed]], self.at[slot[placed]] = h[placed], number[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & most


_TAIL = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
#: Bytes of a range that are hashed eight at a time with many others; longer ones go through BLAKE2.
SHORT = 128


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number (zeros follow the end), without a copy for each place."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def piece_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each raw[begin:end], one function for each salt; no sum of its bytes, so that order always counts."""
    size = ends - begins
    h = mix64(size.astype(np.uint64) * M1 + mix64(np.array([salt + 1], np.uint64)))
    view, at = eights(raw), 0
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    while len(live):
        rest = size[live] - at
        word = view[begins[live] + at] & _TAIL[np.minimum(rest, 8)]
        h[live] = mix64(h[live] ^ mix64(word * M2 + np.uint64(at + 1)))
        at += 8
        live = live[rest > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[begins[i] : ends[i]], digest_size=8, salt=salt.to_bytes(4, "little")).digest(), "little")
    return h


def same_bytes(raw: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether raw[at:at+size] and other[there:there+size] are equal, for each place."""
    same, one, two, k = np.ones(len(at), bool), eights(raw), eights(other), 0
    live = np.flatnonzero(size > 0)
    while len(live):
        rest = size[live] - k
        differ = (one[at[live] + k] ^ two[there[live] + k]) & _TAIL[np.minimum(rest, 8)] != 0
        same[live[differ]] = False
        k += 8
        live = live[~differ & (rest > 8)]
    return same


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    while len(x) < n:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class Remembered:
    """Ids of ranges of bytes, by number; found by hash, and then only if the bytes (and a mark) are the same."""

    def __init__(self) -> None:
        self.table, self.known = OpenTable(), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.data, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.start, self.size, self.at, self.length, self.mark = (np.zeros(1 << 14, np.int64) for _ in range(5))

    def _add(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, mark: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ids: those of all new ranges, end to end. Gives the numbers of the ranges."""
        k, n, length = self.known, len(begins), ends - begins
        self.ids, self.data = _grown(self.ids, self.used + len(ids)), _grown(self.data, self.filled + int(length.sum()))
        self.start, self.size, self.at, self.length, self.mark = (_grown(x, k + n) for x in (self.start, self.size, self.at, self.length, self.mark))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[k : k + n], self.length[k : k + n], self.mark[k : k + n] = sizes, length, mark
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        stops = np.cumsum(length)
        self.at[k : k + n] = self.filled + stops - length
        self.data[self.filled : self.filled + int(length.sum())] = raw[np.repeat(begins - stops + length, length) + np.arange(int(length.sum()))]
        self.used, self.filled, self.known = self.used + len(ids), self.filled + int(length.sum()), k + n
        return np.arange(k, k + n, dtype=np.int32)

    def find(self, h: np.ndarray, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The number of each range, -1 where it is not known."""
        at = self.table.find(h)
        hit = np.flatnonzero(at >= 0)
        size = ends[hit] - begins[hit]
        same = (self.length[at[hit]] == size) & (self.mark[at[hit]] == mark[hit])
        same[same] = same_bytes(raw, begins[hit[same]], self.data[: self.filled], self.at[at[hit[same]]], size[same])
        at[hit[~same]] = -1
        return at

    def numbers(self, h: np.ndarray, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, mark: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each range; ``encode`` gives the ids (end to end) and their counts for those that are new."""
        at = self.find(h, raw, begins, ends, mark)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            free = self.table.find(fresh) < 0
            fresh, one = fresh[free], new[one[free]]
            self.table.put(fresh, self._add(raw, begins[one], ends[one], mark[one], *encode(one)))
            at[new] = self.find(h[new], raw, begins[new], ends[new], mark[new])
            # other bytes have this hash already; these are encoded each time
            rest = np.flatnonzero(at < 0)
            if len(rest):
                at[rest] = self._add(raw, begins[rest], ends[rest], mark[rest], *encode(rest))
        return at

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers end to end, and where each ends (with 0 before)."""
        sizes = self.size[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.start[at] - stops[:-1], sizes) + np.arange(int(stops[-1]))], stops
