"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a whole text (shares of kinds of bytes, word and line repetition, entropy, lengths) are mapped to
cosines that approximate a Gaussian kernel. The normal equations are summed in each partition and then over
partitions; the ridge score is calibrated to a probability by isotonic regression over a fixed grid of scores. Only
labelled rows are measured for the fit; every text is then measured and scored in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import bundled, durable, piece_hashes, slices, unbundled, utf8_view

#: Cosines, inverse kernel width, ridge weight, cells of the calibration, and labels used at most (of more, those
#: with the smallest hashes of their ids).
COSINES, GAMMA, RIDGE, CELLS, LABELLED = 256, 0.05, 1e-2, 512, 200_000
PARTS = 16
CUT = 0.7
#: How far a score may lie from its isotonic level, so that rows of one level keep the order of their ridge scores.
TILT = 0.005

_KINDS = [range(65, 91), range(97, 123), range(48, 58), [32], [10], [9, 11, 12, 13], [33, 63], [44, 46, 58, 59], [124], [35, 36, 37, 38, 42, 64, 94, 126], [39, 34, 40, 41, 45], [60, 61, 62, 91, 93, 92, 95, 96, 123, 125, 47, 43], range(128, 256), [*range(9), *range(14, 32), 127]]
_SYMBOLIC = np.zeros(256, bool)
_SYMBOLIC[[33, *range(35, 39), 42, 64, 94, 124, 126]] = True
STATISTICS = len(_KINDS) + 12


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS numbers for each text of a batch; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.repeat(np.arange(n), size)
    counts = np.bincount(text * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64) if len(raw) else np.zeros((n, 256))
    share = counts / np.maximum(1, size)[:, None]
    out = np.zeros((n, STATISTICS))
    for k, kind in enumerate(_KINDS):
        out[:, k] = np.sqrt(share[:, list(kind)].sum(1))
    at = len(_KINDS)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, at] = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    out[:, at + 1] = np.log1p(size)
    out[:, at + 2] = share.max(1)
    if not len(raw):
        return out
    for k, sep in enumerate((raw <= 32, raw == 10)):  # words, lines
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(~sep & (edge[:-1] | np.concatenate([[True], sep[:-1]])))
        ends = np.flatnonzero(~sep & (edge[1:] | np.concatenate([sep[1:], [True]]))) + 1
        h, owner = piece_hashes(raw, begins, ends), text[begins]
        many = np.bincount(owner, minlength=n)
        per = np.maximum(1, many)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
        order = np.lexsort((h, owner))
        first = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
        i = at + 3 + 3 * k
        out[:, i] = np.bincount(owner, same, minlength=n) / per
        out[:, i + 1] = np.bincount(owner[order], first, minlength=n) / per
        out[:, i + 2] = np.log1p(np.bincount(owner, ends - begins, minlength=n) / per)
        if not k:
            mark = np.bincount(owner, _SYMBOLIC[raw[ends - 1]], minlength=n) / per
            upper = np.bincount(owner, (raw[begins] >= 65) & (raw[begins] <= 90) & ((ends - begins < 2) | (raw[np.minimum(begins + 1, len(raw) - 1)] < 97)), minlength=n) / per
            out[:, at + 9], out[:, at + 10] = mark, upper
        else:
            out[:, at + 11] = np.log1p(many)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_view(batch.column("text"))
        for i, j in slices(offsets, 1 << 19):
            x = statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("y").slice(i, j - i), pa.FixedSizeListArray.from_arrays(x.ravel(), STATISTICS).cast(pa.list_(pa.float64()))], ["id", "y", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


class Cosines:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, COSINES))
        self.b = rng.uniform(0, 2 * np.pi, COSINES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / COSINES), np.ones((len(x), 1))])


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators; cells without weight take the value before them."""
    blocks: list[list[float]] = []
    for t, w in zip(total, weight):
        blocks.append([float(t), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t1, w1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + w1, blocks[-1][2] + k1]
    return np.concatenate([np.full(k, t / w if w else 0.5) for t, w, k in blocks])


class Scorer:
    """From statistics to a calibrated probability of label 1."""

    def __init__(self, cosines: Cosines, weights: np.ndarray):
        self.cosines, self.weights, self.learned = cosines, weights, False

    def place(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores, with -0.5 to 1.5 as 0 to 1."""
        return np.clip((self.cosines(x) @ self.weights + 0.5) / 2, 0, 1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.minimum((self.place(x) * CELLS).astype(np.int64), CELLS - 1)

    def calibrate(self, total: np.ndarray, weight: np.ndarray) -> None:
        """Isotonic levels of cells; within a level a slope that keeps its mean and stays clear of its neighbours."""
        self.levels = TILT + (1 - 2 * TILT) * isotonic(total, weight)
        edge = np.flatnonzero(np.concatenate([[True], self.levels[1:] != self.levels[:-1], [True]]))
        self.middle, self.slope = np.zeros(CELLS), np.zeros(CELLS)
        for a, b in zip(edge, edge[1:]):
            centers, w = (np.arange(a, b) + 0.5) / CELLS, weight[a:b]
            middle = np.average(centers, weights=w) if w.sum() else centers.mean()
            near = [abs(self.levels[a] - self.levels[k]) / 2 for k in (a - 1, b) if 0 <= k < CELLS]
            reach = max(middle - a / CELLS, b / CELLS - middle)
            self.middle[a:b], self.slope[a:b] = middle, min([TILT, *near]) / reach
        self.learned = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(x), 0.5)
        place = self.place(x)
        cell = np.minimum((place * CELLS).astype(np.int64), CELLS - 1)
        return self.levels[cell] + self.slope[cell] * (place - self.middle[cell])


def fit(measured: DataFrame) -> Scorer:
    """measured: id, y (0 or 1), x. Four fifths of the rows fit the ridge, the others calibrate it."""
    calibrates = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) == 0
    # dealt and sorted by what does not change between runs, so that sums don't either
    rows = durable(measured.select("id", "x", "y", calibrates.alias("calibrates")).repartition(PARTS, "id").sortWithinPartitions("id", "y", F.xxhash64("x")))
    moments = [f(F.element_at("x", i + 1)) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    got = np.array([v or 0.0 for v in rows.agg(*moments).first()]).reshape(STATISTICS, 2)
    cosines = Cosines(got[:, 0], got[:, 1])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((COSINES + 1, COSINES + 2))
        for batch in batches:
            keep = ~batch.column("calibrates").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)[keep].astype(np.float64)
            z = cosines(_matrix(batch.column("x"))[keep])
            a[:, :-1] += z.T @ z
            a[:, -1] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["a"])

    # PARTS matrices of fixed size
    a = sum((np.frombuffer(r.a).reshape(COSINES + 1, COSINES + 2) for r in rows.mapInArrow(sums, "a binary").collect()), np.zeros((COSINES + 1, COSINES + 2)))
    scorer = Scorer(cosines, np.linalg.solve(a[:, :-1] + RIDGE * np.eye(COSINES + 1), a[:, -1]))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scorer.cell(_matrix(batch.column("x")))), batch.column("y").cast(pa.float64())], ["cell", "y"])

    table = rows.where("calibrates").mapInArrow(cells, "cell long, y double").groupBy("cell").agg(F.sum("y"), F.count("*")).collect()  # CELLS rows at most
    total, weight = np.zeros(CELLS), np.zeros(CELLS)
    for cell, t, w in table:
        total[cell], weight[cell] = t, w
    # half a row of each label at the ends keeps the levels apart without rows
    weight[0] += 0.5
    weight[-1] += 0.5
    total[-1] += 0.5
    if a[-1, -2] + weight.sum() > 1:  # any row at all
        scorer.calibrate(total, weight)
    return scorer


def _held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Scorer:
    """The scorer of these labels; measures labelled rows only."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~_held_out(F.col("id")))
    # at most LABELLED rows of two numbers
    known = known.orderBy(F.xxhash64("id", F.lit(1)), "id", "y").limit(LABELLED)
    rows = _rows(docs, id_col, text_col).join(F.broadcast(known), "id")
    return fit(rows.select("id", "y", "text").mapInArrow(_measure, "id long, y int, x array<double>"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """For each row: id, held_out, score (0 to 1, the calibrated probability of label 1), predicted (1 from CUT on).

    Labels of rows whose crc32(id as text) mod 4 is 2 are never learned from. Only the whole text decides a score, so
    equal texts get equal scores; a null or empty text is measured as zeros. Labels other than 0 and 1 are left out; of
    several for one id all count. Without labels every score is 0.5. A null id is not held out. Repeated rows each get
    a row, other columns are not looked at whatever their names, no rows give no rows.
    """
    scorer = fitted(docs, labels, id_col, text_col, label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(scorer, batch))], ["id", "score"])

    out = _rows(docs, id_col, text_col).mapInArrow(score, "id long, score double")
    return out.select(F.col("id").alias(id_col), _held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _scores(scorer: Scorer, batch: pa.RecordBatch) -> np.ndarray:
    raw, offsets = utf8_view(batch.column("text"))
    x = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, 1 << 19)]
    return scorer(np.concatenate(x)) if x else np.zeros(0)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, that score CUT or more.

    Null and empty texts are scored like others. Without labels every score is 0.5 and no row stays. Repeated rows and
    null ids are judged by their text alone, columns may have any names, no rows give no rows.
    """
    scorer = fitted(docs, labels, id_col, text_col, label_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer, batch) >= CUT, pa.bool_()))

    rows = bundled(docs, id_col, text_col)
    return unbundled(rows.mapInArrow(keep, rows.schema), docs.columns)
