"""Usable vectors, their matrices, and the ranking of what queries find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id (long), v (array<float> if it is that, else array<double>) and dim of rows with an id whose vector has
    components, all of them finite."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def ranked(found: DataFrame, k: int, best: Column) -> DataFrame:
    """The first k of each query by the order given, ties to the smaller id: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
