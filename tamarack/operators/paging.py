"""Pages of results: totals, keysets and their cursors, bounded probes, oversampled previews."""

from __future__ import annotations

import json
from base64 import urlsafe_b64decode, urlsafe_b64encode
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sizes of pages, and rows that a preview shows and counts at most
SIZES = (25, 50, 100)
DEFAULT_SIZE = 50
PREVIEW = 2000
_EPOCH = datetime(1970, 1, 1)


def page_size(asked: int | None) -> int:
    """A size that pages may have."""
    return asked if asked in SIZES else DEFAULT_SIZE


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the time in microseconds, so that none is lost, and the id."""

    micros: int
    id: int

    @classmethod
    def of(cls, at: datetime, id_: int) -> Cursor:
        naive = at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
        return cls((naive - _EPOCH) // timedelta(microseconds=1), id_)

    def encoded(self) -> str:
        return urlsafe_b64encode(json.dumps([self.micros, self.id]).encode()).decode().rstrip("=")

    @classmethod
    def decoded(cls, text: str) -> Cursor:
        try:
            micros, id_ = json.loads(urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        except (ValueError, TypeError) as e:
            raise ValueError("no cursor") from e
        if type(micros) is not int or type(id_) is not int:
            raise ValueError("no cursor")
        return cls(micros, id_)


def micros(at: str | Column) -> Column:
    """A time as microseconds since 1970, for keys of cursors."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def keyset_page(rows: DataFrame, size: int, at: str, id_col: str, cursor: Cursor | None = None) -> DataFrame:
    """The next ``size`` rows, newest first, each with its cursor's parts and whether there are more after this page.

    One row more than the page is read to know that; nothing before the cursor is.
    """
    rows = rows.withColumn("cursor_micros", micros(at))
    if cursor is not None:
        rows = rows.where((F.col("cursor_micros") < cursor.micros) | ((F.col("cursor_micros") == cursor.micros) & (F.col(id_col) < cursor.id)))
    order = [F.col("cursor_micros").desc(), F.col(id_col).desc()]
    some = rows.orderBy(*order).limit(size + 1)
    # size + 1 rows
    counted = some.crossJoin(F.broadcast(some.agg((F.count("*") > size).alias("has_more"))))
    return counted.orderBy(*order).limit(size)


def with_total(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page by offset, each row with the count of all rows, which is aggregated beside it and not over a window."""
    total = rows.agg(F.count("*").alias("total"))
    # one row
    return rows.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total))


def probed_count(rows: DataFrame, most: int = PREVIEW) -> DataFrame:
    """How many rows there are, counted no further than one past ``most``: shown (text) and capped."""
    n = rows.limit(most + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(most)).alias("counted"), (F.col("n") > most).alias("capped"), F.when(F.col("n") > most, F.lit(f"{most}+")).otherwise(F.col("n").cast("string")).alias("shown"))


def preview(rows: DataFrame, keep: Column, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows that are kept. The filter goes first, so that nothing need be oversampled."""
    return rows.where(keep).orderBy(*order).limit(size)
