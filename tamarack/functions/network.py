"""IP addresses and networks as column expressions; the rare IPv6 goes through a vectorised function."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(column: str | Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    column = F.trim(F.col(column) if isinstance(column, str) else column)
    octets = F.transform(F.split(column, r"\."), lambda x: x.try_cast("long"))
    return F.when(column.rlike(IPV4), F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def is_private(column: str | Column) -> Column:
    """Whether an IPv4 address or network is private, reserved, or empty; what is no IPv4 is not."""
    column = F.trim(F.col(column) if isinstance(column, str) else column)
    n = ipv4_number(F.substring_index(column, "/", 1))
    a, b = F.shiftright(n, 24), F.shiftright(n, 16).bitwiseAND(F.lit(255))
    inside = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
    return (column == "") | F.coalesce(inside, F.lit(False))


def _ipv6(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            if v is None or "%" in v:
                return None
            return str(ipaddress.IPv6Network(v, strict=False)) if "/" in v else str(ipaddress.IPv6Address(v))
        except ValueError:
            return None

    return values.map(one)


def network(column: str | Column) -> Column:
    """struct(kind, value, prefix) of an address or network in canonical form; null if it is none or covers all."""
    column = F.trim(F.col(column) if isinstance(column, str) else column)
    base, tail = F.substring_index(column, "/", 1), F.regexp_extract(column, r"/(0|[1-9][0-9]{0,2})$", 1).try_cast("int")
    n, single = ipv4_number(base), ~column.contains("/")
    mask = F.lit(0x100000000) - F.pow(F.lit(2), F.lit(32) - tail).cast("long")
    v4 = F.when(single, F.struct(F.lit("ip").alias("kind"), ipv4_text(n).alias("value"), F.lit(None).cast("int").alias("prefix"))).when(
        tail.between(1, 32), F.struct(F.lit("ip").alias("kind"), F.concat(ipv4_text(n.bitwiseAND(mask)), F.lit("/"), tail.cast("string")).alias("value"), tail.alias("prefix"))
    )
    return F.when(n.isNotNull(), v4)


def with_network(df, column: str, name: str = "network"):
    """df with the canonical network of a column; only rows with a colon go through Python."""
    six = F.when(F.col(column).contains(":"), F.pandas_udf(_ipv6, "string")(F.trim(F.col(column))))
    prefix = F.regexp_extract(F.col("_six"), r"/(\d+)$", 1).try_cast("int")
    found = F.when(F.col("_six").isNotNull() & F.coalesce(prefix > 0, F.lit(True)), F.struct(F.lit("ipv6").alias("kind"), F.col("_six").alias("value"), prefix.alias("prefix")))
    return df.withColumn("_six", six).withColumn(name, F.coalesce(network(column), found)).drop("_six")
