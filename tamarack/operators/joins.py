"""Joins that an equality alone does not express: containment in networks and intervals, chains, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.sources.shared import durable


def longest_prefix(addresses: DataFrame, networks: DataFrame, address: str = "number", id_col: str = "id") -> DataFrame:
    """Each address with the longest network that strictly contains it: networks have lo, hi, bits.

    An address stands once for each length that networks have (32 at most), cut to it; then the join is an equality on
    length and first address, and a full network's addresses are split like any skewed key.
    """
    networks = networks.where("bits < 32").select("bits", "lo").distinct()
    lengths = sorted(r.bits for r in networks.select("bits").distinct().collect())  # 32 rows at most
    spread = addresses.withColumn("bits", F.explode(F.array(*(F.lit(b) for b in lengths)).cast("array<int>")))
    spread = spread.withColumn("lo", F.expr(f"shiftleft(shiftright(cast({address} as bigint), 32 - bits), 32 - bits)"))
    best = spread.join(networks, ["bits", "lo"]).groupBy(id_col).agg(F.max(F.struct("bits", "lo")).alias("best"))
    return best.select(id_col, F.col("best.lo").alias("network"), F.col("best.bits").alias("bits"))


def narrowest_interval(points: DataFrame, intervals: DataFrame, point: str, id_col: str, width: int) -> DataFrame:
    """Each point with the narrowest interval (lo, hi, name) around it, null if there is none.

    The equality key is the cell of ``width`` that a point lies in; an interval stands in each cell it touches.
    """
    cells = intervals.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    met = points.withColumn("cell", F.floor(F.col(point) / width)).join(cells, "cell").where(F.col(point).between(F.col("lo"), F.col("hi")))
    best = met.groupBy(id_col).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("size"), "lo", "name")).alias("best"))
    return points.select(id_col).join(best, id_col, "left").select(id_col, F.col("best.name").alias("name"))


def chain_ends(nodes: DataFrame, id_col: str, next_col: str, most: int = 16) -> DataFrame:
    """Where each node's chain of pointers ends, within ``most`` steps, and how many steps that is.

    Pointers double their reach in every round, so the rounds are the logarithm of the steps.
    """
    jump = nodes.select(F.col(id_col).alias("at"), F.coalesce(next_col, id_col).alias("to"), F.when(F.col(next_col).isNull(), 0).otherwise(1).alias("steps"))
    reach = 1
    while reach < most:
        further = jump.select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        jump = jump.join(further, "to", "left").select("at", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        reach *= 2
    return jump.select(F.col("at").alias(id_col), F.col("to").alias("end"), "steps")


def graph_components(edges: DataFrame, most: int = 1000) -> DataFrame:
    """node and the smallest node of its component, of undirected edges (u, v).

    Labels go along edges and jump to the labels of labels until nothing changes, a table for each round. Components
    that are not done after ``most`` rounds raise an error; rounds are about the logarithm of the longest way.
    """
    both = durable(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    for _ in range(most):
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        jumped = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = label.join(near, "node").join(jumped, "label", "left").select("node", F.least("label", "near", F.coalesce("far", "label")).alias("new"), F.col("label").alias("old"))
        new = durable(new)
        label = new.select("node", F.col("new").alias("label"))
        if new.where("new <> old").isEmpty():
            return label
    raise RuntimeError(f"components are not complete after {most} rounds")


def snapshot_missing(active: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Active memberships that a new snapshot doesn't hold."""
    return active.join(seen.select(*key), key, "left_anti")


def membership_outcomes(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """What an idempotent write does to each incoming membership, and the row that results.

    created, adopted (no fingerprint was stored), reactivated (it was expired or missing), changed (other content),
    unchanged, or overridden (its status is held). First seen only goes back, last seen only forward.
    """
    s = stored.select(*key, F.col("fingerprint").alias("was"), F.col("status").alias("was_status"), "missing_since", "override_enabled", F.col("first_seen").alias("s_first"), F.col("last_seen").alias("s_last"))
    both = incoming.join(s, key, "left")
    known = F.col("was_status").isNotNull()
    outcome = (
        F.when(~known, "created")
        .when(F.coalesce("override_enabled", F.lit(False)), "overridden")
        .when((F.col("was_status") == "expired") | F.col("missing_since").isNotNull(), "reactivated")
        .when(F.col("was").isNull(), "adopted")
        .when(F.col("was") != F.col("fingerprint"), "changed")
        .otherwise("unchanged")
    )
    status = F.when(F.coalesce("override_enabled", F.lit(False)), F.col("was_status")).otherwise("active")
    return both.select(*key, outcome.alias("outcome"), F.least("first_seen", "s_first").alias("first_seen"), F.greatest("last_seen", "s_last").alias("last_seen"), status.alias("status"), "fingerprint")
