"""From a tree of the search language to a DataFrame.

A condition is either a column of the indicator rows or a set of keys in another table. Sets that stand alone under a
top-level AND become semi or anti joins; sets under OR or NOT become flags of left joins that are never null, so that
three-valued logic stays with the row columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import folded, like
from tamarack.operators import fusion, identity
from tamarack.operators.identity import KEY
from tamarack.plans.language import HASH_TYPES, Condition, Group, Node, Not, canonical_ioc, flipped, parse
from tamarack.sources.tables import Tables


def text_match(column: Column, c: Condition, value: str | None = None) -> Column:
    """The positive form of a text operator on a column, without regard to case."""
    value = (c.values[0] if value is None else value).lower()
    low = F.lower(column)
    match c.operator.removeprefix("not_"):
        case "contains":
            return low.contains(value)
        case "starts_with":
            return low.startswith(value)
        case "ends_with":
            return low.endswith(value)
        case "in":
            return low.isin(*(v.lower() for v in c.values))
        case _:
            return low == value


class Compiler:
    """Compiles one query over the tables, as of one moment."""

    def __init__(self, t: Tables, now: datetime, zone: str = "UTC"):
        self.t, self.now, self.zone = t, now, zone
        self.flags: list[tuple[str, list[str], DataFrame]] = []
        self.seen_columns = False

    def rows(self, query: str | Node) -> DataFrame:
        """The indicator rows that the query matches."""
        node = parse(query) if isinstance(query, str) else query
        parts = list(node.parts) if isinstance(node, Group) and node.word == "and" else [node]
        found, later = self.t.items, []
        for p in parts:
            inner, keep = (p.child, False) if isinstance(p, Not) else (p, True)
            if not keep and isinstance(inner, Condition) and inner.field == "classification":
                inner, keep = flipped(inner), True  # leaves out whole identities
            keys = self.keys(inner) if isinstance(inner, Condition) else None
            if keys is None:
                later.append(p)
            else:
                keys, positive = keys
                found = found.join(keys, KEY, "left_semi" if keep == positive else "left_anti")
        wanted = [self.column(p) for p in later]
        if self.seen_columns:
            found = found.join(fusion.membership_times(self.t.memberships), KEY, "left")
        for name, on, keys in self.flags:
            found = found.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left")
        for w in wanted:
            found = found.where(w)
        return found.select(*self.t.items.columns)

    def search(self, query: str | Node) -> DataFrame:
        """The identities that the query matches."""
        return identity.identities(identity.annotated(self.rows(query), self.t))

    def column(self, node: Node) -> Column:
        if isinstance(node, Group):
            parts = [self.column(p) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.word == "and" else out | p
            return out
        if isinstance(node, Not):
            if isinstance(node.child, Condition) and node.child.field == "classification":
                return self.column(flipped(node.child))
            return ~self.column(node.child)
        if node.field in ("source", "type", "known_hash_type", *HASH_TYPES) or self._is_hash(node):
            found = self._source(node) if node.field == "source" else self._known(node) if node.field.endswith("type") else self._hash(node)
            return ~found if node.operator.startswith("not_") else found
        keys = self.keys(node)
        if keys is not None:
            flag = self._member(keys[0])
            return flag if keys[1] else ~flag
        return getattr(self, f"_{node.kind}", self._row)(node)

    def _member(self, keys: DataFrame, on: list[str] = KEY) -> Column:
        """Whether a row is among these keys, never null."""
        name = f"_in{len(self.flags)}"
        self.flags.append((name, on, keys))
        return F.coalesce(F.col(name), F.lit(False))

    def _is_hash(self, c: Condition) -> bool:
        return c.field == "ioc" and c.operator in ("contains", "equals") and self._hash_type(c.values[0]) is not None

    def _source(self, c: Condition) -> Column:
        """The row's own name, its desk's, or that of a feed it is in; the rows are read once."""
        t = self.t
        own = F.coalesce(text_match(F.col("source_name"), c), F.lit(False))
        feeds = self._member(t.memberships.join(t.feeds.where(text_match(F.col("feed_name"), c)), "feed_id"))
        desks = t.manual_sources.where(text_match(F.col("source_name"), c)).select(F.col("source_id").alias("ioc_source_id"))
        return own | feeds | self._member(desks, ["ioc_source_id"])

    def _known(self, c: Condition) -> Column:
        """The type of the file that a row belongs to, or its own where it belongs to none."""
        t, values = self.t, [v.lower() for v in c.values]
        linked = t.links.join(identity.resolved(t.artifacts), "artifact_id").select(*KEY, F.col("artifact").alias("artifact_id"))
        known = t.hashes.where(F.col("is_primary")) if c.field == "type" else t.hashes
        known = linked.join(known.where(F.col("hash_type").isin(*values)).select("artifact_id").distinct(), "artifact_id")
        raw = F.coalesce(F.col("observable_type").isin(*values), F.lit(False))
        return self._member(known) | (raw & ~self._member(t.links))

    def _hash(self, c: Condition) -> Column:
        """The row itself, or one of the file that has the hash."""
        kind, value = (self._hash_type(c.values[0]), c.values[0].lower()) if c.field == "ioc" else (c.field, c.values[0])
        own = F.coalesce((F.col("observable_type") == kind) & (F.lower("observable") == value), F.lit(False))
        return own | self._member(self._of_artifacts(self.t.hashes.where((F.col("hash_type") == kind) & (F.lower("hash_value") == value)).select("artifact_id")))

    def _row(self, c: Condition) -> Column:
        column = F.coalesce("status", F.lit("active")) if c.field == "status" else F.col({"ioc": "observable"}.get(c.field, c.field))
        found = text_match(column, c, canonical_ioc(c.values[0]) if c.field == "ioc" else None)
        return ~found if c.operator.startswith("not_") else found

    def _date(self, c: Condition) -> Column:
        self.seen_columns |= c.field != "created_at"
        column = {"created_at": F.col("created_at"), "first_seen": F.coalesce("m_first", "first_seen_at"), "last_seen": F.col("m_last"), "last_changed": F.col("m_changed")}[c.field]
        kind = self.t.items.schema["created_at"].dataType
        at = [F.lit(m.at(self.now, self.zone)).cast(kind) for m in c.moments]
        if c.operator == "between":
            return column.between(*at)
        return column < at[0] if c.operator == "before" else column > at[0]

    def keys(self, c: Condition) -> tuple[DataFrame, bool] | None:
        """The keys that a condition means and whether rows must be (True) or must not be among them."""
        positive = not c.operator.startswith("not_")
        t = self.t
        match c.field:
            case "tag":
                inherited = t.candidates.join(t.report_tags, "report_id").select(*KEY, "tag")
                every = t.tags.select(*KEY, "tag").union(inherited)
                return every.where(like(folded("tag"), c)).select(*KEY), positive
            case "threat_actor" | "malware_family":
                return t.actors.where((F.col("kind") == c.field) & like(folded("name"), c)).select(*KEY), positive
            case "source_threat_actor" | "source_malware_family":
                current = t.attributions.where((F.col("kind") == c.field.removeprefix("source_")) & (F.col("assertion") == "current"))
                return current.where(like(folded("label"), c)).select(*KEY), positive
            case "report_id":
                # a report is named by its number, its uuid or its label
                names = [F.lower(F.col(n).cast("string")) for n in ("report_id", "report_uuid", "title")]
                values = [v.strip().lower() for v in c.values]
                reports = t.report_names.where(names[0].isin(*values) | names[1].isin(*values) | names[2].isin(*values)).select("report_id").distinct()
                return t.candidates.join(reports, "report_id").select(*KEY), positive
            case "related_entity" | "entity_type":
                if c.field == "related_entity":  # by its name or any alias
                    names = t.entities.select("entity_id", "entity_name").union(t.entity_aliases.select("entity_id", "alias"))
                    wanted = names.where(like(folded("entity_name"), c)).select("entity_id").distinct()
                else:
                    wanted = t.entities.where(F.col("entity_type").isin(*(v.lower() for v in c.values))).select("entity_id")
                reports = t.relations.join(wanted, "entity_id").select("report_id").distinct()
                direct = t.direct_relations.join(wanted, "entity_id").select("id").distinct()
                # a direct endpoint names a row by its number alone, a candidate by type and number
                ends = t.items.select(*KEY).join(direct, "id", "left_semi").select(*KEY)
                return t.candidates.join(reports, "report_id").select(*KEY).union(ends), positive
            case "classification":
                keys = fusion.classification_keys(t, [v.lower() for v in c.values])
                return (keys, True) if positive else (identity.closure(keys, t.items, t.links), False)
            case "imphash" | "tlsh" | "ssdeep":
                value = F.col("attr_value") if c.field == "ssdeep" else F.lower("attr_value")
                owners = t.file_attributes.where((F.col("attr_type") == c.field) & (value == c.values[0])).select("artifact_id")
                return self._of_artifacts(owners), True
        return None

    @staticmethod
    def _hash_type(value: str) -> str | None:
        low = value.strip().lower()
        return dict(zip((32, 40, 64), HASH_TYPES)).get(len(low)) if low and not set(low) - set("0123456789abcdef") else None

    def _of_artifacts(self, owners: DataFrame) -> DataFrame:
        """Rows linked to an artifact, or to one that is the same after merges."""
        same = identity.resolved(self.t.artifacts)
        wanted = owners.join(same, "artifact_id").select("artifact").distinct()
        return same.join(wanted, "artifact").join(self.t.links, "artifact_id").select(*KEY)
