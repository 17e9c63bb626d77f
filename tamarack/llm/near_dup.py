"""Near-duplicate components of documents by bottom-k sketches of word shingles.

One hash function maps every shingle to 64 bits; a document keeps its k smallest values. Inverted lists over pairs of
neighbouring retained values bring together documents whose sketches overlap, the sketch of the union estimates the
similarity of a pair and drops hopeless ones, and exact Jaccard over full shingle sets confirms each link.

Documents with the same set are one class and only its smallest id takes part. In a list, every member is held
against the smallest id. Lists whose other members are not yet in one component after that are searched again, in
blocks of bounded size, by sketch alone: what could be linked across components forms families, and families are held
together exactly, again in blocks. A block gives back a forest at most, never its pairs.

Two sets of similarity 0.75 or more share a retained pair surely while both are at most KEYS + 1 large, and else but
for a chance below 1e-8 (no two neighbours among the KEYS smallest values of the union are common to both).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import M1, dealt, durable, mix64, piece_hashes, slices, spread_join, utf8_view

WORDS = 5
PERCENT = 75
#: Values kept of each document, and pairs of neighbours among the smallest that make keys.
SKETCH, KEYS = 64, 33
#: A pair is dropped if the estimate of its similarity lies this far below the limit: for a pair at the limit fewer
#: than 28 of 64 values would have to be shared where 48 are expected, a chance of 2.5e-8.
SLACK = 0.32
#: Members of a block in the search within lists, and documents that are verified together.
BLOCK, TOGETHER = 2048, 512
#: Shingles whose counts are added up at once.
COLUMNS = 8192

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS, salt: int = 0) -> Iterator[np.ndarray]:
    """For each text of a batch the sorted 64-bit hashes of its distinct shingles, by one function for each salt."""
    blank = _BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    word = piece_hashes(_LOWER[raw], begins, ends, salt)
    first = np.searchsorted(begins, offsets)
    n = len(word)
    full = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        full += word[k : n - words + 1 + k] * _PLACE[k % WORDS] if len(full) else 0
    full = mix64(full)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        elif b > a:
            yield mix64((word[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * M1)
        else:
            yield np.zeros(0, np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_view(batch.column("text"))
        for i, j in slices(offsets):
            sizes, one, two, kept = [], [], [], []
            part, marks = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            # two functions that have nothing in common tell whether two sets are the same
            for s, other in zip(shingle_sets(part, marks), shingle_sets(part, marks, salt=1)):
                sizes.append(len(s))
                one.append(int(mix64(s).sum(dtype=np.uint64)))
                two.append(int(mix64(other).sum(dtype=np.uint64)))
                kept.append(s[:SKETCH].tobytes())
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(sizes, pa.int64()), as_long(one), as_long(two), pa.array(kept, pa.binary())], ["id", "n", "h1", "h2", "sketch"])


def run_keys(sketch: np.ndarray, n: int) -> np.ndarray:
    """The keys under which a document is listed: hashes of neighbouring retained values."""
    low = sketch[: KEYS + 1]
    return mix64(low[:-1] * _PLACE[0] + low[1:] * _PLACE[1]).view(np.int64) if n > 1 else np.zeros(0, np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [run_keys(np.frombuffer(s, np.uint64), n) for s, n in zip(batch.column("sketch").to_pylist(), batch.column("n").to_pylist())]
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity by the sketch of the union; exact if both sketches are whole sets."""
    union = np.union1d(a, b)
    if len(a) == SKETCH or len(b) == SKETCH:
        union = union[:SKETCH]
    return np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / max(1, len(union))


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("sketch").to_pylist(), batch.column("other").to_pylist())
        keep = pa.array([estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= PERCENT / 100 - SLACK for x, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("center").filter(keep), batch.column("id").filter(keep)], ["center", "id"])


def _joined(near: np.ndarray) -> np.ndarray:
    """The smallest position in the component of each position, for a symmetric matrix of links."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _plausible_groups(table: pa.Table) -> pa.Table:
    """Members of a list (or of two blocks of it) that may be linked across components, each with the least of its group."""
    left, right = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    ids, label, side = (table.column(x).to_numpy() for x in ("id", "label", "block"))
    sketches = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
    n, size = len(ids), np.array([len(x) for x in sketches])
    where, value = np.repeat(np.arange(n), size), np.concatenate(sketches)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    held = np.zeros((n, column.max(initial=0) + 1), np.float32)
    held[where[shared], column] = 1
    # sketches that are whole sets tell the similarity; of others, two sets as alike as asked share about its part
    whole = size < SKETCH
    enough = np.where(whole[:, None] & whole[None, :], PERCENT / (100 + PERCENT) * (size[:, None] + size[None, :]) - 1e-3, (PERCENT / 100 - SLACK) * np.minimum(size[:, None], size[None, :]))
    near = (held @ held.T >= np.maximum(1, enough)) & (label[:, None] != label[None, :])
    if left != right:
        near &= side[:, None] != side[None, :]
    group = _joined(near)
    found = np.flatnonzero(near.any(1) & (group != np.arange(n)))
    return pa.table({"u": ids[found], "v": ids[group[found]]})


def _links_across(table: pa.Table) -> pa.Table:
    """Exact links between members of a family, or of two blocks of it, that join components: a forest of them."""
    left, right = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    ids, label, side = (table.column(x).to_numpy() for x in ("id", "label", "block"))
    raw, offsets = utf8_view(table.column("text"))
    sets = list(shingle_sets(raw, offsets, salt=1))
    n, size = len(sets), np.array([len(x) for x in sets])
    where, value = np.repeat(np.arange(n), size), np.concatenate(sets)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    where, (_, column) = where[shared], np.unique(column[shared], return_inverse=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    where, column = where[order], column[order]
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((n, COLUMNS), np.float32)
        held[where[a:b], column[a:b] - at] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    linked = (100 * both >= PERCENT * (size[:, None] + size[None, :] - both)) & (label[:, None] != label[None, :]) & (size > 0)
    if left != right:
        linked &= side[:, None] != side[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = ([], [])
    for i, j in zip(*np.nonzero(np.triu(linked))):
        a, b = find(int(label[i])), find(int(label[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            found[0].append(ids[i])
            found[1].append(ids[j])
    return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})


def _in_blocks(rows: DataFrame, group: str, members: DataFrame, size: int) -> DataFrame:
    """Each row of a group once for every pair of blocks that its own is part of: columns block, low, high."""
    rows = durable(rows.join(dealt(members), group).withColumn("blocks", F.ceil(F.col("members") / size).cast("int")).withColumn("block", F.expr("cast(pmod(hash(id), blocks) as int)")).drop("members"))
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as low, greatest(x, block) as high))")
    many = rows.where("blocks > 1").withColumn("at", F.explode(pairs)).select("*", "at.low", "at.high").drop("at")
    one = rows.where("blocks = 1").withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    return one.union(many).drop("blocks")


def _confirm(table: pa.Table) -> pa.Table:
    """Exact similarity of a center, by each of its texts, with each of a block of documents."""
    center = table.column("center")[0].as_py()
    ids = table.column("id").to_pylist()
    raw, offsets = utf8_view(table.column("text"))
    sets = list(shingle_sets(raw, offsets, salt=1))
    every = [s for i, s in zip(ids, sets) if i == center and len(s)]
    found = []
    for i, s in zip(ids, sets):
        if i != center and len(s):
            for own in every:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(s) - both):
                    found.append(i)
                    break
    return pa.table({"u": pa.array([center] * len(found), pa.int64()), "v": pa.array(found, pa.int64())})


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (center, id) that are links, as (u, v). Centers of many pairs are dealt out in blocks."""
    load = pairs.groupBy("center").agg(F.count("*").alias("load"))
    pairs = pairs.join(dealt(load), "center").select("center", "id", F.expr(f"cast(pmod(hash(id), ceil(load / {TOGETHER})) as int)").alias("part"))
    wanted = pairs.union(pairs.select("center", F.col("center").alias("id"), "part").distinct())
    return wanted.join(dealt(texts), "id").groupBy("center", "part").applyInArrow(_confirm, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of each node that has a link: columns node, label.

    Alternating large-star and small-star steps; every step is a join and a partial aggregate on edges, written as a
    table, so that no part of the graph meets in one place and lost executors cost one step at most.
    """
    edges = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = edges.count()
        # a node with very many edges is looked up by all of them where they are
        least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")).select("u", F.least("u", "m").alias("m"), "edges"))
        large = durable(spread_join(both, dealt(least), ["u"], "inner", "edges", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(low), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u > v")
        edges = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down or none, and nodes with one have none coming in."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down = 1 and up > 0)").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, n_shingles (distinct 5-word shingles), component_id and kept.

    Linked are documents whose shingle sets have a Jaccard similarity of 0.75 or more; component_id is the smallest id
    reachable over links. Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. Fewer than
    five words make one shingle of all. Null, empty and blank texts have no shingles and are linked with nothing. Rows
    with the same id are one document for links; a row with a null id takes no part, has a null component and is kept.
    Other columns are not looked at. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = durable(texts.mapInArrow(_sketches, "id long, n long, h1 long, h2 long, sketch binary"))
    known = sets.where("id is not null and n > 0")
    classes = durable(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    # the smallest id of a class has its sketch; an id of several texts stays once for each
    reps = durable(spread_join(known, dealt(classes), ["h1", "h2"], "inner", "copies", sets.count()).where("id = rep").select("id", "n", "sketch").distinct())

    listed = reps.mapInArrow(_lists, "key long, id long")
    lists = listed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("center")).where("members > 1")
    members = durable(listed.join(dealt(lists), "key").select("key", "id", "center"))
    sketch = dealt(reps.select("id", "sketch"))
    pairs = members.where("id != center").select("center", "id").distinct()
    pairs = pairs.join(sketch, "id").join(dealt(reps.select(F.col("id").alias("center"), F.col("sketch").alias("other"))), "center")
    pairs = durable(pairs.select("center", "id", "sketch", "other").mapInArrow(_plausible, "center long, id long"))
    listed_texts = durable(texts.join(dealt(members.select("id").distinct()), "id", "left_semi").dropDuplicates(["id", "text"]))
    # texts of one id are one document
    several = known.groupBy("id").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).where("a <> b or c <> d").select("id")
    same = known.join(dealt(several), "id", "left_semi").join(dealt(classes), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    links = durable(_confirmed(pairs, listed_texts).union(same))
    labels = components(links)

    held = durable(members.join(dealt(labels.select(F.col("node").alias("id"), "label")), "id", "left").select("key", "id", "center", F.coalesce("label", "id").alias("label")))
    others = F.when(F.col("id") != F.col("center"), F.col("label"))
    mixed = held.groupBy("key").agg(F.count("*").alias("members"), F.min(others).alias("a"), F.max(others).alias("b"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("same")).where("a != b")
    # lists with the same members are searched once
    mixed = mixed.groupBy("members", "same").agg(F.min("key").alias("key")).select("key", "members")
    spread = _in_blocks(held.select("key", "id", "label"), "key", mixed, BLOCK).join(sketch, "id")
    maybe = durable(spread.groupBy("key", "low", "high").applyInArrow(_plausible_groups, "u long, v long").distinct())
    if not maybe.isEmpty():
        families = components(maybe).select(F.col("node").alias("id"), F.col("label").alias("family"))
        families = families.union(families.select(F.col("family").alias("id"), "family").distinct())
        families = durable(families.join(dealt(labels.select(F.col("node").alias("id"), "label")), "id", "left").select("id", "family", F.coalesce("label", "id").alias("label")))
        members = families.groupBy("family").agg(F.count("*").alias("members"))
        spread = _in_blocks(families, "family", members, TOGETHER).join(dealt(listed_texts), "id")
        links = links.union(spread.groupBy("family", "low", "high").applyInArrow(_links_across, "u long, v long"))
        labels = components(links)

    in_class = durable(classes.join(dealt(labels.withColumnRenamed("node", "rep")), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("class_label"), "copies"))
    # an id with several texts joins their classes
    lone = spread_join(sets.select("id", "n", "h1", "h2"), dealt(in_class), ["h1", "h2"], "left", "copies", sets.count()).withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("class_label")), F.col("id"))))
    return lone.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component; of rows with one id, one.

    Rows with a null id stay.
    """
    kept = near_duplicates(docs, id_col, text_col).where(f"kept and `{id_col}` is not null").select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("kept_id"))
    # dealt by id already for the join
    first = rows.join(dealt(kept), "kept_id").dropDuplicates(["kept_id"]).select("row")
    return first.union(rows.where("kept_id is null").select("row")).select("row.*")
