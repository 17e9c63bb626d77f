"""Removal of byte passages that occur earlier in the corpus, by longest previous factors.

A byte goes if a string of LENGTH bytes over it also starts earlier (smaller document id, or same document and earlier
start). Equal strings have the same anchor (the smallest hash of a GRAM-byte string in them, leftmost of equals), so
neighbouring string starts with one anchor form a run, and runs are dealt out by the anchor's hash: a string and its
earlier copies always meet. A run's context is all bytes of its strings. Copies of one context are one class, known by
a 128-bit BLAKE2b digest of the bytes, and combined inside each task before anything is sent; only the first of a class
can hold a first occurrence, and an anchor with one class has no others.

The first contexts of all classes of an anchor that has several are set end to end in corpus order, for a bucket of
anchors at once. In the suffix array of that text the previous and the next smaller position of each string start are
its best earlier matches; the longer common prefix with either, counted on the bytes, is its longest previous factor.
Where it reaches LENGTH the string goes.

An anchor that very many different contexts share (the edges of a passage that a large part of the corpus quotes)
would fill one task; such anchors are found on a sample and their runs are cut into single strings, dealt out by the
string's own digest. That changes where work is done, not the result. Buckets follow the bytes that go into them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import M1, M2, bundled, durable, eights, mix64, slices, unbundled, utf8_view

LENGTH, GRAM = 100, 16
#: Bytes of text that are worked on at once; anchors are marked in 24 bits.
STEP = 1 << 19
#: One of so many documents is looked at for overfull anchors; an anchor counts as such if it has this part of the
#: sample's runs, in different contexts, so there are at most that many.
SAMPLE, PART, LEAST = 64, 5000, 16

#: Bytes of text for each bucket of runs, and of contexts for each suffix array.
BUCKET_TEXT, BUCKET_CONTEXTS = 1 << 21, 1 << 20

RUN = np.dtype([("h", "<u8"), ("c", "<u8"), ("d", "<u8"), ("id", "<i8"), ("ord", "<i4"), ("s", "<i8"), ("n", "<i4"), ("gone", "u1")])


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian number (zeros follow the end)."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    out = np.empty(len(raw) + 8, np.uint64)
    for o in range(8):
        x = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
        out[o::8] = x[: len(out[o::8])]
    return out


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: text number, start in raw, count, anchor hash."""
    empty = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty, empty, empty.view(np.uint64)
    w = _words(raw)
    grams = w[: len(raw) - GRAM + 1] * M1 + w[8 : len(raw) - GRAM + 9] * M2
    grams ^= grams >> np.uint64(32)
    grams *= M1
    grams ^= grams >> np.uint64(29)
    low = np.uint64(0xFFFFFF)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, have = LENGTH - GRAM + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    anchor = (least & low).astype(np.int64)
    n = len(anchor)  # len(raw) - LENGTH + 1
    mark = np.zeros(len(raw) + 1, np.int32)
    ends = offsets[1:]
    np.add.at(mark, np.maximum(offsets[:-1], ends - LENGTH + 1), 1)
    np.add.at(mark, ends, -1)
    ok = np.cumsum(mark)[:n] == 0
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    start = np.flatnonzero(ok & change)
    stop = np.empty(n, bool)
    stop[-1] = True
    stop[:-1] = change[1:] | ~ok[1:]
    last = np.flatnonzero(ok & stop)
    return np.searchsorted(offsets, start, "right") - 1, start, last - start + 1, grams[anchor[start]]


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit BLAKE2b digest of each raw[start:end], as two columns."""
    data, blake = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    found = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """Parts of a batch of about STEP bytes: (first row, bytes, offsets, start of the bytes in the first row)."""
    for i, j in slices(offsets, STEP):
        a, b = offsets[i], offsets[j]
        if j == i + 1 and b - a > 2 * STEP:  # one long text: parts that overlap by a string less a byte
            for at in range(0, b - a - LENGTH + 1, STEP):
                part = raw[a + at : min(b, a + at + STEP + LENGTH - 1)]
                yield i, part, np.array([0, len(part)]), at
        else:
            yield i, raw[a:b], offsets[i : j + 1] - a, 0


def _table_of_runs(batch: pa.RecordBatch, overfull: np.ndarray) -> np.ndarray:
    """All runs of a batch of texts, with those of overfull anchors cut into single strings."""
    raw, offsets = utf8_view(batch.column("text"))
    ids, ords = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "ord"))
    out = []
    for first, part, marks, at in _pieces(raw, offsets):
        row, start, n, h = runs(part, marks)
        alone = np.zeros(len(h), bool)
        if len(overfull) and (cut := np.isin(h, overfull)).any():
            one = np.repeat(start[cut], n[cut]) + np.concatenate([np.arange(k) for k in n[cut]])
            alone = np.concatenate([np.zeros(int((~cut).sum()), bool), np.ones(len(one), bool)])
            row, start, n, h = (np.concatenate(x) for x in ((row[~cut], np.repeat(row[cut], n[cut])), (start[~cut], one), (n[~cut], np.ones(len(one), np.int64)), (h[~cut], np.zeros(len(one), np.uint64))))
        t = np.zeros(len(row), RUN)
        found = digests(part, start, start + n + LENGTH - 1)
        t["c"], t["d"], t["n"] = found[:, 0], found[:, 1], n
        t["h"] = np.where(alone, mix64(found[:, 0].copy()), h)
        t["id"], t["ord"], t["s"] = ids[row + first], ords[row + first], start - marks[row] + at
        out.append(t)
    return np.concatenate(out) if out else np.zeros(0, RUN)


def _firsts(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by class and place; which of the sorted are the first of their class."""
    t = t[np.lexsort((t["s"], t["ord"], t["id"], t["d"], t["c"], t["h"]))]
    first = np.ones(len(t), bool)
    first[1:] = (t["h"][1:] != t["h"][:-1]) | (t["c"][1:] != t["c"][:-1]) | (t["d"][1:] != t["d"][:-1])
    return t, first


def _joined(t: np.ndarray) -> np.ndarray:
    """Runs of one document that touch become one."""
    t = t[np.lexsort((t["s"], t["ord"], t["id"]))]
    if not len(t):
        return t
    new = np.ones(len(t), bool)
    new[1:] = (t["id"][1:] != t["id"][:-1]) | (t["ord"][1:] != t["ord"][:-1]) | (t["s"][1:] != t["s"][:-1] + t["n"][:-1])
    out = t[new].copy()
    out["n"] = np.add.reduceat(t["n"].astype(np.int64), np.flatnonzero(new))
    return out


def _send(buckets: int, overfull: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, first = _firsts(_table_of_runs(batch, overfull))
            gone = _joined(t[~first])
            gone["gone"] = 1
            t = np.concatenate([t[first], gone])
            # what is settled may go anywhere; it is dealt by document
            by = np.where(t["gone"] == 1, mix64(t["id"].view(np.uint64) + np.uint64(7)), mix64(t["h"])) % np.uint64(buckets)
            order = np.argsort(by, kind="stable")
            t, by = t[order], by[order]
            at = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(t) else np.zeros(0, np.int64)
            # column by column, which packs better
            blobs = [b"".join(np.ascontiguousarray(x[f]).tobytes() for f in RUN.names) for x in np.split(t, at[1:])] if len(t) else []
            yield pa.RecordBatch.from_arrays([pa.array(by[at].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "runs"])

    return send


def _unpack(blob: bytes) -> np.ndarray:
    n, at = len(blob) // RUN.itemsize, 0
    t = np.empty(n, RUN)
    for f in RUN.names:
        t[f] = np.frombuffer(blob, RUN[f], n, at)
        at += n * RUN[f].itemsize
    return t


def _settle(table: pa.Table) -> pa.Table:
    """Runs that go as a whole, and those whose anchor stands in several contexts (with the anchor's hash as key)."""
    t = np.concatenate([_unpack(x.as_buffer().to_pybytes()) for x in table.column("runs")])
    settled = t[t["gone"] == 1]
    t, first = _firsts(t[t["gone"] == 0])
    settled = _joined(np.concatenate([settled, t[~first]]))
    t = t[first]
    same = t["h"][1:] == t["h"][:-1]
    mixed = np.zeros(len(t), bool)
    mixed[1:] |= same
    mixed[:-1] |= same
    t = t[mixed]
    both = np.concatenate([settled, t])
    key = np.concatenate([np.zeros(len(settled), np.int64), mix64(t["h"]).view(np.int64)])
    return pa.table({"id": both["id"], "ord": both["ord"], "s": both["s"], "n": both["n"], "key": pa.array(key, mask=np.arange(len(both)) < len(settled))})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted contexts out of the texts."""
    for batch in batches:
        raw, offsets = utf8_view(batch.column("text"))
        for i, (a, wanted) in enumerate(zip(offsets, batch.column("wanted"))):
            w = wanted.values.flatten()
            s, n, key = (x.to_numpy() for x in w)
            texts = [raw[a + p : a + p + m + LENGTH - 1].tobytes() for p, m in zip(s, n)]
            k = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(k, batch.column("id")[i].as_py())), pa.array(np.full(k, batch.column("ord")[i].as_py(), np.int32)), pa.array(s), pa.array(n), pa.array(texts, pa.binary())], ["key", "id", "ord", "s", "n", "context"])


def suffix_order(text: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the starts in the order of their suffixes, compared by ``most`` bytes at least; equals by place.

    Sorted by five bytes at a time, and after the first only what has an equal so far.
    """
    view = eights(text)
    five = lambda at, k: (view[np.minimum(starts[at] + k, len(text))].byteswap() >> np.uint64(24)).astype(np.int64)
    word = five(np.arange(len(starts)), 0)
    order = np.argsort(word, kind="stable")
    word, group, there = word[order], np.zeros(len(order), np.int64), np.arange(len(order))  # there: places that are not settled
    for k in range(5, most + 5, 5):
        same = (word[1:] == word[:-1]) & (group[1:] == group[:-1])
        alike = np.zeros(len(word), bool)
        alike[1:] |= same
        alike[:-1] |= same
        if k >= most or not alike.any():
            break
        group = np.cumsum(np.concatenate([[True], ~same]) & alike)[alike]
        there = there[alike]
        word = five(order[there], k)
        # one number for both while it has room
        by = np.argsort(group << 40 | word, kind="stable") if group[-1] < 1 << 23 else np.lexsort((word, group))
        word, order[there] = word[by], order[there][by]
    return order


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value (-1: none).

    A tree of minima: up from a place until the part left of it holds a smaller value, then down to the last such.
    """
    n = len(values)
    levels = [values]
    while len(levels[-1]) > 1:
        x = levels[-1]
        if len(x) % 2:
            x = np.append(x, np.iinfo(x.dtype).max)
        levels.append(np.minimum(x[::2], x[1::2]))
    near, level = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    live = np.arange(n)
    for k, least in enumerate(levels):
        at = live >> k
        left = np.flatnonzero(at & 1)
        hit = left[least[at[left] - 1] < values[live[left]]]
        near[live[hit]], level[live[hit]] = at[hit] - 1, k
        keep = at > 1
        keep[hit] = False
        live = live[keep]
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(level == k)
        child = 2 * near[down] + 1
        below = levels[k - 1]
        right = child < len(below)
        right[right] = below[child[right]] < values[down[right]]
        near[down], level[down] = np.where(right, child, child - 1), k - 1
    return near


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from a and from b on are equal, ``most`` at most and not beyond the end of the text."""
    view, out = eights(text), np.zeros(len(a), np.int64)
    end = np.minimum(len(text) - np.maximum(a, b), most)
    live = np.flatnonzero(end > 0)
    for k in range(0, most, 8):
        x = view[a[live] + k] ^ view[b[live] + k]
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        out[live] = k + np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        live = live[(x == 0) & (end[live] > k + 8)]
        if not len(live):
            break
    return np.minimum(out, end)


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, most: int, least: int = 0) -> np.ndarray:
    """For each of the sorted starts the longest string there that also begins at an earlier of them (which it may
    overlap), up to ``most`` bytes. Where that is less than ``least``, some smaller number may stand for it.

    In the order of their suffixes the earlier start with the longest common prefix is the previous or the next smaller
    position.
    """
    out = np.zeros(len(starts), np.int64)
    order = suffix_order(text, starts, most)
    if least and len(order):
        # who shares less than this with both neighbours shares less with all
        near = common_prefixes(text, starts[order[1:]], starts[order[:-1]], least) >= least
        order = order[np.concatenate([[False], near]) | np.concatenate([near, [False]])]
    place = starts[order]
    for smaller in (smaller_before(place), len(place) - 1 - smaller_before(place[::-1])[::-1]):
        there = np.flatnonzero((smaller >= 0) & (smaller < len(place)))
        out[order[there]] = np.maximum(out[order[there]], common_prefixes(text, place[there], place[smaller[there]], most))
    return out


def _factors(table: pa.Table) -> pa.Table:
    """Strings of a bucket of contexts that start earlier in it, as runs."""
    ids, ords, s, n = (table.column(x).to_numpy() for x in ("id", "ord", "s", "n"))
    order = np.lexsort((s, ords, ids))
    texts = table.column("context").to_pylist()
    raw = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    ids, ords, s, n = ids[order], ords[order], s[order], n[order].astype(np.int64)
    sizes = n + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    hit = longest_previous_factors(raw, begin[which] + inside, LENGTH, LENGTH) >= LENGTH
    t = np.zeros(int(hit.sum()), RUN)
    t["id"], t["ord"], t["s"], t["n"] = ids[which[hit]], ords[which[hit]], s[which[hit]] + inside[hit], 1
    t = _joined(t)
    return pa.table({"id": t["id"], "ord": t["ord"], "s": t["s"], "n": t["n"]})


def spans_of(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans covered by the strings of these runs."""
    order = np.argsort(s)
    a, b = s[order], np.maximum.accumulate(s[order] + n[order] + LENGTH - 1) if len(s) else s
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    return a[new], b[np.flatnonzero(np.concatenate([new[1:], [True]]))] if len(a) else b


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_view(batch.column("text"))
        out = {x: [] for x in ("n_bytes", "n_removed", "span_starts", "span_ends", "kept_sha256", "kept", "kept_text")}
        for a, b, found in zip(offsets, offsets[1:], batch.column("found")):
            text = raw[a:b]
            starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if found.is_valid:
                s, n = (x.to_numpy() for x in found.values.flatten())
                starts, ends = spans_of(s.astype(np.int64), n.astype(np.int64))
            kept, at = [], 0
            for p, q in zip(starts, ends):
                kept.append(text[at:p].tobytes())
                at = q
            kept = b"".join([*kept, text[at:].tobytes()])
            for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("span_starts", starts.tolist()), ("span_ends", ends.tolist()), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept), ("kept_text", kept.decode("utf-8", "ignore"))):
                out[k].append(v)
        kinds = {"span_starts": pa.list_(pa.int64()), "span_ends": pa.list_(pa.int64()), "kept": pa.binary(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], ["row", *out])


def _overfull(rows: DataFrame) -> np.ndarray:
    """Anchors that many different contexts share, on a sample of documents; PART at most."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _table_of_runs(batch, np.zeros(0, np.uint64))
            t, first = _firsts(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(t[x][first]).view(np.int64)) for x in ("h", "c")], ["h", "c"])

    found = rows.where(f"pmod(xxhash64(id), {SAMPLE}) = 0").mapInArrow(seen, "h long, c long").distinct().groupBy("h").agg(F.count("*").alias("contexts"))
    found = durable(found)
    total = found.agg(F.sum("contexts")).first()[0] or 0
    most = max(LEAST, -(-total // PART))
    return np.array([x[0] for x in found.where(F.col("contexts") >= most).select("h").collect()], np.int64).view(np.uint64)


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, buckets: int | None) -> DataFrame:
    """Each row as a struct, with what remove_repeats returns."""
    spark = docs.sparkSession
    rows = bundled(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(2**63 - 1)))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("ord", F.lit(0))
    else:
        rows = durable(rows.withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"), "text"))))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = buckets or max(64, -(-size // BUCKET_TEXT))
    keyed = rows.select("id", "ord", "text")
    sent = keyed.mapInArrow(_send(dealt, _overfull(keyed)), "bucket int, runs binary")
    settled = durable(sent.groupBy("bucket").applyInArrow(_settle, "id long, ord int, s long, n int, key long"))
    wanted = settled.where("key is not null")
    size = wanted.agg(F.sum(F.col("n") + F.lit(LENGTH - 1))).first()[0] or 0
    dealt = buckets or max(64, -(-size // BUCKET_CONTEXTS))
    wanted = wanted.groupBy("id", "ord").agg(F.collect_list(F.struct("s", "n", "key")).alias("wanted"))
    contexts = keyed.join(wanted, ["id", "ord"]).select("id", "ord", "text", "wanted").mapInArrow(_contexts, "key long, id long, ord int, s long, n int, context binary")
    factors = contexts.withColumn("bucket", F.pmod("key", F.lit(dealt))).groupBy("bucket").applyInArrow(_factors, "id long, ord int, s long, n int")
    gone = settled.where("key is null").select("id", "ord", "s", "n").union(factors)
    gone = gone.groupBy("id", "ord").agg(F.collect_list(F.struct("s", "n")).alias("found"))
    # the text once only: in the struct there are the other columns
    slim = rows.withColumn("row", F.col("row").dropFields(text_col)) if len(docs.columns) > 1 else rows
    cut = slim.join(gone, ["id", "ord"], "left").select("row", "text", "found")
    kinds = cut.schema["row"].dataType.simpleString()
    return cut.mapInArrow(_cut, f"row {kinds}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept_sha256 string, kept binary, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends and kept (the bytes left).

    Texts are UTF-8 bytes; a null text is empty and loses nothing. Rows are ordered by id, rows of one id by their
    text's hash and then in any order (of repeated rows the first keeps its bytes), null ids last. Texts shorter than
    LENGTH are never touched and give no source either, as matches don't cross texts; very long texts are worked on in
    overlapping parts. ``kept`` may end inside a character. Other columns, whatever their names, are not looked at. An
    empty table gives no rows.
    """
    out = _without_repeats(docs.select(id_col, text_col), id_col, text_col, buckets)
    return out.select(F.col("row").getField(id_col).cast("long").alias(id_col), "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), "kept_sha256", "span_starts", "span_ends", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """The rows of docs with all their columns and the bytes left as text (a character that was cut goes as a whole).

    A null text becomes an empty one, null ids stay and count as last, of repeated rows the first keeps its text and
    the others are left with an empty one. Columns may have any names. An empty table gives no rows.
    """
    out = _without_repeats(docs, id_col, text_col, buckets)
    return unbundled(out, docs.columns, **{text_col: F.col("kept_text")})
