"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The new words of a batch are set end to end and indexed by a suffix array. Every piece of the vocabulary is found by
binary search; the places in its range are edges over the text. Edges are sorted by where they end and relaxed: the
prefix that ends there has this piece as its last token if the token before it and this one stay two tokens when
merged by the rules. Of all edges that end at a place, exactly one does (the last token of a prefix's BPE encoding is
unique), so following them back from the end of a word gives the ids of the merge rules, not merely a cheapest path.

Words are cut between two bytes that no piece has side by side, as after every word a blank. Their ids are remembered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import OpenTable, Remembered, mix64, piece_hashes, slices, utf8_view

SPACE = "▁"
#: Bytes that are encoded at once, and words (and bytes of them) whose ids are remembered.
STEP, REMEMBERED, REMEMBERED_BYTES = 1 << 21, 1 << 21, 1 << 26
INDEXED = 16


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback, and which neighbours stay apart."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_id[int(self.text[i][3:5], 16)] = i
        self.rank = {self.text[i]: (-sp.get_score(i), i) for i in range(n) if not special[i] and not byte[i]}
        self.is_byte = np.array(byte)
        self.bytes = [b"" if s else bytes([int(t[3:5], 16)]) if b else t.replace(SPACE, " ").encode() for t, s, b in zip(self.text, special, byte)]
        known = np.zeros(0x110000, bool)
        known[[ord(t) for t in self.rank if len(t) == 1]] = True
        known[32] = known[ord(SPACE)]
        self.known_char = known
        ids = [i for _, i in self.rank.values()]
        self.piece_ids = np.array([i for i in ids if len(self.bytes[i]) <= INDEXED])
        self.long_ids = [i for i in ids if len(self.bytes[i]) > INDEXED]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.low = np.array([self.bytes[i] for i in self.piece_ids], f"S{INDEXED}")
        self.high = np.array([self.bytes[i].ljust(INDEXED, b"\xff") for i in self.piece_ids], f"S{INDEXED}")
        self.alone = np.array([i in self.rank_ids() and self.merged(self.text[i]) == [i] for i in range(n)]) | self.is_byte
        self.apart, self.answers = OpenTable(), np.zeros(1 << 12, bool)
        self.inside = np.zeros((256, 256), bool)
        for i in ids:
            b = np.frombuffer(self.bytes[i], np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.lengths)])

    def rank_ids(self) -> set[int]:
        if not hasattr(self, "_ids"):
            self._ids = {i for _, i in self.rank.values()}
        return self._ids

    def merged(self, text: str) -> list[int]:
        """The ids of a text by the merge rules alone: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [x for p in parts for x in ([self.rank[p][1]] if p in self.rank else [int(self.byte_id[b]) for b in p.encode()])]

    def stay_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the text of two tokens encodes as these two."""
        code = mix64((first * self.size + second).astype(np.uint64))
        at = self.apart.find(code)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, one = np.unique(code[new], return_index=True)
            one = new[one]
            answers = [bool(self.is_byte[p] or self.is_byte[t]) or self.merged(self.text[p] + self.text[t]) == [p, t] for p, t in zip(first[one].tolist(), second[one].tolist())]
            k = self.apart.used
            while k + len(answers) > len(self.answers):
                self.answers = np.concatenate([self.answers, np.zeros_like(self.answers)])
            self.answers[k : k + len(answers)] = answers
            self.apart.put(fresh, np.arange(k, k + len(answers), dtype=np.int32))
            at[new] = self.apart.find(code[new])
        return self.answers[at]

    def edges(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every place where a piece stands in the text, by binary search in its suffix array."""
        padded = np.concatenate([raw, np.full(INDEXED, 0xFF, np.uint8)])
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, INDEXED)[: len(raw)]
        keys = np.ascontiguousarray(suffixes).view(">u8").reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        index = np.ascontiguousarray(suffixes[order]).view(f"S{INDEXED}").ravel()
        low, high = np.searchsorted(index, self.low, "left"), np.searchsorted(index, self.high, "right")
        count = high - low
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start, piece = order[np.repeat(low, count) + inside], np.repeat(self.piece_ids, count)
        whole = raw.tobytes()
        more = []
        for i in self.long_ids:
            b = self.bytes[i]
            a, z = np.searchsorted(index, np.array([b[:INDEXED]], f"S{INDEXED}"), "left")[0], np.searchsorted(index, np.array([b[:INDEXED]], f"S{INDEXED}"), "right")[0]
            more += [(p, i) for p in order[a:z].tolist() if whole.startswith(b, p)]
        if more:
            start, piece = np.concatenate([start, [p for p, _ in more]]), np.concatenate([piece, [i for _, i in more]])
        return start, piece

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        raw = np.frombuffer(b"\xff".join([*words, b""]), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        home = np.repeat(begin, size + 1)
        start, piece = self.edges(raw)
        # bytes of characters that are no piece stand for themselves
        codes = np.frombuffer(b"\xff".join([*words, b""]).replace(b"\xff", b"\n").decode().encode("utf-32-le"), "<u4")
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        loose = np.flatnonzero(np.repeat(~self.known_char[codes], width) & (raw != 0xFF))
        start, piece = np.concatenate([start, loose]), np.concatenate([piece, self.byte_id[raw[loose]]])
        end = start + self.lengths[piece]
        reach = end - home[start]
        order = np.argsort(reach, kind="stable")
        start, piece, end, reach = start[order], piece[order], end[order], reach[order]
        first = start == home[start]
        last, back = np.full(len(raw) + 1, -1, np.int64), np.zeros(len(raw) + 1, np.int64)
        cut = np.flatnonzero(np.concatenate([[True], reach[1:] != reach[:-1], [True]])) if len(reach) else [0]
        for a, b in zip(cut, cut[1:]):
            s, p, f = start[a:b], piece[a:b], first[a:b]
            before = last[s]
            ok = f & self.alone[p]
            ask = np.flatnonzero(~f & (before >= 0) & self.alone[p])
            ok[ask] = self.stay_apart(before[ask], p[ask])
            last[end[a:b][ok]], back[end[a:b][ok]] = p[ok], s[ok]
        # back from the ends of all words, a token at a time
        found, at, who = [], begin + size, np.arange(len(words))
        live = size > 0
        missed = live & (last[at] < 0)
        at, who = at[live & ~missed], who[live & ~missed]
        while len(at):
            found.append((who, last[at]))
            at = back[at]
            more = at > begin[who]
            at, who = at[more], who[more]
        counts = np.zeros(len(words), np.int64)
        for w, _ in found:
            counts[w] += 1
        odd = {int(k): self.merged(words[k].decode().replace(" ", SPACE)) for k in np.flatnonzero(missed)}
        for k, ids in odd.items():
            counts[k] = len(ids)
        stop = np.cumsum(counts)
        out, place = np.zeros(int(counts.sum()), np.uint32), stop - 1
        for w, t in found:
            out[place[w]] = t
            place[w] -= 1
        for k, ids in odd.items():
            out[stop[k] - counts[k] : stop[k]] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the blank that encoding puts first."""
        size = self.lengths[ids]
        stops = np.cumsum(size)
        out = self.flat[np.repeat(self.offset[ids] - (stops - size), size) + np.arange(int(stops[-1]) if len(ids) else 0)]
        return out[1 if len(out) and out[0] == 32 else 0 :].tobytes()


class Encoder:
    """Encodes batches of texts; remembers the ids of words."""

    def __init__(self, path: str):
        self.vocabulary, self.memory = Vocabulary(path), Remembered()

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        size = np.diff(offsets)
        # a blank before every text that is not empty
        raw = np.insert(raw, offsets[:-1][size > 0], 32)
        offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(size)
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= ~self.vocabulary.inside[raw[:-1], raw[1:]] & (raw[1:] & 0xC0 != 0x80)
        cuts = np.flatnonzero(edge)
        begins, ends = cuts[:-1], cuts[1:]
        if self.memory.known > REMEMBERED or self.memory.filled > REMEMBERED_BYTES:
            self.memory = Remembered()
        data = raw.tobytes()
        encode = lambda which: self.vocabulary.encode_words([data[a:b] for a, b in zip(begins[which].tolist(), ends[which].tolist())])
        at = self.memory.numbers(piece_hashes(raw, begins, ends), raw, begins, ends, np.zeros(len(begins), np.int64), encode)
        ids, stops = self.memory.joined(at)
        edge = stops[np.searchsorted(begins, offsets)]
        return [ids[a:b] for a, b in zip(edge, edge[1:])]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            raw, offsets = utf8_view(batch.column("text"))
            for i, j in slices(offsets, STEP):
                part, marks = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found = encoder.encode(part, marks)
                columns = [batch.column("id").slice(i, j - i), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64())]
                decoded = [encoder.vocabulary.decode(x) for x in found]
                columns.append(pa.array([zlib.crc32(x) for x in decoded], pa.int64()))
                whole = batch.column("whole").slice(i, j - i).to_numpy(zero_copy_only=False)
                columns.append(pa.array([bool(w) and x == part[a:b].tobytes() for x, a, b, w in zip(decoded, marks, marks[1:], whole)], pa.bool_()))
                names = ["id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return encode


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """For each row: id, n_tokens, ids_crc32, decoded_crc32, round_trip (decoding gives the text), and the ids if asked.

    The ids are those of the library for this model (no special tokens). The character U+2581 is a blank to the model,
    so a text with it is encoded with blanks in its place, and decoding does not give it back. Whole texts are encoded,
    however long. Null and empty texts have no ids. Repeated rows each get a row, null ids stay null, other columns,
    whatever their names, are not looked at, no rows give no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.replace(text, F.lit(SPACE), F.lit(" ")).alias("text"), (~F.coalesce(F.contains(text, F.lit(SPACE)), F.lit(False))).alias("whole"))
    kinds = "id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_encode(model_path, with_ids), kinds).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the text of their ids in ``text_col``, which replaces a column of that name.

    Null ids give a null text, no ids an empty one; an id outside the vocabulary raises. Bytes that are no UTF-8 become
    U+FFFD. Repeated rows stay, other columns stay as they are, no rows give no rows.
    """
    others = [c for c in encoded.columns if c != text_col]
    rows = encoded.select(F.struct(*others).alias("row"), F.col(ids_col).cast("array<long>").alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(model_path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)).decode("utf-8", "replace") if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = rows.mapInArrow(decode, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col("row").getField(c).alias(c) for c in others), F.col("text").alias(text_col))
