"""Packing of documents into training sequences as vector bin packing.

A sequence has limits on tokens, segments and loss-bearing tokens. Bins are filled one at a time; the next piece is
the one of the waiting items whose demand has the largest weighted dot product with what is left in the bin. Items may
be cut, so a gap is closed with the head of an item that is too long (or, where loss-bearing ids are used up, with the
prompt of one). What remains at the end of a task is dealt to sequences whose lengths are powers of two, which need no
padding.

Each task packs what it reads, batch by batch, with at most WAITING tokens waiting, so nothing is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import Remembered, piece_hashes, slices, utf8_view

#: Limits of a sequence: ids, pieces, loss-bearing ids; and leading ids of a document that bear no loss.
TOKENS, SEGMENTS, LOSS, PROMPT = 4096, 24, 4064, 16
END_ID = 2
#: Tokens and items that wait for a place, pieces of text (and bytes of them) whose ids are remembered, and bytes that
#: are split at once.
WAITING, ITEMS, REMEMBERED, REMEMBERED_BYTES, STEP = 1 << 20, 4096, 1 << 20, 1 << 26, 1 << 20

#: Bytes of texts that are split without the tokenizer: 1 letters, 2 blanks, 3 other ASCII, 0 what needs a look.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 2
_HARD = np.zeros(256, bool)
_HARD[[0x27, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True  # an apostrophe, or a character over U+00FF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_letters() -> list[str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


# fixed values: what a tokenizer file must say for its texts to be split here
_NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits into runs of letters, digits and the rest."""
    normalizers = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    special = [x.get("content", "") for x in spec.get("added_tokens") or []]
    return (
        normalizers == _NORMALIZER
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": _SPLIT}
        and steps[0].get("invert") is True
        and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        and all(x.startswith("<|") for x in special)
        and spec.get("truncation") is None and spec.get("padding") is None and not spec.get("model", {}).get("dropout")
    )


class PieceTokenizer:
    """The ids that a tokenizer file gives, for files that ``splits_at_words`` from remembered ids of pieces.

    A piece lies between places where the tokenizer always splits: blanks, and the edges of runs of letters. Pieces
    are found by a hash and compared by their bytes. Texts with characters for which lower-casing, composing or
    splitting depends on neighbours are split at blanks only, and their words go through the whole tokenizer. With any
    other file the library does it all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.known = splits_at_words(json.load(f))
        self.letters = dict(enumerate(_byte_letters()))
        self.memory = Remembered()

    def learn(self, pieces: list[bytes], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and their counts; simple ones are a single run of lower-cased letters."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids: list[list[int]] = [[t.id for t in tokenize(p.decode("latin-1").translate(letters))] if s else [] for p, s in zip(pieces, simple.tolist())]
        others = np.flatnonzero(~simple)
        for i, x in zip(others.tolist(), self.tokenizer.encode_batch_fast([pieces[i].decode() for i in others], add_special_tokens=False)):
            ids[i] = x.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Lower-cased bytes, and the start, end, text and simplicity of every piece."""
        low = _LOWER[raw]
        accent = np.zeros(len(raw), bool)
        accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[accent] += 0x20
        hard = _HARD[raw]
        hard[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # no letters
        hard[1:] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)  # a special token may begin here
        odd = np.diff(np.concatenate([[0], np.cumsum(hard)])[offsets]) > 0
        kind = _KIND[raw]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        if odd.any():
            at = odd[text]
            low[at] = raw[at]
            kind[at & (kind != 2)] = 4
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        cuts = np.flatnonzero(edge)
        begins, ends = cuts[:-1], cuts[1:]
        full = kind[begins] != 2
        begins, ends = begins[full], ends[full]
        return low, begins, ends, text[begins], kind[begins] == 1

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(raw):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        if not self.known:
            data = raw.tobytes()
            texts = [data[a:b].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        low, begins, ends, text, simple = self._pieces(raw, offsets)
        if self.memory.known > REMEMBERED or self.memory.filled > REMEMBERED_BYTES:
            self.memory = Remembered()
        data = low.tobytes()
        learn = lambda which: self.learn([data[a:b] for a, b in zip(begins[which].tolist(), ends[which].tolist())], simple[which])
        # whether it is a run of letters is part of a piece: the same bytes may stand in a text that was not lower-cased
        at = self.memory.numbers(piece_hashes(low, begins, ends) ^ simple.astype(np.uint64), low, begins, ends, simple.astype(np.int64), learn)
        ids, stops = self.memory.joined(at)
        edge = stops[np.searchsorted(text, np.arange(len(offsets)))]
        return [ids[a:b] for a, b in zip(edge, edge[1:])]


_TOKENIZERS: dict[str, PieceTokenizer] = {}


class Packer:
    """Fills bins from a pool of items (tokens, loss-bearing tokens at their end)."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        self.limit = (tokens, segments, loss)
        self.key, self.start, self.tokens, self.loss = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bins = 0

    def add(self, keys: list, tokens: np.ndarray, loss: np.ndarray) -> None:
        self.key += keys
        self.start = np.concatenate([self.start, np.zeros(len(keys), np.int64)])
        self.tokens, self.loss = np.concatenate([self.tokens, tokens]), np.concatenate([self.loss, loss])

    def waiting(self) -> int:
        return int(self.tokens.sum())

    def _take(self, i: int, length: int) -> tuple:
        piece = (self.key[i], int(self.start[i]), length)
        self.start[i] += length
        self.tokens[i] -= length
        self.loss[i] = min(self.loss[i], self.tokens[i])
        return piece

    def _fill(self) -> list[tuple]:
        """Pieces of the next bin: of the items that fit as a whole the one with the largest dot product of its demand
        with what is left, each limit weighted by how much all waiting items ask of it; else the longest part."""
        room, segments, loss = self.limit
        demand = np.array([self.tokens.sum() / room, np.count_nonzero(self.tokens) / segments, self.loss.sum() / max(1, loss)])
        weight = demand / np.array([room, segments, max(1, loss)]) ** 2 / max(demand.max(), 1e-9)
        pieces = []
        while room and segments:
            take = np.minimum(np.minimum(self.tokens, room), self.tokens - self.loss + loss)
            whole = (take == self.tokens) & (take > 0)
            if segments > 1 and whole.any():
                i = int(np.argmax(np.where(whole, self.tokens * (weight[0] * room) + weight[1] * segments + self.loss * (weight[2] * loss), -1)))
            else:  # a part, or the last piece, closes as much of the gap as it can; whole items first
                i = int(np.argmax(2 * take + whole)) if len(take) else 0
                if not len(take) or take[i] <= 0:
                    break
            length, before = int(take[i]), int(self.loss[i])
            pieces.append(self._take(i, length))
            loss -= before - int(self.loss[i])
            room -= length
            segments -= 1
        return pieces

    def pack(self, keep: int, items: int = 0) -> Iterator[list[tuple]]:
        """Bins while more than ``keep`` tokens or ``items`` items wait; with keep 0 all, the last ones of power-of-two
        lengths."""
        while (rest := self.waiting()) > keep or (items and np.count_nonzero(self.tokens) > items):
            if rest < self.limit[0] and not keep:
                for pieces in self._powers():
                    yield self._close(pieces)
                break
            pieces = self._fill()
            if not pieces:
                raise ValueError("no item can be placed under these limits")
            yield self._close(pieces)
        live = np.flatnonzero(self.tokens)
        self.key = [self.key[i] for i in live]
        self.start, self.tokens, self.loss = self.start[live], self.tokens[live], self.loss[live]

    def _powers(self) -> Iterator[list[tuple]]:
        """What is left, the longest items first, in sequences of the largest power of two that they fill."""
        live = sorted(np.flatnonzero(self.tokens).tolist(), key=lambda i: -self.tokens[i])
        while live:
            segments, loss, pieces = self.limit[1], self.limit[2], []
            length = 1 << (int(self.tokens[live[:segments]].sum()).bit_length() - 1)
            while length and live and segments:
                i = live[0]
                before = int(self.loss[i])
                take = min(length, int(self.tokens[i]), int(self.tokens[i]) - before + loss)
                if take <= 0:
                    break
                pieces.append(self._take(i, take))
                loss -= before - int(self.loss[i])
                length -= take
                segments -= 1
                if not self.tokens[i]:
                    live.pop(0)
            if not pieces:
                raise ValueError("no item can be placed under these limits")
            yield pieces
            live.sort(key=lambda i: -self.tokens[i])

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for key, start, length in pieces:
            out.append((key, start, length, self.bins, at))
            at += length
        self.bins += 1
        return out


def _pack(path: str, tokens: int, segments: int, loss: int, with_ids: bool):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = PieceTokenizer(path)
        tokenizer, packer, held, number = _TOKENIZERS[path], Packer(tokens, segments, loss), {}, 0
        base = TaskContext.get().partitionId() << 36

        def rows(bins: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            out = [[] for _ in schema]
            for pieces in bins:
                for key, start, length, sequence, at in pieces:
                    doc, ids, prompt = held[key]
                    part = ids[start : start + length]
                    bears = start + length - min(max(start, prompt), start + length)
                    for column, x in zip(out, (doc, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + sequence, at, bears, part.astype(np.int32))):  # zip ends before ids that nobody wants
                        column.append(x)
                    if start + length == len(ids):
                        del held[key]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

        for batch in batches:
            docs = batch.column("id").to_pylist()
            prompts = batch.column("prompt").to_pylist()
            raw, offsets = utf8_view(batch.column("text"))
            for at, end in slices(offsets, STEP):
                encoded = tokenizer.encode(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                keys = list(range(number, number + len(encoded)))
                number += len(encoded)
                for key, doc, ids, prompt in zip(keys, docs[at:end], encoded, prompts[at:end]):
                    held[key] = (doc, np.append(ids, np.uint32(END_ID)), prompt)
                sizes = np.array([len(held[k][1]) for k in keys], np.int64)
                packer.add(keys, sizes, np.maximum(0, sizes - np.array(prompts[at:end], np.int64)))
                if packer.waiting() > WAITING or len(packer.key) > ITEMS:
                    yield from rows(packer.pack(WAITING // 2, ITEMS // 2))
        yield from rows(packer.pack(0))

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, prompt: int | Column = PROMPT, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with their places: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids).

    A document is its tokenizer's ids (no special tokens added) and END_ID; all but its first ``prompt`` ids (a number,
    or a column with one for each row, such as the length of an instruction; null is 0) bear loss. Sequences hold at
    most ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing ids; a sequence that another limit ends before
    its tokens are full is padded. Null and empty texts are END_ID alone. Very long texts are encoded whole and cut
    over sequences. Repeated rows and equal texts are packed each on their own, null ids stay null. Other columns,
    whatever their names, are not looked at. An empty table gives no rows. sequence_id is unique, not gapless.
    """
    if tokens < 1 or segments < 1 or loss < 1:
        raise ValueError("limits must be at least 1")
    bare = F.greatest(F.coalesce(prompt if isinstance(prompt, Column) else F.lit(prompt), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), bare.alias("prompt"))
    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_pack(tokenizer_path, tokens, segments, loss, with_ids), kinds).withColumnRenamed("id", id_col)
