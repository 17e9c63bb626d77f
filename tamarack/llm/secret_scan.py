"""Secrets in texts: a character convolutional network over every candidate, with fixed patterns as a base.

Candidates are what the fixed patterns match (these always count) and much that they leave: runs with digits, values of
assignments and quoted values that are too short for the patterns, short hexadecimal and key-like runs. The network
sees each with the characters around it. It is trained on labelled findings of a bounded sample of documents (matches
of the patterns against other candidates and ordinary words) and on findings made up from random alphabets and set
into real contexts. Its probabilities are calibrated on findings of documents that it did not learn from, and the
threshold is the highest one that keeps the asked recall there, on real and on made-up findings alike.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import bundled, durable, unbundled

#: Fixed patterns, with what a match must have to count.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

#: Other candidates: runs with a digit, long runs with changes of case, quoted values, short keys.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]*[0-9])[A-Za-z0-9+/_=.-]{8,}")
_CASED = re.compile(r"(?<![A-Za-z+/_=-])[A-Za-z+/_=-]{16,}")
_CHANGES = re.compile(r"[a-z][A-Z].*[a-z][A-Z]", re.DOTALL)
_QUOTED = re.compile(r"[\"'`]([^\s\"'`]{8,})(?=[\"'`])")
_KEY = re.compile(r"AKIA[A-Z0-9]{4,}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: An assignment's value counts for the patterns from 12 characters on, and as a candidate from so many.
SHORT_VALUE = 6

BEFORE, INSIDE, AFTER = 16, 32, 16
WIDTH = BEFORE + INSIDE + AFTER
CLASSES, EMBED, FILTERS, REACH = 98, 8, 24, 5
RECALL = 0.95
#: Bounds of training: documents that findings are taken from (about), findings of each label and contexts used at
#: most, and findings made up for each label. Of more findings those with the smallest hashes are taken.
SAMPLE_DOCS, FINDINGS, CONTEXTS, MADE = 4000, 3000, 2000, 1500
#: One of so many words of a sampled document is an ordinary token or a context.
EVERY = 64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of pattern matches, leftmost without overlap within a kind, in code points."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # runs of 16 or more are the maximal runs that count
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans beside those of the patterns that the network judges; what lies inside a pattern's span is judged there."""
    found = set()
    for m in _RUN.finditer(text):
        end = m.start() + len(m[0].rstrip("."))
        if end - m.start() >= 8 and (end - m.start() >= 12 or _LETTER.search(m[0])):
            found.add((m.start(), end))
    found.update((m.start(), m.end()) for m in _CASED.finditer(text) if _CHANGES.search(m[0]))
    if '"' in text or "'" in text or "`" in text:
        found.update(m.span(1) for m in _QUOTED.finditer(text) if _LETTER.search(m[1]) and _DIGIT.search(m[1]))
    if "AKIA" in text:
        found.update(m.span() for m in _KEY.finditer(text))
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found.update(m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= SHORT_VALUE)
    out, reach, inside = [], -1, [(a, b) for a, _, b in base]
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if b > reach and not any(p <= a and b <= q for p, q in inside):
            out.append((a, b))
            reach = b
    return out


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes around each part of INSIDE characters of each span, and the span that each row belongs to."""
    rows, owner = [], []
    for k, (a, b) in enumerate(spans):
        for at in range(a, b, INSIDE):
            end = min(b, at + INSIDE)
            s = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0") + text[at:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
            rows.append(s)
            owner.append(k)
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WIDTH)
    return np.where(codes == 0, 0, np.where(codes < 32, 1, np.where(codes < 127, codes - 30, CLASSES - 1))).astype(np.int64), np.array(owner, np.int64)


class Network:
    """Embedding, one convolution, maximum over places inside and around the candidate, a hidden layer, one output."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        hidden = 16
        self.p = {
            "e": rng.normal(0, 0.5, (CLASSES, EMBED)),
            "c": rng.normal(0, 1 / np.sqrt(REACH * EMBED), (REACH * EMBED, FILTERS)),
            "cb": np.zeros(FILTERS),
            "h": rng.normal(0, 1 / np.sqrt(3 * FILTERS), (3 * FILTERS, hidden)),
            "hb": np.zeros(hidden),
            "o": rng.normal(0, 0.25, hidden),
            "ob": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold, self.report = 1.0, 0.0, 0.5, {}

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.p
        e = p["e"][x]
        places = WIDTH - REACH + 1
        cols = np.stack([e[:, k : k + places] for k in range(REACH)], 2).reshape(len(x), places, REACH * EMBED)
        z = np.maximum(cols @ p["c"] + p["cb"], 0)
        inside = slice(BEFORE, BEFORE + INSIDE - REACH + 1)
        used = (x[:, BEFORE : BEFORE + INSIDE - REACH + 1] != 0).astype(np.float32)[:, :, None]
        weight = used / np.maximum(1, used.sum(1, keepdims=True))
        top, around = z[:, inside].argmax(1), z.argmax(1)
        f = np.concatenate([np.take_along_axis(z[:, inside], top[:, None], 1)[:, 0], (z[:, inside] * weight).sum(1), np.take_along_axis(z, around[:, None], 1)[:, 0]], 1)
        h = np.maximum(f @ p["h"] + p["hb"], 0)
        return h @ p["o"] + p["ob"][0], (x, cols, z, inside, weight, top, around, f, h)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0, np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) * self.scale + self.shift, -30, 30)))

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, (x, cols, z, inside, weight, top, around, f, h) = self._forward(x)
        d = (1 / (1 + np.exp(-out)) - y)[:, None] / len(x)
        g = {"o": (h * d).sum(0), "ob": d.sum(0)}
        dh = d * p["o"] * (h > 0)
        g["h"], g["hb"] = f.T @ dh, dh.sum(0)
        df = dh @ p["h"].T
        dz = np.zeros_like(z)
        rows, cells = np.arange(len(x))[:, None], np.arange(FILTERS)[None]
        dz[:, inside] += weight * df[:, None, FILTERS : 2 * FILTERS]
        dz[rows, BEFORE + top, cells] += df[:, :FILTERS]
        dz[rows, around, cells] += df[:, 2 * FILTERS :]
        dz *= z > 0
        g["c"], g["cb"] = np.tensordot(cols, dz, ((0, 1), (0, 1))), dz.sum((0, 1))
        dcols = (dz @ p["c"].T).reshape(len(x), -1, REACH, EMBED)
        g["e"] = np.zeros_like(p["e"])
        for k in range(REACH):
            np.add.at(g["e"], x[:, k : k + dcols.shape[1]], dcols[:, :, k])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, real: np.ndarray, epochs: int = 6, rate: float = 4e-3, seed: int = 99) -> None:
        """Learns from rows that are not held out; calibrates and measures on the others."""
        rng = np.random.default_rng(seed)
        tx, ty = x[~held], y[~held].astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(tx))
            for i in range(0, len(order), 64):
                step += 1
                g = self._gradient(tx[order[i : i + 64]], ty[order[i : i + 64]])
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self._calibrate(self.logits(x[held]), y[held], real[held])

    def _calibrate(self, z: np.ndarray, y: np.ndarray, real: np.ndarray) -> None:
        """Platt scaling by Newton steps on held-out findings, then the threshold, then what it does there."""
        a, b = 1.0, 0.0
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, r = q * (1 - q) + 1e-6, q - y
            hess = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1.0]])
            step = np.linalg.solve(hess, [(r * z).sum() + (a - 1), r.sum() + b])
            a, b = max(0.05, a - step[0]), b - step[1]
        self.scale, self.shift = float(a), float(b)
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        # the highest threshold that keeps the recall among real and among made-up findings
        kinds = [np.sort(p[(y == 1) & k]) for k in (real, ~real)]
        self.threshold = min((float(g[int((1 - RECALL) * len(g))]) for g in kinds if len(g)), default=1.0)
        said = p >= self.threshold
        self.report = {}
        for name, k in (("real", real), ("made", ~real)):
            hits = int((said & (y == 1) & k).sum())
            self.report[name] = {"findings": int(((y == 1) & k).sum()), "others": int(((y == 0) & k).sum()), "recall": hits / max(1, int(((y == 1) & k).sum())), "precision": hits / max(1, int((said & k).sum()))}


_ALPHABETS = {
    "hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
}


def made_up(contexts: list[tuple[str, str]], words: list[str], seed: int = 90) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and the number of the context of MADE tokens from random alphabets and MADE ordinary ones."""
    rng = np.random.default_rng(seed)
    contexts, words = contexts or [("some words before ", " and some after")], words or ["plain", "words", "stand", "here"]
    rows, y, of = [], [], []
    pick = lambda n: [words[i] for i in rng.integers(0, len(words), n)]

    def put(token: str, label: int) -> None:
        k = int(rng.integers(0, len(contexts)))
        left, right = contexts[k]
        x, _ = windows(left + token + right, [(len(left), len(left) + len(token))])
        rows.append(x)
        y.extend([label] * len(x))
        of.extend([k] * len(x))

    for alphabet in _ALPHABETS.values():
        for _ in range(MADE // len(_ALPHABETS)):
            put("".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(20, 56))), 1)
    for k in range(MADE):
        parts = pick(4)
        put(
            [
                lambda: "-".join(p.lower() for p in parts),
                lambda: "".join(p.capitalize() for p in parts),
                lambda: "_".join(parts) + str(rng.integers(0, 100)),
                lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}-00-00Z",
                lambda: "/".join(p.lower() for p in parts) + f"/v{rng.integers(1, 9)}",
                lambda: "".join(parts).upper() + str(rng.integers(0, 10)),
                lambda: "=" * int(rng.integers(16, 40)) if k % 2 else "-" * 20 + str(rng.integers(0, 10)),
                lambda: (parts[0].lower() * 6)[:24] + str(rng.integers(0, 10)),
                lambda: f"{parts[0].lower()}.{parts[1].lower()}{rng.integers(1, 999)}",
                lambda: ".".join(str(v) for v in rng.integers(0, 256, 4)),
                lambda: "+" + "-".join(str(v) for v in rng.integers(100, 9999, 3)),
            ][k % 11](),
            0,
        )
    return np.concatenate(rows), np.array(y), np.array(of)


_WORD = re.compile(r"[^\W\d_]{3,}")


def findings(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, label) of the labelled findings of a text: 1 a pattern's match, 0 another candidate or an ordinary
    word, 2 a word that stands as a context. A long candidate of all kinds of characters may well be a secret that the
    patterns miss; it has no label."""
    base = base_spans(text)
    yield from ((a, b, 1) for a, _, b in base)
    for a, b in candidates(text, base):
        kinds = [any(f(c) for c in text[a:b]) for f in (str.islower, str.isupper, str.isdigit)]
        if not (b - a >= 16 and all(kinds)) and not any(p < b and a < q for p, _, q in base):
            yield a, b, 0
    for m in _WORD.finditer(text):
        chance = (m.start() * 0x9E3779B1 + len(m[0]) * 0x85EBCA6B + ord(m[0][0])) >> 7
        if chance % EVERY == 0:
            yield m.start(), m.end(), 2 if chance // EVERY % 2 else 0


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, texts, starts = [], [], [], []
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            for a, b, label in findings(t or ""):
                # what a window can show of it, and no more
                end = min(b, a + 2 * INSIDE)
                left = max(0, a - BEFORE)
                ids.append(i)
                labels.append(label)
                texts.append(t[left : end + AFTER])
                starts.append(struct.pack("<ii", a - left, end - left))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(texts, pa.string()), pa.array(starts, pa.binary())], ["id", "label", "around", "span"])


def trained_network(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network trained on findings in whole texts of about SAMPLE_DOCS documents, chosen by the hashes of their ids.

    A quarter of these documents is held out for calibration; ``report`` tells recall and precision there. What is
    collected has a bound (FINDINGS, CONTEXTS and short texts around them), whatever the documents.
    """
    n = docs.count()
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << 40)) < (1 << 40) * min(1.0, SAMPLE_DOCS / max(1, n))
    rows = docs.where(chosen).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the same findings in every run, each once for each document
    found = durable(rows.mapInArrow(_found, "id long, label int, around string, span binary").distinct())
    first = lambda label, most: found.where(F.col("label") == label).orderBy(F.xxhash64("around", "id"), "around", "span", "id").limit(most).collect()
    real = [*first(1, FINDINGS), *first(0, FINDINGS)]
    contexts = first(2, CONTEXTS)
    held = lambda r: zlib.crc32(str(r.id).encode()) % 4 == 0
    xs, ys, hs, rs = [], [], [], []
    for r in real:
        x, _ = windows(r.around, [struct.unpack("<ii", r.span)])
        xs.append(x)
        ys += [r.label] * len(x)
        hs += [held(r)] * len(x)
        rs += [True] * len(x)
    places = [(r.around, *struct.unpack("<ii", r.span)) for r in contexts]
    x, y, of = made_up([(t[:a], t[b:]) for t, a, b in places], [t[a:b] for t, a, b in places])
    apart = np.array([held(r) for r in contexts]) if contexts else np.zeros(1, bool)
    network = Network()
    hold = np.concatenate([np.array(hs, bool), apart[of] if contexts else np.arange(len(of)) % 4 == 0])
    network.train(np.concatenate([*xs, x]), np.concatenate([np.array(ys, np.int64), y]), hold, np.concatenate([np.array(rs, bool), np.zeros(len(y), bool)]))
    return network


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(network: Network):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in COLUMNS]
            for at in range(0, batch.num_rows, 512):
                texts = [t or "" for t in batch.column("text").slice(at, 512).to_pylist()]
                for b, rest, p in _judged(network, texts):
                    more = [(a, 3, e) for (a, e), q in zip(rest, p[len(b) :]) if q >= network.threshold]
                    every = sorted(b + more)
                    kinds = [k for _, k, _ in b]
                    values = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_spell(b).encode()).hexdigest(), _spell(every), [a for a, _, _ in every], [e for _, _, e in every], len(more), len(p), min(p[: len(b)], default=None))
                    for column, v in zip(out, values):
                        column.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), *(pa.array(v, t) for v, t in zip(out, kinds))], [*batch.schema.names, *COLUMNS])

    return scan


def _judged(network: Network, texts: list[str]) -> Iterator[tuple[list, list, list[float]]]:
    """For each text the patterns' spans, the other candidates, and the probability of each of both."""
    base = [base_spans(t) for t in texts]
    rest = [candidates(t, b) for t, b in zip(texts, base)]
    spans = [[(a, e) for a, _, e in b] + r for b, r in zip(base, rest)]
    seen = [windows(t, s) if s else (np.zeros((0, WIDTH), np.int64), np.zeros(0, np.int64)) for t, s in zip(texts, spans)]
    p = network.probability(np.concatenate([x for x, _ in seen])) if seen else []
    done = 0
    for b, r, s, (x, owner) in zip(base, rest, spans, seen):
        # of a long candidate the part that looks most like a secret counts
        best = np.zeros(len(s))
        np.maximum.at(best, owner, p[done : done + len(x)])
        done += len(x)
        yield b, r, best.tolist()


COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_starts", "span_ends", "n_model", "n_judged", "least_base")
_DDL = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, span_starts array<int>, span_ends array<int>, n_model long, n_judged long, least_base double"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """For each row: id, text, counts by pattern, base_sha256, spans, the starts and ends of all spans, n_model (spans
    that the network adds), n_judged (candidates it judged, with the patterns' spans) and least_base (the lowest
    probability of a pattern's span, null without any).

    Whole texts are read, however long; a null text is empty and has no spans. Offsets are code points, ends exclusive.
    Spans of different kinds may overlap, as a candidate may reach beyond a pattern's span. Repeated rows each get a
    row, null ids stay null, other columns are not looked at whatever their names, no rows give no rows.
    """
    network = network or trained_network(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(network), f"id long, text string, {_DDL}").withColumnRenamed("id", id_col)


def _cut(text: str | None, starts: list[int], ends: list[int], mark: str) -> str | None:
    """The text with spans replaced by the mark, spans that overlap by one."""
    if not starts:
        return text
    parts, at = [], -1
    for a, b in zip(starts, ends):
        if a >= at:
            parts += [text[max(0, at) : a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with all their columns, every span in their text replaced by the mark.

    A null text stays null, a text without spans as it is; spans that overlap become one mark. Repeated rows and null
    ids stay, columns may have any names, no rows give no rows.
    """
    scan = _scan(network or trained_network(docs, id_col, text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            out = [_cut(t, a, b, mark) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "span_starts", "span_ends")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "clean"])

    rows = bundled(docs, id_col, text_col)
    slim = rows.withColumn("row", F.col("row").dropFields(text_col)) if len(docs.columns) > 1 else rows
    out = slim.select("row", "text").mapInArrow(cut, f"row {slim.schema['row'].dataType.simpleString()}, clean string")
    return unbundled(out, docs.columns, **{text_col: F.col("clean")})
