"""Operator 4, personal data: plain expressions, and a character-level
bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Every kind of personal data looked for holds a digit or an ``@``, so the model
reads the regions around those characters (``REACH`` to each side) and leaves
the rest untagged.  A region is cut into overlapping windows; their emission
scores are averaged, middle of a window before its edge, and the whole region
is decoded once with the transitions, so windows never disagree.

A region longer than ``BLOCK`` is decoded in blocks that overlap by ``LAP``
characters to each side and are joined in the middle, many in one batch, so a
long table of numbers costs in proportion to its length.

The labelled spans are the plain matches in a bounded sample of documents
(``SAMPLE_DOCS``, ``SAMPLE_CHARS`` characters each at most, ``SAMPLE_WINDOWS``),
and the same spans written in forms that the expressions miss (``odd_form``):
those are what the model is there to add.  Every document is scanned whole.  A span
of the model is added if its least tag probability is ``CONFIDENCE``, it fits its
kind's plainest form and overlaps no plain match.

Spans are code points, end exclusive.  Defined cases: null text is empty and
has no spans; rows are scanned one by one; a sample without spans gives a model
that adds none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textbatch import slices

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS = 800
SAMPLE_CHARS = 20_000
SAMPLE_WINDOWS = 2_000
REACH = 24
WINDOW = 64
STRIDE = 32
HIDDEN = 16
EPOCHS = 20
CONFIDENCE = 0.9
BLOCK = 512
LAP = 64
TAGS = 1 + 2 * len(KINDS)  # O, then first and further characters of each kind
_CHARS = 130  # ASCII, other letters, everything else

# Possessive and anchored at the start of a run: the same leftmost matches, in linear time.
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_REST.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain matches, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of the digits and ``@`` of a text."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(c < 128, c, np.where((c >= 0xC0) & (c < 0x2000), 128, 129))


def _windows(length: int) -> list[int]:
    """Starts of the windows that cover a region; the last ends with it."""
    if length <= WINDOW:
        return [0]
    return [*range(0, length - WINDOW, STRIDE), length - WINDOW]


@dataclass
class Tagger:
    """Parameters by name; ``f`` and ``b`` are the two reading directions."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    spans_seen: int = 0

    @staticmethod
    def fresh(seed: int = 11) -> Tagger:
        r, h = np.random.default_rng(seed), HIDDEN
        p = {}
        for d in "fb":
            p[f"x{d}"] = r.normal(0, 0.1, (_CHARS, 4 * h))
            p[f"x{d}"][:, h : 2 * h] += 1  # forget gates start open
            p[f"u{d}"] = r.normal(0, h**-0.5, (h, 4 * h))
        p["w"] = r.normal(0, (2 * h) ** -0.5, (2 * h, TAGS))
        p["o"] = np.zeros(TAGS)
        p["t"] = np.zeros((TAGS, TAGS))
        return Tagger(p)

    def _both(self, name: str) -> np.ndarray:
        """A parameter of the two directions, as one array."""
        return np.stack([self.p[name + d] for d in "fb"]).astype(np.float32)

    def _read(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states of both directions over windows x (batch, time); with
        ``keep`` also what the gradient needs: (quantity, step, direction, batch, unit)."""
        n, steps = x.shape
        k = HIDDEN
        gate = np.repeat(np.float32([0.5, 1]), [3 * k, k])  # sigmoid(z) is (1 + tanh(z / 2)) / 2
        table, u = self._both("x") * gate, self._both("u") * gate
        at, direction = np.stack([x, x[:, ::-1]]), np.arange(2)[:, None]
        h, c = np.zeros((2, n, k), np.float32), np.zeros((2, n, k), np.float32)
        out = np.zeros((2, n, steps, k), np.float32)
        saved = np.empty((7, steps if keep else 0, 2, n, k), np.float32)
        for t in range(steps):
            z = np.tanh(table[direction, at[:, :, t]] + h @ u)
            s = 0.5 * z[..., : 3 * k] + 0.5
            i, f, o, g = s[..., :k], s[..., k : 2 * k], s[..., 2 * k :], z[..., 3 * k :]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                for q, value in enumerate((h, c, i, f, o, g, tc)):
                    saved[q, t] = value
            c, h = new, o * tc
            out[:, :, t] = h
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2), saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._read(x, False)[0] @ self.p["w"] + self.p["o"]

    def _unread(self, x: np.ndarray, grad: np.ndarray, saved: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the two directions' parameters from that of the states."""
        k, (n, steps) = HIDDEN, x.shape
        grad = np.stack([grad[:, :, :k], grad[:, ::-1, k:]]).astype(np.float32)
        back = self._both("u").transpose(0, 2, 1)
        before, c, i, f, o, g, tc = saved
        # Each gate's slope; the third is met by the states' gradient, the others by the cells'.
        slope = np.empty((steps, 2, n, 4, k), np.float32)
        slope[..., 0, :], slope[..., 1, :], slope[..., 2, :], slope[..., 3, :] = g * i * (1 - i), c * f * (1 - f), tc * o * (1 - o), i * (1 - g * g)
        cell = o * (1 - tc * tc)
        dz, met = np.zeros_like(slope), np.zeros_like(slope[0])
        dh, dc = np.zeros_like(cell[0]), np.zeros_like(cell[0])
        for t in range(steps - 1, -1, -1):
            dh = dh + grad[:, :, t]
            dc = dc + dh * cell[t]
            met[:] = dc[:, :, None]
            met[:, :, 2] = dh
            np.multiply(slope[t], met, out=dz[t])
            dh, dc = dz[t].reshape(2, n, 4 * k) @ back, dc * f[t]
        out = {}
        # Small products a step: large ones would have BLAS threads wait for each other.
        for j, d in enumerate("fb"):
            flat = dz[:, j].reshape(steps, n, 4 * k)
            read = (x if d == "f" else x[:, ::-1]).T.ravel()
            order = np.argsort(read, kind="stable")
            first = np.flatnonzero(np.diff(read[order], prepend=-1))
            out[f"x{d}"] = np.zeros((_CHARS, 4 * k), np.float32)
            out[f"x{d}"][read[order[first]]] = np.add.reduceat(flat.reshape(-1, 4 * k)[order], first)
            out[f"u{d}"] = (before[:, j].transpose(0, 2, 1) @ flat).sum(0)
        return out

    def marginals(self, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of emissions (batch, time, tag) of the given lengths,
        and the expected transitions, by forward and backward sums that are
        scaled to 1 at each step."""
        move = np.exp(self.p["t"] - self.p["t"].max())
        here = np.exp(e - e.max(2, keepdims=True))
        steps = e.shape[1]
        fwd, bwd = np.empty_like(here), np.ones_like(here)
        fwd[:, 0] = here[:, 0] / here[:, 0].sum(1, keepdims=True)
        for i in range(1, steps):
            a = fwd[:, i - 1] @ move * here[:, i]
            fwd[:, i] = a / a.sum(1, keepdims=True)
        for i in range(steps - 2, -1, -1):
            b = (here[:, i + 1] * bwd[:, i + 1]) @ move.T
            bwd[:, i] = np.where((i + 1 < n)[:, None], b / b.sum(1, keepdims=True), 1)
        live = (np.arange(steps)[None] < n[:, None])[:, :, None]
        prob = fwd * bwd
        prob = prob / prob.sum(2, keepdims=True) * live
        before, after = fwd[:, :-1], here[:, 1:] * bwd[:, 1:]
        before = before * live[:, 1:] / (before @ move * after).sum(2, keepdims=True)
        return prob, move * (before.reshape(-1, TAGS).T @ after.reshape(-1, TAGS))

    def decode(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The likeliest tags of each row."""
        t, steps = self.p["t"], e.shape[1]
        best, back = e[:, 0], []
        for i in range(1, steps):
            s = best[:, :, None] + t
            back.append(s.argmax(1))
            best = np.where((i < n)[:, None], s.max(1) + e[:, i], best)
        tags = np.zeros(e.shape[:2], np.int64)
        now = best.argmax(1)
        rows = np.arange(len(n))
        for i in range(steps - 1, -1, -1):
            tags[:, i] = now
            if i:
                now = np.where(i < n, back[i - 1][rows, now], now)
        return tags

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 32, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in "mv")
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                bx, by = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
                h, saved = self._read(bx, True)
                prob, pairs = self.marginals(h @ self.p["w"] + self.p["o"], np.full(len(bx), bx.shape[1]))
                d = prob - np.eye(TAGS)[by]
                g = self._unread(bx, d @ self.p["w"].T, saved)
                g["t"] = pairs
                np.add.at(g["t"], (by[:, :-1].ravel(), by[:, 1:].ravel()), -1)
                g["w"] = (h.transpose(0, 2, 1) @ d).sum(0)
                g["o"] = d.sum((0, 1))
                step += 1
                for k in self.p:
                    q = g[k] / len(bx)
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def tag_regions(self, texts: list[np.ndarray], batch: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tags, probability of each) of every region (character codes)."""
        starts = [range(0, max(1, len(t)), BLOCK) if len(t) > BLOCK + LAP else (0,) for t in texts]
        blocks = [t[max(0, s - LAP) : s + BLOCK + LAP] if len(at) > 1 else t for t, at in zip(texts, starts, strict=True) for s in at]
        found = iter(self._tag_blocks(blocks, batch))
        out = []
        for t, at in zip(texts, starts, strict=True):
            some = [next(found) for _ in at]
            if len(at) > 1:
                lo = [min(s, LAP) for s in at]
                some = [(tags[a : a + BLOCK], prob[a : a + BLOCK]) for (tags, prob), a in zip(some, lo, strict=True)]
                some = [(np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]))]
            out.append(some[0])
        return out

    def _tag_blocks(self, texts: list[np.ndarray], batch: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        lo = 0
        while lo < len(order):
            # Rows of like length; a very long region is handled with few others.
            hi = min(len(order), lo + batch)
            while hi > lo + 1 and len(texts[order[hi - 1]]) * (hi - lo) > batch * 4 * WINDOW:
                hi = (lo + hi + 1) // 2
            some, lo = order[lo:hi], hi
            n = np.array([len(texts[i]) for i in some])
            at = [(r, s) for r, i in enumerate(some) for s in _windows(len(texts[i]))]
            x = np.full((len(at), WINDOW), 32)
            for k, (r, s) in enumerate(at):
                piece = texts[some[r]][s : s + WINDOW]
                x[k, : len(piece)] = piece
            e, weight = np.zeros((len(some), max(n.max(), WINDOW), TAGS)), np.zeros((len(some), max(n.max(), WINDOW)))
            near = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
            for a in range(0, len(at), 2048):
                scores = self.emissions(x[a : a + 2048])
                for k, (r, s) in enumerate(at[a : a + 2048]):
                    e[r, s : s + WINDOW] += scores[k] * near[:, None]
                    weight[r, s : s + WINDOW] += near
            e /= np.maximum(weight, 1)[:, :, None]
            tags, (prob, _) = self.decode(e, n), self.marginals(e, n)
            for r, i in enumerate(some):
                t = tags[r, : n[r]]
                out[i] = (t, prob[r, np.arange(n[r]), t])
        return out


def _tagged(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(len(text), np.int64)
    for s, k, e in reversed(spans):  # of overlapping ones the first wins
        y[s:e] = 2 + 2 * k
        y[s] = 1 + 2 * k
    return y


def odd_form(kind: int, span: str, how: int) -> str:
    """A span in a form that the plain expressions miss or cut short."""
    if kind == 0:
        return span.replace("@", " @ ") if how % 2 else span.replace("@", " @").replace(".", " . ")
    if kind == 1:
        return span.replace(".", ". ") if how % 2 else span.replace(".", " . ")
    digits = [c for c in span if c in "0123456789"]
    if kind == 2:
        return (". " if how % 2 else ".").join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    return "+" + ("/" if how % 2 else "_").join("".join(digits[max(0, i) : i + 3]) for i in range(len(digits) % 3 - 3 if len(digits) % 3 else 0, len(digits), 3))


def rewritten(text: str, spans: list[tuple[int, int, int]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with its spans in odd forms, and where they are then."""
    out, at, size, moved = [], 0, 0, []
    for i, (s, k, e) in enumerate(spans):
        if s < at:
            continue
        new = odd_form(k, text[s:e], seed + i)
        out += [text[at:s], new]
        size += s - at
        moved.append((size, k, size + len(new)))
        size += len(new)
        at = e
    return "".join([*out, text[at:]]), moved


def _labelled(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    for i, text in enumerate(texts):
        spans = base_spans(text)
        yield text, spans
        if spans:
            yield rewritten(text, spans, i)


def training_windows(texts: list[str], limit: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in _labelled(texts):
        c, y = codes(text), _tagged(text, spans)
        for lo, hi in regions(text):
            for s in _windows(hi - lo):
                a = max(0, min(lo + s, len(text) - WINDOW))
                x, t = np.full(WINDOW, 32), np.zeros(WINDOW, np.int64)
                x[: len(c[a : a + WINDOW])], t[: len(c[a : a + WINDOW])] = c[a : a + WINDOW], y[a : a + WINDOW]
                xs.append(x)
                ys.append(t)
            if len(xs) >= limit:
                return np.array(xs[:limit]), np.array(ys[:limit])
    return np.array(xs).reshape(-1, WINDOW), np.array(ys).reshape(-1, WINDOW)


def fit(texts: list[str]) -> Tagger:
    model = Tagger.fresh()
    x, y = training_windows(texts)
    model.spans_seen = int((y > 0).any(axis=1).sum()) if len(x) else 0
    if model.spans_seen:
        model.train(x, y)
    return model


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Texts to learn from: documents with a digit or ``@``, least id hash first."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select(F.xxhash64("doc_id").alias("_h"), "text")
    n = some.count()
    if n > 2 * sample_docs:
        some = some.where(F.col("_h") <= F.lit(int((4 * sample_docs / n - 1) * (1 << 63))))
    return [r.text for r in some.orderBy("_h", "text").limit(sample_docs).collect()]


def _plausible(kind: int, s: str) -> bool:
    digits = sum(c in "0123456789" for c in s)
    return (
        ("@" in s and "." in s.partition("@")[2] and not s.startswith("@")) if kind == 0
        else (s.count(".") == 3 and digits >= 4) if kind == 1
        else (12 <= digits <= 19 and _luhn("".join(c for c in s if c in "0123456789"))) if kind == 2
        else 9 <= digits <= 15
    )


def model_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the model adds to each text's plain ones."""
    where = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in regions(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not model.spans_seen or not where:
        return out
    coded = {i: codes(texts[i]) for i, _, _ in where}
    for (i, lo, _), (tags, prob) in zip(where, model.tag_regions([coded[i][lo:hi] for i, lo, hi in where]), strict=True):
        for s in np.flatnonzero((tags > 0) & (tags % 2 == 1)).tolist():
            kind, e = int(tags[s] - 1) // 2, s + 1
            while e < len(tags) and tags[e] == tags[s] + 1:
                e += 1
            a, b = lo + s, lo + e
            if prob[s:e].min() >= CONFIDENCE and _plausible(kind, texts[i][a:b]) and not any(x < b and a < y for x, _, y in base[i]):
                out[i].append((a, kind, b))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_NONE = hashlib.sha256(b"").hexdigest()
_TRIGGER_BYTE = np.zeros(256, bool)
_TRIGGER_BYTE[[64, *range(48, 58)]] = True


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (plain
    matches), base_sha256, spans (all), n_added."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or fit(sample(docs)))  # a few thousand numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for b in batches:
            for lo, hi, data, offsets in slices(b, "text"):
                n = hi - lo
                hits = np.searchsorted(offsets, np.flatnonzero(_TRIGGER_BYTE[data]), side="right") - 1
                rows = np.unique(hits).tolist()
                raw = data.tobytes()
                texts = [raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace") for r in rows]
                base = [base_spans(t) for t in texts]
                added = model_spans(tagger, texts, base)
                counts = np.zeros((len(KINDS), n), np.int64)
                sha, listed, more = [_NONE] * n, [""] * n, np.zeros(n, np.int64)
                for r, s, a in zip(rows, base, added, strict=True):
                    for _, k, _ in s:
                        counts[k, r] += 1
                    sha[r] = hashlib.sha256(_listed(s).encode()).hexdigest()
                    listed[r] = _listed(sorted(s + a))
                    more[r] = len(a)
                cols = [b.column(0).slice(lo, n), *map(pa.array, counts), pa.array(sha), pa.array(listed), pa.array(more)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    longs = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {longs}, base_sha256 string, spans string, n_added bigint")
