"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling, written in numpy.

A step's input is a word: a hashed embedding of the word and the mean of hashed embeddings of its
character trigrams. The network reads windows of words that overlap; a document's score is that of
its worst window. Labels are of documents, so training takes from a toxic document the windows
that look worst so far, first by trigram log-odds, then by the network itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import slices, table
from tessella.llm.learning import judged, labelled_sample, remainder, score

LENGTH, STRIDE = 24, 16
WORDS, GRAMS = 1 << 14, 1 << 14
D, H = 6, 8  # of an embedding, of a direction's state
_WORD = re.compile(r"[^\W_]+").findall


class Batch:
    """Texts as windows: distinct words with their hashed inputs, and word numbers by window and place (pad: the last)."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        put = number.setdefault
        rows = [np.array([put(w, len(number)) for w in _WORD((t or "").lower())], np.int32) for t in texts]
        self.vocabulary = list(number)
        self._inputs()
        pad = len(number)
        starts = [self._starts(len(r)) for r in rows]
        self.owner = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
        self.windows = np.full((len(self.owner), LENGTH), pad, np.int32)
        k = 0
        for r, at in zip(rows, starts, strict=True):
            if len(r) >= LENGTH:
                self.windows[k : k + len(at)] = r[at[:, None] + np.arange(LENGTH)]
            elif len(r):
                self.windows[k, : len(r)] = r
            k += len(at)

    @staticmethod
    def _starts(n: int) -> np.ndarray:
        """Windows every STRIDE words, the last one ending with the text."""
        if n <= LENGTH:
            return np.zeros(min(n, 1), np.int64)
        return np.append(np.arange(0, n - LENGTH, STRIDE), n - LENGTH)

    def _inputs(self) -> None:
        """For each word a bucket of whole words; for each of its trigrams (its ends are marked) a bucket of trigrams."""
        data = np.frombuffer(("^" + "^".join(self.vocabulary) + "^").encode() if self.vocabulary else b"", np.uint8).astype(np.uint32)
        self.word = np.zeros(len(self.vocabulary), np.int64)
        self.gram = self.first = np.zeros(0, np.int64)
        if not len(data):
            return
        code = data[:-2] * np.uint32(0x01000193) ^ data[1:-1] * np.uint32(0x9E3779B1) ^ data[2:] * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(15)
        marks = np.flatnonzero(data == ord("^"))
        # a trigram with a mark in the middle lies across two words; a word of one letter has one trigram
        inside = data[1:-1] != ord("^")
        self.gram = (code * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)[inside]
        assert GRAMS == 1 << 14
        self.first = np.concatenate([[0], np.cumsum(np.diff(marks) - 1)[:-1]])
        scale = np.cumprod(np.full(256, 0x01000193, np.uint32), dtype=np.uint32)
        place = np.arange(len(data)) - np.repeat(marks, np.diff(np.append(marks, len(data))))
        h = np.add.reduceat(data * scale[place % 256], marks[:-1], dtype=np.uint32) if len(marks) > 1 else np.zeros(0, np.uint32)
        h ^= h >> np.uint32(15)
        self.word = (h * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.gram)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": draw(WORDS, D) * np.float32(0.1), "gram": draw(GRAMS, D) * np.float32(0.1)}
        for way in "fb":
            self.p |= {f"w{way}": draw(2 * D, 3 * H), f"c{way}": np.zeros(3 * H, np.float32), f"u{way}": draw(H, 3 * H)}
        self.p |= {"att": draw(2 * H, H), "att0": np.zeros(H, np.float32), "pick": draw(H), "out": draw(2 * H), "out0": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def embed(self, b: Batch) -> np.ndarray:
        """[word, 2 D] of a batch's distinct words."""
        if not b.vocabulary:
            return np.zeros((0, 2 * D), np.float32)
        grams = np.add.reduceat(self.p["gram"][b.gram], b.first, axis=0) / b.sizes()[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][b.word], grams], axis=1)

    def forward(self, e: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """A logit for each window. keep: gets what backward needs."""
        p, (n, length), pad = self.p, windows.shape, len(e)
        real = windows != pad
        states = np.empty((length, n, 2 * H), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for way, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            x = np.concatenate([e @ p[f"w{way}"] + p[f"c{way}"], np.zeros((1, 3 * H), np.float32)])
            h = np.zeros((n, H), np.float32)
            for t in range(length) if way == "f" else range(length - 1, -1, -1):
                g, hu = x[windows[:, t]], h @ p[f"u{way}"]
                zr = _sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
                new = c + z * (h - c)
                if not real[:, t].all():
                    new = np.where(real[:, t, None], new, h)
                if keep is not None:
                    trace[way].append((t, h, z, r, c, hu[:, 2 * H :]))
                states[t, :, part] = h = new
        a = np.tanh(states @ p["att"] + p["att0"])
        s = np.where(real.T, a @ p["pick"], np.float32(-30))
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        if keep is not None:
            keep += [states, a, w, pooled, trace, real]
        return pooled @ p["out"] + p["out0"][0]

    def backward(self, b: Batch, e: np.ndarray, windows: np.ndarray, target: np.ndarray, rate: float) -> float:
        """One step of Adam on the logistic loss; gives the loss."""
        p, kept, g = self.p, [], {}
        logit = self.forward(e, windows, kept)
        states, a, w, pooled, trace, real = kept
        prob = _sigmoid(logit)
        d = ((prob - target) / len(target)).astype(np.float32)
        g["out"], g["out0"] = d @ pooled, d.sum(keepdims=True)
        dpool = d[:, None] * p["out"]
        ds = w[:, :, None] * dpool
        dw = np.einsum("nh,tnh->tn", dpool, states)
        dscore = w * (dw - (w * dw).sum(axis=0)) * real.T
        g["pick"] = np.einsum("tn,tnh->h", dscore, a)
        da = dscore[:, :, None] * p["pick"] * (1 - a * a)
        g["att"], g["att0"] = np.einsum("tnh,tnk->hk", states, da), da.sum(axis=(0, 1))
        ds = ds + da @ p["att"].T
        de = np.zeros((len(e) + 1, 2 * D), np.float32)
        for way, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            u, dh = p[f"u{way}"], np.zeros((len(windows), H), np.float32)
            dx, du = np.zeros((len(e) + 1, 3 * H), np.float32), np.zeros_like(u)
            for t, h, z, r, c, hn in reversed(trace[way]):
                dh = dh + ds[t, :, part]
                on = real[:, t, None]
                dnew = np.where(on, dh, 0)
                dz = dnew * (h - c) * z * (1 - z)
                dc = dnew * (1 - z) * (1 - c * c)
                dr = dc * hn * r * (1 - r)
                gate = np.concatenate([dz, dr, dc], axis=1)
                back = np.concatenate([dz, dr, dc * r], axis=1)
                du += h.T @ back
                np.add.at(dx, windows[:, t], gate)
                dh = np.where(on, dnew * z + back @ u.T, dh)
            g[f"u{way}"], g[f"c{way}"], g[f"w{way}"] = du, dx[:-1].sum(axis=0), e.T @ dx[:-1]
            de[:-1] += dx[:-1] @ p[f"w{way}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], b.word, de[:-1, :D])
        np.add.at(g["gram"], b.gram, np.repeat(de[:-1, D:] / b.sizes()[:, None].astype(np.float32), b.sizes(), axis=0))
        self.steps += 1
        for k, v in g.items():
            m, s = self.m[k]
            m *= 0.9
            m += 0.1 * v
            s *= 0.99
            s += 0.01 * v * v
            p[k] -= np.float32(rate) * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)
        return float(-np.log(np.maximum(1e-7, np.where(target > 0, prob, 1 - prob))).mean())

    def logits(self, b: Batch, block: int = 2048) -> np.ndarray:
        e = self.embed(b)
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(e, b.windows[k : k + block]) for k in range(0, len(b.windows), block))])

    def worst(self, b: Batch, texts: int) -> np.ndarray:
        """The highest logit of each text; -20 for one without words."""
        out = np.full(texts, -20, np.float32)
        np.maximum.at(out, b.owner, self.logits(b))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        s = self.worst(Batch(texts), len(texts)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -40, 40)))


def fit(texts: list[str], label: np.ndarray, rounds: int = 3, epochs: int = 3, seed: int = 9) -> Network:
    """Trains on labelled texts; rounds choose anew the windows that stand for a text."""
    net, rng = Network(), np.random.default_rng(seed)
    if not len(label) or label.min() == label.max():
        net.slope, net.shift = 0.0, -2.0
        return net
    b = Batch(texts)
    # The start: in how many toxic and other texts a trigram occurs, as log-odds in one dimension.
    seen = np.zeros((2, GRAMS))
    grams = np.split(b.gram, b.first[1:])
    for k in range(len(texts)):
        words = np.unique(b.windows[b.owner == k]) if len(texts) < 200 else np.unique(b.windows[np.searchsorted(b.owner, k) : np.searchsorted(b.owner, k + 1)])
        words = words[words < len(b.vocabulary)]
        if len(words):
            seen[label[k], np.unique(np.concatenate([grams[w] for w in words]))] += 1
    odds = np.log((seen[1] + 0.5) / (1 + (label == 1).sum())) - np.log((seen[0] + 0.5) / (1 + (label == 0).sum()))
    odds[seen[1] < 3] = np.minimum(odds[seen[1] < 3], 0)
    net.p["gram"][:, 0] = odds / 3
    word = np.append(np.add.reduceat(odds[b.gram], b.first) / b.sizes(), -9)
    look = np.sort(word[b.windows], axis=1)[:, -2:].sum(axis=1)
    for turn in range(rounds):
        chosen = []
        for k in range(len(texts)):
            lo, hi = np.searchsorted(b.owner, [k, k + 1])
            if hi > lo:
                worst = lo + np.argsort(-look[lo:hi], kind="stable")
                some = rng.integers(lo, hi, 2)
                chosen.append(worst[:1] if label[k] else np.unique(np.append(worst[:2], some)))
        chosen = np.concatenate(chosen)
        target = label[b.owner[chosen]].astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for i in range(0, len(order), 256):
                at = chosen[order[i : i + 256]]
                part, windows = _part(b, b.windows[at])
                net.backward(part, net.embed(part), windows, target[order[i : i + 256]], 0.01 if turn < rounds - 1 else 0.004)
        look = net.logits(b)
    worst = net.worst(b, len(texts)).astype(np.float64)
    net.slope, net.shift = _calibrate(worst, label)
    return net


def _part(b: Batch, windows: np.ndarray) -> tuple[Batch, np.ndarray]:
    """The words that some windows use, as a batch of their own, and the windows in its numbers."""
    part = Batch.__new__(Batch)
    used, at = np.unique(windows, return_inverse=True)
    pad = used[-1] == len(b.vocabulary)
    words = used[:-1] if pad else used
    part.vocabulary = [b.vocabulary[w] for w in words]
    part._inputs()
    return part, at.reshape(windows.shape).astype(np.int32)


def _calibrate(s: np.ndarray, label: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the documents' worst logits."""
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -40, 40)))
        w = p * (1 - p) + 1e-4
        g = np.array([((p - label) * s).mean() + 1e-3 * (slope - 1), (p - label).mean()])
        hess = np.array([[(w * s * s).mean() + 1e-3, (w * s).mean()], [(w * s).mean(), w.mean() + 1e-6]])
        slope, shift = np.array([slope, shift]) - 0.5 * np.linalg.solve(hess, g)
    return float(max(slope, 0.1)), float(shift)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, text: str = "text", doc_id: str = "doc_id") -> Network:
    """Learns from up to per_label labelled documents of either label, none of them held out (crc32 of the id mod 4 is 2)."""
    rows = labelled_sample(docs, labels, "toxic", remainder(doc_id, 4) != 2, per_label, text, doc_id).collect()
    rows = sorted((r.text or "", r.label) for r in rows)
    return fit([t for t, _ in rows], np.array([y for _, y in rows], np.int64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_label: int = 1500, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds score: 0 to 1, higher for texts with a window like those that make documents toxic.

    Only text is an input; all windows of whole texts are scored. Null and empty texts have a score
    near 0. Without both labels in the sample every score is the same, 0.12. Other columns stay; a
    column named score is replaced.
    """
    net = train(docs, labels, per_label, text, doc_id)
    net.m = {}
    return score(docs, lambda: net.scores, text)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return judged(toxicity_scores(docs, table(spark, sf_dir, "labels")), 4, 2, 0.3)
