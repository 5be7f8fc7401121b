"""Language identification by a convolutional network over bytes.

A text, in lower case, is cut into windows of a fixed number of bytes. Each byte has a learned vector;
filters of several widths slide over the window, the largest response of each filter is kept, and a softmax
layer turns these into language probabilities. A text's probabilities are the mean over all its windows,
weighted by their letters. The network is trained in numpy on labelled text. When it is applied, the products
of byte vectors and filters are looked up in tables by pairs of bytes, which gives the same responses.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMS = 8
#: Training documents of each language, at most about so many, and windows taken of each.
SAMPLE = 1200
WINDOWS_EACH = 2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]").search


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows of all texts, zeros at the end of the last one, and the text each belongs to."""
    raw = [t.lower().encode() for t in texts]
    count = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    flat = b"".join(r.ljust(c * WINDOW, b"\0") for r, c in zip(raw, count, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), count)


@dataclass
class Network:
    """Byte vectors, one filter bank per width, biases, and the softmax layer over ``names``."""

    names: list[str]
    vectors: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, names: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        return cls(
            names, draw(256, DIMS, scale=0.5), [draw(w * DIMS, FILTERS, scale=(2 / (w * DIMS)) ** 0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(FILTERS * len(WIDTHS), len(names), scale=0.15),
            np.zeros(len(names), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.banks, *self.biases, self.out, self.out_bias]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per width: responses of a pair of bytes at the filter's start, and of the pair or byte after it."""
        out = []
        for width, bank in zip(WIDTHS, self.banks, strict=True):
            one = [self.vectors @ bank[k * DIMS : (k + 1) * DIMS] for k in range(width)]
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            out.append((pair(one[0], one[1]), None if width == 2 else one[2] if width == 3 else pair(one[2], one[3])))
        return out

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Softmax over languages for a batch of windows."""
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        kept = []
        for width, bias, (first, second) in zip(WIDTHS, self.biases, tables, strict=True):
            n = WINDOW - width + 1
            r = first[pairs[:, :n]]
            if width == 3:
                r += second[x[:, 2:]]
            elif width == 4:
                r += second[pairs[:, 2:]]
            kept.append(np.maximum(r.max(axis=1) + bias, 0))
        z = np.concatenate(kept, axis=1) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of ``parameters``."""
        n = len(x)
        seen = self.vectors[x]
        cols, args, kept = [], [], []
        for width, bank, bias in zip(WIDTHS, self.banks, self.biases, strict=True):
            c = np.lib.stride_tricks.sliding_window_view(seen, width, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, width * DIMS)
            r = c @ bank
            at = r.argmax(axis=1)
            cols.append(c)
            args.append(at)
            kept.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + bias)
        top = np.concatenate(kept, axis=1)
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (top > 0)
        g_vectors, g_banks, g_biases = np.zeros_like(self.vectors), [], []
        rows = np.arange(n)[:, None]
        for k, (width, bank) in enumerate(zip(WIDTHS, self.banks, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            picked = cols[k][rows, args[k]]  # the patch each filter chose
            g_banks.append(np.einsum("nfd,nf->df", picked, g))
            g_biases.append(g.sum(axis=0))
            patch = np.einsum("nf,df->nfd", g, bank).reshape(n, FILTERS, width, DIMS)
            for j in range(width):
                np.add.at(g_vectors, x[rows, args[k] + j].ravel(), patch[:, :, j].reshape(-1, DIMS))
        return [g_vectors, *g_banks, *g_biases, hidden.T @ p, p.sum(axis=0)]


def fit(x: np.ndarray, langs: list[str], epochs: int = 3, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on windows and their languages; with fewer than two languages there is nothing to learn."""
    names = sorted(set(langs))
    net = Network.new(names, seed)
    if len(names) < 2:
        return net
    rng = np.random.default_rng(seed)
    place = {n: k for k, n in enumerate(names)}
    y = np.array([place[v] for v in langs])
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in net.parameters()]
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            step += 1
            pick = order[i : i + batch]
            now = rate * (1 - step / (total + 1))
            for v, g, (m1, m2) in zip(net.parameters(), net.gradients(x[pick], y[pick]), state, strict=True):
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.999
                m2 += 0.001 * g * g
                v -= (now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network:
    """Fit on a bounded sample of each language, chosen by a hash; held-out rows and null languages never count.

    Of each sampled text some windows, from anywhere in it, reach the driver.
    """
    rows = docs.filter(~held_out(key)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("id"))
    rows = rows.filter("text is not null and lang is not null and id is not null")
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for v, n in have.items():
        share = F.when(F.col("lang") == v, min(1.0, sample / n)).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(13), "id"), 11).cast("double") / F.lit(float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, v, k in zip(*[b.column(c).to_pylist() for c in ("text", "lang", "id")], strict=True):
                x, _ = windows([t])
                pick = np.random.default_rng(zlib.crc32(k.encode())).permutation(len(x))[:WINDOWS_EACH]
                out += [(v, k, x[i].tobytes()) for i in pick]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "id", "x"])

    got = rows.filter(draw < share).mapInArrow(run, "lang string, id string, x binary").collect()
    got.sort(key=lambda r: (r.lang, r.id, r.x))
    x = np.frombuffer(b"".join(r.x for r in got), np.uint8).reshape(-1, WINDOW)
    return fit(x, [r.lang for r in got])


def predict(docs: DataFrame, net: Network, text: str = "text", batch: int = 256) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the mean probability of that language over the whole text.

    A null text, or one without a letter, is ``und`` with score 0. Only the text enters. Columns of these
    names in ``docs`` are replaced. No rows move; memory holds a few texts' windows, a batch at a time.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(text)]
            total, weight = np.zeros((len(texts), len(net.names))), np.zeros(len(texts))
            i = 0
            while i < len(texts) and net.names:
                j, size = i + 1, len(texts[i])
                while j < len(texts) and size + len(texts[j]) < batch * WINDOW * 4:
                    size += len(texts[j])
                    j += 1
                x, of = windows(texts[i:j])
                for k in range(0, len(x), batch):
                    part = x[k : k + batch]
                    letters = (((part >= 97) & (part <= 122)) | (part >= 128)).sum(axis=1) + 1e-3
                    p = net.probabilities(part, tables) * letters[:, None]
                    np.add.at(total, i + of[k : k + batch], p)
                    np.add.at(weight, i + of[k : k + batch], letters)
                i = j
            mean = total / np.maximum(weight, 1e-9)[:, None]
            named = [bool(net.names) and _LETTER(t) is not None for t in texts]
            best = mean.argmax(axis=1) if net.names else np.zeros(len(texts), int)
            lang = [net.names[k] if ok else UNKNOWN for k, ok in zip(best, named, strict=True)]
            score = [float(min(m[k], 1.0)) if ok else 0.0 for m, k, ok in zip(mean, best, named, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"]
            )

    return docs.select(kept).mapInArrow(run, schema)
