"""Quality scores by Bradley-Terry ranking of preference pairs.

A document labelled good is preferred to one labelled bad. The model is a score, linear in features of the
text; the chance of a preference is the logistic function of the score difference, so the loss is the
logistic loss on feature differences. Every labelled row is in a pair: rows are dealt to groups by a hash, and within
a group each row of the more frequent label meets rows of the other. Newton steps add up the pairs' sums in tasks. The
threshold comes from exact counts of all training scores in bins, and scores are
shifted so that it becomes the given cut on the 0 to 1 scale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import held_out
from trialweave.llm.words import slices

#: Labelled rows of a group, rows of the rarer label in it (at least about so many, if need be as copies), rows of it that each other meets.
GROUP, RARE, MEETS = 50_000, 64, 2
#: Bins that training scores are counted in.
BINS = 1 << 14
CUT = 0.7
WINDOW = 32
_SYMBOLS = b"!#$%&*|<>{}[]\\^~_=+@/"
_STOPS = b".,;:?'\"-()"

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "newline", "other_space", "high",
    "upper_words", "symbol_words", "digit_words", "long_words", "short_words", "same_words", "near_words", "distinct",
    "most_upper", "most_symbol", "most_same", "most_near", "capital",
)


def _class_table() -> np.ndarray:
    """Rows of byte classes: letters, upper, digit, symbol, stop, newline, other space, high."""
    t = np.zeros((8, 256), np.uint8)
    t[0, 65:91] = t[0, 97:123] = t[0, 128:] = 1
    t[1, 65:91] = 1
    t[2, 48:58] = 1
    t[3, list(_SYMBOLS)] = 1
    t[4, list(_STOPS)] = 1
    t[5, 10] = 1
    t[6, [9, 11, 12, 13]] = 1
    t[7, 128:] = 1
    return t


_CLASSES = _class_table()


def features(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text; null and empty texts have all zeros."""
    out = np.zeros((len(column), len(NAMES)))
    for i, j, w in slices(column):
        m = j - i
        offsets = w.texts
        n_words = np.diff(offsets)
        has = n_words > 0
        if not len(w.starts):
            continue
        doc = np.repeat(np.arange(m), n_words)
        each = np.maximum(n_words, 1)
        length = w.ends - w.starts
        bytes_ = np.bincount(doc, length, m)
        counts = {}
        for k, name in enumerate(("letter", "upper", "digit", "symbol", "stop", "newline", "space", "high")):
            total = np.zeros(len(w.data) + 1, np.int64)
            np.cumsum(_CLASSES[k][w.data], out=total[1:], dtype=np.int64)
            if name in ("newline", "space"):
                first = np.minimum(w.starts[np.minimum(offsets[:-1], len(w.starts) - 1)], len(w.data))
                last = w.ends[np.maximum(offsets[1:] - 1, 0)]
                counts[name] = np.where(has, total[last] - total[first], 0)
            else:
                counts[name] = total[w.ends] - total[w.starts]
        per_doc = lambda x: np.bincount(doc, x, m)
        upper_word = (counts["upper"] >= 2) & (2 * counts["upper"] > counts["letter"])
        symbol_word = counts["symbol"] > 0
        h = w.hashes(lower=True)
        same = np.zeros(len(h), bool)
        near = np.zeros(len(h), bool)
        for back in (1, 2, 3, 4):
            hit = np.zeros(len(h), bool)
            hit[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
            near |= hit
            if back == 1:
                same = hit
        order = np.lexsort((h, doc))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order], fresh, m)
        # Words in runs of WINDOW: the run that has most of a trait, so a bad part of a long text counts.
        nth = np.arange(len(h)) - offsets[doc]
        run = np.flatnonzero((nth % WINDOW == 0))
        run_doc, run_size = doc[run], np.diff(np.append(run, len(h)))

        def most(flag: np.ndarray) -> np.ndarray:
            share = np.add.reduceat(flag.astype(float), run) / np.maximum(run_size, WINDOW // 2)
            best = np.zeros(m)
            np.maximum.at(best, run_doc, share)
            return best

        total = np.maximum(bytes_, 1)
        cols = [
            np.log1p(bytes_), np.log1p(n_words), bytes_ / each / 10,
            *[per_doc(counts[c]) / total for c in ("upper", "digit", "symbol", "stop")],
            counts["newline"] / each, counts["space"] / each, per_doc(counts["high"]) / total,
            per_doc(upper_word) / each, per_doc(symbol_word) / each, per_doc(counts["digit"] > 0) / each,
            per_doc(length > 20) / each, per_doc(length < 3) / each, per_doc(same) / each, per_doc(near) / each,
            np.log1p(distinct) / np.log1p(np.maximum(n_words, 1)),
            most(upper_word), most(symbol_word), most(same), most(near), per_doc(counts["upper"] == 1) / each,
        ]
        out[i:j] = np.where(has[:, None], np.column_stack(cols), 0)
    return out


@dataclass(frozen=True)
class Model:
    """Weights on standardised features, and the shift and scale of the 0 to 1 score."""

    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray
    threshold: float
    scale: float
    cut: float = CUT

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.threshold) / self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pairs(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Differences of good and bad rows; each row of the longer side meets ``MEETS`` of the other, and all rows take part."""
    n = max(len(good), len(bad)) if len(good) and len(bad) else 0
    at = np.arange(n)
    return np.concatenate([good[at % max(len(good), 1)] - bad[(at + r) % max(len(bad), 1)] for r in range(MEETS)])


def _standard(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / sd, -8, 8)


def _scale(n: float, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = total / n
    sd = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return mean, np.where(sd > 1e-6, sd, 1.0)


def _preferences(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, log-likelihood, score and information."""
    z = d @ w
    miss = 1 / (1 + np.exp(np.clip(z, -500, 500)))
    return np.concatenate([[len(d), -np.logaddexp(0, -z).sum()], miss @ d, ((d * (miss * (1 - miss))[:, None]).T @ d).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], d: int, ridge: float, passes: int = 40, tol: float = 1e-7) -> np.ndarray:
    """Weights of the largest mean log-likelihood - ridge / 2 * |w|^2; ``sums(w)`` adds up :func:`_preferences`."""
    w, best = np.zeros(d), None
    for _ in range(passes):
        s = sums(w)
        n, value = s[0], s[1] / s[0] - ridge / 2 * w @ w
        if best is not None and value < best[0] - 1e-12:
            w = (best[1] + w) / 2  # overshoot: go half way back
            continue
        best = value, w
        step = np.linalg.solve(s[2 + d :].reshape(d, d) / n + ridge * np.eye(d), s[2 : 2 + d] / n - ridge * w)
        w = w + step
        if np.abs(step).max() <= tol:
            break
    return np.round(w, 7)  # whatever order sums were added up in


def _threshold(low: float, high: float, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """The bin edge that separates the labels best, and the scale, from counts of scores in ``BINS`` between two ends."""
    edges = np.linspace(low, high, BINS + 1)
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    error = lost + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    # Equally good edges: the middle of the gap between the labels.
    threshold = edges[best[len(best) // 2]]
    middle = [edges[np.searchsorted(np.cumsum(c), c.sum() / 2)] for c in (good, bad)]
    return float(threshold), float(max(middle[0] - middle[1], 1e-6) / 8)


def _binned(s: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(((s - low) / max(high - low, 1e-12) * BINS).astype(np.int64), 0, BINS - 1)


def _one_label(d: int, good: float, bad: float, cut: float) -> Model:
    """With one label only there are no pairs: all weights are 0 and every text scores the cut or, if all are bad, less."""
    return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if good or not bad else 1.0, 1.0, cut)


def fit(x: np.ndarray, y: np.ndarray, cut: float = CUT, ridge: float = 1e-4) -> Model:
    """The model of :func:`train` for rows at hand."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return _one_label(x.shape[1], len(good), len(bad), cut)
    mean, sd = _scale(len(x), x.sum(axis=0), (x**2).sum(axis=0))
    d = _pairs(_standard(good, mean, sd), _standard(bad, mean, sd))
    w = _newton(lambda at: _preferences(d, at), x.shape[1], ridge)
    s = _standard(x, mean, sd) @ w
    counts = [np.bincount(_binned(s[y == v], s.min(), s.max()), minlength=BINS) for v in (1, 0)]
    return Model(mean, sd, w, *_threshold(s.min(), s.max(), *counts), cut)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``k, x, y``: features and label of every training row.

    Rows with several labels count only if they agree; null keys, texts and labels are left out. Texts stay where they
    are: labels meet the features.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key)
    known = known.agg(F.min(label).alias("y"), F.max(label).alias("__other")).filter("y = __other")
    known = known.select(F.col(key).cast("long").alias("k"), F.col("y").cast("int").alias("y"))
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(F.col(key).cast("long").alias("k"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), _lists(features(b.column("__text")))], names=["k", "x"])

    return rows.mapInArrow(run, "k long, x array<double>").join(known, "k")


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array of one length over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                total = part(b) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([_lists(total[None, :])], names=["sums"])

    return rows.mapInArrow(run, "sums array<double>").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums")).first().sums.toArray()


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", cut: float = CUT, ridge: float = 1e-4) -> Model:
    """Learn from all labelled rows that are not held out. The driver sees sums of the size of the features, and bins."""
    d = len(NAMES)
    rows = labelled(docs, labels, key, text, label).persist(StorageLevel.MEMORY_AND_DISK)
    have = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = have.get(1, 0), have.get(0, 0)
    if not good or not bad:
        rows.unpersist()
        return _one_label(d, good, bad, cut)
    sums = _summed(rows.select("x"), lambda b: (lambda x: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)]))(_matrix(b.column("x"))))
    mean, sd = _scale(good + bad, sums[:d], sums[d:])

    groups = -(-(good + bad) // GROUP)
    rare, copies = int(good < bad), -(-RARE * groups // min(good, bad))
    times = F.when(F.col("y") == rare, copies).otherwise(1)
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64(F.lit(11), "k", "copy"), F.lit(groups)))

    def pair(t: pa.Table) -> pa.Table:
        x, y = _standard(_matrix(t.column("x")), mean, sd), t.column("y").to_numpy()
        # In the order of a hash, then of the features: whatever order rows came in.
        order = np.lexsort((*x.T, t.column("copy").to_numpy(), t.column("place").to_numpy()))
        x, y = x[order], y[order]
        return pa.table({"x": _lists(_pairs(x[y == 1], x[y == 0]))})

    dealt = dealt.withColumn("place", F.xxhash64(F.lit(12), "k"))
    pairs = dealt.groupBy("group").applyInArrow(pair, "x array<double>").persist(StorageLevel.MEMORY_AND_DISK)
    w = _newton(lambda at: _summed(pairs, lambda b: _preferences(_matrix(b.column("x")), at)), d, ridge)
    pairs.unpersist()

    raw = lambda b: _standard(_matrix(b.column("x")), mean, sd) @ w

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = raw(b)
                yield pa.RecordBatch.from_arrays([pa.array([s.min()]), pa.array([s.max()])], names=["low", "high"])

    found = rows.select("x").mapInArrow(ends, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    low, high = found.low, found.high

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BINS, np.int64)
        for b in batches:
            total += np.bincount(_binned(raw(b), low, high) + BINS * b.column("y").to_numpy(), minlength=2 * BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    counts = rows.select("x", "y").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    rows.unpersist()
    every = np.zeros(2 * BINS)
    every[counts.column("bin").to_numpy()] = counts.column("n").to_numpy()
    return Model(mean, sd, w, *_threshold(low, high, every[BINS:], every[:BINS]), cut)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the model's cut upwards).

    Null and empty texts get the score of a text without any trait. Nothing but the text enters the score. Columns
    of these names in ``docs`` are replaced. No rows move between tasks; the model is a few numbers.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(b.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(s), pa.array((s >= model.cut).astype(np.int32))],
                names=[*kept, "score", "predicted"],
            )

    return docs.select(kept).mapInArrow(run, schema)
