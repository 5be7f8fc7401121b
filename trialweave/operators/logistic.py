"""Many ridge logistic models over one table, fitted together.

The estimation stage needs dozens of small models (one propensity model, and three nuisance
models per fold, for every imputed data set) over the same rows. Fitting them one by one
means hundreds of passes; here every Newton pass reads the table once and sums score vector
and information matrix of all models. Spark partitions the rows and adds the partial
sums; the driver solves systems of the size of the feature list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


EVERY_GROUP = 0  # rows of this group number train the models of all groups


@dataclass(frozen=True)
class Task:
    """One model per group: a 0/1 (or class-number) target on the rows where ``rows`` holds."""

    name: str
    target: Column
    rows: Column
    classes: int = 2


@dataclass
class Fit:
    coef: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)  # (classes-1, p+1), intercept last
    cov: dict[tuple[int, str], np.ndarray] = field(default_factory=dict)
    status: dict[tuple[int, str], str] = field(default_factory=dict)
    passes: int = 0


def _softmax(eta: np.ndarray) -> np.ndarray:
    """Probabilities of classes 1.. against reference class 0."""
    top = np.maximum(eta.max(axis=1), 0.0)
    e = np.exp(eta - top[:, None])
    return e / (np.exp(-top) + e.sum(axis=1))[:, None]


def _partial_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """n, log-likelihood, score and information (upper blocks in full) of one batch."""
    if weight is not None:  # few rows: one by one
        return sum(w * _partial_sums(x[i : i + 1], y[i : i + 1], beta) for i, w in enumerate(weight))
    k = beta.shape[0]
    eta = x @ beta.T
    p = _softmax(eta)
    hot = (y[:, None] == np.arange(1, k + 1)[None, :]).astype(float)
    top = np.maximum(eta.max(axis=1), 0.0)
    loglik = (hot * eta).sum() - (top + np.log(np.exp(-top) + np.exp(eta - top[:, None]).sum(axis=1))).sum()
    score = (hot - p).T @ x
    half = {(a, b): (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x for a in range(k) for b in range(a, k)}
    info = [half[min(a, b), max(a, b)] for a in range(k) for b in range(k)]  # each block is symmetric
    counts = np.array([(y == c).sum() for c in range(k + 1)], dtype=float)
    return np.concatenate([counts, [loglik], score.ravel(), np.concatenate([i.ravel() for i in info])])


def model_rows(df: DataFrame, x: str, tasks: list[Task], group: str) -> DataFrame:
    """The narrow table every pass reads: group, feature array, one class number per task."""
    code = [F.when(t.rows, t.target.cast("int")).otherwise(F.lit(-1)).cast("int") for t in tasks]
    return df.select(F.col(group).cast("int").alias("group"), F.col(x).alias("x"), F.array(*code).alias("y"))


def fit(
    rows: DataFrame,
    tasks: list[Task],
    p: int,
    penalty: dict[tuple[int, str], np.ndarray] | float,
    groups: list[int],
    max_passes: int = 40,
    tol: float = 1e-7,
    read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None,
    start: dict[tuple[int, str], np.ndarray] | None = None,
    pseudo: dict[tuple[int, str], tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None,
) -> Fit:
    """Maximise log-likelihood - 1/2 sum(penalty * b^2), intercept free, for all models.

    ``rows`` comes from :func:`model_rows` and should be persisted; ``read`` takes group, feature and class arrays from
    other batches, or gives one such triple after the other, features with a 1 at the end. ``pseudo`` are weighted rows (features, classes, weights) that count like read ones, ``start``
    the coefficients to begin with.
    """
    keys = [(g, i) for g in groups for i in range(len(tasks))]
    pen = {}
    for g, i in keys:
        v = penalty if isinstance(penalty, float) else penalty[(g, tasks[i].name)]
        pen[(g, i)] = np.append(np.broadcast_to(v, (p,)), 0.0)
    zero = {(g, i): np.zeros((tasks[i].classes - 1, p + 1)) for g, i in keys}
    beta = {(g, i): (start or {}).get((g, tasks[i].name), zero[(g, i)]) for g, i in keys}
    best: dict = {}
    result = Fit()
    active = dict(beta)
    while active and result.passes < max_passes:
        result.passes += 1
        sums = _pass(rows, active, p, read)
        nxt = {}
        for key, b in active.items():
            g, i = key
            name = (g, tasks[i].name)
            k = b.shape[0]
            s = sums.get(key)
            if pseudo and name in pseudo:
                px, py, pw = pseudo[name]
                if len(pw):
                    s = (0 if s is None else s) + _partial_sums(np.column_stack([px, np.ones(len(px))]), py, b, pw)
            counts = s[: k + 1] if s is not None else np.zeros(k + 1)
            if s is None or (counts > 0).sum() < 2:
                result.coef[name], result.status[name] = np.full((k, p + 1), np.nan), "single class"
                continue
            value = s[k + 1] - 0.5 * float((pen[key] * b * b).sum())
            if key in best and value < best[key][0] - 1e-10 * abs(best[key][0]):
                nxt[key] = (best[key][1] + b) / 2  # overshoot: go half way back
                continue
            best[key] = (value, b)
            d = k * (p + 1)
            score = s[k + 2 : k + 2 + d] - (b * pen[key]).ravel()
            blocks = s[k + 2 + d :].reshape(k, k, p + 1, p + 1)
            info = blocks.transpose(0, 2, 1, 3).reshape(d, d) + np.diag(np.tile(pen[key], k))
            step = np.linalg.lstsq(info, score, rcond=None)[0].reshape(b.shape)
            result.coef[name], result.status[name] = b + step, "ok"
            result.cov[name] = np.linalg.pinv(info)
            if np.abs(step).max() > tol:
                nxt[key] = b + step
        active = nxt
    for key in active:
        result.status[(key[0], tasks[key[1]].name)] = "not converged"
    return result


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return batch.column("group").to_numpy(), x, batch.column("y").flatten().to_numpy().reshape(n, -1)


def _pass(rows: DataFrame, beta: dict[tuple[int, int], np.ndarray], p: int, read: Callable | None = None) -> dict[tuple[int, int], np.ndarray]:
    """One read of the table: summed statistics of every model still moving."""
    read = read or _read

    def partials(batches):
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if isinstance(arrays := read(batch), tuple):
                group, x, y = arrays
                arrays = [(group, np.column_stack([x, np.ones(len(x))]), y)]
            for group, x, y in arrays:
                for (g, i), b in beta.items():
                    use = ((group == g) | (group == EVERY_GROUP)) & (y[:, i] >= 0)
                    if use.any():
                        part = _partial_sums(x, y[:, i], b) if use.all() else _partial_sums(x[use], y[use, i], b)
                        total[(g, i)] = total[(g, i)] + part if (g, i) in total else part
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in total], pa.int32()),
                    pa.array([k[1] for k in total], pa.int32()),
                    pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64())),
                ],
                names=["group", "task", "sums"],
            )

    parts = rows.mapInArrow(partials, "group int, task int, sums array<double>")
    out = parts.groupBy("group", "task").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"))
    return {(r.group, r.task): r.sums.toArray() for r in out.collect()}


def dot(x: str, coef: str, p: int) -> Column:
    """Linear predictor of a feature array and a coefficient array with the intercept last."""
    # A loop: a term for each feature would be more code than the JVM compiles.
    return F.expr(f"aggregate(zip_with({x}, slice({coef}, 1, {p}), (v, w) -> v * w), get({coef}, {p}), (s, v) -> s + v)")
