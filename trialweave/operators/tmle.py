"""Cross-fitting folds, fluctuation step and its bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.functions.scalars import clip, expit, hash_long, logit
from trialweave.operators.ordering import numbered

# Clips that decide results.
G_CLIP = 1e-6
Q_CLIP = 1e-8
MIN_ROWS = 10
CHUNK = 2048
#: Rows of a leaf of the tree that draws are split down, and neighbouring leaves (as a power of two) that one task takes.
PER_LEAF, TOGETHER = 256, 6
#: Order up to which a replicate's sums are expanded around the estimate, and the error that may leave, as a share of the
#: replicates' spread.
ORDER, SHARE = 4, 1e-3


def stratified_folds(df: DataFrame, groups: list[str], keys: list[str], treatment: str, folds: int, seed: int) -> DataFrame:
    """Add ``fold``: shuffled by key hash, sizes equal within each arm up to one row."""
    nth = numbered(df, [*groups, treatment], hash_long(seed, *[F.col(k) for k in keys]), "__nth")
    return nth.withColumn("fold", F.pmod(F.col("__nth") - 1, F.lit(folds)).cast("int")).drop("__nth")


def clever_covariate(t: Column, g: Column) -> Column:
    g = clip(g, G_CLIP, 1 - G_CLIP)
    return t / g - (F.lit(1.0) - t) / (F.lit(1.0) - g)


def perturbed(q0: Column, q1: Column, g: Column, t: Column, eps: Column) -> Column:
    """Outcome probability after moving it by ``eps`` along the clever covariate."""
    own = (F.lit(1.0) - t) * logit(clip(q0, Q_CLIP, 1 - Q_CLIP)) + t * logit(clip(q1, Q_CLIP, 1 - Q_CLIP))
    return expit(own + eps * clever_covariate(t, g))


def risk_ratio(df: DataFrame, groups: list[str], eps: Column) -> DataFrame:
    """Mean perturbed probability under treatment over that under control."""
    q = [F.col("q0"), F.col("q1"), F.col("g")]
    r1, r0 = (F.avg(perturbed(*q, F.lit(a), eps)) for a in (1.0, 0.0))
    return df.groupBy(*groups).agg((r1 / r0).alias("rr"))


def with_draws(rows: DataFrame, levels: int, seed: int = 0, per_leaf: int = PER_LEAF) -> DataFrame:
    """``rows`` dealt so that resampling with exactly n draws needs no look beyond a task.

    Row hashes are the leaves of a binary tree of hash ranges of about ``per_leaf`` rows each. For every leaf one row
    (``kind`` 0) comes first: ``nodes`` holds, for every node on the way to the leaf and every trim level, how
    many rows lie below the node and below its left child. That is all that :func:`leaf_counts` needs to split the draws
    of a replicate down to the leaf, the same in whichever task.
    """
    groups = max(1, rows.select("group").distinct().count())
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / groups / per_leaf))))
    leaf = F.shiftrightunsigned("row", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("leaf", leaf)
    below = F.array(*[F.sum((F.col("depth") > j).cast("long")) for j in range(levels)])
    leaves = rows.groupBy("group", "leaf").agg(below.alias("n"))
    up = leaves.select("group", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d"), "leaf", "n").withColumn("place", F.expr(f"shiftright(leaf, {bits} - d)"))
    nodes = up.groupBy("group", "d", "place").agg(F.array(*[F.sum(F.get("n", F.lit(j))) for j in range(levels)]).alias("n"))
    left = nodes.filter("d > 0 and place % 2 = 0").select("group", (F.col("d") - 1).alias("d"), F.expr("shiftright(place, 1)").alias("place"), F.col("n").alias("left"))
    nodes = nodes.join(left, ["group", "d", "place"], "left").withColumn("left", F.coalesce("left", F.array_repeat(F.lit(0).cast("long"), levels)))
    path = up.drop("n").join(nodes, ["group", "d", "place"]).groupBy("group", "leaf").agg(F.array_sort(F.collect_list(F.struct("d", "n", "left"))).alias("p"))
    path = path.select("group", "leaf", F.flatten(F.transform("p", lambda x: F.concat(x["n"], x["left"]))).alias("nodes"))
    columns = ["row", "depth", "t", "y", "g", "q0", "q1"]
    types = dict(rows.dtypes)
    head = path.select("group", "leaf", F.lit(0).alias("kind"), *[F.lit(None).cast(types[c]).alias(c) for c in columns], "nodes")
    body = rows.select("group", "leaf", F.lit(1).alias("kind"), *columns, F.lit(None).cast("array<bigint>").alias("nodes"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = head.unionByName(body).repartition(parts, "group", F.shiftright("leaf", max(0, min(TOGETHER, bits - 5))))
    return dealt.sortWithinPartitions("group", "leaf", "kind", *columns)


def leaf_counts(nodes: np.ndarray, group: int, leaf: int, level: int, replicates: int, seed: int = 0, path: dict | None = None) -> np.ndarray:
    """How often each of a leaf's rows is drawn in each replicate: replicates x rows, at one trim level.

    ``nodes``: depths x (rows below, rows below the left child) x levels. A node's draws are split between its children
    by a binomial number that depends on the node only, and a leaf's fall on its rows evenly. ``path`` holds the splits
    on the way to the leaf before, most of which are those of the next one.
    """
    n, bits = int(nodes[-1, 0, level]), len(nodes) - 1
    if not replicates:
        return np.zeros((0, n), np.int64)
    draws = np.full(replicates, nodes[0, 0, level], np.int64)
    path = {} if path is None else path
    for d in range(bits):
        place = leaf >> (bits - d)
        at, to_left = path.get((level, d), (None, None))
        if at != (group, place):
            total, left = nodes[d, :, level]
            rng = np.random.default_rng([seed, 1, group, level, d, place])
            to_left = rng.binomial(draws, left / total) if total else draws * 0
            path[(level, d)] = (group, place), to_left
        draws = draws - to_left if leaf >> (bits - d - 1) & 1 else to_left
    rng = np.random.default_rng([seed, 2, group, level, leaf])
    picks = rng.integers(0, max(n, 1), int(draws.sum()), dtype=np.uint32) + np.repeat(np.arange(replicates) * n, draws)
    return np.bincount(picks, minlength=n * replicates).reshape(replicates, n)


def _leaves(batches, levels: int):
    """Group, leaf, nodes and rows of every leaf of a task; a leaf's rows come in a row."""
    now, nodes, held = None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(c).to_numpy() for c in ("group", "leaf", "kind")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if tuple(keys[i][:2]) != now:
                if held:
                    yield (*now, nodes, pa.Table.from_batches(held))
                now, held = tuple(int(k) for k in keys[i][:2]), []
            if keys[i][2] == 0:
                nodes = np.array(b.column("nodes")[i].as_py(), np.int64).reshape(-1, 2, levels)
            else:
                held.append(b.slice(i, j - i))
    if held:
        yield (*now, nodes, pa.Table.from_batches(held))


def _logit(q):
    q = np.clip(q, Q_CLIP, 1 - Q_CLIP)
    return np.log(q / (1 - q))


def _expit(x):
    with np.errstate(over="ignore"):
        x = np.exp(-x)
        x += 1
        return np.reciprocal(x, out=x)


def _added(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all tasks, by group and trim level."""
    out = parts.groupBy("group", "level").agg(Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"))
    return {(r.group, r.level): r.sums.toArray() for r in out.collect()}


def _batch(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in total], pa.int32()),
            pa.array([k[1] for k in total], pa.int32()),
            pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64())),
        ],
        names=["group", "level", "sums"],
    )


def _terms(c: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Clipped ``g``, both outcomes' logits, clever covariate, logit of the own arm's outcome, ``y``."""
    g, t = np.clip(c["g"], G_CLIP, 1 - G_CLIP), c["t"]
    l0, l1 = _logit(c["q0"]), _logit(c["q1"])
    return g, l0, l1, t / g - (1 - t) / (1 - g), np.where(t == 1, l1, l0), c["y"]


def _estimate_sums(rows: DataFrame, eps: dict[int, np.ndarray], means: bool, levels: set[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The sums of :func:`_sums` for the estimate alone, which counts each row once, in whatever way rows are dealt."""
    names = ("depth", "t", "y", "g", "q0", "q1")

    def partials(batches):
        total: dict = {}
        for b in batches:
            group = b.column("group").to_numpy()
            every = {n: b.column(n).to_numpy() for n in names}
            for grp in np.unique(group).tolist():
                if grp not in eps:
                    continue
                order = np.flatnonzero(group == grp)
                order = order[np.argsort(-every["depth"][order], kind="stable")]  # a level's rows come first
                depth = every["depth"][order]
                g, l0, l1, h, own, y = _terms({n: every[n][order] for n in names})
                up, down = 1 / g, 1 / (1 - g)
                for j in range(len(eps[grp])):
                    k = int(np.searchsorted(-depth, -j, side="left"))
                    if (grp, j) not in levels or not k:
                        continue
                    e = eps[grp][j][0]
                    if means:
                        a, b_ = _expit(l1[:k] + e * up[:k]).sum(), _expit(l0[:k] - e * down[:k]).sum()
                    else:
                        p = _expit(own[:k] + e * h[:k])
                        a, b_ = h[:k] @ (y[:k] - p), (h[:k] ** 2) @ (p * (1 - p))
                    sums = np.array([a, b_, k])
                    total[(grp, j)] = total[(grp, j)] + sums if (grp, j) in total else sums
        if total:
            yield _batch(total)

    return _added(rows.select("group", *names).mapInArrow(partials, "group int, level int, sums array<double>"))


def _sums(
    rows: DataFrame, eps: dict[int, np.ndarray], replicates: int, means: bool, levels: set[tuple[int, int]], seed: int = 0
) -> dict[tuple[int, int], np.ndarray]:
    """One pass: per group, trim level and replicate the two sums the step needs.

    ``rows`` comes from :func:`with_draws`, if there are replicates. Replicate 0 counts each row once (the point estimate). ``means`` selects
    the sums of both potential outcomes instead of score and information.
    """
    if not replicates:
        return _estimate_sums(rows, eps, means, levels)
    deep = len(next(iter(eps.values()))) if eps else 0

    def partials(batches):
        total, path = {}, {}
        for grp, leaf, nodes, part in _leaves(batches, deep):
            c = {n: part.column(n).to_numpy() for n in ("depth", "t", "y", "g", "q0", "q1")}
            g, l0, l1, h, own, y = _terms(c)
            for j in range(deep):
                rows_ = np.flatnonzero(c["depth"] > j)
                if (grp, j) not in levels or not len(rows_):
                    continue
                e = eps[grp][j][:, None]
                drawn = np.vstack([np.ones((1, len(rows_)), np.int64), leaf_counts(nodes, grp, leaf, j, replicates, seed, path)])
                for first in range(0, len(rows_), CHUNK):
                    k, n = rows_[first : first + CHUNK], drawn[:, first : first + CHUNK].astype(float)
                    if means:
                        a = (n * _expit(l1[k] + e / g[k])).sum(axis=1)
                        b = (n * _expit(l0[k] - e / (1 - g[k]))).sum(axis=1)
                    else:
                        p = _expit(own[k] + e * h[k])
                        np_ = n * p
                        a = n @ (h[k] * y[k]) - np_ @ h[k]
                        p *= np_
                        b = (np_ - p) @ h[k] ** 2
                    sums = np.concatenate([a, b, [len(k)]])
                    total[(grp, j)] = total[(grp, j)] + sums if (grp, j) in total else sums
        if total:
            yield _batch(total)

    return _added(rows.mapInArrow(partials, "group int, level int, sums array<double>"))


def _expanded(a: np.ndarray, by: np.ndarray, first: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Coefficients of ``weight * expit(a + by * x)`` in powers of ``x``, the given constant first, and a bound of the rest.

    No derivative of the logistic function beyond the first exceeds the first, which grows by no more than exp(by * x).
    """
    p = _expit(a)
    s, q = p * (1 - p), 1 - 2 * p
    high = [s, s * q / 2, s * (1 - 6 * s) / 6, s * q * (1 - 12 * s) / 24]
    rest = np.abs(weight) * s * np.abs(by) ** (ORDER + 1) / math.factorial(ORDER + 1)
    return [first, *[weight * c * by**i for i, c in enumerate(high, 1)], rest]


def _replicates(rows: DataFrame, eps: dict[int, np.ndarray], replicates: int, seed: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Roots and log risk ratios of all replicates from one pass, for the groups and levels in which that is exact enough.

    A replicate's root is near the estimate, and ever nearer the more rows there are: its score and both its
    outcome sums are expanded there, so that a row costs a few products a replicate. What the expansions leave out is
    bounded by sums over the same rows; where that is not small beside the spread of the replicates, the level is left out.
    """
    deep = len(next(iter(eps.values()))) if eps else 0
    g_ = clip(F.col("g"), G_CLIP, 1 - G_CLIP)
    farthest = rows.filter("kind = 1").groupBy("group").agg(F.max(F.greatest(F.lit(1.0) / g_, F.lit(1.0) / (F.lit(1.0) - g_))).alias("far"))
    far = {r.group: r.far for r in farthest.collect()}
    width = ORDER + 2

    def partials(batches):
        total, path = {}, {}
        for grp, leaf, nodes, part in _leaves(batches, deep):
            c = {n: part.column(n).to_numpy() for n in ("depth", "t", "y", "g", "q0", "q1")}
            g, l0, l1, h, own, y = _terms(c)
            for j in range(deep):
                k = np.flatnonzero(c["depth"] > j)
                if not len(k):
                    continue
                e, up, down = eps[grp][j][0], 1 / g[k], -1 / (1 - g[k])
                at = own[k] + e * h[k], l1[k] + e * up, l0[k] + e * down
                score = _expanded(at[0], h[k], h[k] * (y[k] - _expit(at[0])), -h[k])
                ones = np.ones(len(k))
                both = [_expanded(a, by, _expit(a), ones) for a, by in zip(at[1:], (up, down), strict=True)]
                n = leaf_counts(nodes, grp, leaf, j, replicates, seed, path).astype(float)
                sums = (n @ np.column_stack([*score, *both[0], *both[1]])).ravel()
                total[(grp, j)] = total[(grp, j)] + sums if (grp, j) in total else sums
        if total:
            yield _batch(total)

    out = {}
    for (g, j), sums in _added(rows.mapInArrow(partials, "group int, level int, sums array<double>")).items():
        sums = sums.reshape(replicates, 3, width).transpose(1, 2, 0)
        step = np.zeros(replicates)
        with np.errstate(all="ignore"):
            for _ in range(50):
                value = sum(sums[0][i] * step**i for i in range(ORDER + 1))
                slope = sum(i * sums[0][i] * step ** (i - 1) for i in range(1, ORDER + 1))
                move = -value / slope
                step = step + move
            risk = [sum(s[i] * step**i for i in range(ORDER + 1)) for s in sums[1:]]
            grown = np.exp(far[g] * np.abs(step)) * np.abs(step) ** (ORDER + 1)
            root_error = sums[0, -1] * grown / np.abs(slope)
            log_rr = np.log(risk[0] / risk[1])
            # What is left out of the sums, and what an error of the root does to them.
            error = sum(s[-1] * grown / r + np.abs(s[1]) / r * root_error for s, r in zip(sums[1:], risk, strict=True))
            fine = (np.abs(move) <= 1e-12 * np.maximum(1.0, np.abs(step))) & (far[g] * np.abs(step) <= 1) & (root_error <= SHARE * step.std()) & (error <= SHARE * log_rr.std())
        if fine.all():
            out[(g, j)] = eps[g][j][0] + step, log_rr
    return out


def _solve(
    rows: DataFrame, start: dict[int, np.ndarray], close: np.ndarray, max_passes: int, seed: int, known: dict[tuple[int, int], tuple] | None = None
) -> tuple[dict, dict]:
    """Roots of all scores by bracketed Newton steps, and which have settled; arrays of levels x replicates per group.

    The ``known`` groups and levels are not looked at.
    """
    replicates, groups = len(close) - 1, list(start)
    eps = {g: e.copy() for g, e in start.items()}
    lo = {g: np.full(e.shape, -np.inf) for g, e in eps.items()}
    hi = {g: np.full(e.shape, np.inf) for g, e in eps.items()}
    done = {g: np.zeros(e.shape, dtype=bool) for g, e in eps.items()}
    for g, j in known or {}:
        done[g][j] = True
    for _ in range(max_passes):
        moving = {(g, j) for g in groups for j in range(len(eps[g])) if not done[g][j].all()}
        if not moving:
            break
        sums = _sums(rows, eps, replicates, False, moving, seed)
        for g, j in moving:
            s = sums.get((g, j))
            if s is None:
                done[g][j] = True
                continue
            score, info = s[: replicates + 1], s[replicates + 1 : -1]
            e = eps[g][j]
            lo[g][j] = np.where(score > 0, np.maximum(lo[g][j], e), lo[g][j])
            hi[g][j] = np.where(score < 0, np.minimum(hi[g][j], e), hi[g][j])
            with np.errstate(all="ignore"):
                new = e + score / info
                wide = e + np.sign(score) * np.maximum(1.0, 2 * np.abs(e))
                middle = (lo[g][j] + hi[g][j]) / 2
            small = np.abs(new - e) <= close * np.maximum(1.0, np.abs(e))
            inside = small | ((new > lo[g][j]) & (new < hi[g][j]))
            new = np.where(inside, new, np.where(np.isfinite(middle), middle, wide))
            new = np.where((score == 0) | done[g][j], e, new)
            done[g][j] |= small | (score == 0)
            eps[g][j] = new
    return eps, done


def fluctuation(
    rows: DataFrame,
    groups: list[int],
    trims: tuple[float, ...],
    replicates: int = 200,
    tol: float = 1e-9,
    max_passes: int = 30,
    replicate_tol: float = 1e-4,
    seed: int = 0,
) -> list[tuple[int, float, float | None, float | None, float | None, str]]:
    """``(group, trim, eps, log risk ratio, its bootstrap SE, status)`` for all trim levels.

    ``rows``: ``group, depth, row (hash), t, y, g, q0, q1``, best persisted; read as they are for the estimate, and dealt once
    for the replicates, which take one pass for all levels together, or, where they are too far from the
    estimate for that, one a step. The driver holds one number per group, level and replicate.
    A replicate of a level draws exactly as many rows as the level has, with replacement. Newton steps that leave the
    bracket known from earlier signs are bisected. An estimate that has not settled after ``max_passes`` is NULL;
    replicates that have not do not count for the error. A step's error is that of its square, hence the wider
    tolerance for replicates.
    """
    zero = {g: np.zeros((len(trims), 1)) for g in groups}
    every = {(g, j) for g in groups for j in range(len(trims))}
    # The estimate first, which needs no draws; replicates then start from it.
    eps, done = _solve(rows, zero, np.array([tol]), max_passes, seed)
    sums = _sums(rows, eps, 0, True, every, seed)
    log_rrs = {}
    if replicates:
        dealt = with_draws(rows, len(trims), seed).persist(StorageLevel.MEMORY_AND_DISK)
        known = _replicates(dealt, eps, replicates, seed)
        if len(known) < len(every):
            first = {g: np.repeat(e, replicates + 1, axis=1) for g, e in eps.items()}
            roots, settled = _solve(dealt, first, np.array([tol] + [replicate_tol] * replicates), max_passes, seed, known)
            for (g, j), s in _sums(dealt, roots, replicates, True, every - known.keys(), seed).items():
                with np.errstate(all="ignore"):
                    rr = s[1 : replicates + 1] / s[replicates + 2 : -1]
                    log_rrs[(g, j)] = np.log(rr[np.isfinite(rr) & (rr > 0) & settled[g][j][1:]])
        log_rrs |= {k: v for k, (_, v) in known.items()}
        dealt.unpersist()
    out = []
    for g in groups:
        for j, trim in enumerate(sorted(trims)):
            s = sums.get((g, j))
            if s is None or s[-1] < MIN_ROWS:
                out.append((g, float(trim), None, None, None, "too few rows"))
                continue
            with np.errstate(all="ignore"):
                rr = s[0] / s[1]
            if not done[g][j][0]:
                out.append((g, float(trim), None, None, None, "not converged"))
                continue
            if not np.isfinite(rr) or rr <= 0:
                out.append((g, float(trim), None, None, None, "no risk ratio"))
                continue
            usable = log_rrs.get((g, j), np.zeros(0))
            enough = replicates > 1 and len(usable) >= replicates / 2
            se = float(np.std(usable, ddof=1)) if enough else None
            status = "ok" if enough else "too few usable replicates"
            out.append((g, float(trim), float(eps[g][j][0]), float(np.log(rr)), se, status))
    return out
