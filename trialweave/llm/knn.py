"""Exact top-k search by inner product as a Voronoi join.

Pivots are some of the vectors. Queries and data each belong to the cell of their nearest pivot. A cell's
summary is its number of rows, its radius and the distances of its innermost ids. With them, every query
cell gets a lower bound of its queries' k-th score, and a data cell is needed only if the upper bound of its
scores reaches it. Queries, the smaller side, are sent to the blocks of the needed cells, each block is
searched exhaustively, and the blocks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps
from trialweave.llm.vectors import best, clean, matrix, meet, top_rows

#: Pivots at most, rows of data for each pivot, and rows of a block, by which large cells are split.
PIVOTS = 512
ROWS_PER_PIVOT = 2048
BLOCK_ROWS = 4096


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``far``, the nearest pivot and its distance."""
    norms = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            if not len(x):
                continue
            cell = (norms - 2 * (x @ pivots.T)).argmin(axis=1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"])

    return rows.mapInArrow(run, "id long, v array<double>, cell int, far double")


def needed_cells(
    pivots: np.ndarray, radius: dict[int, float], data: dict[int, tuple[int, float, list[float]]], k: int, ids: dict[int, list[int]] | None = None
) -> list[tuple[int, int]]:
    """Pairs of query cell and data cell that can hold one of a query's ``k`` best.

    With q = p + a and x = r + b for the pivots p and r, the score q.x lies within |a||r| + |b||p| + |a||b| of p.r.
    ``data`` has rows, radius and the innermost distances of each cell, ``ids`` whose they are (all different if
    not given). An id counts once, with its best bound, and one more than ``k`` ids are counted, as no row of the
    query's own id counts.
    """
    size, dot, out = np.sqrt((pivots**2).sum(axis=1)), pivots @ pivots.T, []
    for i, u in radius.items():
        spread = lambda j, b: u * size[j] + b * size[i] + u * b  # noqa: B023, E731
        bounds: dict = {}
        for j, (_, _, inner) in data.items():
            for b, own in zip(inner, ids[j] if ids else [(j, n) for n in range(len(inner))], strict=True):
                bounds[own] = max(bounds.get(own, -np.inf), dot[i, j] - spread(j, b))
        lower = sorted(bounds.values(), reverse=True)
        least = lower[k] if len(lower) > k else -np.inf
        for j, (_, r, _) in data.items():
            slack = 1e-9 * (abs(dot[i, j]) + spread(j, r) + 1)
            if dot[i, j] + spread(j, r) + slack >= least:
                out.append((i, j))
    return out


def _prepare(block: pa.Table) -> tuple[np.ndarray, np.ndarray, float]:
    ids = block.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = matrix(block.column("v").combine_chunks())[order]
    return ids[order], x, float(np.abs(x).max(initial=0))


def _solver(k: int):
    def solve(state, qids: np.ndarray, q: np.ndarray):
        ids, x, most = state
        # Sums below 2**53 are exact in doubles; larger ones are made with integers.
        if float(np.abs(q).max(initial=0)) * most * x.shape[1] < 2**53:
            score = q @ x.T
        else:
            score = (q.astype(np.int64) @ x.T.astype(np.int64)).astype(float)
        lo, hi = np.searchsorted(ids, qids), np.searchsorted(ids, qids, side="right")
        for r in np.flatnonzero(hi > lo):
            score[r, lo[r] : hi[r]] = -np.inf
        row, col = top_rows(score, ids, k)
        return row, ids[col], score[row, col]

    return solve


def top_k(
    vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, factor: int = 256,
    pivots: int = PIVOTS, rows_per_pivot: int = ROWS_PER_PIVOT, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best other rows by the inner product of floor(factor * x).

    ``is_query`` is a condition on ``id``. Null ids and vectors that are null, hold null or non-finite components or
    have an odd length take no part; an empty table or no query gives no rows. Repeated rows are candidates of
    their own; a query is compared with no row of its id, and a repeated query with equal vectors counts once. Other
    columns are ignored. Hot cells are split into blocks of bounded size. Pivots and summaries are bounded in number.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "knn")
    whole = clean(vectors, key, vector)
    whole = whole.select("id", F.transform("v", lambda x: F.floor(x * float(factor)).cast("double")).alias("v"))
    n = whole.count()
    want = max(1, min(pivots, n // rows_per_pivot))
    # The vectors of smallest hash are a random sample that every run repeats; at most ``pivots`` rows.
    chosen = whole.select("v", F.xxhash64(F.lit(17), "id").alias("h")).orderBy("h", "v").limit(want).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centre = np.unique(np.array([r.v for r in chosen]), axis=0)
    data = steps.write(_cells(whole, centre))
    queries = data.filter(is_query(F.col("id"))).dropDuplicates(["id", "v"])
    # Only the innermost of each task's ids are sent on, so no task gathers a whole cell.
    nearest = data.groupBy("cell", "id").agg(F.min("far").alias("far"))
    nearest = nearest.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))).filter(F.col("nth") <= k + 1)
    inner: dict[int, list[tuple[float, int]]] = {}
    for r in nearest.collect():
        inner.setdefault(r.cell, []).append((r.far, r.id))
    summary, ids = {}, {}
    for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        summary[r.cell] = (r.n, r.far, [far for far, _ in inner[r.cell]])
        ids[r.cell] = [own for _, own in inner[r.cell]]
    radius = {r.cell: r.far for r in queries.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    pairs = needed_cells(centre, radius, summary, k, ids)
    blocks = {j: -(-m // block_rows) for j, (m, _, _) in summary.items()}
    table = spark.createDataFrame([(i, j, blocks[j]) for i, j in pairs], "cell int, data_cell int, blocks int")
    name = lambda cell, nth: (F.col(cell).cast("long") * F.lit(1 << 32) + nth).alias("block")
    sent = queries.join(table, "cell").select("id", "v", "data_cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("nth"))
    sent = sent.select("id", "v", name("data_cell", F.col("nth")))
    count = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
    dealt = data.join(count, "cell").select("id", "v", name("cell", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sum(blocks.values()), 4096))
    found = meet(dealt, sent, _prepare, _solver(k), "id bigint, v array<double>", parts)
    return best(found, k).withColumn("score", F.col("score").cast("long"))
