"""What the two vector searches share: clean vectors, blocks of data that meet streams of queries, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(df: DataFrame, key: str, vector: str, zero: bool = True, keep: dict[str, Column] | None = None) -> DataFrame:
    """``id``, ``v`` (doubles) and the columns ``keep`` of the rows with an id and a vector that is whole and finite.

    The dimension is the most frequent length (the larger of equally frequent ones); other lengths, and zero
    vectors if ``zero`` is false, are left out.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    if not zero:
        df = df.filter(F.exists(v, lambda x: x != 0))
    lengths = df.groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    dims = lengths.n if lengths else 0
    return df.filter(F.size(vector) == dims).select(F.col(key).cast("long").alias("id"), v.alias("v"), *[c.alias(n) for n, c in (keep or {}).items()])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def meet(
    data: DataFrame, queries: DataFrame, prepare: Callable, solve: Callable, payload: str, parts: int, batch: int = 256
) -> DataFrame:
    """Let each block's data meet the queries sent to it: ``query_id, vec_id, score``.

    ``data`` and ``queries`` have ``block``; queries have ``id`` and ``v``, data the columns of ``payload``. A task
    reads a block's data first (``prepare`` makes the solver's state of it), then its queries, a batch at a time,
    so memory holds one block and one batch, however many queries there are. ``solve(state, ids, vectors)``
    returns arrays of query places, ids and scores.
    """
    fields = [c.split()[0] for c in payload.split(", ")]
    typed = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in payload.split(", ")]
    left = data.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<double>").alias("qv"), *fields)
    right = queries.select("block", F.lit(1).alias("kind"), F.col("id").alias("qid"), F.col("v").alias("qv"), *typed)
    rows = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, state = None, [], None
        for b in batches:
            names = b.column("block").to_numpy()
            kinds = b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(names) != 0) | (np.diff(kinds) != 0)) + 1), len(names)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if names[i] != block:
                    block, held, state = names[i], [], None
                if kinds[i] == 0:
                    held.append(b.slice(i, j - i).select(fields))
                    continue
                if not held and state is None:
                    continue
                if state is None:
                    state, held = prepare(pa.Table.from_batches(held).combine_chunks()), []
                for k in range(i, j, batch):
                    part = b.slice(k, min(batch, j - k))
                    ids = part.column("qid").to_numpy()
                    at, found, score = solve(state, ids, matrix(part.column("qv")))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query by score, ties to the smaller id, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` best finite scores, ties to the smaller id."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero(score >= least[:, None])
    else:
        row, col = np.nonzero(np.ones_like(score, bool))
    fine = np.isfinite(score[row, col])
    row, col = row[fine], col[fine]
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]
