"""Hard negatives of anchors by inner product, with bounds along spanning trees of anchors.

Anchors near one another form small groups; each group's minimum spanning tree leads from its middle anchor to all
others. In a block of candidates the root's scores are computed; further down, a candidate x whose score at the
parent lies in an interval has a score at the child within that interval widened by |parent - child| |x|. Only
candidates whose interval meets what the child needs (for positives its best k, for negatives the windows below its
positives) are scored, which closes their interval for the child's own children.

Blocks and trees are bounded; a task holds one block and one tree, however many meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps, join_unique
from trialweave.llm.vectors import clean, matrix, top_rows

#: Pivots at most and rows for each pivot, anchors of a tree (on average), and the least and most rows of a block.
PIVOTS = 256
ROWS_PER_PIVOT = 1024
TREE = 64
BLOCK_ROWS = (4096, 65536)
_EXACT = float(2**53)


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal ``names`` (whole numbers) in a stream of batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[i])
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = now
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows: an order in which parents come first, and each one's parent and distance.

    Places are in the returned order, and a parent's last child is its largest subtree, so few parents wait at a time.
    """
    n = len(x)
    norms = (x**2).sum(axis=1)
    far = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0))
    root = int(far.sum(axis=1).argmin())
    up, edge, inside = np.full(n, root), far[root].copy(), np.zeros(n, bool)
    inside[root], added = True, [root]
    for _ in range(n - 1):
        new = int(np.where(inside, np.inf, edge).argmin())
        inside[new] = True
        added.append(new)
        nearer = ~inside & (far[new] < edge)
        edge[nearer], up[nearer] = far[new][nearer], new
    below = np.ones(n, int)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in reversed(added[1:]):
        below[up[i]] += below[i]
        children[up[i]].append(i)
    order, stack = [], [root]
    while stack:
        i = stack.pop()
        order.append(i)
        stack.extend(sorted(children[i], key=lambda c: -below[c]))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    parent, length = place[up[order]], edge[order]
    parent[0], length[0] = -1, 0.0
    return np.array(order), parent, length


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of the groups of anchors, a row an anchor."""
    for t in runs(batches, ["tree", "label"]):
        x = matrix(t.column("v").combine_chunks())
        order, up, edge = spanning_tree(x)
        t = t.take(pa.array(order))
        columns = [t.column("tree"), t.column("label"), pa.array(np.arange(len(order), dtype=np.int32)), pa.array(up.astype(np.int32)), pa.array(edge), t.column("id"), t.column("v")]
        yield from pa.table(columns, names=["tree", "label", "nth", "up", "edge", "id", "v"]).to_batches()


class Block:
    """A block of candidates: ids in order, labels, vectors, their lengths, and exact scores of an anchor."""

    def __init__(self, t: pa.Table):
        order = np.argsort(t.column("cid").to_numpy(), kind="stable")
        self.ids = t.column("cid").to_numpy()[order]
        self.labels = t.column("clabel").to_numpy()[order]
        self.x = matrix(t.column("cv").combine_chunks())[order]
        self.norms = np.sqrt((self.x**2).sum(axis=1))
        self.most = float(np.abs(self.x).max(initial=0))

    def score(self, a: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Inner products with all rows, or with those of a mask; whole numbers beyond 2**53 are summed as such."""
        x = self.x if at is None else self.x[at]
        if float(np.abs(a).max(initial=0)) * self.most * len(a) < _EXACT:
            return x @ a
        return (x.astype(np.int64) @ a.astype(np.int64)).astype(float)


def walk(block: Block, tree: pa.Table, wanted: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each anchor's place, the mask of candidates that were scored, and the upper bounds, which are their scores.

    ``wanted(place, low, high)`` tells which candidates an anchor needs, from the bounds of all scores.
    """
    x = matrix(tree.column("v").combine_chunks())
    up, edge = tree.column("up").to_numpy(), tree.column("edge").to_numpy()
    waits = np.bincount(up[up >= 0], minlength=len(up))
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    slack = block.norms * np.sqrt((x**2).sum(axis=1)).max(initial=0) * 1e-12 + 1e-6
    for i in range(len(up)):
        if up[i] < 0:
            low = high = block.score(x[i])
            scored = np.ones(len(block.ids), bool)
        else:
            low, high = known[up[i]]
            spread = edge[i] * block.norms + slack
            low, high = low - spread, high + spread
            scored = wanted(i, low, high)
            if 2 * np.count_nonzero(scored) > len(scored):
                scored = np.ones(len(scored), bool)
                low = high = block.score(x[i])
            elif scored.any():
                low[scored] = high[scored] = block.score(x[i], scored)
            waits[up[i]] -= 1
            if not waits[up[i]]:
                del known[up[i]]
        if waits[i]:
            known[i] = (low, high)
        yield i, scored, high


def _best_same(k: int):
    def solve(block: Block, tree: pa.Table) -> Iterator[tuple]:
        ids, labels = tree.column("id").to_numpy(), tree.column("label").to_numpy()

        def others(i):
            fine = block.labels == labels[i]
            fine[slice(*np.searchsorted(block.ids, [ids[i], ids[i] + 1]))] = False
            return fine

        def wanted(i, low, high):
            fine = others(i)
            low = low[fine]
            least = np.partition(low, len(low) - k)[-k] if len(low) > k else -np.inf
            return fine & (high >= least)

        for i, scored, score in walk(block, tree, wanted):
            at = np.flatnonzero(scored & others(i))
            _, col = top_rows(score[None, at], block.ids[at], k)
            yield np.full(len(col), i), np.zeros(len(col), np.int32), block.ids[at][col], score[at][col]

    return solve


def _best_below(k: int, least: int, most: int):
    def solve(block: Block, tree: pa.Table) -> Iterator[tuple]:
        labels = tree.column("label").to_numpy()
        scores = [np.array(s if s is not None else [], float) for s in tree.column("scores").to_pylist()]

        def wanted(i, low, high):
            out = np.zeros(len(low), bool)
            for p in scores[i]:
                out |= (100 * high >= least * p) & (100 * low <= most * p)
            return out & (block.labels != labels[i])

        for i, scored, score in walk(block, tree, wanted):
            if not len(scores[i]):
                continue
            at = np.flatnonzero(scored & (block.labels != labels[i]))
            ids, score = block.ids[at], score[at]
            for nth, p in enumerate(scores[i].tolist()):
                fits = (100 * score >= least * p) & (100 * score <= most * p)
                _, col = top_rows(score[None, fits], ids[fits], k)
                yield np.full(len(col), i), np.full(len(col), nth, np.int32), ids[fits][col], score[fits][col]

    return solve


def _meet(data: DataFrame, trees: DataFrame, extra: dict[str, str], solve: Callable, parts: int) -> DataFrame:
    """What ``solve`` finds where trees are sent to blocks: ``tree, label, nth, positive, found, score``.

    ``data`` has ``block, id, label, v``; ``trees`` the columns of anchors with ``block`` and those of ``extra``.
    """
    anchor = {"tree": "long", "label": "long", "nth": "int", "up": "int", "edge": "double", "id": "long", "v": "array<double>"} | extra
    null = lambda t: F.lit(None).cast(t)
    left = data.select("block", F.lit(-1).cast("long").alias("tree"), *[null(t).alias(c) for c, t in anchor.items() if c != "tree"], F.col("id").alias("cid"), F.col("label").alias("clabel"), F.col("v").alias("cv"))
    right = trees.select("block", *anchor, null("long").alias("cid"), null("long").alias("clabel"), null("array<double>").alias("cv"))
    left = left.select(right.columns)
    rows = left.unionByName(right).repartition(parts, "block").sortWithinPartitions("block", "tree", "label", "nth")
    names = ["tree", "label", "nth", "positive", "found", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's own rows come first, with tree -1; labels are only compared among anchors' rows.
        known = (b.set_column(b.schema.get_field_index("label"), "label", b.column("label").fill_null(0)) for b in batches)
        name, block = None, None
        for t in runs(known, ["block", "tree", "label"]):
            now, tree = t.column("block")[0].as_py(), t.column("tree")[0].as_py()
            if tree < 0:
                name, block = now, Block(t)
                continue
            if now != name:
                continue
            found = list(solve(block, t.select(list(anchor))))
            at, positive, ids, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([],) * 4
            if len(at):
                own = [t.column(c).take(pa.array(at)).combine_chunks() for c in ("tree", "label", "nth")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(positive), pa.array(ids), pa.array(score)], names=names)

    return rows.mapInArrow(run, "tree long, label long, nth int, positive int, found long, score double")


def hard_negatives(
    vectors: DataFrame, is_anchor, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3,
    window: tuple[int, int] = (50, 95), factor: int = 256, tree: int = TREE, block_rows: tuple[int, int] = BLOCK_ROWS, rows_per_pivot: int = ROWS_PER_PIVOT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: each anchor's positives, each with its negatives.

    Scores are inner products of floor(factor * x), which must fit a long; higher come first, ties by smaller key. An
    anchor's positives are its first rows of the same label, a positive's negatives the first rows of other labels
    whose score is within ``window`` percent of the positive's. ``is_anchor`` is a condition on ``id``.

    Rows with a null key or label, or a vector that is null, empty, of an odd length or holds null or non-finite
    components take no part. No row of the anchor's own key is its positive; equal rows of other keys count
    one by one, a repeated anchor with equal vector and label once, with others as an anchor of its own. An anchor
    without positives, and a positive without negatives, have no rows; an empty table gives none. Other columns
    are ignored. Labels of any share are dealt over blocks of bounded size.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "negatives")
    whole = clean(vectors.filter(F.col(label).isNotNull()), key, vector, keep={"label": F.col(label).cast("long")})
    whole = whole.select("id", "label", F.transform("v", lambda x: F.floor(x * float(factor)).cast("double")).alias("v"))
    # Rows are dealt to blocks by number, not by value, so that equal rows do not meet in one; the numbers are written.
    data = steps.write(whole.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    n = data.count()
    rows = min(block_rows[1], max(block_rows[0], n // 64))
    blocks = max(1, -(-n // rows))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 4096))
    anchors = data.filter(is_anchor(F.col("id"))).dropDuplicates(["id", "label", "v"]).withColumn("hash", F.xxhash64("id", "v"))
    # Anchors of smallest hash are pivots, at most PIVOTS of them; groups are cells of one label, split by hash.
    want = max(1, min(PIVOTS, anchors.count() // rows_per_pivot))
    pivots = [r.v for r in anchors.orderBy("hash", "id", "label").limit(want).collect()]
    if not pivots:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    centre = np.array(pivots)
    norms = (centre**2).sum(axis=1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (norms - 2 * (matrix(b.column("v")) @ centre.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int64))], names=["id", "label", "v", "hash", "cell"])

    anchors = anchors.select("id", "label", "v", "hash").mapInArrow(deal, "id long, label long, v array<double>, hash long, cell long")
    anchors = steps.write(anchors.withColumn("group", F.struct("label", "cell")))
    sizes = anchors.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / tree).cast("long").alias("trees"))
    grouped = join_unique(anchors, sizes, "group").select("id", "label", "v", (F.col("cell") * F.lit(1 << 40) + F.pmod("hash", "trees")).alias("tree"))
    grouped = grouped.repartition(parts, "label", "tree").sortWithinPartitions("label", "tree", "id", "v")
    trees = steps.write(grouped.mapInArrow(_grow, "tree long, label long, nth int, up int, edge double, id long, v array<double>"))

    # Positives: a label's trees visit the blocks of that label.
    of_label = data.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias("blocks"))
    of_label = steps.write(of_label.join(trees.select("label").distinct(), "label", "left_semi"))
    own = join_unique(data, of_label, "label").filter("blocks is not null").withColumn("block", F.xxhash64("label", F.pmod("deal", "blocks")))
    sent = join_unique(trees, of_label, "label").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    sent = sent.withColumn("block", F.xxhash64("label", "part"))
    near = _meet(own, sent, {}, _best_same(positives), parts)
    place = ["tree", "label", "nth"]
    order = Window.partitionBy(*place).orderBy(F.desc("score"), "found")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    # At most ``positives`` rows an anchor, in order; their place is what a negative refers to.
    lists = near.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("rank", "found", "score"))).alias("p"))
    lists = lists.select(*place, F.col("p.score").alias("scores"), F.col("p.found").alias("found"))
    trees = steps.write(trees.join(lists, place, "left"))

    # Negatives: all trees visit all blocks.
    mixed = data.withColumn("block", F.pmod("deal", F.lit(blocks)))
    sent = trees.drop("found").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = _meet(mixed, sent, {"scores": "array<double>"}, _best_below(negatives, *window), parts)
    order = Window.partitionBy(*place, "positive").orderBy(F.desc("score"), "found")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).withColumnRenamed("found", "negative_id")
    out = found.join(trees.select(*place, "id", "scores", "found"), place)
    return out.select(
        F.col("id").alias("anchor_id"), F.get("found", F.col("positive")).alias("positive_id"), "rank", "negative_id",
        F.get("scores", F.col("positive")).cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"),
    )
