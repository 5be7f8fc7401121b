"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, reduced to minwise tokens: for each of 64 hash functions, the
smallest value over the set. Documents with equal sets are one. In a tree, a node branches by two functions:
every document goes to the child named by its token. Two documents of similarity s share a child with
probability s each, so at 0.8 they share 1.6 of two children on average and most of their paths go on for ever;
independent trees catch the rest (five trees miss a pair at the threshold with probability below 1e-6).
Branching stops at small nodes, whose pairs are all compared, and at depth 3. A node that is large there mostly
holds near copies of one another: documents are compared with some pivots of their largest node first, and what
these links leave apart is compared exhaustively, in blocks: all but a node's largest component with all of it. Comparison is by a short sketch of the tokens, then by the parities of
the sets' bins (no pair at the threshold fails either but with probability below 1e-6), and then on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.llm.components import components
from trialweave.llm.shared import Steps
from trialweave.llm.words import Words, mix, slices

TOKENS = 64
TREES = 5
#: Depth of the first nodes that are looked at, and of the last.
FIRST, LAST = 2, 3
#: Documents of a node whose pairs are all compared; pivots of a larger node, and rounds of them.
SMALL = 32
PIVOTS, ROUNDS = 16, 2
#: Sketch positions, of 64 with two bits each, in which a pair may differ; 9.6 are expected at similarity 0.8.
DIFFER = 28
#: Bins with a parity bit each, a power of two, and standard deviations above the expectation at which a pair is given up.
BITS, SURE = 2048, 5.5
PARTNERS = 256
#: Rows of a node that one task of the exhaustive comparison holds.
BLOCK = 2048
#: Bits of the largest bitmap of documents whose texts are wanted (8 MB), and of each of its parts (as Spark has them).
MARKS, MAP = 1 << 26, 1 << 15
#: Columns of a document in a node.
NODE = ["key", "rep", "n", "high", "low"]

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1 << 63, size=TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1 << 63, size=TOKENS, dtype=np.uint64)
_ORDER = [np.random.default_rng(100 + t).permutation(TOKENS).tolist() for t in range(16)]
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_sets(w: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than ``width``, one of them all."""
    h = w.hashes(lower=True)
    acc = mix(h ^ np.uint64(width))
    for k in range(1, width):
        acc = mix(acc[: len(h) - k] * _C[0] + h[k:]) if len(h) > k else acc[:0]
    for a, b in zip(w.texts[:-1], w.texts[1:], strict=True):
        if b - a >= width:
            yield np.unique(acc[a : b - width + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mix(one * _C[1] + x)
            yield one
        else:
            yield np.zeros(0, np.uint64)


def _tokens(s: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 8192):
        np.minimum(out, ((s[i : i + 8192, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _bits(s: np.ndarray) -> np.ndarray:
    """The parity of the number of elements in each of ``BITS`` bins; of two sets, bins differ by elements of one only."""
    bins = (mix(s ^ _C[2]) >> np.uint64(65 - BITS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, tokens, bits = [], [], [], [], [np.zeros(0, np.int64)]
            for _, _, w in slices(b.column("text")):
                for s in shingle_sets(w, width):
                    n.append(len(s))
                    d1.append(mix(s ^ _C[1]).sum(dtype=np.uint64))
                    d2.append(mix(s * _C[2] + _C[0]).sum(dtype=np.uint64))
                    tokens.append(_tokens(s))
                    bits.append(_bits(s))
            t = np.array(tokens, np.uint32).reshape(-1, TOKENS)
            high, low = (np.packbits((t >> k & 1).astype(np.uint8), axis=1).view(np.int64).ravel() for k in (0, 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, k, dtype=np.int32)), pa.array(v))
                for v, k in ((t.view(np.int32).ravel(), TOKENS), (np.concatenate(bits), BITS // 64))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"), b.column("uid"), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)),
                    pa.array(np.array(d2, np.uint64).view(np.int64)), lists[0], pa.array(high), pa.array(low), lists[1],
                ],
                names=["id", "uid", "n", "d1", "d2", "tokens", "high", "low", "bits"],
            )

    return run


def _nodes(depth: int):
    """The nodes of each document at a depth, over all trees; below the first depth, only children of its ``parents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            at, given = mix(np.arange(1, len(t) + 1, dtype=np.uint64)), None
            if "parents" in b.schema.names:
                lists = b.column("parents")
                of = np.repeat(at, lists.value_lengths().to_numpy(zero_copy_only=False))
                given = np.unique(mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ of))
            keys, rows = [], []
            for tree in range(TREES):
                name = {1: np.full(len(t), tree, np.uint64)}
                for q in range(2, 2 << depth):
                    token = t[:, _ORDER[tree][q % TOKENS]]
                    name[q] = mix(mix(name[q >> 1] * _C[0] + np.uint64(q)) ^ token)
                for q in range(1 << depth, 2 << depth):
                    own = np.arange(len(t))
                    if given is not None:
                        parent = mix(name[q >> 1] ^ at)
                        own = np.flatnonzero(given.take(np.searchsorted(given, parent), mode="clip") == parent)
                    keys.append(name[q][own])
                    rows.append(own)
            row = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(keys).view(np.int64)), *(b.column(c).take(row) for c in NODE[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=NODE)

    return run


def _meet(small: int, differ: int, share: tuple[int, int]):
    """From rows sorted by node: the pairs ``a, b`` of nodes of at most ``small`` rows that sizes and sketches allow
    (as ``_alike`` does), and the rows of ``large`` nodes, document ``a`` in node ``b``. Nodes of one row give nothing.
    """
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, big = np.zeros((len(NODE), 0), np.int64), None
        for b in chain(batches, [None]):
            rows = left if b is None else np.concatenate([left, np.stack([b.column(c).to_numpy() for c in NODE])], axis=1)
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            sizes = np.diff(np.append(starts, rows.shape[1]))
            large = sizes > small
            large[0] |= big is not None and rows[0, 0] == big
            # The last node may go on in the next batch; only of a small one rows are held.
            end = rows.shape[1] if large[-1] or b is None else starts[-1]
            left, big = rows[:, end:], rows[0, -1] if large[-1] else None
            wide = np.repeat(large, sizes)[:end]
            many = rows[:2, :end][:, wide]
            key, rep, n, high, low = rows[:, :end][:, ~wide & np.repeat(sizes > 1, sizes)[:end]]
            found = []
            for d in range(1, small):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                j = i + d
                ok = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
                ok &= (rep[i] != rep[j]) & (np.bitwise_count(((high[i] ^ high[j]) | (low[i] ^ low[j])).view(np.uint64)) <= differ)
                found.append(np.sort(np.stack([rep[i[ok]], rep[j[ok]]]), axis=0))
            out = np.concatenate([many[::-1], *found], axis=1)
            flag = np.arange(out.shape[1]) < many.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(flag)], names=["a", "b", "large"])

    return run


def _alike(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether sizes and sketches allow the similarity."""
    num, den = share
    return F.expr(
        f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) and "
        f"bit_count(({a}.high ^ {b}.high) | ({a}.low ^ {b}.low)) <= {DIFFER}"
    )


def _close(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether the parities allow the similarity.

    Sets at the threshold differ by at most d = (n_a + n_b) * (den - num) / (den + num) elements. Each changes one
    parity, so at most d bits differ, which loses no pair; where bins take several such elements, fewer are expected.
    """
    num, den = share
    most = f"({a}.n + {b}.n) * {den - num}d / {den + num}d"
    odd = f"(1 - exp({most} * {-2 / BITS}d)) / 2"
    # A loop: written out, the join's code would be too long for the JVM to compile.
    differ = f"aggregate(zip_with({a}.bits, {b}.bits, (p, q) -> bit_count(p ^ q)), 0, (p, q) -> p + q)"
    return F.expr(f"{differ} <= least({most} + 0.001, {BITS}d * {odd} + {SURE}d * sqrt({BITS}d * {odd} * (1 - {odd})) + 4)")


def _wanted(docs: DataFrame, sides: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``uid`` is in ``sides``, and few others: without an exchange, by a bitmap of hashes.

    It has 16 bits or more a wanted row up to ``MARKS`` in all, so that the texts that move are about those of pairs,
    however many documents there are. The join that follows is exact.
    """
    marks = min(MARKS, max(MAP, 1 << (16 * sides.count()).bit_length()))
    part, bit = F.expr(f"pmod(uid, {marks}L) div {MAP}"), F.expr(f"pmod(uid, {marks}L) % {MAP}")
    maps = sides.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = f"cast(conv(hex(substring(map, cast(pmod(uid, {marks}L) % {MAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = F.expr(f"getbit({byte}, cast(pmod(uid, {marks}L) % 8 as int)) = 1")
    return docs.join(F.broadcast(maps), (part == F.col("part")) & marked).select(docs.columns)


def _verify(pairs: DataFrame, docs: DataFrame, width: int, share: tuple[int, int], steps: Steps) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity.

    Each ``a`` meets its partners' texts one after another; more partners than ``PARTNERS`` are spread over tasks.
    """
    num, den = share
    count = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts"))
    sent = pairs.join(count, "a").select("a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("uid"))
    own = count.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("uid"))
    sides = steps.write(sent.unionByName(own))
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    rows = _wanted(docs.select("uid", "text"), sides).join(sides, "uid").repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for b in batches:
            a, role, uid = (b.column(c).to_numpy() for c in ("a", "role", "uid"))
            found, k = [], 0
            for _, _, w in slices(b.column("text")):
                for s in shingle_sets(w, width):
                    if role[k] == 0:
                        pivot, own = a[k], s
                    elif pivot == a[k]:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if den * both >= num * (len(own) + len(s) - both):
                            found.append(k)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(uid[found])], names=["a", "b"])

    return steps.write(rows.mapInArrow(run, "a long, b long"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row with a key.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. Documents whose shingle sets
    have ``share[1] * intersection >= share[0] * union`` are linked; ``component_id`` is the smallest key that
    links reach, ``kept`` marks the row that has it. Null and empty texts have no shingles and no links. Rows
    with a null key are left out; rows that repeat a key are documents of their own under that key. Other
    columns are ignored. An empty table gives no rows. No task gathers a group: groups of equal sets are one row
    after a pre-aggregation, large nodes are joined in splittable parts, and partners of a hot pivot are spread.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "near")
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    docs = docs.select("id", F.xxhash64("id", "text").alias("uid"), "text")
    rows = steps.write(docs.mapInArrow(_features(width), "id long, uid long, n long, d1 long, d2 long, tokens array<int>, high long, low long, bits array<long>"))
    same = rows.filter("n > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("first"), F.min("uid").alias("rep"), *[F.first(c).alias(c) for c in ("n", "high", "low", "tokens", "bits")]
    )
    reps = steps.write(same)

    # By number: a pair's comparison costs more than the bytes of its rows tell.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    small, inside = [], reps.select("tokens", *NODE[1:])
    for depth in range(FIRST, LAST + 1):
        # One exchange of narrow rows: nodes are counted, and small ones compared, where their rows meet.
        nodes = inside.mapInArrow(_nodes(depth), ", ".join(f"{c} long" for c in NODE)).repartition(parts, "key").sortWithinPartitions("key")
        met = steps.write(nodes.mapInArrow(_meet(SMALL, DIFFER, share), "a long, b long, large boolean"))
        small.append(met.filter("not large").select("a", "b"))
        rest = met.filter("large").select(F.col("a").alias("rep"), F.col("b").alias("key"))
        if depth == LAST or rest.isEmpty():
            break
        parents = rest.groupBy("rep").agg(F.collect_set("key").alias("parents"))
        inside = reps.select("tokens", *NODE[1:]).join(parents, "rep")
    sketch = reps.select("rep", "n", "bits")
    pairs = reduce(DataFrame.unionByName, small).distinct()
    pairs = pairs.join(sketch.alias("x"), F.col("a") == F.col("x.rep")).join(sketch.alias("y"), F.col("b") == F.col("y.rep"))
    pairs = pairs.filter(_close("x", "y", share)).select("a", "b")

    known = None
    if not rest.isEmpty():
        # One row a document, with all its large nodes, the largest first.
        rest = rest.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key")))
        rest = rest.groupBy("rep").agg(F.expr("transform(sort_array(collect_set(struct(size, key)), false), x -> x.key)").alias("keys"))
        rest = steps.write(rest.join(reps.select("rep", "n", "high", "low", "bits"), "rep"))
        for turn in range(ROUNDS + 1):
            held = _in_components(rest, known)
            if turn < ROUNDS:  # near copies share their largest node, so that one is enough for their links to pivots
                held = held.withColumn("key", F.expr("keys[0]"))
            else:
                held = steps.write(held.select("rep", "component", F.explode("keys").alias("key")))
            nodes = steps.write(_apart(held))
            if turn and nodes.isEmpty():
                continue
            apart = held.join(nodes, "key")
            if turn < ROUNDS:
                order = Window.partitionBy("key").orderBy(F.expr("component = most"), F.xxhash64(F.lit(turn), "rep"))
                first = apart.withColumn("nth", F.row_number().over(order)).filter(f"nth <= {PIVOTS}")
                more = apart.alias("b").join(first.alias("a"), "key").filter("a.rep <> b.rep")
            else:
                # Rows of a node's largest component are not compared with one another; a pair that shares several
                # nodes is looked at in one of them only.
                apart = apart.join(rest, "rep")
                blocks = f"cast(ceil(others / {BLOCK}) as int)"
                a = apart.filter("component <> most").withColumn("block", F.expr(f"pmod(hash(rep), {blocks})")).repartition(parts, "key", "block")
                b = apart.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks} - 1)"))).repartition(parts, "key", "block")
                more = b.alias("b").join(a.alias("a"), ["key", "block"]).filter("a.rep < b.rep or b.component = b.most")
            more = more.filter(F.expr("a.component <> b.component") & _alike("a", "b", share) & _close("a", "b", share))
            if turn == ROUNDS:
                more = more.filter("array_min(array_intersect(a.keys, b.keys)) = a.key")
            more = more.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))
            if turn == 0:
                more = more.unionByName(pairs)
            found = _verify(steps.write(more.distinct()), docs, width, share, steps)
            steps.release()
            # A component known is as good as its links.
            links = found if known is None else known.filter("node <> component").toDF("a", "b").unionByName(found)
            known = steps.write(components(links, steps))
    else:
        known = steps.write(components(_verify(steps.write(pairs), docs, width, share, steps), steps))

    named = known.join(reps.select(F.col("rep").alias("node"), "first"), "node")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    member = reps.select("d1", "d2", "first", F.col("rep").alias("node")).join(known, "node", "left").join(least, "component", "left")
    member = steps.write(member.select("d1", "d2", F.coalesce("least", "first").alias("component_id")))
    steps.keep(rows, member)
    out = rows.select("id", "n", "d1", "d2").join(member, ["d1", "d2"], "left")
    found = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"), (found == F.col("id")).alias("kept"))


def _in_components(rest: DataFrame, known: DataFrame | None) -> DataFrame:
    """The rows with the ``component`` that links put them in; without links each is one of its own."""
    if known is None:
        return rest.withColumn("component", F.col("rep"))
    rows = rest.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.withColumn("component", F.coalesce("component", "rep"))


def _apart(rows: DataFrame) -> DataFrame:
    """The nodes that hold more than one component: the one with ``most`` rows, and how many rows are in ``others``."""
    held = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    nodes = held.groupBy("key").agg(F.max(F.struct("held", "component")).alias("top"), F.sum("held").alias("size"))
    return nodes.filter("top.held < size").select("key", F.col("top.component").alias("most"), F.expr("size - top.held").alias("others"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest key, once.

    Rows with a null key cannot be told apart from others and all stay. Of rows with equal key and text that differ
    elsewhere, a hash of their other columns decides, so reruns agree. Columns keep their names and values.
    """
    names = near_duplicates(docs, key, text, **options).filter("kept").select(F.col(key).alias("__key")).distinct()
    stay = docs.join(names, F.col(key).cast("long") == F.col("__key"), "left_semi")
    others = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != text])))
    stay = stay.groupBy(F.col(key).alias("__key"), F.xxhash64(text).alias("__th")).agg(F.min_by(F.struct(*docs.columns), others).alias("__row"))
    return stay.select("__row.*").unionByName(docs.filter(F.col(key).isNull()))
