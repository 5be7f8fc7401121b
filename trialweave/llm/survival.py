"""Audit of how filters interact: what each would remove alone, after others, and in every order.

A document's failures make a truth table over all subsets of the filters: one bit a subset, set if the document
survives it. With five filters that is one 32-bit word. Counting survivors of every subset at once is a positional
popcount, done with carry-save adders over whole batches of words. All orders, steps and shares follow from the 32
counts of a part.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps, join_unique

#: Filters by letter, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_COPY = 1 << FILTERS.index("E")
_ODD = re.compile(rb"[#$%&*|]")
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()
    upper = len(raw.translate(None, _NOT_UPPER))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 3 * len(text)) << 2
        | (_ODD.search(raw) is not None) << 3
    )


def survival_words() -> np.ndarray:
    """The truth-table word of each failure mask: bit s is set if no filter of subset s fails."""
    subsets = np.arange(SUBSETS, dtype=np.uint32)
    return np.array([((subsets & m) == 0).astype(np.uint64) @ (np.uint64(1) << subsets.astype(np.uint64)) for m in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save adders.

    Three words of one weight become their sum in the same weight and their carry in the next, until at most one
    word of each weight is left.
    """
    total, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            n = len(words) // 3
            a, b, c = words[:n], words[n : 2 * n], words[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * n :]])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        total += weight * np.unpackbits(words.astype("<u4").view(np.uint8), bitorder="little").astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return total


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = [], []
        for t in b.column("text"):
            text = t.as_py() or ""
            masks.append(failures(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = survival_words()
    for b in batches:
        parts = b.column("part").dictionary_encode()
        code = parts.indices.to_numpy()
        words = table[b.column("mask").to_numpy()]
        kinds = [np.ones(len(words), bool), *(b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))]
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
        groups = [order[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        counts = [[positional_popcount(words[g][k[g]]).tolist() for g in groups] for k in kinds]
        yield pa.RecordBatch.from_arrays(
            [parts.dictionary, *[pa.array(c, pa.list_(pa.int64())) for c in counts]], names=["part", "alive", "good", "toxic"]
        )


def survivors(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, alive, good, toxic``: per part, survivors of each of the 32 subsets of filters, in arrays by subset."""
    steps = Steps(docs.sparkSession, "survival")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    rows = steps.write(rows.mapInArrow(_judge, "id long, part string, mask int, digest binary"))
    copies = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    rows = join_unique(rows, steps.write(copies), "digest")
    mask = F.col("mask").bitwiseOR(F.when(F.col("id") > F.col("first"), _COPY).otherwise(0))
    rows = steps.write(rows.select("id", "part", mask.alias("mask")))
    said = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("id is not null")
    said = steps.write(said.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    rows = join_unique(rows, said, "id")
    rows = rows.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    counts = rows.mapInArrow(_count, "part string, alive array<long>, good array<long>, toxic array<long>")
    kinds = ("alive", "good", "toxic")
    each = counts.select("part", F.posexplode(F.arrays_zip(*kinds)).alias("subset", "n")).groupBy("part", "subset")
    each = each.agg(*[F.sum(f"n.{c}").alias(c) for c in kinds])
    # 32 rows a part.
    whole = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *kinds))).alias("n"))
    return whole.select("part", *[F.col(f"n.{c}").alias(c) for c in kinds])


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each filter does in each of the 120 orders: ``part, filter_order, step`` and counts of documents.

    Failing: A under 200 words, B fewer distinct words than half, C over 3 % of A-Z, D any of ``#$%&*|``, E a text
    that a row with a smaller key has. ``kept`` and ``removed`` are those of the step; ``redundant`` fail its filter
    and went earlier; ``unique_fails`` fail no other; ``good_lost`` and ``toxic_lost`` are the removed with a label
    of quality or toxic 1; ``shapley`` is the filter's removals summed over all orders.

    A null text counts as empty, a null part as the empty string. A null key has no copies and no labels. Equal rows
    count one by one, and neither is a copy of the other; of several labels of one key any 1 counts. An empty table
    gives no rows. Other columns are ignored. A text or key that a third of all rows share is joined by broadcast of
    its one row; counts are made per batch before anything is shuffled by part.
    """
    n = survivors(docs, labels, key, text, part)
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for i, letter in enumerate(order):
            place = FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": i + 1, "place": place, "before": before, "after": before | 1 << place})
            before |= 1 << place
    shares = []
    for bit in (1 << i for i in range(len(FILTERS))):
        without = [s for s in range(SUBSETS) if not s & bit]
        weights = {s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in without}
        shares.append(" + ".join(f"{weights[s]} * (alive[{s}] - alive[{s | bit}])" for s in without))
    alone = ", ".join(f"alive[{SUBSETS - 1 - (1 << i)}] - alive[{SUBSETS - 1}]" for i in range(len(FILTERS)))
    n = n.select("*", F.expr(f"array({', '.join(shares)})").alias("shares"), F.expr(f"array({alone})").alias("alone"))
    schema = "array<struct<filter_order: string, step: int, place: int, before: int, after: int>>"
    rows = n.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), schema)))
    removed = F.expr("alive[before] - alive[after]")
    return rows.select(
        "part", "filter_order", "step", F.expr("alive[after]").alias("kept"), removed.alias("removed"),
        (F.expr("alive[0] - alive[shiftleft(1, place)]") - removed).alias("redundant"), F.expr("alone[place]").alias("unique_fails"),
        F.expr("good[before] - good[after]").alias("good_lost"), F.expr("toxic[before] - toxic[after]").alias("toxic_lost"),
        F.expr("shares[place]").alias("shapley"),
    )
