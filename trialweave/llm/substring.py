"""Removal of long repeated passages by a compacted de Bruijn graph.

Every window of ``k`` words is an edge of the graph, between its first and its last k - 1 words. A text is a
walk over edges. Walks are cut into paths where the smallest word group inside the window changes: the edges of
a path share that group (the path's anchor), so equal edges of any texts always lie in paths of equal anchors.

An anchor with one path only has no branch, however often the path occurs: the whole path is one row with its
fingerprint and its first source, and all later occurrences repeat it. Only paths whose anchor has several
different continuations are opened into edges, read again at their source coordinates, and joined edge by
edge to find the first source of each. A join back to the sources then marks the repeated words.

Fingerprints are two independent 64-bit hashes of the words at the source coordinates, and the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps
from trialweave.llm.words import Words, mix, slices, span_hash

WINDOW = 50
#: Words of an anchor.
ANCHOR = 8
_A, _B, _D = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
_LOW = np.uint64(0xFFFFFFFF)
#: A path that holds more than this share of all occurrences is common; there are fewer than so many of them.
COMMON = 1000
NAME = ["anchor", "f1", "f2", "edges"]


def paths(w: Words, window: int, anchor: int) -> dict[str, np.ndarray]:
    """The paths of a slice of texts: text, first word (in the slice), number of edges, anchor, two fingerprints."""
    h1, h2 = w.hashes(0), w.hashes(1)
    n = len(h1)
    texts = np.repeat(np.arange(len(w.texts) - 1), np.diff(w.texts))
    empty = np.zeros(0, np.int64)
    if n < window:
        return {"text": empty, "start": empty, "edges": empty, "anchor": empty, "f1": empty, "f2": empty, "h1": h1, "h2": h2}
    at = np.arange(n - anchor + 1)
    groups = mix(span_hash(h1, at, at + anchor, _A))
    # Smallest group of each window, the leftmost of equals: a doubling minimum over hash and place.
    least, span, want = (groups & ~_LOW) | at.astype(np.uint64), 1, window - anchor + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    place = (least & _LOW).astype(np.int64)
    edge = np.arange(len(place))
    whole = texts[edge] == texts[edge + window - 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1]) | (texts[edge[1:]] != texts[edge[:-1]])
    start = np.flatnonzero(new)
    edges = np.diff(np.append(start, len(place)))
    keep = whole[start]
    start, edges = start[keep], edges[keep]
    end = start + edges + window - 1
    return {
        "text": texts[start], "start": start, "edges": edges, "anchor": groups[place[start]].view(np.int64),
        "f1": mix(span_hash(h1, start, end, _B)).view(np.int64), "f2": mix(span_hash(h2, start, end, _D)).view(np.int64), "h1": h1, "h2": h2,
    }


def _cut(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column("text")):
                p = paths(w, window, anchor)
                row = pa.array(i + p["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(row), b.column("th").take(row), pa.array((p["start"] - w.texts[p["text"]]).astype(np.int64)),
                        pa.array(p["edges"].astype(np.int32)), pa.array(p["anchor"]), pa.array(p["f1"]), pa.array(p["f2"]),
                    ],
                    names=["id", "th", "start", "edges", "anchor", "f1", "f2"],
                )

    return run


def _merged(common: list[Row], window: int):
    """The occurrences of common paths, a row for each text (and batch): repeated words, and paths to be opened at their source."""
    table = np.array([[r[c] for c in NAME] for r in common], np.int64)
    first, branch = np.array([r["first"] for r in common], np.int64), np.array([r["branch"] for r in common])
    order = np.argsort(table[:, 1], kind="stable")
    table, first, branch = table[order], first[order], branch[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in NAME])
            lo, hi = (np.searchsorted(table[:, 1], own[:, 1], side=side) for side in ("left", "right"))
            which = np.full(len(own), -1)
            for k in range(int((hi - lo).max(initial=0))):
                at = np.flatnonzero(lo + k < hi)
                same = (table[lo[at] + k] == own[at]).all(axis=1)
                which[at[same]] = lo[at[same]] + k
            row = np.flatnonzero(which >= 0)
            if not len(row):
                continue
            which = which[row]
            ids, ths, start, edges = (b.column(c).to_numpy()[row] for c in ("id", "th", "start", "edges"))
            late, opened = ids > first[which], branch[which] & (ids == first[which])
            new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])))
            lists = []
            for use, right, name in ((late, start + edges + window - 1, "end"), (opened, edges.astype(np.int32), "edges")):
                offsets = np.append(0, np.cumsum(use))[np.append(new, len(row))].astype(np.int32)
                cells = pa.StructArray.from_arrays([pa.array(start[use]), pa.array(right[use])], names=["start", name])
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), cells))
            yield pa.RecordBatch.from_arrays([pa.array(ids[new]), pa.array(ths[new]), *lists], names=["id", "th", "spans", "places"])

    return run


def _open(window: int):
    """Edges of the paths whose places are listed with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("places").to_pylist()
            for i, j, w in slices(b.column("text")):
                h1, h2 = w.hashes(0), w.hashes(1)
                row, start, edges = [], [], []
                for k in range(i, j):
                    for p in lists[k]:
                        row.append(k)
                        start.append(p["start"])
                        edges.append(p["edges"])
                if not row:
                    continue
                row, start, edges = np.array(row), np.array(start, np.int64), np.array(edges, np.int64)
                nth = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                row, start = np.repeat(row, edges), np.repeat(start, edges) + nth
                at = w.texts[row - i] + start
                e1 = mix(span_hash(h1, at, at + window, _B)).view(np.int64)
                e2 = mix(span_hash(h2, at, at + window, _D)).view(np.int64)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(row), b.column("th").take(row), pa.array(start), pa.array(e1), pa.array(e2)], names=["id", "th", "start", "e1", "e2"]
                )

    return run


def _remove(kept: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("__spans")
            out, words, removed, digest = [], [], [], []
            for t, spans in zip(b.column("__text"), lists, strict=True):
                raw = (t.as_py() or "").encode()
                all_words = raw.split()
                if spans.is_valid and len(spans):
                    gone = np.zeros(len(all_words) + 1, np.int64)
                    s = spans.values.field("start").to_numpy(), spans.values.field("end").to_numpy()
                    np.add.at(gone, s[0], 1)
                    np.add.at(gone, s[1], -1)
                    stay = np.cumsum(gone)[:-1] <= 0
                    left = [x for x, ok in zip(all_words, stay.tolist(), strict=True) if ok]
                else:
                    left = all_words
                joined = b" ".join(left)
                changed = len(left) < len(all_words)
                out.append(None if not t.is_valid else joined.decode() if changed else t.as_py())
                words.append(len(all_words))
                removed.append(len(all_words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
            columns = [*[b.column(c) for c in kept], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = [*kept, "n_words", "n_removed", "kept_sha256"]
            if text:
                columns.append(pa.array(out, pa.string()))
                names.append(text)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and the text without its repeated words.

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller key; windows are
    judged on the input. A text that loses words becomes the kept words joined by one space; others stay as they
    are, null stays null. ``kept_sha256`` is the digest of the kept words joined by one space. Repeats inside a row,
    or among rows of the same key, are no repeats. Rows with a null key keep all their words and are no source.
    Other columns pass through; new columns replace old ones of their names. An empty table gives no rows.
    A passage in a third of all rows is one row per map task after pre-aggregation; nothing is gathered by passage, and
    occurrences of common paths do not move: they become one row for each text where they are.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "repeats")
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).filter("id is not null")
    name = NAME
    runs = steps.write(source.mapInArrow(_cut(window, anchor), "id long, th long, start long, edges int, anchor long, f1 long, f2 long"))
    # One row per different path, with its first source.
    unique = steps.write(runs.groupBy(*name).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")))
    steps.release()
    branching = unique.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    branching = unique.join(branching, "anchor", "left_semi")
    branching = steps.write(branching.select(*name, "first", "n"))
    # Occurrences of paths that are repeated or branch; the others are done with.
    several = unique.filter("first < last").select(*name, "first", "n", F.lit(False).alias("branch"))
    asked = several.unionByName(branching.select(*name, "first", "n", F.lit(True).alias("branch")))
    asked = asked.groupBy(*name).agg(F.min("first").alias("first"), F.max("n").alias("n"), F.max("branch").alias("branch"))
    asked = steps.write(asked)
    least = max(runs.count() // COMMON, COMMON)
    common = asked.filter(F.col("n") > least).drop("n").collect()
    rare = runs
    if common:
        rare = runs.join(F.broadcast(asked.filter(F.col("n") > least).select(*name)), name, "left_anti")
    found = rare.join(asked.filter(F.col("n") <= least).drop("n"), name).select("id", "th", "start", "edges", "first", "branch")
    spans = F.struct("start", (F.col("start") + F.col("edges") + window - 1).alias("end"))
    found = found.select("id", "th", F.when(F.col("id") > F.col("first"), spans).alias("span"), F.when(F.col("branch") & (F.col("id") == F.col("first")), F.struct("start", "edges")).alias("place"))
    found = steps.write(found.filter("span is not null or place is not null"))
    spans = found.filter("span is not null").select("id", "th", F.array("span").alias("spans"))
    places = found.filter("place is not null").select("id", "th", F.array("place").alias("places"))
    tables = [found]
    if common:
        schema = "id long, th long, spans array<struct<start:long,end:long>>, places array<struct<start:long,edges:int>>"
        merged = steps.write(runs.mapInArrow(_merged(common, window), schema))
        spans = spans.unionByName(merged.filter("size(spans) > 0").select("id", "th", "spans"))
        places = places.unionByName(merged.filter("size(places) > 0").select("id", "th", "places"))
        tables.append(merged)
    steps.drop(runs, unique, branching, asked)

    # Branching paths, opened into edges at their first source.
    places = places.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    edges = source.join(places, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(_open(window), "id long, th long, start long, e1 long, e2 long")
    edges = steps.write(edges)
    steps.release()
    origin = edges.groupBy("e1", "e2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("e1", "e2", "first")
    late = edges.join(origin, ["e1", "e2"]).filter("id > first").select("id", "th", F.array(F.struct("start", (F.col("start") + window).alias("end"))).alias("spans"))
    spans = spans.unionByName(late).groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("__spans"))
    spans = steps.write(spans)
    steps.drop(edges, *tables)

    new = ["n_words", "n_removed", "kept_sha256"]
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = docs.select(kept).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add(text, "string")
    spans = spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__spans")
    rows = docs.select(*kept, F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
    rows = rows.join(spans, (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    return rows.select(*kept, "__text", "__spans").mapInArrow(_remove(kept, text if with_text else ""), schema)
