"""Removal of repeated byte strings by sorting suffixes to a bounded depth.

Two windows of ``WINDOW`` equal bytes hold the same smallest group of ``ANCHOR`` bytes, so texts are cut into paths:
runs of windows that share their smallest group. Of equal paths the first in the corpus stays. A group that occurs in
one path only needs no more; the windows of all others are suffixes to be sorted. They meet by the bytes that a few
neighbouring windows have in common, and each such set is sorted by deep-shallow sorting: multikey quicksort over
eight-byte characters down to ``SHALLOW`` bytes, then blind tries for what is still equal. Of equal suffixes the first
stays. What is sent back to a text is where its windows are the first; every byte of another window goes.

Equal paths are found by two hashes of 64 bits and their length; windows are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.shared import Steps
from trialweave.llm.words import buffers, mix

WINDOW = 100
#: Bytes of an anchor, a power of two, and places of an anchor in a window that are sent together.
ANCHOR = 32
CHUNK = 32
#: Depth of the quicksort, rows that are small enough for plain sorting, and rows of a set beyond which windows are counted singly.
SHALLOW = 40
SMALL = 32
LARGE = 8192
SALTS = 16
#: One text in so many tells which anchors have very many paths: those with more than HOT of them, MOST at the most.
SAMPLE = 32
HOT = 256
MOST = 1000
#: Texts are worked on in slices of about so many bytes; longer texts in pieces, which overlap by a window.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


def pieces(column, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, place in its text, bytes and offsets of slices of a text column."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        if offsets[i + 1] - offsets[i] <= SLICE_BYTES:
            yield i, 0, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        else:
            j = i + 1
            for at in range(offsets[i], offsets[j] - window + 1, SLICE_BYTES):
                part = data[at : min(at + SLICE_BYTES + window - 1, offsets[j])]
                yield i, at - offsets[i], part, np.array([0, len(part)])
        i = j


def anchors(data: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its smallest group's place (the leftmost) and hash."""
    h, m = data.astype(np.uint64) + np.uint64(1), 1
    while m < anchor:
        h = h[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    h = mix(h)
    least, span, want = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, window - anchor + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    place = (least & _LOW).astype(np.int64)
    return place, h[place]


def _cut(window: int, anchor: int):
    """Paths of texts, of equal ones in a batch the first.

    ``place`` holds a path's start, its number of windows, and whether they hold several places of their group, in
    one number that sorts by start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, groups, fulls, spots = [], [], [], []
            for i, base, data, offsets in pieces(b.column("text"), window):
                if len(data) < window:
                    continue
                place, group = anchors(data, window, anchor)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                whole = text[: len(place)] == text[window - 1 :]
                moved = place[1:] != place[:-1]
                new = np.ones(len(place), bool)
                new[1:] = (group[1:] != group[:-1]) | (whole[1:] != whole[:-1]) | (text[1 : len(place)] != text[: len(place) - 1])
                start = np.flatnonzero(new)
                edges = np.diff(np.append(start, len(place)))
                several = np.zeros(len(place), np.int64)
                several[1:] = moved & ~new[1:]
                several = np.add.reduceat(several, start) > 0
                keep = whole[start]
                start, edges, several = start[keep], edges[keep], several[keep]
                raw = data.tobytes()
                fulls.append(np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), (start + edges + window - 1).tolist(), strict=True)], np.uint64))
                groups.append(group[start])
                rows.append(i + text[start])
                spots.append((start - offsets[text[start]] + base) << 32 | edges << 1 | several)
            if not rows:
                continue
            row, group, full, spot = (np.concatenate(c) for c in (rows, groups, fulls, spots))
            ids, hashes = b.column("id").to_numpy(), b.column("th").to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((hashes, ids))] = np.arange(len(ids))
            order = np.lexsort((rank[row], mix(group ^ (full * np.uint64(_BASE)))))  # rows of a text come in order
            first = np.ones(len(order), bool)
            first[1:] = (group[order[1:]] != group[order[:-1]]) | (full[order[1:]] != full[order[:-1]])
            at = order[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[at].view(np.int64)), pa.array(full[at].view(np.int64)), pa.array(ids[row[at]]), pa.array(hashes[row[at]]), pa.array(spot[at])],
                names=["anchor", "full", "id", "th", "place"],
            )

    return run


def _mark(hot: list[int]):
    """The first of equal paths in a stream sorted by anchor, path and source, and whether it is to be opened.

    A path is open if it repeats itself or its anchor has other paths, for which the stream is one path ahead; anchors
    named ``hot`` are dealt over tasks by path and always open.
    """
    names = ["id", "th", "place", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        before = None  # anchor and path of the last row so far, and whether the anchor had two paths by then
        for b in batches:
            if not b.num_rows:
                continue
            anchor, full = b.column("anchor").to_numpy(), b.column("full").to_numpy()
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (full[1:] != full[:-1])
            if before is not None:
                new[0] = (anchor[0], full[0]) != before[:2]
            at = np.flatnonzero(new)
            if not len(at):
                continue
            a = anchor[at]
            other = np.zeros(len(at), bool)
            same = a[1:] == a[:-1]
            other[1:] |= same
            other[:-1] |= same
            place = b.column("place").to_numpy()[at]
            if before is not None and a[0] == before[0]:
                other[0] = True
                held = held.set_column(3, "open", pa.array([True]))
            if held is not None:
                yield from held.to_batches()
            open_ = other | (place & 1 > 0) | np.isin(a, hot)
            t = pa.table([*[b.column(c).take(pa.array(at)) for c in ("id", "th")], pa.array(place), pa.array(open_)], names=names)
            yield from t.slice(0, len(at) - 1).to_batches()
            held, before = t.slice(len(at) - 1).combine_chunks(), (a[-1], full[at[-1]])
        if held is not None:
            yield from held.to_batches()

    return run


def _open(window: int, anchor: int, chunk: int):
    """Neighbouring windows of the listed paths, keyed by the bytes they have in common."""
    names = ["key", "id", "th", "start", "n", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, places = b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("places")
            out: list[list] = [[] for _ in names]
            for k, t in enumerate(b.column("text")):
                raw = t.as_py().encode()
                for path in places[k].as_py():
                    first = path >> 32
                    data = np.frombuffer(raw, np.uint8, ((path & 0xFFFFFFFF) >> 1) + window - 1, first)
                    place, _ = anchors(data, window, anchor)
                    nth = (place - np.arange(len(place))) // chunk
                    cuts = np.flatnonzero((place[1:] != place[:-1]) | (nth[1:] != nth[:-1])) + 1
                    starts, seen = [0, *cuts.tolist()], set()
                    for s, e in zip(starts, [*starts[1:], len(place)], strict=True):
                        held = raw[first + s : first + e + window - 1]
                        core, q = first + int(place[s]) - int(nth[s]) * chunk, int(nth[s])
                        # A path that repeats itself sends each of its strings once.
                        if len(starts) > 3:
                            if (q, held) in seen:
                                continue
                            seen.add((q, held))
                        key = xxhash.xxh3_64_intdigest(raw[core : core + window - chunk + 1], q)
                        for column, value in zip(out, (key, ids[k], hashes[k], first + s, e - s, held), strict=True):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield _opened(out, names)
                    out = [[] for _ in names]
            yield _opened(out, names)

    return run


def _opened(out: list[list], names: list[str]) -> pa.RecordBatch:
    key = pa.array(np.array(out[0], np.uint64).view(np.int64))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([key, *[pa.array(c, t) for c, t in zip(out[1:], types, strict=True)]], names=names)


def blind_trie(keys: list[bytes]) -> list[list[int]]:
    """Places of equal keys of one length, in the order of the keys.

    Inner nodes hold the depth at which their strings part and one child for each byte there; a search looks at these
    bytes only, and one comparison with the leaf it ends at tells where the new key leaves the tree.
    """
    root: list | tuple = (keys[0], [0])
    for i in range(1, len(keys)):
        s, node = keys[i], root
        while type(node) is list:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        key, places = node
        if key == s:
            places.append(i)
            continue
        depth = len(s) - ((int.from_bytes(key) ^ int.from_bytes(s)).bit_length() + 7) // 8
        above, node = None, root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = (s, [i])
        if type(node) is list and node[0] == depth:
            node[1][s[depth]] = leaf
            continue
        new = [depth, {key[depth]: node, s[depth]: leaf}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.append(node[1])
    return out


def deep_shallow(data: bytes, starts: np.ndarray, groups: list[int], depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` bytes, and which equal the one before them.

    ``groups`` are the borders of sets that are sorted on their own. Equal suffixes keep their order.
    """
    shallow = min(shallow, depth)
    characters = np.ndarray((len(data) + 1,), ">u8", data + bytes(8), strides=(1,))
    order, same = np.arange(len(starts)), np.zeros(len(starts), bool)
    stack, deep = [(i, j, 0) for i, j in zip(groups, groups[1:], strict=False)], []
    while stack:
        lo, hi, d = stack.pop()
        if hi - lo < 2:
            continue
        if d >= shallow:
            deep.append((lo, hi, d))
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            keyed = sorted((data[s + d : s + shallow], i) for s, i in zip(starts[part].tolist(), part.tolist(), strict=True))
            order[lo:hi] = [i for _, i in keyed]
            run = 0
            for k in range(1, len(keyed) + 1):
                if k == len(keyed) or keyed[k][0] != keyed[run][0]:
                    if k - run > 1:
                        deep.append((lo + run, lo + k, shallow))
                    run = k
            continue
        c = characters[starts[part] + d].astype(np.uint64)
        pivot = np.partition(c[:: max(1, len(c) // 9)], 4)[4]
        less, more = c < pivot, c > pivot
        a, b = int(less.sum()), len(c) - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        stack += [(lo, lo + a, d), (lo + a, lo + b, d + 8), (lo + b, hi, d)]
    for lo, hi, d in deep:
        part = order[lo:hi].tolist()
        k = lo
        for equal in blind_trie([data[s + min(d, depth) : s + depth] for s in starts[order[lo:hi]].tolist()]):
            order[k : k + len(equal)] = [part[i] for i in equal]
            same[k + 1 : k + len(equal)] = True
            k += len(equal)
    return order, same


def _firsts(window: int):
    """Windows that no earlier row's window of the same key equals, as runs; rows come sorted by key, then by source."""
    names = ["id", "th", "start", "edges"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, n, start = (t.column(c).to_numpy() for c in ("key", "n", "start"))
        _, at, rows = np.unique(key, return_index=True, return_counts=True)
        alone = np.zeros(len(key), bool)
        alone[at[rows == 1]] = True
        meet = np.flatnonzero(~alone)
        first = np.ones(int(n.sum()), bool)
        if len(meet):
            strings = t.column("bytes").take(pa.array(meet)).to_pylist()
            size, count = np.array([len(s) for s in strings]), n[meet]
            row = np.repeat(np.arange(len(meet)), count)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            starts = (np.cumsum(size) - size)[row] + inner
            groups = [0, *(np.flatnonzero(np.diff(key[meet][row])) + 1).tolist(), len(row)]
            order, same = deep_shallow(b"".join(strings), starts, groups, window)
            mine = np.ones(len(row), bool)
            mine[order[same]] = False
            first[np.repeat(~alone, n)] = mine
        row = np.repeat(np.arange(len(key)), n)
        begin = first.copy()
        begin[1:] &= ~first[:-1] | (row[1:] != row[:-1])
        end = first.copy()
        end[:-1] &= ~first[1:] | (row[1:] != row[:-1])
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        source = row[begin]
        place = start[source] + begin - (np.cumsum(n) - n)[source]
        own = [t.column(c).take(pa.array(source)).combine_chunks() for c in ("id", "th")]
        return pa.RecordBatch.from_arrays([*own, pa.array(place.astype(np.int32)), pa.array((end - begin + 1).astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for i in range(0, b.num_rows, LARGE):
                held.append(b.slice(i, LARGE))
                if sum(h.num_rows for h in held) < LARGE:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column("key").to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                if cut:
                    yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held and sum(h.num_rows for h in held):
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _drop(kept: list[str], output: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, digest, left = [], [], [], [], []
            for t, known, firsts in zip(b.column("__text"), b.column("__known").to_pylist(), b.column("__firsts"), strict=True):
                raw = (t.as_py() or "").encode()
                windows, removed = len(raw) - window + 1, None
                if known and windows > 0:
                    once = np.zeros(windows + 1, np.int32)
                    if firsts.is_valid and len(firsts):
                        start, edges = (firsts.values.field(c).to_numpy().astype(np.int64) for c in ("start", "edges"))
                        np.add.at(once, start, 1)
                        np.add.at(once, start + edges, -1)
                    again = np.cumsum(once)[:-1] <= 0
                    if again.any():
                        upto = np.zeros(len(raw) + 1, np.int64)
                        np.cumsum(again, out=upto[1 : windows + 1])
                        upto[windows + 1 :] = upto[windows]
                        removed = upto[1:] > upto[np.maximum(np.arange(len(raw)) - window + 1, 0)]
                size.append(len(raw))
                if removed is None:
                    gone.append(0)
                    spans.append(0)
                else:
                    gone.append(int(removed.sum()))
                    spans.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
                    raw = np.frombuffer(raw, np.uint8)[~removed].tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if output:
                    left.append(raw if t.is_valid else None)
            columns = [*[b.column(c) for c in kept], *[pa.array(c, pa.int64()) for c in (size, gone, spans)], pa.array(digest, pa.string())]
            names = [*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if output:
                columns.append(pa.array(left, pa.binary()))
                names.append(output)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", output: str = "kept_bytes", window: int = WINDOW, anchor: int = ANCHOR, large: int = LARGE) -> DataFrame:
    """``docs`` without the text, with ``n_bytes, n_removed, n_spans, kept_sha256`` and the bytes that stay in ``output``.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a row of a smaller key, or
    earlier in its own; strings are judged on the input. ``n_spans`` counts the runs of bytes that went. The bytes
    left may cut a character in two, so they are binary; a null text counts as empty and leaves null.

    Of several texts of one key, the one of smaller hash counts as earlier; equal texts of one key count as one.
    Rows with a null key keep all bytes and are no source. Other columns pass through, those named like a new one
    are replaced. An empty table gives no rows. ``output`` empty leaves the bytes out. Texts of any length are cut
    in pieces of bounded size. No set of rows is held beyond ``large``: larger ones are counted window by window.
    """
    if anchor & (anchor - 1) or window <= anchor:
        raise ValueError("anchor must be a power of two below window")
    chunk = min(CHUNK, window - anchor + 1)
    spark = docs.sparkSession
    steps = Steps(spark, "suffixes")
    source = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).filter(f"id is not null and octet_length(text) >= {window}")
    cut = _cut(window, anchor)
    path = "anchor long, full long, id long, th long, place long"
    # Anchors with very many paths, judged by one text in SAMPLE; this only says how rows are dealt.
    some = source.filter(F.pmod("th", F.lit(SAMPLE)) == 0).mapInArrow(cut, path)
    some = some.groupBy("anchor").agg(F.approx_count_distinct("full", 0.1).alias("n")).filter(F.col("n") > HOT).orderBy(F.desc("n"), "anchor").limit(MOST)
    hot = [r.anchor for r in some.collect()]
    deal = F.when(F.col("anchor").isin(hot), F.xxhash64("anchor", "full")).otherwise(F.col("anchor")) if hot else F.col("anchor")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = source.mapInArrow(cut, path).withColumn("deal", deal)
    marked = marked.repartition(parts, "deal").drop("deal").sortWithinPartitions("anchor", "full", "id", "th", "place")
    marked = steps.write(marked.mapInArrow(_mark(hot), "id long, th long, place long, open boolean"))
    steps.release()
    places = marked.filter("open").groupBy("id", "th").agg(F.collect_list("place").alias("places"))
    opened = source.join(places, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(_open(window, anchor, chunk), "key long, id long, th long, start int, n int, bytes binary")
    opened = steps.write(opened)
    steps.release()

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hot = steps.write(opened.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > large).select("key", salt))
    opened_salted = opened.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)).cast("int"))
    usual = opened_salted.join(hot, ["key", "salt"], "left_anti")
    usual = usual.select("key", "id", "th", "start", "n", "bytes").repartition(parts, "key").sortWithinPartitions("key", "id", "th", "start")
    usual = usual.mapInArrow(_firsts(window), "id long, th long, start int, edges int")
    single = opened_salted.join(hot, ["key", "salt"], "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    single = single.groupBy(F.expr(f"substring(bytes, i + 1, {window})").alias("bytes")).agg(F.min(F.struct("id", "th", (F.col("start") + F.col("i")).alias("start"))).alias("first"))
    single = single.select("first.*", F.lit(1).alias("edges"))
    closed = marked.filter("not open").select("id", "th", F.shiftright("place", 32).cast("int").alias("start"), F.expr("cast(place & 4294967295 as bigint) >> 1").cast("int").alias("edges"))
    firsts = closed.unionByName(usual).unionByName(single)
    firsts = steps.write(firsts.groupBy("id", "th").agg(F.collect_list(F.struct("start", "edges")).alias("__firsts")))
    steps.drop(marked, opened, hot)

    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", output]
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = docs.select(kept).schema
    for c in new[:3]:
        schema = schema.add(c, "long")
    schema = schema.add("kept_sha256", "string")
    if output:
        schema = schema.add(output, "binary")
    firsts = firsts.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__firsts")
    rows = docs.select(*kept, F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
    rows = rows.join(firsts, (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    return rows.select(*kept, F.col("__key").isNotNull().alias("__known"), "__text", "__firsts").mapInArrow(_drop(kept, output, window), schema)
