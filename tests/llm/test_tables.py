"""Deduplication, archives, mixing and searches against brute force and on odd input."""

import gzip
import hashlib
import io
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from trialweave.llm import hnsw, knn, minhash, mixing, substring, warc


def shingles(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return set(zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, documents, width):
    got = minhash.near_duplicates(documents, width=width).collect()
    want = brute_components([(r.doc_id, r.text) for r in documents.collect()], width)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_of_near_copies(spark):
    """More near copies than a node may hold, chained so that the ends are not alike."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        if k % 5 == 0:
            words[rnd.randrange(120)] = f"new{k}"
        own = list(words)
        own[rnd.randrange(120)] = f"own{k}"
        rows.append((1000 - k, " ".join(own)))
    rows += [(k, " ".join(f"u{k}x{i}" for i in range(30))) for k in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_left_over_documents_are_compared_in_blocks(spark, monkeypatch):
    """One pivot, small blocks and nodes: the exhaustive comparison has to find most links."""
    for name, value in (("SMALL", 3), ("PIVOTS", 1), ("ROUNDS", 1), ("BLOCK", 7)):
        monkeypatch.setattr(minhash, name, value)
    rnd, rows = random.Random(9), []
    for k in range(90):  # pairs of one family lie around the threshold
        own = [f"w{i}" for i in range(100)]
        for i in rnd.sample(range(100), 4 + k % 6):
            own[i] = f"own{k % 40}x{i}"
        rows.append((k, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=1).collect()
    want = brute_components(rows, 1)
    assert 1 < len({c for *_, c in want}) < 90
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_rows_of_large_nodes_are_made_once(spark, monkeypatch):
    """One row a document for the pivots, one a document and node for what is left; two families that pivots link."""
    plans, write = [], minhash.Steps.write
    monkeypatch.setattr(minhash.Steps, "write", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(self, df))
    rows = []
    for k in range(160):
        own = [f"w{k % 2}x{i}" if i % 3 else f"both{i}" for i in range(120)]
        own[k % 120] = f"own{k}"
        rows.append((k, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 1)
    assert sum(p.count("Generate explode(keys") for p in plans) == 1


def test_rows_of_nodes_move_once_a_depth(spark, monkeypatch):
    """Node rows are joined neither with their sizes nor with their parents, and only texts of pairs are sent to be compared."""
    plans, write = [], minhash.Steps.write
    monkeypatch.setattr(minhash.Steps, "write", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(self, df))
    rows = [(k, " ".join(f"own{k}" if i == k % 110 else f"w{k % 3}x{i}" for i in range(110))) for k in range(150)]
    rows += [(1000 + k, " ".join(f"u{k}x{i}" for i in range(30))) for k in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 1)
    assert not any("parent#" in line or "size#" in line for p in plans for line in p.splitlines() if "Join " in line or line.lstrip(" :+-").startswith("Filter (size"))
    assert any("bitmap_construct_agg" in p for p in plans)


@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_nodes_across_batches_meet_as_if_in_one(batch):
    """Nodes of 1 to 9 rows, up to four of them compared in full."""
    rng, rows = np.random.default_rng(3), []
    for key in range(60):
        high, low = rng.integers(1 << 62, size=2)
        for i in range(key % 9 + 1):
            rows.append((key, 100 * key + i, 10 - (i == 3) * 5, int(high) ^ (1 << i), int(low) ^ (2 << i)))
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    whole = pa.RecordBatch.from_arrays(columns, names=minhash.NODE)
    batches = [whole.slice(i, batch) for i in range(0, len(rows), batch)]
    out = [tuple(r.values()) for b in minhash._meet(4, 3, (80, 100))(iter([*batches, whole.slice(0, 0)])) for r in b.to_pylist()]
    sizes = {key: key % 9 + 1 for key in range(60)}
    want = [(r[1], r[0], True) for r in rows if sizes[r[0]] > 4]
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[1] < y[1] and sizes[x[0]] <= 4 and 5 * min(x[2], y[2]) >= 4 * max(x[2], y[2]):
                if (x[3] ^ y[3] | x[4] ^ y[4]).bit_count() <= 3:
                    want.append((x[1], y[1], False))
    assert sorted(out) == sorted(want) and any(not large for *_, large in want)


def test_texts_of_pairs_are_found_without_an_exchange(spark):
    docs = spark.range(20_000).selectExpr("xxhash64(id) uid", "string(id) text")
    some = docs.filter("text % 50 = 0")
    got = minhash._wanted(docs, some)
    assert got.join(some, "uid", "left_semi").count() == 400 and got.count() < 1_500
    assert minhash._wanted(docs, some.limit(0)).count() == 0
    assert minhash._wanted(docs, docs).count() == 20_000


def test_parts_of_a_node_beside_its_largest_component(spark):
    rows = spark.createDataFrame([(1, r, c) for r, c in enumerate([7, 7, 7, 8, 9])] + [(2, r, 7) for r in range(4)], "key long, rep long, component long")
    assert [tuple(r) for r in minhash._apart(rows).collect()] == [(1, 7, 2)]


def test_parities_lose_no_pair_at_the_threshold_and_leave_few_others(spark):
    rng, rows = np.random.default_rng(1), []
    for k in range(600):
        both = 4 * int(rng.integers(1, [5, 100, 3000][k % 3]))
        apart = both // 4 if k % 2 else both // 2  # similarity of 4/5 or 2/3
        left = int(rng.integers(0, apart // 5 + 1)) if k % 2 else apart // 2
        s = rng.integers(1 << 63, size=both + apart, dtype=np.uint64)
        a, b = np.unique(s[: both + left]), np.unique(np.concatenate([s[:both], s[both + left :]]))
        rows.append((k % 2 == 1, both, (len(a), minhash._bits(a).tolist()), (len(b), minhash._bits(b).tolist())))
    side = "struct<n: bigint, bits: array<bigint>>"
    got = spark.createDataFrame(rows, f"near boolean, both int, a {side}, b {side}").withColumn("ok", minhash._close("a", "b", (80, 100))).collect()
    assert all(r.ok for r in got if r.near)
    middle = [r.ok for r in got if not r.near and 100 < r.both < 2000]
    assert len(middle) > 50 and sum(middle) < 0.02 * len(middle)


def test_one_of_equal_rows_is_chosen_alike_on_every_run(spark):
    rows = [(1, "a b c d e f", f"s{i}") for i in range(20)]
    kept = [
        minhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n), width=2).collect()
        for order, n in ((rows, 1), (rows[::-1], 5))
    ]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_near_duplicates_on_odd_rows(spark, odd_documents):
    got = minhash.near_duplicates(odd_documents, width=2).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)
    assert minhash.near_duplicates(odd_documents.limit(0)).count() == 0
    kept = minhash.keep_one(odd_documents, width=2)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 8, 10, 12, None]))


def brute_repeats(rows, window):
    first, out = {}, []
    for k, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    for k, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(k), len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "anchor"), [(50, 8), (6, 2)])
def test_repeats_equal_brute_force(spark, documents, window, anchor):
    got = substring.remove_repeats(documents, window=window, anchor=anchor).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([(r.doc_id, r.text) for r in documents.collect()], window)
    assert all(r.n_removed == 0 or hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_few_words_have_many_branches(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60)))) for k in range(80)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=6, anchor=2).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, 6)


def test_common_passages_are_one_row_a_text(spark, monkeypatch):
    made, write = [], substring.Steps.write

    def counted(self, df):
        out = write(self, df)
        if {"id", "th"} < set(out.columns) and not {"anchor", "e1"} & set(out.columns):
            made.append(out.count())
        return out

    monkeypatch.setattr(substring.Steps, "write", counted)
    passage = [f"all{i}" for i in range(20)]
    rows = [(k, " ".join([*passage[: 20 - k % 2 * 3], *([f"end{k % 3}"] if k % 2 else []), *[f"own{k}x{i}" for i in range(k % 9)], *passage[:12]])) for k in range(90)]
    rows += rows[40:44] + [(50, rows[3][1]), (None, rows[3][1]), (200, None), (201, "")]
    docs, most = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []
    for share in (1, 50):  # no path, and most of them
        made.clear()
        monkeypatch.setattr(substring, "COMMON", share, raising=False)
        got = substring.remove_repeats(docs, window=6, anchor=2).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_repeats(rows, 6)
        most.append(max(made))
    assert most[1] < 0.4 * most[0]


def test_repeats_on_odd_rows(spark, odd_documents):
    docs = odd_documents.withColumnRenamed("size", "n_removed")
    got = substring.remove_repeats(docs).collect()
    want = brute_repeats([(r.doc_id, r.text) for r in odd_documents.collect()], 50)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert {r.text for r in got if r.doc_id == 3} == {None} and {r.text for r in got if r.doc_id == 5} == {" \t\n "}
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    rows = [
        (1, "http://a/1", big), (5, "http://a/ü\r\nX: y", big), (3, None, big), (4, "u", small), (6, "u", small), (7, "u", None),
        (8, "u", ""), (None, "u", big), (5, "http://a/5", big), (9, "u", "y" * 2_000_000), (10, "u", "WARC/1.0\r\n\r\n" * 100),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record_type")
    archives = warc.write_archives(pages.repartition(3), archive_bytes=5000)
    got = warc.read_archives(archives).collect()
    assert sum(r.records for r in archives.collect()) == len(got) == len(rows) and all(r.digest_ok for r in got)
    raw = {(k, h or "") for k, _, h in rows}
    for r in got:
        target = 5 if r.key in (1, 3, None) else None
        assert r.record_type == ("revisit" if target else "response") and r.refers_to == target
        if not target:
            assert (r.key, r.payload.decode()) in raw
            assert r.payload_bytes == len(r.payload) and r.payload_digest == hashlib.sha1(r.payload).hexdigest()
        else:
            assert r.payload_bytes == len(big.encode()) and r.payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_reader_finds_damage():
    whole = warc.record(1, "u", b"payload", None)
    assert warc.parse(whole)["digest_ok"] and not warc.parse(whole.replace(b"payload", b"pAyload"))["digest_ok"]
    with pytest.raises(ValueError):
        warc.parse(whole[:-1])
    packed = gzip.compress(whole) + gzip.compress(warc.record(2, None, b"", None))
    assert [at for at, _ in warc.members(io.BytesIO(packed))] == [0, len(gzip.compress(whole))]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[:-3])))


def test_targets_share_the_excess_again():
    got = mixing.targets([("b", 100), (None, 10), ("a", 10), ("c", 1000)])
    assert got["a"] == 20 and got[None] == 20 and math.isclose(sum(got.values()), 1.5 * 1120)
    assert all(got[s] <= 2 * n for s, n in [("b", 100), ("c", 1000)])
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.plan_mix(docs, rows_per_bucket=8).collect()
    assert len(rows) == docs.count()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] and r.copies <= 2 for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= max(r["size"] for r in own)
    again = mixing.plan_mix(docs.repartition(7), rows_per_bucket=8).collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}


def test_pivot_keeps_totals_and_expectations():
    size, part = np.array([3.0, 5, 7, 11, 2, 9]), np.array([0.2, 0.7, 0.5, 0.9, 0.4, 0.3])
    rng, total = np.random.default_rng(0), np.zeros(6)
    for _ in range(4000):
        out, held = mixing._pivot(size, part, rng.random(6))
        assert abs(out @ size - part @ size) < 1e-6 and all(k == held or x in (0, 1) for k, x in enumerate(out))
        total += out
    assert np.abs(total / 4000 - part).max() < 0.04


def test_mix_on_odd_rows(spark, odd_documents):
    plan = mixing.plan_mix(odd_documents).collect()
    assert sum(r.same for r in plan) == odd_documents.count() and all(r.copies == 0 for r in plan if r["size"] == 0)
    rows = mixing.mix(odd_documents)
    assert rows.columns == odd_documents.columns and rows.count() == sum(r.same * r.copies for r in plan)
    assert mixing.mix(odd_documents.limit(0)).count() == 0


def odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in np.float32(rng.standard_normal(8))]) for k in range(300)]
    rows += [(k, [0.5] * 8) for k in range(300, 420)]  # many equal vectors
    rows += [(500, None), (501, []), (502, [1.0] * 7 + [None]), (503, [float("nan")] + [1.0] * 7), (504, [float("inf")] * 8), (505, [1.0] * 3)]
    rows += [(None, [1.0] * 8), (550, [0.0] * 8), (50, rows[50][1]), (7, rows[7][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as score"), rows


def brute_search(rows, k, product):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in fine if i % 50 == 0}.items():
        found = sorted((-product(a, b), i) for i, b in fine if i != q and product(a, b) is not None)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)] if product(a, a) is not None else []
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"rows_per_pivot": 20, "block_rows": 16}])
def test_exact_search_equals_brute_force(spark, sizes):
    df, rows = odd_vectors(spark)
    got = knn.top_k(df, lambda i: i % 50 == 0, **sizes).collect()
    want = brute_search(rows, 5, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert knn.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert knn.top_k(df.filter("vec_id = 0"), lambda i: i % 50 == 0).count() == 0


def test_bounds_leave_out_cells(spark):
    """Two far clusters: queries of one need nothing of the other."""
    centre = np.array([[100.0, 0], [-100.0, 0]])
    pairs = knn.needed_cells(centre, {0: 1.0, 1: 1.0}, {0: (50, 1.0, [0.1] * 6), 1: (50, 1.0, [0.1] * 6)}, 5)
    assert pairs == [(0, 0), (1, 1)]


def test_repeated_query_ids_leave_no_neighbour_out(spark):
    """More rows of a query's id than it has neighbours asked for, alone in their cell."""
    rng = np.random.default_rng(3)
    at = lambda x: [x, *[float(y) for y in 0.01 * rng.standard_normal(7)]]
    rows = [(50, [40.0] + [0.0] * 7)] * 12 + [(k, at(16.0)) for k in range(1, 40)] + [(k, at(-16.0)) for k in range(60, 90)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, rows_per_pivot=1).collect()
    want = brute_search(rows, 5, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)))
    assert len(want) == 5 and sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def cosine(a, b):
    n = math.sqrt(a @ a) * math.sqrt(b @ b)
    return a @ b / n if n else None


@pytest.mark.parametrize("shard", [2048, 64])
def test_graph_search_on_odd_rows(spark, shard):
    df, rows = odd_vectors(spark)
    got = hnsw.nearest(df, lambda i: i % 50 == 0, shard_rows=shard).collect()
    want = {(q, n): (i, s) for q, n, i, s in brute_search(rows, 5, cosine)}
    assert {(r.query_id, r["rank"]) for r in got} == set(want)
    right = np.mean([math.isclose(want[r.query_id, r["rank"]][1], r.score, abs_tol=1e-12) for r in got])
    assert right >= 0.9
    assert hnsw.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_graph_search_has_high_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    got = {}
    for r in hnsw.nearest(df, lambda i: i % 50 == 0, shard_rows=128).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(set(sorted((i for i in x if i != q), key=lambda i: -cosine(x[q], x[i]))[:5]) & got[q]) for q in got]
    assert np.mean(hits) >= 4.5


def test_graph_search_finds_near_copies_in_a_full_shard(spark):
    """Groups of near but not equal vectors, as large as a batch, with the parameters in use."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((32, 64)), 64, axis=0) + 0.01 * rng.standard_normal((2048, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, lambda i: i % 5 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, 2048, 5):
        s = unit @ unit[q]
        s[q] = -2
        hits.append(len(set(np.argsort(-s)[:5].tolist()) & got.get(q, set())))
    assert np.mean(hits) >= 4.95
