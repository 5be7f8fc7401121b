"""Byte repeats, hard negatives and filter interactions against brute force and on odd input."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest

from trialweave.llm import negatives, suffix, survival


def brute_bytes(rows, window):
    """Rows of ``key, text``; of several texts of a key none may matter to the other."""
    first = {}
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - window + 1):
            first.setdefault(raw[i : i + window], (k, i))
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - window + 1):
            if k is not None and first[raw[i : i + window]] < (k, i):
                gone[i : i + window] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if raw else 0
        left = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((str(k), len(raw), int(gone[:-1].sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out)


def got_bytes(df, **how):
    rows = suffix.remove_repeats(df, **how).collect()
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes or b"")) for r in rows)


@pytest.mark.parametrize("how", [{}, {"window": 20, "anchor": 8}, {"window": 20, "anchor": 8, "large": 3}])
def test_byte_repeats_equal_brute_force(spark, documents, how):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows = rows if not how else rows[:60]
    got = got_bytes(spark.createDataFrame(rows, "doc_id long, text string"), **how)
    want = brute_bytes(rows, how.get("window", 100))
    assert got == want and sum(w[2] for w in want) > 0


def test_byte_repeats_of_few_letters(spark):
    """Runs, periods and strings that branch everywhere."""
    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 120)))) for k in range(60)]
    rows += [(100 + k, "a" * (30 + 17 * k)) for k in range(6)] + [(200 + k, "abc" * (20 + k) + "é" * 30) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"window": 12, "anchor": 4}, {"window": 12, "anchor": 4, "large": 2}):
        assert got_bytes(df, **how) == brute_bytes(rows, 12)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    """Pieces end at other places in other texts; a repeat across their borders is still found."""
    rnd = random.Random(6)
    size = suffix.SLICE_BYTES
    long = "".join(rnd.choice("abcdefgh") for _ in range(2 * size + 5000))
    rows = [(1, long), (2, "x" * 77 + long[size - 3000 : size + 3000] + "y" * 50), (3, long[5000:])]
    got = {k: (n, gone, spans) for k, n, gone, spans, _, _ in got_bytes(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got["1"][1:] == (0, 0) and got["2"] == (6127, 6000, 1) and got["3"] == (len(long) - 5000, len(long) - 5000, 1)


def test_byte_repeats_on_odd_rows(spark, odd_documents):
    docs = odd_documents.withColumnRenamed("size", "n_spans")
    want = brute_bytes([(r.doc_id, r.text) for r in odd_documents.collect()], 100)
    assert got_bytes(docs) == want
    out = suffix.remove_repeats(docs)
    assert [r.kept_bytes for r in out.filter("doc_id = 3").collect()] == [None]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0 and "kept_bytes" not in suffix.remove_repeats(docs, output="").columns
    two = spark.createDataFrame([(1, "p" * 150), (1, "p" * 150), (1, "q" * 99), (None, "p" * 150)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.remove_repeats(two).collect()) == [("1", 99, 0), ("1", 150, 149), ("1", 150, 149), ("None", 150, 0)]


def test_suffixes_are_in_order():
    rnd = random.Random(1)
    base = bytes(rnd.choice(b"ab") for _ in range(150))
    data = b"".join(base if rnd.random() < 0.5 else bytes(rnd.choice(b"abc") for _ in range(60)) for _ in range(40))
    n = len(data) - 99
    order, same = suffix.deep_shallow(data, np.arange(n), [0, n // 3, n], 100)
    for lo, hi in ((0, n // 3), (n // 3, n)):
        want = sorted(range(lo, hi), key=lambda i: (data[i : i + 100], i))
        assert order[lo:hi].tolist() == want
        assert same[lo + 1 : hi].tolist() == [data[a : a + 100] == data[b : b + 100] for a, b in zip(want, want[1:], strict=False)]
    assert suffix.blind_trie([b"ba", b"aa", b"ba", b"ab"]) == [[1], [3], [0, 2]]


def brute_negatives(rows, positives=5, negatives_=3):
    fine = [(i, l, np.floor(256 * np.array(v, float))) for i, v, l in rows if i is not None and l is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, x in {(i, l): (i, l, y) for i, l, y in fine if i % 50 == 0}.values():
        scored = sorted((-int(x @ y), i, l) for i, l, y in fine if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            below = [s for s in scored if s[2] != label and 50 * p >= 100 * s[0] >= 95 * p][:negatives_]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(below)]
    return sorted(out)


def odd_vectors(spark, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, 8))
    rows = [(k, [float(x) for x in np.float32(centre[k % 4] + 0.3 * rng.standard_normal(8))], int(rng.integers(0, 3))) for k in range(700)]
    rows += [(k, [0.5] * 8, k % 2) for k in range(700, 820)]  # many equal vectors
    rows += [(1000, None, 1), (1001, [], 1), (1002, [1.0] * 7 + [None], 1), (1050, [float("nan")] + [1.0] * 7, 1), (1004, [float("inf")] * 8, 1)]
    rows += [(None, [1.0] * 8, 1), (1100, [1.0] * 8, None), (1150, [0.0] * 8, 1), (1200, [1.0] * 8, 77), (50, rows[50][1], rows[50][2]), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as v", "2 as score", "3 as hash", "4 as tree"), rows


@pytest.mark.parametrize("sizes", [{}, {"tree": 4, "block_rows": (64, 64), "rows_per_pivot": 4}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    df, rows = odd_vectors(spark)
    got = negatives.hard_negatives(df, lambda i: i % 50 == 0, **sizes)
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want and len(want) > 50
    assert negatives.hard_negatives(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 0"), lambda i: i % 50 == 0).count() == 0


def test_bounds_spare_scores_and_lose_none():
    """Along a tree, upper bounds are never too low, and a tight group's windows leave far candidates unscored."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = np.floor(256 * np.concatenate([rng.standard_normal((1, 8)) + 0.01 * rng.standard_normal((40, 8))]))
    y = np.floor(256 * rng.standard_normal((500, 8)))
    block = negatives.Block(pa.table({"cid": np.arange(500), "clabel": np.zeros(500, int), "cv": pa.array(y.tolist())}))
    order, up, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and up[0] == -1 and all(up[i] < i for i in range(1, 40))
    assert all(math.isclose(edge[i], np.linalg.norm(x[order[i]] - x[order[up[i]]])) for i in range(1, 40))
    tree = pa.table({"v": pa.array(x[order].tolist()), "up": up, "edge": edge})
    spared = 0
    for i, scored, high in negatives.walk(block, tree, lambda i, low, high: high >= 2.0e5):
        exact = block.x @ x[order[i]]
        assert (high >= exact).all() and (high[scored] == exact[scored]).all() and (scored | (exact < 2.0e5)).all()
        spared += int((~scored).sum())
    assert spared > 5000


def brute_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    for k, q, x in labels:
        good |= {k} if q == 1 and k is not None else set()
        toxic |= {k} if x == 1 and k is not None else set()
    rows = []
    for k, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and least[t] < k}
        rows.append((lang or "", {c for c, f in fails.items() if f}, k in good, k in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, found = [r[1:] for r in rows if r[0] == part], []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone, kept = [r for r in left if c in r[0]], [r for r in left if c not in r[0]]
                fail = sum(c in r[0] for r in own)
                found.append([part, order, step, len(kept), len(gone), fail - len(gone), sum(r[0] == {c} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)])
                left = kept
        shares = {c: sum(f[4] for f in found if f[1][f[2] - 1] == c) for c in "ABCDE"}
        out += [(*f, shares[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def test_audit_equals_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in documents.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert sorted(map(tuple, survival.audit(documents, labels).collect())) == want


def test_audit_on_odd_rows(spark, odd_documents):
    docs = odd_documents.withColumnRenamed("size", "part").unionByName(spark.createDataFrame([(20 + k, "Same # text", "en", "a", 1, "x") for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long, part string"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (3, None, 1), (22, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'a' as part", "1 as alive")
    want = brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert sorted(map(tuple, survival.audit(docs, labels).collect())) == want
    assert survival.audit(docs.limit(0), labels).count() == 0
    bare = brute_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [])
    assert sorted(map(tuple, survival.audit(docs, labels.limit(0)).collect())) == bare


def test_a_hot_text_and_key_are_joined_by_broadcast(spark):
    """More than a thousand copies of one text, and as many rows of one key."""
    rows = [(k, "copy", "en") for k in range(1500)] + [(7000, f"t{k}", "en") for k in range(1500)]
    want = brute_audit(rows, [(7000, 1, 0), (3, 1, 1)])
    labels = spark.createDataFrame([(7000, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, survival.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect())) == want


def test_positional_popcount():
    words = np.random.default_rng(2).integers(0, 2**32, 12345, dtype=np.uint32)
    for n in (0, 1, 2, 3, 4, 7, 100, 12345):
        assert survival.positional_popcount(words[:n]).tolist() == [int((words[:n] >> i & 1).sum()) for i in range(32)]
    table = survival.survival_words()
    assert all(bool(table[m] >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))
