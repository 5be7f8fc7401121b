"""Every stage of the pipeline, and its whole run, against plain Python on odd rows."""

import hashlib
from collections import Counter

import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from test_tables import brute_components
from trialweave.llm import bpe, mixing, quality


@pytest.fixture(scope="module")
def folder(spark, odd_documents, tmp_path_factory):
    """Odd rows, a near copy, a repeated passage and texts of either label."""
    d = str(tmp_path_factory.mktemp("corpus"))
    passage = " ".join(f"Passage{i}" for i in range(60))
    tail = lambda k: " ".join(f"tail{k}x{i}" for i in range(90))
    rows = [(20, f"{passage} {tail(20)}", "en", "a", 1, "x"), (21, f"{tail(21)} {passage} end", "en", "b", 1, "x")]
    rows += [(22, tail(20) + " last", "en", "a", 1, "x"), (23, tail(23), "en", "a", 1, "x"), (24, tail(23) + " last", "en", "c", 1, "x")]
    rows += [(100 + k, f"The plain text number {k} is about the life of a town, and {k * 7} more of it.", "en", "a", 1, "x") for k in range(40)]
    rows += [(200 + k, f"$$$ {k} ### BUY!!! NOW {k * 3} %%% @@@ WIN ||| {k}", "en", "b", 1, "x") for k in range(40)]
    odd_documents.unionByName(spark.createDataFrame(rows, odd_documents.schema)).write.parquet(f"{d}/documents.parquet")
    labels = [(100 + k, 1) for k in range(40)] + [(200 + k, 0) for k in range(40)] + [(None, 1), (100, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def plain_quality(docs, rows, spark, folder):
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.score(quality.features(pa.array([r["text"] for r in rows], pa.string())))
    return [r for r, s in zip(rows, score, strict=True) if s >= model.cut]


def plain_one_of_each(docs, rows, *_):
    named = [r for r in rows if r["doc_id"] is not None]
    least = {k: c for k, _, c in brute_components([(r["doc_id"], r["text"]) for r in named], 5)}
    kept = {(r["doc_id"], r["text"]): r for r in named if least[r["doc_id"]] == r["doc_id"]}
    return [*kept.values(), *(r for r in rows if r["doc_id"] is None)]


def plain_repeats(docs, rows, *_):
    first, out = {}, []
    for r in sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        w = (r["text"] or "").encode().split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), r["doc_id"])
    for r in rows:
        w, gone = (r["text"] or "").encode().split(), set()
        for i in range(len(w) - 49):
            if r["doc_id"] is not None and first[tuple(w[i : i + 50])] < r["doc_id"]:
                gone.update(range(i, i + 50))
        text = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r["text"]
        out.append(tuple((r | {"text": text, "n_chars": None if text is None else len(text)}).values()))
    return out


def plain_mix(docs, rows, *_):
    copies = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.plan_mix(docs).collect()}
    size = lambda r: len((r["text"] or "").encode().split())
    return [tuple(r.values()) for r in rows for _ in range(copies[r["doc_id"], r["source"], size(r)])]


def plain_tokens(docs, rows, *_):
    ranks = bpe.read_ranks(vocabularies.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for r in rows:
        text = r.pop("text") or ""
        ids = reference.encode_ordinary(text)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        out.append((*r.values(), len(ids), *digests, ids))
    return out


def test_every_stage_and_the_whole_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, n = docs.columns, docs.count()
    for (name, stage), plain in zip(corpus_pipeline.STAGES, [plain_quality, plain_one_of_each, plain_repeats, plain_mix, plain_tokens], strict=True):
        got = stage(spark, docs, folder).persist()
        rows = [r.asDict() for r in docs.collect()]
        want = [tuple(r.values()) if isinstance(r, dict) else r for r in plain(docs, rows, spark, folder)]
        frozen = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
        assert Counter(map(frozen, got.collect())) == Counter(map(frozen, want)), name
        if name != "byte-level bpe":
            assert got.columns == names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
            assert name == "source mixing" or 0 < got.count() <= n
        assert Counter(map(frozen, got.collect())) != Counter(map(frozen, map(dict.values, rows))), f"{name} has nothing to do"
        docs, n = got, got.count()
    assert docs.columns == [*[c for c in names if c != "text"], "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == docs.columns
    assert Counter(map(frozen, whole.collect())) == Counter(map(frozen, docs.collect()))
