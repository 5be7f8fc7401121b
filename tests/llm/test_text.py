"""Tokenizers, classifiers and word helpers against their references and on odd input."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from trialweave.llm import bpe, langid, quality, unigram
from trialweave.llm.words import slices

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")
PIECES = vocabularies.path("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab Z9'\n\t\r\x0b\x1c\x85  ,.!éß中🙂▁the "), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, vocabularies.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=500, deadline=None)
@given(text=TEXT)
def test_bpe_equals_reference(codec, reference, text):
    ids = codec.encode(text)
    assert ids == ",".join(map(str, reference.encode_ordinary(text)))
    assert codec.decode(ids) == text.encode()


def test_perfect_hash_has_no_empty_slot(codec):
    whole = codec.whole
    assert len(whole.key) == len(codec.ranks) and set(whole.key) == set(codec.ranks)
    assert all(whole.get(k) == r for k, r in codec.ranks.items())
    assert whole.get(b"surely no token of any vocabulary") is None
    assert bpe.PerfectHash({}).get(b"a") is None


def test_bpe_on_odd_rows(spark, odd_documents, reference):
    rows = bpe.encode(odd_documents.withColumnRenamed("size", "n_tokens"), RANKS, vocabularies.PATTERN).collect()
    assert len(rows) == odd_documents.count() and "text" not in rows[0]
    texts = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    for r in rows:
        want = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(odd_documents.limit(0), RANKS, vocabularies.PATTERN).count() == 0


def test_a_long_word_is_merged_quickly(codec, reference):
    word = "abcdefghijklm" * 4000
    assert codec.encode(word) == ",".join(map(str, reference.encode_ordinary(word)))


@pytest.fixture(scope="module")
def unigram_reference():
    pieces = unigram.read_pieces(PIECES)
    low = min(pieces.values())
    vocabulary = [("<unk>", low), *((f"<0x{i:02X}>", low) for i in range(256)), *pieces.items()]
    out = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    out.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return out


@settings(max_examples=500, deadline=None)
@given(text=TEXT)
def test_unigram_counts_equal_reference(unigram_reference, text):
    assert unigram.counter(PIECES).count(text) == len(unigram_reference.encode(text).ids)


def test_unigram_ties_go_to_the_piece_that_starts_first():
    # "ab" + "c" and "a" + "bc" tie, as do "abc" and both: the longest piece at an end comes first and stays.
    count = unigram.Counter({"▁": 0.0, "a": -1.0, "ab": -2.0, "b": -1.0, "bc": -2.0, "c": -1.0, "abc": -3.0})
    assert count.pieces("▁abc") == 2
    with pytest.raises(ValueError):
        unigram.Counter({"a▁b": 0.0})
    assert unigram.Counter({}).count("éa") == 3 + 2 + 1


def test_unigram_on_odd_rows(odd_documents, unigram_reference):
    rows = unigram.count_tokens(odd_documents, PIECES).collect()
    texts = {r.doc_id: r.text or "" for r in odd_documents.collect()}
    assert all(r.n_tokens == len(unigram_reference.encode(texts[r.doc_id]).ids) for r in rows) and len(rows) == odd_documents.count()
    assert unigram.count_tokens(odd_documents.limit(0), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_texts(texts):
    found = []
    for _, _, w in slices(pa.array(texts, pa.string()), size=40):
        for a, b in zip(w.texts[:-1], w.texts[1:], strict=True):
            found.append([w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)])
    assert found == [(t or "").encode().split() for t in texts]


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_quality_on_held_out_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.score(docs.select("doc_id", "text"), model).collect() if held(r.doc_id) and r.doc_id in known]
    right = np.mean([r.predicted == known[r.doc_id] for r in rows])
    assert right >= 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_on_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 0, 1), (None, 1, 0), (4, None, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd_documents, labels)
    rows = quality.score(odd_documents.withColumnRenamed("size", "score"), model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = quality.train(odd_documents.limit(0), labels.limit(0))
    assert {r.predicted for r in quality.score(odd_documents, nothing).collect()} == {1}
    assert quality.score(odd_documents.limit(0), model).count() == 0


def test_preferred_documents_score_higher():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 5))
    y = (x @ [2, -1, 0, 0, 0] + 0.1 * rng.standard_normal(400) > -1).astype(int)
    model = quality.fit(x, y)
    assert ((model.score(x) >= 0.7) == y).mean() > 0.95


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(docs)
    rows = langid.predict(docs, net).collect()
    right = np.mean([r.lang_pred == r.lang for r in rows if held(r.doc_id)])
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_rows(spark, odd_documents):
    net = langid.train(odd_documents)
    rows = {r.doc_id: r for r in langid.predict(odd_documents.withColumnRenamed("size", "score"), net).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (3, 4, 5))
    assert rows[6].lang_pred in ("de", "en", "es", "fr")
    assert langid.predict(odd_documents.limit(0), net).count() == 0
    none = langid.train(odd_documents.limit(0))
    assert {r.lang_pred for r in langid.predict(odd_documents, none).collect()} == {"und"}


def test_lookup_tables_give_the_responses_of_the_filters():
    net = langid.Network.new(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (3, langid.WINDOW), dtype=np.uint8)
    seen, kept = net.vectors[x], []
    for width, bank, bias in zip(langid.WIDTHS, net.banks, net.biases, strict=True):
        r = np.array([[seen[i, t : t + width].ravel() @ bank for t in range(langid.WINDOW - width + 1)] for i in range(3)])
        kept.append(np.maximum(r.max(axis=1) + bias, 0))
    z = np.exp(np.concatenate(kept, axis=1) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x, net.tables()), z / z.sum(axis=1, keepdims=True), atol=1e-4)
