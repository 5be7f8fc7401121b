"""What classifiers learn from, on rows of their own."""

import numpy as np

from trialweave.llm import quality


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """All rows but held-out ones are in pairs, in groups of any size; the model is that of the rows at hand."""
    rng = np.random.default_rng(5)
    texts = [(k, " ".join(rng.choice(["plain", "words", "of", "a", "town"] if k % 9 else ["$$$", "BUY!!!", "WIN", "now"], 12))) for k in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 9 > 0)) for k, _ in texts], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, "doc_id", "text", "quality")
    used = rows.filter(~quality.held_out("k")).count()
    assert used == rows.count() == docs.filter(~quality.held_out()).count()
    seen = []
    plain = quality._scale
    monkeypatch.setattr(quality, "_scale", lambda n, *more: seen.append(n) or plain(n, *more))
    for group in (quality.GROUP, 100):
        monkeypatch.setattr(quality, "GROUP", group)
        model = quality.train(docs, labels)
        assert seen[-1] == used
        right = [(r.predicted == 1) == (r.doc_id % 9 > 0) for r in quality.score(docs, model).collect()]
        assert np.mean(right) > 0.99
        again = quality.train(docs.repartition(5), labels)
        assert np.array_equal(model.weight, again.weight) and model.threshold == again.threshold


def test_all_rows_are_in_pairs():
    for a, b in ((1, 1), (3, 7), (7, 3), (5, 5)):
        good, bad = np.arange(1, a + 1)[:, None] * 100.0, np.arange(1, b + 1)[:, None] * 1.0
        found = {(int(round(x / 100 + 0.4)), int(round(-x % 100))) for x in quality._pairs(good, bad)[:, 0]}
        assert {g for g, _ in found} == set(range(1, a + 1)) and {w for _, w in found} == set(range(1, b + 1))
