"""Co-training quality classifier: held-out accuracy, exchange of pseudo-labels, edges."""

import random

import numpy as np

from faultline.llm import quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, keep string"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus():
    rng = random.Random(31)
    words = ["the", "garden", "of", "small", "rivers", "and", "light", "over", "old", "stone"]
    docs, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        toxic = not bad and rng.random() < 0.2
        body = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        text = " ".join(w + "$$$" for w in body) if bad else " ".join(body) + "."
        if toxic:
            text += " you horrid fool " + " ".join(rng.choice(words) for _ in range(9)) + " fool"
        docs.append((i, text, "en", "junk" if bad and rng.random() < 0.9 else "web", len(text), "s", "k"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic), "t"))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    odd = [(2000, None, None, None, None, "", ""), (2001, "", "en", "web", 0, "", ""), (2002, "stone " * 60_000, "en", "web", 9, "", ""),
           (2003, docs[0][1], "xx", "new", -5, "", ""), (2003, docs[0][1], "xx", "new", -5, "", ""), (None, docs[1][1], "en", "web", 4, "", "")]
    more = [(5, None, 1, ""), (None, 1, 0, ""), (99_999, 1, 0, ""), (1, labels[0][1], labels[0][2], "")]
    got = quality.score_quality(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS)).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    keep = {r.doc_id: r.keep for r in got}
    held = [(i, "$" not in t and "fool" not in t) for i, t, *_ in docs if i % 2 == 0]
    assert sum(keep[i] == good for i, good in held) >= 0.97 * len(held)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    docs = spark.createDataFrame([(1, "a b", "en", "web", 3, "", "")], DOCS)
    assert [(r.score, r.keep) for r in quality.score_quality(docs, none).collect()] == [(0.5, True)]
    assert quality.score_quality(spark.createDataFrame([], DOCS), none).collect() == []
    one = quality.score_quality(docs, spark.createDataFrame([(1, 0, 0, "")], LABELS)).collect()
    assert [(r.score, r.keep) for r in one] == [(0.0, False)]


def test_exchange_helps_the_view_with_little_evidence():
    rng = np.random.default_rng(5)
    n = 1_500
    truth = (rng.random(n) < 0.5).astype(float)
    first = (2 * truth - 1)[:, None] * 3 + rng.normal(size=(n, 1))
    second = (2 * truth - 1)[:, None] * 1.5 + rng.normal(size=(n, 30))
    y = np.where(np.arange(n) < 60, truth, np.nan)
    held = np.arange(n) % 3 == 0
    views = quality.Views([])

    def accuracy(rounds):
        text, meta, *_ = quality.fit(views, (first, second), y, held, rounds).parts
        return ((text.logit(first) > 0) == truth)[60:].mean(), ((meta.logit(second) > 0) == truth)[60:].mean()

    alone, together = accuracy(0), accuracy(4)
    assert together[0] > 0.97 and together[1] >= alone[1] and together[1] > 0.97
