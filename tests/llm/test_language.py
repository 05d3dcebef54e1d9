"""Language identification: held-out accuracy, backoff, edges."""

import random
import zlib

import numpy as np

from faultline.llm import language

DDL = "doc_id bigint, text string, lang string, score string, held_out string"
SYLLABLES = {"xa": ["tion", "er", "the", "ing"], "yb": ["schä", "ung", "keit", "zu"], "zc": ["ción", "ñez", "osa", "llo"]}


def corpus():
    rng = random.Random(13)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 6)))
    rows = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join(word(lang).title() for _ in range(rng.randrange(1, 30))) + ".", lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(1000, None, "xa"), (1001, "", "xa"), (1002, "123 -- ² ½ _", "xa"), (1003, "m²", "xa"), (1004, "thetioner " * 60_000, None),
           (1005, "same the", "xa"), (1005, "same the", "xa"), (None, "schäung", None)]
    frame = spark.createDataFrame([(*r, "s", "h") for r in rows + odd], DDL)
    got = language.predict_languages(frame).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out) > 30
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1003].lang_pred != "und" and by_id[1004].lang_pred == "xa" and by_id[None].lang_pred == "yb"
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} & {1000, 1001, 1002} == set()


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DDL)
    assert language.predict_languages(empty).collect() == []
    alone = spark.createDataFrame([(1, "words", None, "", "")], DDL)
    assert [(r.lang_pred, r.score) for r in language.predict_languages(alone).collect()] == [("und", 0.0)]


def test_backoff_takes_the_longest_known_grams():
    totals = {"word": {"a": 1, "b": 1}, "3": {"a": 1, "b": 1}, "1": {"a": 1, "b": 1}}
    model = language.Model(["a", "b"], totals, {"word": (["one"], np.array([[1.0, 0]])), "3": (["^tw"], np.array([[0, 1.0]])), "1": (["t"], np.array([[1.0, 0]]))})
    scorer = language.Scorer(model)
    assert scorer.predict(["one"])[0][0] == "a"
    assert scorer.predict(["two"])[0][0] == "b"  # by ^tw, although t speaks for a
    assert scorer.predict(["tx"])[0][0] == "a"


def test_counts_are_of_all_texts(spark):
    rows = spark.createDataFrame([("xa", "a b a"), ("yb", "A"), ("xa", None), (None, "a")], "lang string, text string")
    got = rows.filter("lang is not null and text is not null").mapInArrow(language.count_words, "lang string, unit string, n bigint")
    assert sorted(map(tuple, got.groupBy("lang", "unit").sum("n").collect())) == [("xa", "a", 2), ("xa", "b", 1), ("yb", "a", 1)]
