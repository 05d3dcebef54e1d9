"""Wu-Manber decontamination against a plain search."""

import hashlib
import random
import re

from faultline.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, BENCH = "doc_id bigint, text string, items string, hits string", "item_id bigint, text string, window string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, bench):
    w, hit, items = words(doc), set(), set()
    for item, text in bench:
        b = words(text)
        n = min(10, len(b))
        if item is None or not n:
            continue
        for s in range(len(b) - n + 1):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == b[s:s + n]:
                    hit.update(range(at, at + n))
                    items.add(str(item))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(w), len(hit), len(items), digest, bool(hit)


def cases():
    rng = random.Random(8)
    vocabulary = ["a", "b", "C", "é", "İ", "7", "x9"]
    glue = [" ", ", ", "\n", "—", "\x7f", "_", " "]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(glue) for _ in range(n))
    bench = [(i, text(rng.choice([1, 2, 9, 10, 11, 25]) + 2)) for i in range(25)]
    bench += [(30, "one"), (31, ""), (32, None), (None, "a b"), (33, bench[0][1]), (33, bench[0][1]), (2, bench[4][1])]
    docs = [(i, text(rng.randrange(60)) + (rng.choice(bench)[1] or "") + text(5)) for i in range(50)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, text(4000)), (104, "ONE"), (104, "ONE"), (None, bench[0][1])]
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = cases()
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "w") for i, t in bench], BENCH)
    want = sorted(((i is None, i or 0), *brute(t, bench)) for i, t in docs)
    for per_table in (dc.TABLE_WINDOWS, 20):  # one table, and several passes
        rows = dc.passage_report(dc.find_passages(d, b, table_windows=per_table)).collect()
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
        assert got == want
    kept = {r.doc_id for r in dc.drop_contaminated(d, b).collect()}
    assert 104 not in kept and 101 in kept


def test_empty(spark):
    none_d, none_b = spark.createDataFrame([], DOCS), spark.createDataFrame([], BENCH)
    one = spark.createDataFrame([(1, "some words", "", "")], DOCS)
    assert dc.passage_report(dc.find_passages(none_d, none_b)).collect() == []
    assert [r.n_hit for r in dc.passage_report(dc.find_passages(one, none_b)).collect()] == [0]


def test_rows_are_dropped_by_themselves(spark):
    b = spark.createDataFrame([(1, "one two three", "w"), (2, "four five", "w")], BENCH)
    rows = [(None, "say one two three", "x", "y"), (None, "clean", None, "y"), (7, "four five six", "x", None), (7, "clean too", "x", "y"),
            (7, "clean too", "x", "y"), (8, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    for per_table in (dc.TABLE_WINDOWS, 1):
        got = dc.drop_contaminated(d, b, table_windows=per_table)
        assert got.columns == d.columns and got.dtypes == d.dtypes
        assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if "clean" in (r[1] or "clean")), key=str)
