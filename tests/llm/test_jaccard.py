"""Shingle join against brute force, and its parts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import common, components, jaccard, shingles
from test_pipeline import shingles as plain_shingles

DDL = "doc_id bigint, text string, n string, rep string, token string, component_id string"


def brute(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def corpus(rng):
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5)))
    bases = [[word() for _ in range(n)] for n in (3, 4, 6, 30, 80, 80, 200, 400)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(420):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words = passage + words[:rng.randrange(len(words) + 1)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"DENSE": 0.01, "LEADERS": 1, "FREQUENT": 4, "SHORT": 3, "GROUP": 8},
                                    {"DENSE": 1e9, "FREQUENT": 10, "SHORT": 2, "KNOWN": 50, "COUNTED": 100, "HANDED": 50, "BUCKET": 500}])
def test_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(random.Random(51))
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one "), (1006, "a b c"), (1007, "a b c d"),
           (1008, "w " * 50_000), (1009, "w " * 49_000), (1010, rows[3][1] + " "), (1011, "x" * 3_000_000)]
    frame = spark.createDataFrame([(i, t, *"nrtc") for i, t in rows + odd], DDL)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(frame).collect())
    assert got == brute(rows + odd)


def test_repeated_null_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, "other words of this document here"), (9, "other words of this document here"), (7, text), (7, text), (None, text), (3, "alone")]
    got = jaccard.similarity_components(spark.createDataFrame([(i, t, *"nrtc") for i, t in rows], DDL)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (7, 5), (None, None), (3, 3)}
    empty = spark.createDataFrame([], DDL)
    assert jaccard.similarity_components(empty).collect() == [] and jaccard.keep_one(empty).collect() == []


def test_one_row_stays_of_copies_with_null_and_repeated_ids(spark):
    text, other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    rows = [(None, text), (None, text + " more"), (None, other), (5, other), (5, other), (5, "of the same id"), (9, third), (4, third), (None, None), (None, "")]
    frame = spark.createDataFrame([(i, t, *"nrtc") for i, t in rows], DDL).repartition(3)
    got = jaccard.keep_one(frame)
    assert got.columns == frame.columns
    got = [(r.doc_id, r.text) for r in got.collect()]
    assert len(got) == 6 and {(5, other), (5, "of the same id"), (4, third), (None, None), (None, "")} <= set(got)
    assert sum(i is None and (t or "").startswith(text) for i, t in got) == 1


def test_components_by_stars_and_in_one_task(spark):
    rng = random.Random(52)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 90)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.root(x) for x in list(forest.up)}
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    for local in (1, components.LOCAL_EDGES):
        got = {r.node: r.root for r in components.components(frame, local).collect()}
        assert all(got.get(x, x) == r for x, r in want.items())


def test_components_of_more_nodes_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 8)
    edges = [(9, 1), *((20 + i, 21 + i) for i in range(0, 12, 2)), (9, 2)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartitionByRange(2, "b")
    with common.batch_rows(spark, 1):
        for local in (1, 4, 8, 16):
            got = components.components(frame, local).collect()
            assert sorted((r.node, r.root) for r in got if r.node != r.root) == [(2, 1), (9, 1), *((21 + i, 20 + i) for i in range(0, 12, 2))]
            assert len({r.node for r in got}) == len(got)


def test_sets_of_a_long_text_equal_those_of_a_short_piece(monkeypatch):
    rng = random.Random(53)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(800)) + "  "
    whole = list(shingles.shingle_sets(pa.array([text, None, text[:50]])))
    assert len(whole[0]) == len(plain_shingles(text)) and len(whole[1]) == 0
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(pa.array([text, None, text[:50]])), strict=True))


def test_blocks_lose_no_possible_pair():
    rng = np.random.default_rng(54)
    n, pos = rng.integers(1, 60, 200), rng.integers(0, 9, 200)
    got = set()
    for x, y in jaccard.block_pairs(n, pos, 85):
        got.update((min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True))
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if jaccard.possible(n[i], pos[i], n[j], pos[j], 85)}
    assert want <= got


def test_parity_bits_never_overstate_the_difference():
    rng = np.random.default_rng(55)
    for _ in range(300):
        pool = np.unique(rng.integers(-2**62, 2**62, 400))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 300), replace=False)) for _ in range(2))
        assert jaccard.least_difference(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_answers_from_the_leader_are_exact():
    rng = np.random.default_rng(56)
    for _ in range(60):
        leader = np.unique(rng.integers(0, 10**9, 100))
        sets = []
        for _ in range(20):
            kept = leader[rng.random(len(leader)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 10**9, rng.integers(0, 20))])))
        links = jaccard.group_links(-1, leader, list(range(20)), sets, 85)
        forest, want = components.Forest(), components.Forest()
        for a, b in links:
            forest.join(a, b)
        every = [*sets, leader]
        for i in range(21):
            for j in range(i):
                both = len(np.intersect1d(every[i], every[j]))
                if 100 * both >= 85 * (len(every[i]) + len(every[j]) - both):
                    want.join(-1 if i == 20 else i, j)
        assert all(forest.root(i) == want.root(i) for i in range(-1, 20))


def test_parity_bits_of_many_pairs_equal_those_of_one():
    rng = np.random.default_rng(57)
    sets = [np.unique(rng.integers(-2**62, 2**62, n)) for n in (1, 20, 33, 40, 70, 100, 130, 600)]
    bits = [jaccard.parity_bits(s) for s in sets]
    x, y = (a.ravel() for a in np.indices((8, 8)))
    want = [jaccard.least_difference(bits[i], bits[j]) for i, j in zip(x, y, strict=True)]
    assert jaccard.least_differences(*jaccard.parity_rows(bits), x, y).tolist() == want
    size, rows = jaccard.parity_rows([None, *bits[1:]])
    got = jaccard.least_differences(size, rows, x, y)
    assert [0 if 0 in (i, j) else w for i, j, w in zip(x, y, want, strict=True)] == got.tolist()


def near_copies(rng):
    """A text, and copies with up to four words replaced: the outer ones link with the least changed only."""
    words = [f"w{i}" for i in range(120)]
    yield words
    while True:
        edits = rng.sample(range(120), rng.randint(0, 4))
        yield [f"x{rng.random()}" if k in edits else w for k, w in enumerate(words)]


def test_long_lists_hand_on_only_pairs_that_parity_bits_allow():
    rng = np.random.default_rng(59)
    sets = [np.unique(rng.integers(-2**62, 2**62, 100)) for _ in range(200)]
    sets.append(np.sort(np.append(sets[7][1:], 5)))
    n = [len(s) for s in sets]
    ids, bits = list(range(201)), [jaccard.parity_bits(s) for s in sets]
    group = pa.table({"token": [1] * 201, "id": ids, "n": n, "pos": [0] * 201, "comp": ids, "bits": pa.array(bits, pa.binary())})
    found = jaccard.list_pairs(group, 85)
    assert list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == [(7, 200)]


def test_pairs_of_a_large_group_are_fewer_than_its_square(spark, monkeypatch):
    made, confirmed = [], jaccard.confirmed
    monkeypatch.setattr(jaccard, "confirmed", lambda pairs, *more: made.append(pairs.count()) or confirmed(pairs, *more))
    rows = [(i, " ".join(words)) for i, words in zip(range(500), near_copies(random.Random(58)), strict=False)]
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert made[-1] <= 500 and sum(made) <= 50 * 500
