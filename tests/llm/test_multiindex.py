"""Near duplicates of embeddings against all pairs."""

import math

import numpy as np
import pytest

from faultline.llm import multiindex

DDL = "vec_id bigint, embedding array<double>, label int, n_links string, kept string"


def run(spark, rows, parts=3, **options):
    frame = spark.createDataFrame([(i, v, g, "n", "k") for i, v, g in rows], DDL).repartition(parts)
    return sorted(map(tuple, multiindex.near_duplicates(frame, **options).collect()), key=str)


def brute(rows, cosine=0.98):
    """Rows and the number of links among them."""
    def fits(v, g):
        return g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    usable = [k for k, (i, v, g) in enumerate(rows) if i is not None and fits(v, g)]
    links = {k: set() for k in usable}
    for k in usable:
        for j in usable:
            a, b = rows[k], rows[j]
            if j != k and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / np.abs(a[1]).max(), np.array(b[1]) / np.abs(b[1]).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[k].add(j)
    out, least = [], {}
    for k in usable:
        if k not in least:
            seen, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            least |= dict.fromkeys(seen, min(rows[j][0] for j in seen))
    for k, (i, _, _) in enumerate(rows):
        c = least.get(k, i)
        out.append((i, len(links.get(k, ())), c, i is None or c == i))
    return sorted(out, key=str), sum(map(len, links.values())) // 2


def planted(seed, size=16, groups=(1, 1, 2, 3, 40, 90), noise=0.02, alone=150):
    rng, rows = np.random.default_rng(seed), []
    for g, members in enumerate(groups):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        for _ in range(members):
            away = rng.normal(size=size)
            rows.append(((centre + noise * away) * rng.uniform(0.5, 2)).tolist())
    rows += rng.normal(size=(alone, size)).tolist()
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[k], int(rng.integers(0, 2)) if k % 7 == 0 else 1) for i, k in enumerate(order)]


ODD = [(1001, None, 1), (1002, [], 1), (1003, [0.0] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, [float("inf")] + [0.0] * 15, 1),
       (1006, [None] * 16, 1), (1010, [1.0, 2.0], 1), (1011, [2.0, 4.0], 1), (1012, [3.0], 1), (1013, [0.5], 1), (1014, [-1.0], 1),
       (1020, [1e300] * 16, 1), (1021, [1e-300] * 16, 1), (None, [1.0] * 16, 1), (1030, [1.0] * 16, None), (1031, [1.0] * 16, None)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # several blocks of residents and visitors in each cell, many cells
        for name, value in (("RESIDENTS", 16), ("VISITORS", 24), ("CHUNK", 5), ("CELL_ROWS", 2), ("SAMPLE", 100)):
            monkeypatch.setattr(multiindex, name, value)
    rows = planted(1) + ODD
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [rows[5], rows[8]]  # copies, repeated rows
    want, links = brute(rows)
    assert links > 2_000
    assert run(spark, rows, recall=1.0) == want


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold in random directions; other vectors are far."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x, y = rng.normal(size=(2, 32))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        near = 0.981 * x + math.sqrt(1 - 0.981**2) * y
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, near.tolist(), 0)]
    found = run(spark, rows)
    assert sum(n for _, n, _, _ in found) >= 2 * 0.99 * 400
    assert all(c == i - i % 2 or n == 0 for i, n, c, _ in found)


def test_traversal_ends_early():
    """Cells are taken by distance, and few of them are needed."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = multiindex.fit_grid(x, 16, 0.98, 0.99)
    first, second, _, _ = grid.excess(x)
    visited = (first[:, :, None] + second[:, None, :] <= grid.reach).mean()
    assert visited < 0.25


def test_chain_over_cells_and_edges():
    links = np.zeros((5, 5), bool)
    links[[0, 0, 1, 1, 3], [0, 1, 1, 2, 4]] = True
    dense = np.ones((40, 30), bool)
    for matrix in (links, dense, np.kron(np.eye(3, dtype=bool), np.ones((20, 20), bool))):
        left, right = np.arange(matrix.shape[0]), 100 + np.arange(matrix.shape[1])
        edges = multiindex.joining(matrix, left, right)
        assert len(edges) <= 4 * sum(matrix.shape)
        from faultline.llm.components import Forest
        got, want = Forest(), Forest()
        for a, b in edges:
            got.join(int(a), int(b))
        for a, b in zip(*np.nonzero(matrix), strict=True):
            want.join(int(left[a]), int(right[b]))
        assert {x: got.root(x) for x in list(want.up)} == {x: want.root(x) for x in list(want.up)}


def test_empty_and_alone(spark):
    assert run(spark, [], 1) == [] and run(spark, [(4, [1.0, 0.5], 2)], 1) == [(4, 0, 4, True)]
    assert run(spark, ODD[:6], 1) == brute(ODD[:6])[0]
