import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions import numeric, ordering, text


def test_round_even_matches_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 0.575, 0.435, 0.145, 0.285, 1.005, -0.125, -2.675, 0.0, 0.325, 99.995]
    values += [rng.randrange(10 ** 4) / 10 ** 4 for _ in range(400)] + [rng.uniform(-50, 50) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for d in (2, 4):
        got = {r.i: r.x for r in df.select("i", numeric.round_even(F.col("v"), d).alias("x")).collect()}
        assert [got[i] for i in range(len(values))] == [round(v, d) for v in values]


def test_round_even_at_every_magnitude(spark):
    rng = random.Random(2)
    values = [2962215.29435, 1e300, -1e17, 4503599627370497.5, 9007199254740993.0, 0.5, 1.5, 2.5, 1e-300, float("inf")]
    values += [round(rng.uniform(-1, 1) * 10 ** rng.randrange(1, 16), 5) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, float("nan")), (-2, None)], "i int, v double")
    for d in (0, 2, 4):
        got = {r.i: r.x for r in df.select("i", numeric.round_even(F.col("v"), d).alias("x")).collect()}
        assert [got[i] for i in range(len(values))] == [round(v, d) if d else float(round(v, 0)) for v in values]
        assert got[-1] != got[-1] and got[-2] is None


def test_percent_of_all_small_ratios(spark):
    ratios = [(e, n) for n in range(1, 401) for e in range(n + 1)]
    df = spark.createDataFrame(ratios, "e int, n int").select("e", "n", numeric.percent(F.col("e") / F.col("n")).alias("p"))
    assert all(r.p == f"{r.e / r.n:.0%}" for r in df.collect())


def test_mask_clean_tokens(spark):
    row = spark.createDataFrame([(
        "blk_-123 at 10.0.0.1:50010 took 123456 and 12",
        "a  \r\n\tb\r---- \n\n\n\n\nc  ",
        "DFS.DataNode.DU.Reserved... café -x- !!! a_b")], "m string, t string, k string").select(
        text.mask(F.col("m")), text.clean_markdown(F.col("t")), text.tokens(F.col("k"))).first()
    assert row[0] == "blk_<id> at <ip> took <n> and 12"
    assert row[1] == "a\n    b\n\nc"
    assert row[2] == ["dfs.datanode.du.reserved", "café", "x", "a_b"]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=4000), np.repeat([1.0, 2.0], [3900, 100])
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)],
                               "a double, b double, c double").repartition(5)
    for q in (0.0, 0.05, 0.5, 0.975, 1.0):
        got = ordering.exact_quantile(df, ["a", "b", "c"], q).first()
        assert got.a == pytest.approx(np.quantile(a, q), abs=1e-12)
        assert got.b == pytest.approx(np.quantile(b, q), abs=1e-12)
        assert got.c is None


def test_quantiles_of_few_rows(spark):
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 20, 87, 100, 333):
        cols = {f"c{i}": rng.normal(size=n) if i else rng.integers(0, 4, n).astype(float) for i in range(4)}
        df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())],
                                   ", ".join(f"{c} double" for c in cols))
        for q in (0.05, 0.5, 0.95):
            got = ordering.exact_quantile(df, list(cols), q).first()
            assert np.allclose([got[c] for c in cols], [np.quantile(v, q) for v in cols.values()])


def test_running_totals_and_numbers(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(5000)
    df = spark.createDataFrame([(float(k), int(k % 7)) for k in keys], "k double, w long").repartition(6)
    got = ordering.running_totals(df, "k", {"w": "cum"}, descending=True).orderBy("k").toPandas()
    w = got["w"].to_numpy()
    assert (got["cum"].to_numpy() == w[::-1].cumsum()[::-1]).all()

    rows = spark.createDataFrame([(f"s{0 if i % 3 == 0 else i % 37:02d}", i) for i in range(1000)],
                                 "g string, n int")           # one group holds a third of the rows
    numbered = ordering.number_rows(rows, ["g", "n"], "id").orderBy("g", "n").toPandas()
    assert numbered["id"].tolist() == list(range(1000))


def test_quantiles_of_hard_values(spark):
    """Wide ranges, ties, infinities and missing values, against numpy's sorted values."""
    rng = random.Random(5)
    columns = {
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)],
        "tied": [float(rng.randint(0, 2)) for _ in range(300)] + [None] * 100,
        "ends": [float("-inf")] * 40 + [float("inf")] * 60 + [rng.uniform(-1, 1) for _ in range(300)],
        "gaps": [float("nan")] * 150 + [None] * 200 + [1.7e308, -1.7e308] * 25,
        "none": [None] * 400,
    }
    frame = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    shares = [0.0, 0.05, 0.31, 0.5, 0.95, 1.0]
    found = ordering.exact_quantiles(frame, list(columns), shares)
    for i, name in enumerate(columns):
        values = sorted(v for v in columns[name] if v is not None and v == v)
        for share, row in zip(shares, found, strict=True):
            if not values:
                assert row[i] is None
                continue
            place = (len(values) - 1) * share
            low, high = values[int(place)], values[min(len(values) - 1, int(place) + 1)]
            want = low if low == high else low + (high - low) * (place - int(place))
            assert row[i] == want or (row[i] != row[i] and want != want)
    one = ordering.exact_quantile(frame, ["tied", "none"], 0.5).first()
    assert one.none is None and one.tied == found[3][1]
