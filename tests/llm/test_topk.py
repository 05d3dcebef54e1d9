"""Exact top-k against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import topk

DDL = "vec_id bigint, embedding array<double>, score string, rank string"


def brute(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if i % 5 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, a in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(a))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5, parts=3, **options):
    frame = spark.createDataFrame([(i, v, "s", "r") for i, v in rows], DDL).repartition(parts)
    return sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 5 == 0, k, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block": 4}])
def test_against_brute_force(spark, options):
    rng = random.Random(61)
    rows = [(i, [rng.gauss(0, 0.5) for _ in range(8)]) for i in range(150)]
    hot = [rng.gauss(0, 0.5) for _ in range(8)]
    rows += [(200 + i, hot) for i in range(90)]  # a third of all rows, all of them tied
    rows += [(400, None), (405, []), (410, [None] * 8), (415, [float("nan")] * 8), (420, [float("inf")] + [0.0] * 7), (None, hot),
             (425, [1.0, 2.0]), (426, [3.0, 4.0]), (430, [0.1] * 3), (500, [3e4] * 8), (505, [-3e7] * 8), (150, hot), (150, hot)]
    assert run(spark, rows, **options) == brute(rows, 5)


def test_few_bins_need_more_rounds(spark, monkeypatch):
    rng = random.Random(62)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(4)]) for i in range(80)]
    monkeypatch.setattr(topk, "BINS", 4)
    monkeypatch.setattr(topk, "CHUNK", 7)
    for k in (1, 3, 200):
        assert run(spark, rows, k) == brute(rows, k)


def test_empty_and_alone(spark):
    assert run(spark, [], parts=1) == [] and run(spark, [(5, [1.0])], parts=1) == []
    assert run(spark, [(5, [1.0]), (6, [2.0])], parts=1) == [(5, 1, 6, 131072)]
