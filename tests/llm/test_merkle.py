"""The manifest against a plain recursive hash tree."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from faultline.llm import merkle

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, pos string, h string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes):
    """(root, paths): for each node the siblings before and after it, level by level."""
    groups, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(h(*run))
            held.append(sum(groups[at:at + 3], []))
        nodes, groups = above, held
    return nodes[0], paths


def brute(rows, changed):
    """{(doc_id, leaf)}: subroot, root, proof, folded root, verified; `changed` gives a row's text now."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = mine, *grow([leaf(*r) for r in mine])
    root, over = grow([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, over, strict=True):
        mine, subroot, paths = trees[s]
        for r, path in zip(mine, paths, strict=True):
            at = leaf(r[0], changed(r), *r[2:])
            for before, after in path + top:
                at = h(before, at, after)
            out.append((r[0], leaf(*r), subroot, root, h(*(b + a for b, a in path + top)), at, at == root))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "l", "t", "p", "h") for r in rows], DDL).repartition(parts)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = merkle.leaf([text if f == "text" else F.col(f) for f in merkle.FIELDS])
    found = merkle.verified(merkle.manifest(frame, carry={"now": now}), F.col("now"))
    hexed = [merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")]
    return sorted(map(tuple, found.select("doc_id", *hexed, F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256),
                                          merkle.hexed(F.col("folded_root")), "verified").collect()), key=str)


def changed(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return r[1].replace("\n", "") if hit and r[1] is not None else r[1]


def planted(seed, sizes):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "é\U0001F600 x", "line\n" * 3, "w " * 50])
            rows.append((rng.randint(1, 10**6), text, rng.choice([None, "en", ""]), s, rng.choice([None, 0, 7])))
    rows += rows[:5] + [(None, "x\ny", "en", "a", 1), (None, "z", None, "a", 2), (rows[0][0], "other", "en", rows[0][3], 3)]
    return rows


@pytest.mark.parametrize("levels", [7, 2])
def test_against_a_plain_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # two levels: windows of nine leaves, three passes
    monkeypatch.setattr(merkle, "SPAN", 3**levels)
    rows = planted(1, {"a": 100, "b": 1, "c": 3, "d": 4, "e": 9, "f": 10, "": 2, None: 28, "é": 2, "Z": 1, "z\n": 27})
    assert run(spark, rows) == brute(rows, changed)


def test_one_source_and_one_row(spark):
    for rows in (planted(2, {"only": 30}), [(4, "a\n", "en", None, 2)], [(4, "a", None, "s", None), (6, None, "en", "t", 0)]):
        assert run(spark, rows, 1) == brute(rows, changed)


def test_empty(spark):
    assert run(spark, [], 1) == []


def test_windows_are_dealt_by_span(spark):
    """A source with nearly all rows doesn't lie in one task."""
    rows = spark.range(3 * merkle.SPAN).select(F.concat(F.lit("="), F.col("id") % 2).alias("tree"), F.col("id").alias("pos"), F.lit(3 * merkle.SPAN).cast("bigint").alias("n"),
                                               merkle.digest(F.col("id").cast("string")).alias("h"))
    plan = merkle.raise_levels(rows)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(tree#\d+, span#\d+", plan)
