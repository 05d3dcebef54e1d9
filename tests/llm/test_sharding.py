"""Sharding against brute force."""

import random
import zlib

from faultline.llm import sharding

DDL = "doc_id bigint, text string, shard string, size string"


def best_capacity(sizes, shards):
    def fits(capacity):
        used, fill = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if fill + s > capacity:
                used, fill = used + 1, 0
            fill += s
        return used <= shards
    lo, hi = 1, max(sum(sizes), 1)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def test_cells_reach_the_exact_minimax():
    rng = random.Random(3)
    for trial in range(60):
        groups = sorted((rng.randrange(1 << 60), rng.choice([1, 5, rng.randrange(1, 400)])) for _ in range(rng.randrange(1, 300)))
        shards = rng.randrange(1, 17)

        def histogram(bits, keep, groups=groups):
            cells = {}
            for key, size in groups:
                if keep(key):
                    cells.setdefault(key >> (60 - bits), []).append(size)
            return [(c << (60 - bits), bits, sum(v), len(v), max(v)) for c, v in cells.items()]

        cells = sharding.Cells(histogram(3, lambda k: True))
        while wanted := cells.open_cells(shards):
            bits = min(60, wanted[0][1] + 3)
            wanted = {c for c in wanted if c[1] < bits}
            inside = lambda k, w=wanted: any(c[0] <= k < c[0] + (1 << (60 - c[1])) for c in w)
            cells = sharding.Cells([c for c in cells.rows if c not in wanted] + histogram(bits, inside))
        cuts = cells.cuts(shards)
        loads = [0] * shards
        for key, size in groups:
            loads[sum(key >= c for c in cuts)] += size
        assert max(loads) == best_capacity([s for _, s in groups], shards)


def rows_of(spark, rows):
    return sharding.shard_documents(spark.createDataFrame(rows, DDL), 4).collect()


def test_documents(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", None, "", "x" * rng.randrange(3000), "é" * rng.randrange(50)]), "s", "z") for i in range(400)]
    rows += [(1007, "twice", "s", "z"), (1007, "twice", "s", "z"), (None, "no id", "s", "z"), (900, "long " * 40_000, "s", "z")]
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    byte = {i: (t or "").encode() for i, t, *_ in rows}
    shard_of, loads, slots = {}, [0] * 4, {}
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        assert r["size"] == len(byte[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(byte[r.doc_id])
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # The giant stands alone, the others share the rest evenly.
    giant = shard_of[texts[900]]
    assert loads[giant] == 200_001 and sum(r.shard == giant for r in got) == 1
    others = [x for i, x in enumerate(loads) if i != giant]
    assert max(others) - min(others) < 0.2 * max(others), others


def test_edges(spark):
    assert rows_of(spark, []) == []
    one = rows_of(spark, [(1, None, "", "")])
    assert [(r["size"], r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]
    same = rows_of(spark, [(i, "same", "", "") for i in range(20)])
    assert len({r.shard for r in same}) == 1
