import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.functions.text import tokens
from faultline.operators import blockmax, chunking, listscore, retrieval
from faultline.plans import prepare, round_trips
from faultline.sources import documents, store
from faultline.sources.materialize import materialize
from faultline.sources.tables import runbooks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("kb")
    (base / "disk.md").write_text(
        "# DataNode disk full\n\nSymptom: No space left on device in datanode logs.\n"
        "Check dfs.datanode.du.reserved and run df -h on each volume.\n"
        "## Action\nFree disk space or add volumes, then restart the DataNode.\n")
    (base / "namenode.md").write_text(
        "# NameNode safe mode\n\nNameNode stays in safe mode when block reports are missing.\n"
        "Run hdfs dfsadmin -safemode get to check the state.\n")
    (base / "empty.md").write_text("   \n")
    (base / "bad.md").write_bytes(b"# Bad encoding\n\nCaf\xe9 log line with enough text here.\n")
    (base / "note.txt").write_text("not markdown")
    (base / "sub").mkdir()
    (base / "sub" / "nested.md").write_text(
        "# Nested\n\nBlock corruption detected by fsck in nested docs.\n")
    return str(base)


@pytest.fixture(scope="module")
def index(spark, folder, tmp_path_factory):
    return prepare.index_documents(spark, folder, str(tmp_path_factory.mktemp("idx")), 200, 20)


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")


def test_documents(spark, folder, tmp_path):
    docs = documents.load_documents(spark, folder)
    names = [r.source for r in documents.document_names(docs).collect()]
    assert names == ["bad.md", "disk.md", "namenode.md", "sub/nested.md"]
    assert documents.document_count(docs).first()[0] == 4
    assert documents.skipped_documents(spark, folder).count() == 1
    assert "Caf�" in docs.filter("source = 'bad.md'").first().content
    with pytest.raises(ValueError):
        documents.load_documents(spark, str(tmp_path))


def test_files_of_rows_and_one_reading(spark, tmp_path):
    """Repeated names share a file, null names and texts have one; usable files are not opened again."""
    rows = [("a", "x\ny"), ("b", "same"), ("b", "same"), ("c", None), (None, "z é"), ("d", " \t ")]
    frame = spark.createDataFrame(rows, "name string, text string")
    round_trips._write_files(frame, str(tmp_path / "own"))
    frame.repartition("name").write.partitionBy("name").text(str(tmp_path / "spark"))
    found = {}
    for kind in ("own", "spark"):
        docs = documents.load_documents(spark, str(tmp_path / kind), "*.txt")
        assert not [f for f in docs.inputFiles() if str(tmp_path) in f]
        skipped = documents.skipped_documents(spark, str(tmp_path / kind), "*.txt")
        found[kind] = (sorted((r.source.split("/")[0], r.content) for r in docs.collect()),
                       sorted(r.source.split("/")[0] for r in skipped.collect()))
    assert found["own"] == found["spark"] and len(found["own"][0]) == 3


def test_tasks_list_and_read_the_files(spark, tmp_path, monkeypatch):
    """No file's name goes through the driver; the rows are those of Spark's reader, hidden and empty files left out."""
    names = ["a.md", "sub/deep/b c.md", "_x=1/c.md", "k=v/d.md", "sub/e.txt", ".f.md", "_g.md", "_h/i.md", "sub/.j/k.md", "l.md._COPYING_", "m._COPYING_/n.md", "_metadata/o.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"Caf\xe9 \xc3\xa9 " + name.encode())
    (tmp_path / "none.md").write_bytes(b"")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "sub" / "gone.md").symlink_to(tmp_path / "nothing")
    (tmp_path / "sub" / "same.md").symlink_to(tmp_path / "a.md")
    monkeypatch.setattr(documents, "TASK_FOLDERS", 2)
    monkeypatch.setattr(documents, "BATCH_ROWS", 2)
    every = documents._read(spark, str(tmp_path))
    assert not [f for f in every.inputFiles() if str(tmp_path) in f] and "binaryFile" not in every._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in every.collect())
    assert [r[0] for r in got] == ["_metadata/o.md", "_x=1/c.md", "a.md", "blank.md", "k=v/d.md", "sub/deep/b c.md", "sub/same.md"]
    assert sorted(tuple(r) for r in documents._read(spark, f"file://{tmp_path}/").collect()) == got
    assert [r.source for r in documents.skipped_documents(spark, str(tmp_path)).collect()] == ["blank.md"]
    monkeypatch.setattr(documents, "_opened_folder", lambda *_: None)
    assert sorted(tuple(r) for r in documents._read(spark, str(tmp_path)).collect()) == got


def test_sections(spark):
    text = "intro line here\n# A\none\n## B\ntwo\n```\n# code\n```\n### C\nthree\n# D\nfour\n#no heading\n#### deep"
    docs = spark.createDataFrame([("s", "s", text)], "source string, path string, content string")
    got = [(r.h1, r.h2, r.h3, r.content) for r in chunking.sections(
        chunking.clean_documents(docs)).orderBy("section_no").collect()]
    assert got == [
        (None, None, None, "intro line here"), ("A", None, None, "# A\none"),
        ("A", "B", None, "## B\ntwo\n```\n# code\n```"), ("A", "B", "C", "### C\nthree"),
        ("D", None, None, "# D\nfour\n#no heading\n#### deep")]


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ")):
    """Chunks by a loop over pieces that holds the last ones."""
    if not separators:
        return [text[i:i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)]
    out, held = [], []

    def flush():
        out.append("".join(held))

    head, *rest = text.split(separators[0])
    for piece in [p for p in [head, *(separators[0] + r for r in rest)] if p]:
        if len(piece) >= size:
            flush()
            held = []
            out += plain_split(piece, size, overlap, separators[1:])
            continue
        if held and sum(map(len, held)) + len(piece) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held.pop(0)
        held.append(piece)
    flush()
    return [c for c in (o.strip() for o in out) if c]


def test_size_split_against_a_loop(spark):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "é\U0001F600", " ", " ", "  ", "\n", "\n\n", "\u00a0", "\n\n\n"]
    texts = ["".join(rng.choice([*words, "d" * rng.randint(1, 40)]) for _ in range(rng.randint(5, 200))) for _ in range(200)]
    texts += ["x" * 400, " " * 300, "\n" * 300, "y" * 30 + "\n\n" + "z" * 95]
    for size, overlap in ((30, 7), (50, 0), (20, 19)):
        long = [t for t in texts if len(t) > size]
        rows = spark.createDataFrame(list(enumerate(long)), "i int, t string")
        got = {r.i: r.c for r in rows.select("i", chunking.split_text(F.col("t"), size, overlap).alias("c")).collect()}
        for i, text in enumerate(long):
            assert got[i] == plain_split(text, size, overlap), (size, overlap, text)


def test_long_text_is_split_in_the_row(spark):
    text = " ".join(f"w{i * 7919 % 10_007}" for i in range(20_000))
    rows = spark.createDataFrame([("s", "s", text)], "source string, path string, content string")
    cut = chunking.size_split(rows)
    plan = cut._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert [r.content for r in cut.orderBy("piece_no").collect()] == plain_split(text, 500, 50)


def test_chunks(spark, folder, index):
    rows = index.chunks.orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert [r.source for r in rows] == sorted(r.source for r in rows)
    assert all(20 <= len(r.content) <= 200 for r in rows)
    with pytest.raises(ValueError):
        chunking.size_split(index.chunks, 10, 10)


def test_keyword_match_ignores_case(spark, index):
    hits = retrieval.retrieve(index, ask(spark, "DFS.DataNode.DU.Reserved no space left"), 2,
                              max_distance=-1.0).orderBy("rank").collect()
    assert hits and hits[0].source == "disk.md" and hits[0].bm25_score >= 2


def test_cutoff_and_empty_context(spark, index):
    q = ask(spark, "weather in paris")
    hits = retrieval.retrieve(index, q, max_distance=-1.0, min_bm25=1e9)
    assert hits.count() == 0 and retrieval.context_blocks(hits).count() == 0
    stats = retrieval.retrieval_stats(hits, q).first()
    assert stats.number_of_results == 0 and stats.sources == []


def test_query_validation(spark, index):
    good, bad = retrieval.split_queries(ask(spark, "", "   ", None, "!!!", "disk"))
    assert good.count() == 1 and bad.count() == 4
    for k in (0, True, "3"):
        with pytest.raises(ValueError):
            retrieval.retrieve(index, good, k)


def test_saved_index_gives_the_same_hits(spark, index, tmp_path):
    q = ask(spark, "safe mode block reports", "disk volumes full")
    store.save_index(index, str(tmp_path / "i"))
    again = store.load_index(spark, str(tmp_path / "i"))
    a, b = (sorted(map(tuple, retrieval.retrieve(i, q, max_distance=10.0).collect())) for i in (index, again))
    assert a == b and a
    with pytest.raises(FileNotFoundError):
        store.load_index(spark, str(tmp_path / "none"))


def reference_bm25(docs, query):
    """Plain-Python Okapi scores for one query."""
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: np.log(n - c + 0.5) - np.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
                for t in query) for d in docs]


def test_bm25_against_plain_python(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], rng.integers(1, 30),
                                 p=[0.5, 0.2, 0.1, 0.1, 0.06, 0.04])) for _ in range(40)]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, content string")
    idx = retrieval.build_index(chunks)
    queries = ["aa ff ff", "zz", "ee dd"]
    got = retrieval.bm25_top(idx, ask(spark, *queries), 40).toPandas()
    docs = [t.split() for t in texts]
    for i, q in enumerate(queries):
        want = reference_bm25(docs, q.split())
        mine = got[got.query_id == i].sort_values("chunk_id").bm25_score.to_numpy()
        assert np.allclose(mine, want)
    short = retrieval.bm25_top(idx, ask(spark, "zz"), 10).orderBy("sparse_rank").collect()
    assert [r.chunk_id for r in short] == list(range(10)) and all(r.bm25_score == 0 for r in short)


def test_bm25_placement_does_not_matter(spark, index):
    """Few queries, many queries over a small corpus, and a plain join give the same scores."""
    q = ask(spark, *[t for t in ("disk space volume", "safe mode", "fsck block") for _ in range(60)])
    terms = retrieval.weighted_terms(index, q)
    n_terms, n_post = terms.count(), index.postings.count()
    assert n_terms > n_post
    results = [sorted((r.query_id, r.chunk_id, round(r.bm25_score, 9)) for r in scores.collect())
               for scores in (retrieval.bm25_scores(index, terms, True), retrieval.bm25_scores(index, terms, False),
                              retrieval.block_search(index, terms, 1_000).top)]
    assert results[0] and results[0] == results[1] == results[2]


@pytest.fixture(scope="module")
def topics(spark):
    """An index of 3,000 chunks: common words everywhere, and a word of its own in each hundred of them."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join([*rng.choice(common, rng.integers(5, 40)), *([f"topic{i // 100}"] * int(rng.integers(0, 4)))]) for i in range(3_000)]
    return retrieval.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"))


def test_most_blocks_stay_unread(spark, topics):
    """Queries of common words and a rarer one: the spans without it can't reach the k-th score."""
    q = ask(spark, *[f"c{i % 30} c{(i + 7) % 30} topic{i} topic{i}" for i in range(30)])
    terms = retrieval.weighted_terms(topics, q)
    found = retrieval.block_search(topics, terms, 10)
    reads = found.reads.agg(F.sum("blocks"), F.sum("read")).first()
    assert reads[1] < 0.25 * reads[0]
    want = {(r.query_id, r.chunk_id, round(r.bm25_score, 9)) for r in retrieval.bm25_top(topics, q).collect()}
    assert {(r.query_id, r.chunk_id, round(r.bm25_score, 9)) for r in retrieval.bm25_top(topics, q, max_rows=0).collect()} == want


def test_blocks_with_ties_and_few_matches(spark, topics):
    """All chunks of a word tie, a word of negative weight bounds nothing, and some queries match little."""
    rows = [("aa bb" if i % 2 else "aa") for i in range(400)] + ["zz"]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(rows)), "chunk_id long, content string"))
    q = ask(spark, "aa", "bb", "aa bb", "zz aa", "zz", "nothing")
    for k in (1, 10, 500):
        plain = [tuple(r) for r in retrieval.bm25_top(index, q, k).orderBy("query_id", "sparse_rank").collect()]
        blocks = [tuple(r) for r in retrieval.bm25_top(index, q, k, max_rows=0).orderBy("query_id", "sparse_rank").collect()]
        assert [r[:2] + r[3:] for r in plain] == [r[:2] + r[3:] for r in blocks]
        assert np.allclose([r[2] for r in plain], [r[2] for r in blocks])


@pytest.mark.parametrize("sizes", [{}, {"group_postings": 2_000, "group_terms": 40}])
def test_groups_hold_the_best_and_hand_on_few(spark, topics, sizes):
    """Groups of bounded size, of which each hands on k chunks a query, give the k best of all scores."""
    q = ask(spark, *[f"c{i % 30} c{(i + 7) % 30} c3 topic{i}" for i in range(30)])
    terms = retrieval.weighted_terms(topics, q)
    every = {}
    for r in retrieval.bm25_scores(topics, terms, True).collect():
        every.setdefault(r.query_id, []).append((-round(r.bm25_score, 9), r.chunk_id))
    found = retrieval.group_search(topics, terms, 10, **sizes).collect()
    groups = 1 if not sizes else -(-topics.postings.count() // sizes["group_postings"])
    for query_id, scores in every.items():
        got = sorted((-round(r.bm25_score, 9), r.chunk_id) for r in found if r.query_id == query_id)
        assert got[:10] == sorted(scores)[:10] and len(got) <= 10 * max(groups, spark.sparkContext.defaultParallelism)


def test_groups_with_repeated_and_null_chunks(spark):
    rows = [(None, "aa cc"), (1, "aa bb"), (1, "aa"), (2, "bb"), (3, "dd dd")] + [(i, "ee aa") for i in range(4, 30)]
    index = retrieval.build_index(spark.createDataFrame(rows, "chunk_id long, content string"))
    terms = retrieval.weighted_terms(index, ask(spark, "aa bb", "cc", "dd ee ee"))
    want = {(r.query_id, r.chunk_id): r.bm25_score for r in retrieval.bm25_scores(index, terms, True).collect()}
    got = {(r.query_id, r.chunk_id): r.bm25_score for r in retrieval.group_search(index, terms, 100).collect()}
    assert got == pytest.approx(want) and (1, None) in got


def test_more_groups_shuffle_no_more(spark, topics):
    """Each group leaves its side's shuffle once, in one row, however many groups of the other side it meets."""
    terms = retrieval.weighted_terms(topics, ask(spark, *[f"c{i % 30} topic{i}" for i in range(30)]))
    for sizes in ({"group_postings": 500, "group_terms": 10}, {"group_postings": 500, "group_terms": 60}):
        met = retrieval.group_search(topics, terms, 10, **sizes)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert "explode" not in plan.lower() and plan.count("Join") == 2
        met.collect()
        final = met._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in final and "CoGroup" not in final


def test_floor_of_earlier_groups_loses_nothing():
    """Chunks read one group after the other give the k best of all, by score and chunk."""
    rng = np.random.default_rng(5)
    lists, scores = [], {}
    asked, weights = np.arange(6), rng.uniform(0.1, 2, 6)
    for slot in range(8):
        rows = [(t, c) for t in range(6) for c in range(40) if rng.random() < (0.9 if t < 3 else 0.2) or c == t]
        gains = np.round(rng.uniform(0.1, 1, len(rows)), 1)
        at = np.searchsorted([t for t, _ in rows], np.arange(7))
        lists.append(listscore._Lists(at, np.array([c for _, c in rows]), gains, 40))
        for (t, c), g in zip(rows, gains):
            scores[slot * 40 + c] = scores.get(slot * 40 + c, 0.0) + weights[t] * g
    for k in (1, 5, 50):
        held = []
        for slot, part in enumerate(lists):
            floor = -sorted(held)[k - 1][0] if len(held) >= k else -np.inf
            found, value = listscore._query_best(part, asked, weights, k, floor)
            held += [(-round(v, 9), slot * 40 + int(c)) for c, v in zip(found, value)]
        assert [(s, c) for s, c in sorted(held)[:k]] == sorted((-round(v, 9), c) for c, v in scores.items())[:k]


def test_blocks_of_asked_terms_only(spark, topics):
    """Postings of other terms are neither shuffled nor written."""
    terms = retrieval.weighted_terms(topics, ask(spark, "topic3 c1", "topic3 unknown"))
    held = retrieval.known_postings(topics, terms)
    assert {r.term for r in held.select("term").distinct().collect()} == {"topic3", "c1"}


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "disk full disk"), (2, "disk full disk"), (3, "???")], "k long, t string")
    v = {r.k: np.array(r.vec) for r in retrieval.hash_embed(df, "k", "t").collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-12 and not v[3].any()

    def lengths(texts):
        return [[float(len(t)), 1.0] for t in texts]

    own = retrieval.batch_embedder(lengths)(df, "k", "t").collect()
    assert {(r.k, tuple(r.vec)) for r in own} == {(1, (14.0, 1.0)), (2, (14.0, 1.0)), (3, (3.0, 1.0))}


def test_context_budget(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a", "x" * 50), (1, 2, "b", "y" * 20), (1, 3, "c", "z"), (2, 1, "a", "w" * 90)],
        "query_id long, rank int, source string, content string")
    got = {r.query_id: r.context for r in retrieval.context_blocks(hits, 80).collect()}
    assert got[1] == "[Source 1: a]\n" + "x" * 50 and got[2].endswith("w" * 90)
    both = retrieval.context_blocks(hits, 98).filter("query_id = 1").first().context
    assert both.count("[Source") == 2 and "\n\n[Source 2: b]\n" in both


def test_default_cases_reach_the_floors(spark):
    """Top-1 at least half, top-3 at least four fifths, with the keyword side alone."""
    chunks = materialize(chunking.chunk_documents(runbooks(spark), 400, 40), "t-chunks")
    cases = documents.load_eval_cases(spark)
    idx = retrieval.build_index(chunks)
    summary, rows = prepare.evaluate_retrieval(idx, cases)
    r = summary.first()
    assert r.n_queries == 15 and r.top_1_accuracy >= 0.5 and r.top_k_recall >= 0.8
    assert r.mrr >= r.top_1_accuracy and rows.count() == 15


def test_eval_case_files(spark, tmp_path):
    good, bad, none = tmp_path / "g.json", tmp_path / "b.json", tmp_path / "n.json"
    good.write_text(json.dumps([{"query": "q", "expected_source": "s"}]))
    bad.write_text(json.dumps([{"query": "q"}]))
    none.write_text("[]")
    assert documents.load_eval_cases(spark, str(good)).first().expected_source == "s"
    for path in (bad, none):
        with pytest.raises(ValueError):
            documents.load_eval_cases(spark, str(path))


def test_failed_query_is_a_miss(spark, index):
    cases = spark.createDataFrame([(0, "safe mode", "namenode.md"), (1, "!!!", "disk.md")],
                                  "query_id long, query string, expected_source string")
    summary, rows = prepare.evaluate_retrieval(index, cases)
    assert summary.first().n_queries == 2
    assert not rows.filter("query_id = 1").first().hit_at_k
    assert rows.select(F.size(tokens(F.col("query")))).count() == 2


def test_blocks_are_dealt_out_once_a_wave(spark):
    """Blocks and wanted spans meet by span; the scores of (query, chunk) pairs need no exchange of their own."""
    blocks = spark.createDataFrame([("a", 0, [(1, 0.5), (2, 1.0)]), ("b", 0, [(2, 1.0)]), ("a", 1, [(70, 2.0)])],
                                   "term string, span bigint, entries array<struct<chunk_id:bigint,gain:double>>")
    weights = spark.createDataFrame([(7, "a", 2.0), (7, "b", 1.0), (8, "a", 1.0)], "query_id bigint, term string, weight double")
    wanted = spark.createDataFrame([(7, 0), (8, 1)], "query_id bigint, span bigint")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    for few in (True, False):
        with blockmax.joined_where_dealt(spark):
            scores = blockmax._scores(wanted, weights, blocks, few)
            plan = scores._jdf.queryExecution().executedPlan().toString()
            assert sorted(tuple(r) for r in scores.collect()) == [(7, 1, 1.0), (7, 2, 3.0), (8, 70, 2.0)]
        dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
        assert sum(x.startswith("span#") and "REPARTITION" in x for x in dealt) == 2
        assert not [x for x in dealt if "chunk_id" in x or "term" in x]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
