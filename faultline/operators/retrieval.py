"""Hybrid retrieval of many queries at once: BM25, hashed embeddings, fusion, cut-off (R5..R16)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (BM25_EPSILON, CANDIDATES, CONTEXT_CHARS, DENSE_WEIGHT, HASH_DIMS,
                         MAX_DISTANCE, MIN_BM25, RETRIEVE_TOP_K, RRF_CONSTANT,
                         SPARSE_WEIGHT)
from ..functions.text import counted, strip, tokens
from ..sources.materialize import materialize
from .blockmax import MAX_BROADCAST_ROWS, Found, bounded_broadcast, gain, is_small, posting_blocks, top_by_blocks
from .listscore import top_by_groups
from .neighbours import nearest

TERM_BUCKETS = 64

Embedder = Callable[[DataFrame, str, str], DataFrame]


# ------------------------------------------------------------------ embeddings
def _hash_vectors(counts: DataFrame, key: str, dims: int) -> DataFrame:
    """Unit vectors from (key, term, tf): a term's hash names a dimension and a sign."""
    digest = F.md5("term")
    bucket = F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(dims))
    sign = F.when(F.substring(digest, 5, 1) < "8", F.col("tf")).otherwise(-F.col("tf"))
    cells = counts.groupBy(key, bucket.alias("_d")).agg(F.sum(sign).cast("double").alias("_w"))
    rows = cells.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_d", "_w"))))
        .alias("_m"),
        F.sqrt(F.sum(F.when(F.col("_d").isNotNull(), F.col("_w") * F.col("_w")))).alias("_norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(
        F.try_divide(F.try_element_at("_m", i), F.col("_norm")), F.lit(0.0)))
    return rows.select(key, dense.alias("vec"))


def hash_embed(df: DataFrame, key: str, text: str, dims: int = HASH_DIMS) -> DataFrame:
    """(key, vec): signed feature hashing of the tokens, scaled to unit length.

    Terms are counted inside the row; only weights of the few dimensions leave it.
    """
    return _hash_vectors(_term_counts(df, key, text), key, dims)


def _term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, term, tf) of rows with unique keys; counted inside the row, so no text is shuffled."""
    found = tokens(F.col(text))
    return (df.select(key, counted(F.coalesce(found, F.array().cast("array<string>"))).alias("_c"))
            .select(key, F.aggregate("_c", F.lit(0), lambda n, c: (n + c["tf"]).cast("int")).alias("dl"), "_c")
            .select(key, "dl", F.explode_outer("_c").alias("_e"))
            .select(key, "dl", F.col("_e.term").alias("term"), F.coalesce("_e.tf", F.lit(0)).alias("tf")))


def batch_embedder(fn: Callable[[list[str]], list[list[float]]]) -> Embedder:
    """Wrap a model call on a list of texts as an embedder that runs per Arrow batch."""
    def embed(df: DataFrame, key: str, text: str) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({key: b[key], "vec": [list(v) for v in fn(b[text].tolist())]})

        return df.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<double>")

    return embed


# ------------------------------------------------------------------ index
@dataclass(frozen=True)
class Index:
    """Tables of a retrieval index: chunks, term postings, term weights, unit vectors."""

    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    vectors: DataFrame
    avg_length: float
    embedder: Embedder = hash_embed


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(chunk_id, term, tf, dl); terms are counted inside the chunk's row.

    A chunk without tokens keeps one row with a NULL term, so it still counts as a chunk.
    """
    return _term_counts(chunks, key, text).select(F.col(key).alias("chunk_id"), "term", "tf", "dl")


def corpus_stats(post: DataFrame) -> tuple[int, float]:
    """Number of chunks and their mean length: one aggregate row, evaluated now."""
    row = (post.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg")).first())
    return row["n"], float(row["avg"] or 0.0)


def build_index(chunks: DataFrame, embedder: Embedder = hash_embed) -> Index:
    """Index tables of chunks; postings and term weights are written once."""
    post = materialize(postings(chunks), "postings")
    n, avg_length = corpus_stats(post)
    # The hashing embedder is a function of the term counts, so the texts are not read again for it.
    vectors = (_hash_vectors(post, "chunk_id", HASH_DIMS) if embedder is hash_embed
               else embedder(chunks, "chunk_id", "content").select("chunk_id", "vec"))
    return Index(chunks, post, materialize(term_weights(post, n), "terms"),
                 materialize(vectors, "vectors"), avg_length, embedder)


def term_weights(post: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): Okapi idf, with negative values replaced by a share of the mean."""
    df = (post.filter(F.col("term").isNotNull())
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    raw = df.select("term", "df", (F.log(F.lit(n) - F.col("df") + 0.5)
                                   - F.log(F.col("df") + 0.5)).alias("_raw"))
    floor = raw.agg((F.avg("_raw") * BM25_EPSILON).alias("f")).scalar()
    return (raw.withColumn("_f", floor)
            .select("term", "df", F.when(F.col("_raw") < 0, F.col("_f")).otherwise(F.col("_raw"))
                    .alias("idf")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated query terms count repeatedly."""
    return (queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _gain(avg_length: float) -> Column:
    return F.col("qtf") * F.col("idf") * gain(avg_length)


def term_bucket(term: Column) -> Column:
    """Storage bucket of a term; a stored index keeps the postings of each bucket in a folder."""
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def asked_postings(index: Index, terms: DataFrame) -> DataFrame:
    """Postings that can hold the asked terms: of a stored index, only their buckets are read."""
    if "bucket" not in index.postings.columns:
        return index.postings
    wanted = [r[0] for r in terms.select(term_bucket(F.col("term"))).distinct().collect()]
    return index.postings.filter(F.col("bucket").isin(wanted)).drop("bucket")


def weighted_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf, idf) of the terms the corpus knows, written once."""
    return materialize(query_terms(queries).join(index.terms.drop("df"), "term"), "query-terms")


def bm25_scores(index: Index, terms: DataFrame, few_terms: bool) -> DataFrame:
    """(query_id, chunk_id, bm25_score) of every chunk sharing a term with the query.

    One side is small and is broadcast, the other is placed by its own key: by chunk for few queries
    over a large corpus, by query for many queries over a small one. The sums then need no further
    exchange, and only the k best per task leave it (see `bm25_top`).
    """
    known = asked_postings(index, terms).filter(F.col("term").isNotNull())
    if few_terms:
        asked = F.broadcast(terms.select("term").distinct())
        pairs = (known.join(asked, "term", "left_semi").repartition("chunk_id")
                 .join(F.broadcast(terms), "term"))
    else:
        pairs = terms.repartition("query_id").join(F.broadcast(known), "term")
    return (pairs.groupBy("query_id", "chunk_id")
            .agg(F.sum(_gain(index.avg_length)).alias("bm25_score")))


def known_postings(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the asked terms only: no other ones are shuffled."""
    return asked_postings(index, terms).join(bounded_broadcast(terms.select("term").distinct()), "term", "left_semi")


def group_search(index: Index, terms: DataFrame, k: int, **options) -> DataFrame:
    """The k best chunks of each query, and others, by groups of chunks (see `listscore`)."""
    asked = bounded_broadcast(terms.select("term").distinct())
    n = index.terms.join(asked, "term", "left_semi").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return top_by_groups(known_postings(index, terms), terms, k, index.avg_length, n, terms.count(), **options)


def block_search(index: Index, terms: DataFrame, k: int, **options) -> Found:
    """The k best chunks by blocks of postings, and how many blocks were read."""
    known = known_postings(index, terms)
    return top_by_blocks(materialize(posting_blocks(known, index.avg_length), "posting-blocks"), terms, k, **options)


def bm25_top(index: Index, queries: DataFrame, k: int = CANDIDATES, terms: DataFrame | None = None,
             max_rows: int | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25_score, sparse_rank): the k best chunks, ties by chunk id.

    Chunks and queries meet in groups of bounded size (see `listscore`). With `max_rows` given, and more
    query terms and more postings than that, postings are read block by block instead, and most blocks
    aren't (see `blockmax`). A query matching fewer than k chunks is filled with the first unmatched chunks at score 0; those are always among the k
    lowest chunk ids, so the fill needs k constants and no pairing of tables.
    """
    terms = weighted_terms(index, queries) if terms is None else terms
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25_score", 9)), "chunk_id")
    if max_rows is None or is_small(terms, max_rows) or is_small(index.postings, max_rows):
        scores = group_search(index, terms, k)
    else:
        scores = block_search(index, terms, k).top
    found = scores.withColumn("sparse_rank", F.row_number().over(order)).filter(F.col("sparse_rank") <= k)
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("sparse_rank", "chunk_id", "bm25_score"))).alias("_hit"))
    lowest = (index.chunks.select("chunk_id").orderBy("chunk_id").limit(k)
              .agg(F.collect_list("chunk_id").alias("ids")).scalar())
    kind = "array<struct<chunk_id:bigint,bm25_score:double>>"
    hit = F.coalesce(F.transform("_hit", lambda h: F.struct(h["chunk_id"], h["bm25_score"])).cast(kind),
                     F.array().cast(kind))
    spare = F.transform(
        F.array_except(F.sort_array("_low"), F.transform(hit, lambda h: h["chunk_id"])),
        lambda c: F.struct(c.alias("chunk_id"), F.lit(0.0).alias("bm25_score"))).cast(kind)
    ranked = F.slice(F.concat(hit, spare), 1, k)
    return (queries.select("query_id").join(lists, "query_id", "left").withColumn("_low", lowest)
            .select("query_id", F.posexplode(ranked).alias("_n", "_h"))
            .select("query_id", "_h.chunk_id", "_h.bm25_score", (F.col("_n") + 1).alias("sparse_rank")))


def dense_top(vectors: DataFrame, query_vectors: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, dense_distance, dense_rank): squared L2, nearest first."""
    near = nearest(query_vectors.select(F.col("query_id").alias("id"), "vec"),
                   vectors.select(F.col("chunk_id").alias("id"), "vec"), k)
    return near.select("query_id", F.col("point_id").alias("chunk_id"),
                       (F.col("distance") * F.col("distance")).alias("dense_distance"),
                       F.col("rank").alias("dense_rank"))


# ------------------------------------------------------------------ queries
def split_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searchable queries, and rejected ones with the reason."""
    text = strip(F.coalesce("query", F.lit("")))
    reason = (F.when(F.col("query").isNull(), F.lit("Query must be a string."))
              .when(text == "", F.lit("Query cannot be empty."))
              .when(F.size(tokens(F.col("query"))) == 0, F.lit("Query has no searchable terms.")))
    judged = queries.withColumn("reason", reason)
    return (judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL"))


# ------------------------------------------------------------------ hybrid
def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (R10, J7); ties keep dense order first."""
    def part(weight: float, rank: str) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(float(RRF_CONSTANT)) + F.col(rank)), F.lit(0.0))

    both = dense.join(sparse, ["query_id", "chunk_id"], "full_outer")
    return both.withColumn("rrf_score", part(DENSE_WEIGHT, "dense_rank")
                           + part(SPARSE_WEIGHT, "sparse_rank"))


def retrieve(index: Index, queries: DataFrame, top_k: int = RETRIEVE_TOP_K,
             max_distance: float = MAX_DISTANCE, min_bm25: float = MIN_BM25,
             candidates: int = CANDIDATES) -> DataFrame:
    """Hits per query: rank, source, chunk_id, dense_distance, bm25_score, content.

    `queries` carries (query_id bigint, query string). A fused candidate stays when it is close
    enough or its BM25 score is high enough; the first `top_k` of those are the hits.
    """
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a positive integer.")
    asked, _ = split_queries(queries)
    terms = weighted_terms(index, asked)
    # At most `candidates` rows per query: written, because the fusion reads both lists twice.
    sparse = materialize(bm25_top(index, asked, candidates, terms), "sparse")
    probes = index.embedder(asked, "query_id", "query")
    dense = materialize(dense_top(index.vectors, probes, candidates), "dense")

    # BM25 of chunks only the dense side proposed: their postings against the query's own terms.
    lone = dense.join(sparse, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id")
    extra = (asked_postings(index, terms).join(bounded_broadcast(lone), "chunk_id").join(terms, ["query_id", "term"])
             .groupBy("query_id", "chunk_id").agg(F.sum(_gain(index.avg_length)).alias("_extra")))
    fused = (fuse(dense, sparse).join(extra, ["query_id", "chunk_id"], "left")
             .withColumn("bm25_score", F.coalesce("bm25_score", "_extra", F.lit(0.0))))
    close = F.coalesce(F.col("dense_distance") <= max_distance, F.lit(False))
    kept = fused.filter(close | (F.col("bm25_score") >= min_bm25))
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("rrf_score", 12)), F.asc_nulls_last("dense_rank"), "sparse_rank")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    # At most `top_k` rows per query: where that is few, the texts stay where they are.
    best = materialize(best, "best")
    texts = index.chunks.select("chunk_id", "source", "content")
    return texts.join(bounded_broadcast(best), "chunk_id").select(
        "query_id", "rank", "source", "chunk_id", "dense_distance", "bm25_score", "rrf_score",
        "content")


def retrieval_stats(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Number of results and sources in rank order, per query."""
    per = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("rank", "source"))).alias("s"))
    return (queries.select("query_id", "query").join(per, "query_id", "left")
            .select("query_id", "query",
                    F.coalesce("n", F.lit(0)).cast("long").alias("number_of_results"),
                    F.coalesce(F.transform("s", lambda x: x["source"]),
                               F.array().cast("array<string>")).alias("sources")))


def context_blocks(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context): source blocks in rank order within a character budget."""
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.col("source"),
                     F.lit("]\n"), F.col("content"))
    upto = (Window.partitionBy("query_id").orderBy("rank")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = (hits.withColumn("_b", block).withColumn("_sum", F.sum(F.length("_b")).over(upto))
            .filter((F.col("rank") == 1) | (F.col("_sum") <= budget)))
    return kept.groupBy("query_id").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "_b"))), lambda x: x["_b"]), "\n\n")
        .alias("context"))
