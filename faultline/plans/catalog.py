"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CAUSES, FEATURES, SIGNAL_NAMES, SIGNALS
from ..functions.numeric import round_even
from ..functions.ordering import exact_quantiles, number_rows
from ..functions.text import clean_markdown, mask, tokens
from ..operators import attribution, chunking, clean, evidence, features, forest, incidents
from ..operators import metrics, neighbours, retrieval, validate
from ..sources import tables as src
from ..sources.materialize import materialize, scratch_path
from ..streaming.windows import epoch_folder, score_batches, stream_features
from . import fixed_forest, prepare, round_trips
from . import investigate as inv

WINDOW = "10min"
STREAM_DAYS, STREAM_FILE_ROWS = 6, 200_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ shared inputs
def raw(spark: SparkSession, sf: str) -> DataFrame:
    return src.log_lines(spark, sf)


def windowed(spark: SparkSession, sf: str) -> DataFrame:
    return clean.preprocess_logs(raw(spark, sf), WINDOW)


def window_table(spark: SparkSession, sf: str) -> DataFrame:
    return features.create_features(windowed(spark, sf))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.number_incidents(materialize(window_table(spark, sf), "features"))


def base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Clean lines and numbered incidents, each written once and shared by the branches of a job."""
    lines = materialize(windowed(spark, sf), "lines")
    table = materialize(features.create_features(lines), "features")
    return lines, incidents.number_incidents(table)


def report_cases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines, inc = base(spark, sf)
    return materialize(inv.collect_cases(lines, inc), "cases"), inc


def stand_in_scores(inc: DataFrame) -> DataFrame:
    """A deterministic score per window, so that everything after the detector can be compared."""
    score = F.least(F.lit(1.0), 0.1 + 0.08 * F.col("logs_per_window") * F.col("error_ratio")
                    + 0.05 * F.col("warning_count") + 0.2 * F.col("fatal_count"))
    rows = inc.select("incident_no", round_even(score, 4).alias("anomaly_score"))
    return rows.withColumn("is_anomaly", F.col("anomaly_score") > 0.5)


def stand_in_contributions() -> list[Column]:
    """Deterministic contributions per feature: alternating sign, growing with the value."""
    return [F.col(c).cast("double") * (0.01 * (i + 1) * (1 if i % 2 == 0 else -1))
            for i, c in enumerate(FEATURES)]


def runbook_index(spark: SparkSession) -> retrieval.Index:
    return retrieval.build_index(materialize(chunking.chunk_documents(src.runbooks(spark)), "chunks"))


def document_index(spark: SparkSession, sf: str) -> retrieval.Index:
    """Whole documents as retrieval units (chunk id = document id)."""
    return retrieval.build_index(src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"),
        F.col("text").alias("content")))


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def joined(col: str, sep: str = " | ") -> Column:
    return F.array_join(F.col(col), sep).alias(col)


def r6(col: str) -> Column:
    return F.round(F.col(col), 6).alias(col)


# ------------------------------------------------------------------ validation
@query
def validate_report(spark, sf):
    return _report_columns(validate.validation_report(raw(spark, sf)))


def _report_columns(report: DataFrame) -> DataFrame:
    return report.select("is_valid", "can_process", joined("errors"), joined("warnings"), joined("missing_columns"),
                         joined("missing_values"), "n_rows", "duplicate_rows", "duplicate_line_ids",
                         "invalid_timestamps", "invalid_log_levels")


@query
def validate_missing_columns(spark, sf):
    """The report of lines without levels and templates: an error names them, and their checks find nothing (V1)."""
    return _report_columns(validate.validation_report(raw(spark, sf).drop("Level", "EventTemplate")))


@query
def validation_gate(spark, sf):
    """Both ways of the gate, for the lines as they are and without a required column (V8)."""
    whole = materialize(raw(spark, sf), "gate-lines")
    parts = [validate.gate(validate.validation_report(df)).withColumn("input", F.lit(name))
             for name, df in (("whole", whole), ("no_level", whole.drop("Level")), ("sound", whole.filter(
                 "pos = 0 AND Level IS NOT NULL AND Time <> '999999'")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def null_counts(spark, sf):
    return validate.null_counts(raw(spark, sf))


@query
def duplicate_rows(spark, sf):
    return validate.duplicate_rows(raw(spark, sf))


@query
def duplicate_line_ids(spark, sf):
    return validate.duplicate_line_ids(raw(spark, sf))


@query
def invalid_timestamps(spark, sf):
    return validate.invalid_timestamps(raw(spark, sf))


@query
def invalid_levels(spark, sf):
    """Every 13th level is spoilt first, so that there is something to find."""
    spoilt = F.when(F.col("LineId") % 13 == 0, F.lit("BOGUS")).otherwise(F.col("Level"))
    return validate.invalid_levels(raw(spark, sf).withColumn("Level", spoilt))


# ------------------------------------------------------------------ cleaning
@query
def clean_logs(spark, sf):
    return clean.clean_logs(raw(spark, sf))


@query
def parsed_logs(spark, sf):
    return clean.parse_timestamp(raw(spark, sf)).select(
        "LineId", "pos", "Date", "Time", "Timestamp", "hour", "minute", "second")


@query
def normalized_levels(spark, sf):
    return clean.normalize_log_level(raw(spark, sf)).select("LineId", "pos", "Level")


@query
def signal_flags(spark, sf):
    flagged = clean.extract_log_features(raw(spark, sf))
    return flagged.select("LineId", "pos", "is_error", "is_warning", "is_info", "is_fatal",
                          *[f"{s}_signal" for s in SIGNAL_NAMES], *[s[2] for s in SIGNALS])


@query
def preprocessed_logs(spark, sf):
    return windowed(spark, sf).select("LineId", "Timestamp", "time_window", "Level", "Component",
                                      "Pid", "EventId", "Content")


@query
def masked_text(spark, sf):
    return raw(spark, sf).select("LineId", "pos", mask(F.col("Content")).alias("masked"))


# ------------------------------------------------------------------ features
@query
def window_features(spark, sf):
    return window_table(spark, sf).select(
        "time_window", *[r6(c) if c.endswith("_ratio") else F.col(c) for c in FEATURES])


@query
def level_counts(spark, sf):
    return incidents.level_counts(windowed(spark, sf))


@query
def signal_counts(spark, sf):
    return incidents.signal_counts(windowed(spark, sf))


@query
def component_lists(spark, sf):
    return incidents.component_lists(windowed(spark, sf)).select("time_window", joined("components"))


@query
def value_counts(spark, sf):
    lines = clean.normalize_log_level(raw(spark, sf))
    parts = [features.top_values(lines, c).select(F.lit(c).alias("column_name"), "value", "n")
             for c in ("Level", "Component", "EventId")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def zscores(spark, sf):
    z = features.zscores(materialize(window_table(spark, sf), "features"))
    return z.select("time_window", *[r6(c) for c in FEATURES])


@query
def feature_quantiles(spark, sf):
    table = materialize(window_table(spark, sf), "features")
    shares = [0.05, 0.5, 0.95]
    rows = [(q, *found) for q, found in zip(shares, exact_quantiles(table, FEATURES, shares), strict=True)]
    return spark.createDataFrame(rows, "q double, " + ", ".join(f"{c} double" for c in FEATURES)).select("q", *[r6(c) for c in FEATURES])


@query
def imputed_features(spark, sf):
    """Bad values (text, NaN, infinity, null) are planted, then coerced and imputed."""
    hour = F.hour("time_window")
    spoilt = {
        "error_count": F.when(hour == 3, F.lit("abc")).otherwise(F.col("error_count").cast("string")),
        "error_ratio": F.when(hour == 4, F.lit(float("nan"))).otherwise(F.col("error_ratio")),
        "warning_ratio": F.when(hour == 5, F.lit(float("inf"))).otherwise(F.col("warning_ratio")),
        "logs_per_window": F.when(hour != 6, F.col("logs_per_window")),
        "fatal_count": F.lit(None).cast("long"),
    }
    table = materialize(window_table(spark, sf).withColumns(spoilt), "spoilt")
    return features.impute(table).select("time_window", *[r6(c) for c in FEATURES])


# ------------------------------------------------------------------ incidents
@query
def incident_list_time(spark, sf):
    return incidents.list_incidents(numbered(spark, sf))


@query
def incident_list_severity(spark, sf):
    return incidents.list_incidents(numbered(spark, sf), limit=100, sort_by="severity")


@query
def incident_count(spark, sf):
    return incidents.incident_count(numbered(spark, sf))


@query
def incident_summary(spark, sf):
    lines, inc = base(spark, sf)
    s = incidents.incident_summary(lines, inc, WINDOW)
    levels = F.transform(F.array_sort(F.map_entries("level_counts")),
                         lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("incident_no", "incident_id", "window_start", "window_end", "n_logs",
                    F.array_join(levels, ",").alias("level_counts"), "n_errors", "n_warnings",
                    "n_fatal", joined("components"),
                    *[F.col("signals").getItem(x).alias(f"{x}_lines") for x in SIGNAL_NAMES])


@query
def incident_lines_chrono(spark, sf):
    lines, inc = base(spark, sf)
    return incidents.incident_lines(lines, inc)


@query
def incident_first_lines(spark, sf):
    lines, inc = base(spark, sf)
    return incidents.incident_lines(lines, inc, limit=2)


@query
def incident_top_lines(spark, sf):
    lines, inc = base(spark, sf)
    return incidents.with_line_totals(incidents.top_lines(lines), inc)


@query
def incident_feature_rows(spark, sf):
    inc = numbered(spark, sf)
    return incidents.incident_features(inc, "inc_3").select(
        "incident_id", "time_window", *[r6(c) if c.endswith("_ratio") else F.col(c) for c in FEATURES])


@query
def resolve_ids(spark, sf):
    """Every incident in four spellings, plus one id past the end and one malformed id each."""
    inc = materialize(numbered(spark, sf), "incidents")
    n = F.col("incident_no").cast("string")
    asked = inc.select(F.explode(F.array(
        F.concat(F.lit("inc_"), n), F.concat(F.lit(" INC "), n, F.lit(" ")),
        F.concat(F.lit("Inc-000"), n), n, F.concat(F.lit("INC-9"), F.lpad(n, 9, "0")),
        F.concat(F.lit("INC-"), n, F.lit("x")))).alias("raw_id"))
    return incidents.resolve_ids(asked, inc)


@query
def similar_incidents(spark, sf):
    inc = materialize(numbered(spark, sf), "incidents")
    return neighbours.similar_incidents(inc).select(
        "incident_no", "rank", "similar_id", "similarity", "window_start", "n_logs", "error_count")


@query
def similar_incidents_blocks(spark, sf):
    """The same with few probes at a time, in many passes over the incidents."""
    inc = materialize(numbered(spark, sf), "incidents")
    return neighbours.similar_incidents(inc, block=512).select(
        "incident_no", "rank", "similar_id", "similarity", "window_start", "n_logs", "error_count")


@query
def similar_incidents_indexed(spark, sf):
    """The same by pivots and rings: blocks that are too far are not read."""
    inc = materialize(numbered(spark, sf), "incidents")
    return neighbours.similar_incidents(inc, indexed=True).select(
        "incident_no", "rank", "similar_id", "similarity", "window_start", "n_logs", "error_count")


# ------------------------------------------------------------------ text
@query
def clean_text(spark, sf):
    """Texts with planted carriage returns, tabs, rules and blank runs are cleaned."""
    d = src.table(spark, sf, "documents")
    dirty = F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n\t---- \r\n\n\n\n"))
    return d.select("doc_id", F.md5(clean_markdown(dirty)).alias("digest"),
                    F.length(clean_markdown(dirty)).alias("n"))


@query
def token_lists(spark, sf):
    d = src.table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"),
                    F.md5(F.array_join("t", " ")).alias("digest"))


@query
def sections(spark, sf):
    parts = chunking.sections(chunking.clean_documents(src.sectioned_documents(spark, sf)))
    return parts.select("source", "section_no", "h1", "h2", "h3",
                        F.length("content").alias("n"), F.md5("content").alias("digest"))


@query
def section_numbers(spark, sf):
    """Sections of at least 20 characters, numbered over all documents."""
    parts = materialize(chunking.sections(chunking.clean_documents(
        src.sectioned_documents(spark, sf))).filter(F.length("content") >= 20)
        .select("source", "section_no"), "sections")
    return number_rows(parts, ["source", "section_no"], "chunk_id")


@query
def chunks(spark, sf):
    return chunking.chunk_documents(src.sectioned_documents(spark, sf)).drop("path")


@query
def document_names(spark, sf):
    d = src.knowledge_documents(spark, sf)
    return d.select("source", F.length("content").alias("n"))


# ------------------------------------------------------------------ retrieval
@query
def term_weights(spark, sf):
    docs = src.table(spark, sf, "documents")
    post = materialize(retrieval.postings(docs, "doc_id", "text"), "postings")
    n, _ = retrieval.corpus_stats(post)
    return retrieval.term_weights(post, n).select("term", "df", r6("idf"))


@query
def text_embeddings(spark, sf):
    d = src.table(spark, sf, "documents").select(F.col("doc_id"), F.col("text"))
    e = retrieval.hash_embed(d, "doc_id", "text")
    return e.select("doc_id", F.posexplode("vec").alias("dim", "v")).select("doc_id", "dim", r6("v"))


@query
def bm25_top(spark, sf):
    top = retrieval.bm25_top(document_index(spark, sf), benchmark_queries(spark, sf))
    return top.select("query_id", "chunk_id", r6("bm25_score"), "sparse_rank")


@query
def bm25_blocks(spark, sf):
    """The same with both sides taken as large: in blocks of postings with a maximum each."""
    top = retrieval.bm25_top(document_index(spark, sf), benchmark_queries(spark, sf), max_rows=0)
    return top.select("query_id", "chunk_id", r6("bm25_score"), "sparse_rank")


@query
def dense_knn(spark, sf):
    e = src.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    near = neighbours.nearest(e, e, 3)
    return near.select("query_id", "rank", "point_id",
                       F.round(F.col("distance") * F.col("distance"), 6).alias("distance"))


@query
def dense_knn_blocks(spark, sf):
    """The same with few probes at a time."""
    e = src.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    near = neighbours.nearest(e, e, 3, block=100)
    return near.select("query_id", "rank", "point_id",
                       F.round(F.col("distance") * F.col("distance"), 6).alias("distance"))


def _hybrid(spark, sf, **options):
    queries = benchmark_queries(spark, sf)
    return retrieval.retrieve(document_index(spark, sf), queries, **options), queries


@query
def hybrid_top(spark, sf):
    hits, _ = _hybrid(spark, sf)
    return hits.select("query_id", "rank", "source", "chunk_id", r6("dense_distance"),
                       r6("bm25_score"), F.round("rrf_score", 9).alias("rrf_score"))


@query
def context_blocks(spark, sf):
    hits, _ = _hybrid(spark, sf)
    out = retrieval.context_blocks(hits)
    return out.select("query_id", F.length("context").alias("n"), F.md5("context").alias("digest"))


@query
def retrieval_stats(spark, sf):
    hits, queries = _hybrid(spark, sf)
    return retrieval.retrieval_stats(hits, queries).select(
        "query_id", "number_of_results", joined("sources"))


def expected_sources(spark, sf):
    """Least document holding each benchmark text.

    A holder contains every inner token of the item, so documents meet items on the item's rarest
    inner token and only those pairs are searched. Items without inner token (of one or two tokens, a
    few short texts) are looked for in every document, in one pass.
    """
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    held = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    items = benchmark_queries(spark, sf).withColumn("t", tokens(F.col("query")))
    middle = F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0)))
    inner = items.select("query_id", F.explode(F.array_distinct(middle)).alias("term"))
    small = retrieval.bounded_broadcast
    counts = (held.join(small(inner.select("term").distinct()), "term", "left_semi")
              .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    rare = (inner.join(counts, "term").groupBy("query_id")
            .agg(F.min_by("term", F.struct("df", "term")).alias("term")))
    pairs = held.join(small(rare), "term").select("query_id", "doc_id")
    found = (pairs.join(docs, "doc_id").join(small(items.drop("t")), "query_id")
             .filter(F.contains("text", F.col("query"))).select("query_id", "doc_id"))
    short = items.filter(F.size("t") < 3).agg(F.collect_list(F.struct("query_id", "query"))).scalar()
    holders = F.filter("short", lambda i: F.contains(F.col("text"), i["query"]))
    found = found.union(docs.withColumn("short", short).select(F.explode(holders).alias("i"), "doc_id")
                        .select("i.query_id", "doc_id"))
    found = found.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return items.join(found, "query_id").select(
        "query_id", "query", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
        .alias("expected_source"))


@query
def retrieval_eval(spark, sf):
    cases = materialize(expected_sources(spark, sf), "cases")
    hits = retrieval.retrieve(document_index(spark, sf), cases.select("query_id", "query"),
                              max_distance=float("inf"), min_bm25=0.0)
    report = metrics.retrieval_report(hits, cases, 3)
    return report.select("n_queries", r6("top_1_accuracy"), r6("top_k_recall"), "top_k", r6("mrr"))


@query
def retrieval_cases(spark, sf):
    cases = materialize(expected_sources(spark, sf), "cases")
    hits = retrieval.retrieve(document_index(spark, sf), cases.select("query_id", "query"),
                              max_distance=float("inf"), min_bm25=0.0)
    return metrics.retrieval_cases(hits, cases).select(
        "query_id", "expected_source", "first_rank", "hit_at_1", "hit_at_k", r6("reciprocal_rank"))


@query
def rejected_queries(spark, sf):
    """User turns, some blanked or reduced to punctuation, that cannot be searched."""
    c = src.user_turns(spark, sf)
    n = F.col("conv_id") * 100 + F.col("turn")
    text = (F.when(n % 5 == 0, F.lit("  \t")).when(n % 7 == 0, F.lit("!!! ??"))
            .when(n % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("text")))
    _, bad = retrieval.split_queries(c.select(n.alias("query_id"), text.alias("query")))
    return bad.select("query_id", "reason")


# ------------------------------------------------------------------ evidence
@query
def suspicious_queries(spark, sf):
    s = evidence.suspicious_signals(incidents.signal_counts(windowed(spark, sf)))
    return (s.select("time_window", F.posexplode("suspicious").alias("no", "s"))
            .select("time_window", (F.col("no") + 1).alias("search_no"), F.col("s.signal").alias("signal"),
                    F.col("s.n").alias("n"), F.col("s.query").alias("query")))


@query
def evidence_query(spark, sf):
    cases, _ = report_cases(spark, sf)
    return cases.select("incident_no", "auto_query")


@query
def log_evidence(spark, sf):
    cases, _ = report_cases(spark, sf)
    return cases.select("incident_no", *[F.col(f"log_{i}") for i in range(len(CAUSES))],
                        *[joined(f"notes_{i}") for i in range(len(CAUSES))], joined("severe_lines"))


@query
def feature_evidence(spark, sf):
    scored = evidence.cause_scores(numbered(spark, sf))
    return (scored.select("incident_no", F.explode("causes").alias("c"))
            .select("incident_no", F.col("c.cause").alias("cause"), F.col("c.direct").alias("points"),
                    F.array_join("c.notes", "; ").alias("notes")))


@query
def root_cause(spark, sf):
    """Verdicts from logs and features alone: no index and no similar incidents are given."""
    cases, inc = report_cases(spark, sf)
    reports = inv.incident_reports(cases, scores=stand_in_scores(inc))
    return _flat_report(reports).select("incident_no", "root_cause", "confidence", "cause_scores",
                                        "explanation", "recommendations")


def _flat(r: DataFrame, *keys: str) -> DataFrame:
    """Reports with their lists and structs as text."""
    known = F.col("cause_scores").isNotNull()
    scores = F.when(known, F.array_join(F.array(*[F.concat(F.lit(f"{c[0]}="), F.format_string(
        "%.2f", F.col("cause_scores").getItem(c[0]))) for c in CAUSES]), ","))
    similar = F.array_join(F.transform("similar_incidents", lambda s: F.concat(
        s["incident_id"], F.lit(":"), F.format_string("%.4f", s["similarity"]))), ",")
    steps = F.array_join(F.transform("plan", lambda s: F.concat(
        s["step"].cast("string"), F.lit(" "), s["tool"], F.lit(": "), s["purpose"])), "\n")
    kinds = F.array_join(F.transform("evidence_details", lambda e: e["type"]), ",")
    factors = F.array_join(F.transform("ml_explanation.top_factors", lambda f: F.concat(
        f["feature"], F.lit(" "), F.format_string("%.4f", f["contribution"] + 0.0))), ", ")
    return r.select(*keys, "incident_id", "window_start", "anomaly_score", "is_anomaly",
                    "root_cause", "confidence", joined("evidence", "\n"), kinds.alias("evidence_types"),
                    joined("explanation", "\n"), joined("recommendations", "\n"),
                    scores.alias("cause_scores"), joined("runbooks", ","),
                    similar.alias("similar_incidents"), joined("limitations", "\n"),
                    F.concat(F.col("ml_explanation.method"), F.lit(": "), factors).alias("ml_explanation"),
                    steps.alias("plan"))


def _flat_report(r: DataFrame) -> DataFrame:
    return _flat(r, "incident_no")


def full_reports(spark, sf):
    cases, inc = report_cases(spark, sf)
    contributions = F.array(*stand_in_contributions())
    values = F.array(*[F.col(c).cast("double") for c in FEATURES])
    factors = inc.select("incident_no", attribution.rank_factors(values, contributions).alias("factors"))
    return inv.incident_reports(
        cases, inv.index_retriever(runbook_index(spark)), stand_in_scores(inc), factors,
        neighbours.similar_incidents(inc))


@query
def incident_report(spark, sf):
    return _flat_report(full_reports(spark, sf))


@query
def investigation_plan(spark, sf):
    cases, _ = report_cases(spark, sf)
    return (cases.select("incident_no", F.explode(evidence.investigation_plan()).alias("s"))
            .select("incident_no", "s.step", "s.tool", "s.purpose"))


def asked_questions(spark, sf):
    """User turns: every third is prefixed with a cause phrase, every fifth names an incident."""
    phrases = ["DataNode heartbeat failure", "network timeout", "something feels slow",
               "disk full, no space left", "replication pending error on storage"]
    n = F.col("conv_id") * 100 + F.col("turn")
    phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (n % len(phrases) + 1).cast("int"))
    text = (F.when(n % 5 == 1, F.concat(F.lit("please look at inc-"), (n % 4999).cast("string"),
                                        F.lit(" for me")))
            .when(n % 3 == 0, F.concat(phrase, F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    return src.user_turns(spark, sf).select(n.alias("query_id"), text.alias("query"))


@query
def analyze_text(spark, sf):
    """Full answers to the user turns; runbooks are searched among all documents."""
    retriever = inv.index_retriever(retrieval.build_index(src.cause_documents(spark, sf)))
    out = inv.analyze(asked_questions(spark, sf), full_reports(spark, sf), retriever)
    return _flat(out, "query_id", "query", "found")


def _logged(spark, sf) -> DataFrame:
    """A log of two days of reports and one of answers to questions, all as of fixed times."""
    path = round_trips.shared_folder(spark, "history")
    cases, inc = report_cases(spark, sf)
    reports = materialize(inv.incident_reports(cases, scores=stand_in_scores(inc)), "reports")
    for day, part in (("2035-03-01", "incident_no % 2 = 0"), ("2035-03-02", "incident_no % 2 = 1")):
        inv.append_history(reports.filter(part), path, F.lit(f"{day} 10:00:00").cast("timestamp"))
    answers = inv.analyze(asked_questions(spark, sf), reports)
    inv.append_history(answers, path, F.lit("2035-03-03 12:00:00").cast("timestamp"))
    return inv.read_history(spark, path)


@query
def investigation_log(spark, sf):
    """All entries of the log, reports and questions."""
    log = _logged(spark, sf)
    return log.select("entry", "incident_id", "query", "root_cause", "confidence", "anomaly_score",
                      F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"))


@query
def latest_investigations(spark, sf):
    """The newest 30 entries, in order; only the last days are read."""
    return inv.history(_logged(spark, sf), 30).select(
        "entry", "incident_id", "query", "root_cause", "confidence",
        F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"))


# ------------------------------------------------------------------ detector and attribution
@query
def calibrated_score(spark, sf):
    """A deterministic decision value per window, calibrated like the detector's."""
    decision = 0.3 - 0.05 * F.col("logs_per_window") - 0.4 * F.col("error_ratio")
    table = materialize(window_table(spark, sf).select("time_window", decision.alias("decision")), "d")
    scale = table.agg(F.greatest(F.stddev_pop("decision"), F.lit(1e-6)).alias("s")).scalar()
    score = forest.score_expr(F.col("decision"), F.col("_s"))
    return table.withColumn("_s", scale).select(
        "time_window", F.round(score, 6).alias("anomaly_score"),
        (F.col("decision") < 0).alias("is_anomaly"))


def _factors(spark, sf):
    values = F.array(*[F.col(c).cast("double") for c in FEATURES])
    return numbered(spark, sf).select("incident_no", attribution.rank_factors(
        values, F.array(*stand_in_contributions())).alias("factors"))


@query
def factor_ranking(spark, sf):
    return (_factors(spark, sf).select("incident_no", F.posexplode("factors").alias("no", "f"))
            .select("incident_no", (F.col("no") + 1).alias("rank"), "f.feature",
                    F.round("f.value", 6).alias("value"),
                    "f.contribution", "f.direction", "f.share", "f.strength"))


@query
def factor_text(spark, sf):
    return _factors(spark, sf).select("incident_no",
                                      attribution.factor_text(F.col("factors")).alias("explanation"))


def _model(spark, sf):
    table = materialize(window_table(spark, sf), "features")
    return forest.train(table), table


@query
def forest_scores(spark, sf):
    model, table = _model(spark, sf)
    return forest.predict(model, table).select("time_window", "decision", "anomaly_score", "is_anomaly")


@query
def incident_verdicts(spark, sf):
    inc = materialize(numbered(spark, sf), "incidents")
    return forest.verdicts(forest.train(inc), inc)


@query
def combined_evaluation(spark, sf):
    """Unsupervised, synthetic and labelled sections; windows with two errors are labelled abnormal."""
    model, table = _model(spark, sf)
    return prepare.evaluate_detector(model, table, _window_labels(table))


@query
def top_anomalies(spark, sf):
    model, table = _model(spark, sf)
    return forest.top_anomalies(model, table)


@query
def attribution_factors(spark, sf):
    model, table = _model(spark, sf)
    rows = attribution.top_factors(attribution.explain(model, table))
    return rows.select("time_window", "anomaly_score", F.posexplode("factors").alias("no", "f")).select(
        "time_window", "anomaly_score", "no", "f.*")


@query
def median_attribution(spark, sf):
    model, table = _model(spark, sf)
    rows = attribution.top_factors(attribution.explain(model, table, "permutation"))
    return rows.select("time_window", attribution.factor_text(F.col("factors")).alias("explanation"))


@query
def synthetic_eval(spark, sf):
    model, table = _model(spark, sf)
    return metrics.synthetic_report(forest.predict(model, metrics.inject_synthetic(table)))


@query
def detector_summary(spark, sf):
    model, table = _model(spark, sf)
    return metrics.unsupervised_summary(forest.predict(model, table))


@query
def scored_report(spark, sf):
    """The whole job with the trained detector in place of the stand-in score."""
    cases, inc = report_cases(spark, sf)
    model = forest.train(inc)
    explained = materialize(attribution.explain(model, inc).select(
        "incident_no", "anomaly_score", "is_anomaly", "factors"), "explained")
    reports = inv.incident_reports(
        cases, inv.index_retriever(runbook_index(spark)),
        explained.select("incident_no", "anomaly_score", "is_anomaly"),
        explained.select("incident_no", "factors"), neighbours.similar_incidents(inc))
    return _flat_report(reports)


# ------------------------------------------------------------------ metrics
def labelled_scores(spark, sf):
    """Labelled documents; the score is a bounded function of the text length."""
    d = src.table(spark, sf, "documents").select("doc_id", "n_chars")
    y = src.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    score = (F.col("n_chars") % 1000).cast("double") / 1000.0
    rows = d.join(y, "doc_id").select("doc_id", "label", score.alias("anomaly_score"))
    return rows.withColumn("is_anomaly", F.col("anomaly_score") > 0.5)


@query
def labeled_metrics(spark, sf):
    row = metrics.labelled_report(labelled_scores(spark, sf))
    return row.select("n_samples", "n_positive", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"),
                      r6("f1"), r6("accuracy"), r6("roc_auc"), r6("pr_auc"))


@query
def ranking_metrics(spark, sf):
    """Ranking metrics per label kind: toxic and (reversed) quality."""
    d = src.table(spark, sf, "documents").select("doc_id", "n_chars")
    y = src.table(spark, sf, "labels")
    rows = d.join(y, "doc_id").withColumn("anomaly_score", (F.col("n_chars") % 97).cast("double") / 97.0)
    toxic = metrics.ranking_metrics(rows.withColumn("label", F.col("toxic")))
    poor = metrics.ranking_metrics(rows.withColumn("label", 1 - F.col("quality")))
    return (toxic.select(F.lit("toxic").alias("kind"), r6("roc_auc"), r6("pr_auc"))
            .unionByName(poor.select(F.lit("poor").alias("kind"), r6("roc_auc"), r6("pr_auc"))))


@query
def score_summary(spark, sf):
    return metrics.unsupervised_summary(labelled_scores(spark, sf)).select(
        "n_samples", r6("anomaly_rate"), r6("score_mean"), r6("score_p95"), r6("score_max"))


def _window_labels(table: DataFrame) -> DataFrame:
    """Labels for the windows starting at minute 0, 20 or 40, given as text."""
    return (table.filter(F.minute("time_window") % 20 == 0)
            .select(F.date_format("time_window", "yyyy-MM-dd HH:mm:ss").alias("time_window"),
                    (F.col("error_count") > 1).cast("int").alias("label")))


@query
def labelled_windows(spark, sf):
    table = materialize(window_table(spark, sf), "features")
    return incidents.join_labels(table, _window_labels(table)).select(
        "time_window", "logs_per_window", "error_count", "label")


@query
def label_coverage(spark, sf):
    table = materialize(window_table(spark, sf), "features")
    return incidents.label_coverage(table, _window_labels(table)).select(
        "n_windows", "n_labelled", r6("coverage"))


# ------------------------------------------------------------------ streaming
@query
def stream_window_features(spark, sf):
    """The window features from a stream over files of lines, run until all files are read.

    The lines of each of a few spans of days arrive together, in as many files as the largest asks for,
    and spans arrive in time order, so a delay of some hours is enough. Two lines far in the future push the watermark past every real window,
    which closes them.
    """
    files, out, state = (scratch_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    if files is None:
        raise ValueError("Streaming needs a shared folder: set spark.checkpoint.dir.")
    lines = materialize(raw(spark, sf), "stream-lines")
    sizes = sorted(lines.groupBy("Date").count().collect())
    spans = [sizes[at:at + STREAM_DAYS] for at in range(0, len(sizes), STREAM_DAYS)]
    parts = max(1, *(-(-sum(n for _, n in span) // STREAM_FILE_ROWS) for span in spans))
    for span in spans:
        lines.filter(F.col("Date").isin([day for day, _ in span])).repartition(parts).write.mode("append").parquet(files)
    for minute in ("00", "01"):
        late = lines.limit(1).withColumns({
            "LineId": F.lit(-1 - int(minute)).cast("long"), "Date": F.lit("350101"),
            "Time": F.lit(f"00{minute}00")})
        late.coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", parts).parquet(files)
    run = (stream_features(stream, WINDOW, "6 hours").writeStream.format("parquet").option("path", out)
           .option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(out).select(
        "time_window", *[r6(c) if c.endswith("_ratio") else F.col(c) for c in FEATURES])


@query
def stream_scores(spark, sf):
    """Scores of a stream of feature rows, each epoch in a folder of its own (ST2)."""
    files, out, state = (round_trips.shared_folder(spark, x) for x in ("scores-in", "scores-out", "scores-state"))
    table = window_table(spark, sf).repartition(6)
    table.write.parquet(files)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(files)
    sink = score_batches(fixed_forest.model(), epoch_folder(out))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("time_window", r6("decision"), r6("anomaly_score"), "is_anomaly")


@query
def forest_shape(spark, sf):
    """What must hold of every trained forest: trees, rows at roots and leaves, depth, and children that add up (M1)."""
    model, _ = _model(spark, sf)
    nodes = spark.createDataFrame(model.nodes)
    inner, leaf = F.col("feature") >= 0, F.col("feature") < 0
    kids = nodes.select("tree_id", F.col("node_id").alias("kid"), F.col("n").alias("kid_n"), (F.col("depth") - 1).alias("kid_depth"))
    below = nodes.filter(inner).join(kids, "tree_id").filter("kid = left_id OR kid = right_id").groupBy("tree_id", "node_id").agg(
        (F.sum("kid_n") == F.max("n")).alias("adds_up"), F.bool_and(F.col("kid_depth") == F.col("depth")).alias("one_deeper"))
    wrong = below.agg(F.count_if(~F.col("adds_up") | ~F.col("one_deeper")).alias("w")).scalar()
    limit = F.ceil(F.log2(F.lit(float(max(model.subsample, 2)))))
    return nodes.agg(
        F.countDistinct("tree_id").alias("n_trees"), F.max(F.when(F.col("node_id") == 0, F.col("n"))).cast("long").alias("root_rows"),
        F.sum(F.when(leaf, F.col("n"))).cast("long").alias("leaf_rows"), (F.count_if(leaf) - F.count_if(inner)).alias("more_leaves"),
        (F.max("depth") <= limit).alias("within_depth")).withColumn("wrong_nodes", wrong)


@query
def training_rows(spark, sf):
    """Training input from raw lines, and again from the features: the same rows (M5)."""
    once = forest.prepare_training_data(raw(spark, sf), WINDOW)
    again = forest.prepare_training_data(materialize(once, "training"), WINDOW)
    return again.select("time_window", *[r6(c) if c.endswith("_ratio") else F.col(c) for c in FEATURES])


@query
def training_summary(spark, sf):
    """Settings and counts that a trained model keeps (M6); the rate follows from exact quantiles of its scores."""
    model, table = _model(spark, sf)
    p = model.params
    scored = metrics.unsupervised_summary(forest.predict(model, table), contamination=p["contamination"])
    return scored.select(
        F.lit(p["n_estimators"]).cast("long").alias("n_estimators"), F.lit(p["random_state"]).cast("long").alias("random_state"),
        F.lit(p["n_samples"]).cast("long").alias("n_samples"), F.lit(p["n_features"]).cast("long").alias("n_features"),
        F.col("contamination_setting"), (F.col("n_samples") == p["n_samples"]).alias("all_rows_scored"),
        (F.abs(F.col("anomaly_rate") - p["train_anomaly_rate"]) < 1e-12).alias("same_rate"),
        (F.col("anomaly_rate") <= F.lit(float(p["contamination"])) + 1e-12).alias("within_setting"))


QUERIES |= fixed_forest.queries(window_table, numbered, r6, _window_labels)
QUERIES |= round_trips.queries(window_table, document_index, benchmark_queries)
