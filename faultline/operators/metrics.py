"""Detector and retrieval metrics (E1..E9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INCIDENT_FEATURES, SEED, SYNTHETIC_CAVEAT
from ..functions.numeric import ratio
from ..functions.ordering import exact_quantile, running_totals
from ..sources.materialize import materialize


def require_binary(df: DataFrame, label: str = "label") -> None:
    """Labels must be 0 or 1 (E1): one aggregate, evaluated now."""
    bad = df.agg(F.count_if(F.col(label).isNull() | ~F.col(label).cast("int").isin(0, 1))).first()[0]
    if bad:
        raise ValueError("Labels must contain only 0/1 (or False/True).")


def score_table(df: DataFrame, label: str = "label", score: str = "anomaly_score",
                flag: str = "is_anomaly") -> DataFrame:
    """Scored rows reduced to (s, flagged) with positives p and negatives n, written once.

    Every labelled metric is a function of this table, so scoring runs a single time.
    """
    y = F.col(label).cast("int")
    flagged = F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag in df.columns else F.lit(False)
    reduced = df.groupBy(F.col(score).alias("s"), flagged.alias("flagged")).agg(
        F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    return materialize(reduced, "scores")


def _confusion(table: DataFrame) -> DataFrame:
    hit = F.col("flagged")

    def total(value: Column, cond: Column | None = None) -> Column:
        v = value if cond is None else F.when(cond, value)
        return F.coalesce(F.sum(v), F.lit(0)).cast("long")

    row = table.agg(total(F.col("p") + F.col("n")).alias("n_samples"), total(F.col("p")).alias("n_positive"),
                    total(F.col("p"), hit).alias("tp"), total(F.col("n"), hit).alias("fp"),
                    total(F.col("p"), ~hit).alias("fn"), total(F.col("n"), ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return row.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, F.col("n_samples"))})


def confusion(df: DataFrame, label: str = "label", flag: str = "is_anomaly") -> DataFrame:
    """One row: counts, precision, recall, F1 and accuracy, 0 where undefined."""
    y, hit = F.col(label).cast("int"), F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    return _confusion(df.groupBy(hit.alias("flagged")).agg(
        F.sum(y).alias("p"), F.sum(1 - y).alias("n")))


def _curve(table: DataFrame) -> DataFrame:
    """Per distinct score: positives, negatives, and their running sums from the top score down."""
    groups = (table.filter(F.col("s").isNotNull()).groupBy("s")
              .agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    return running_totals(groups, "s", {"p": "tp", "n": "fp"}, descending=True)


def _ranking(table: DataFrame) -> DataFrame:
    curve = _curve(table).withColumns({c: F.col(c).cast("double") for c in ("p", "n", "tp", "fp")})
    pos, neg = F.sum("p"), F.sum("n")
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    ap = F.sum(F.col("p") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    both = (F.coalesce(pos, F.lit(0.0)) > 0) & (F.coalesce(neg, F.lit(0.0)) > 0)
    return curve.agg(F.when(both, F.try_divide(auc, pos * neg)).alias("roc_auc"),
                     F.when(both, F.try_divide(ap, pos)).alias("pr_auc"))


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """One row: ROC-AUC (ties share rank) and average precision, NULL with one class.

    The area under the curve is the share of (positive, negative) pairs in the right order, a tie
    counting half; average precision sums recall steps times precision.
    """
    return _ranking(score_table(df, label, score))


def labelled_report(df: DataFrame, label: str = "label") -> DataFrame:
    """Threshold and ranking metrics of scored, labelled rows in one row (E1..E3)."""
    table = score_table(df, label)
    ranks = _ranking(table).select(F.struct("roc_auc", "pr_auc").alias("r")).scalar()
    return (_confusion(table).withColumn("_r", ranks)
            .withColumns({"mode": F.lit("labeled"), "roc_auc": F.col("_r.roc_auc"),
                          "pr_auc": F.col("_r.pr_auc")}).drop("_r"))


def unsupervised_summary(df: DataFrame, score: str = "anomaly_score", flag: str = "is_anomaly",
                         contamination: float | str | None = None) -> DataFrame:
    """Row count, anomaly rate, and mean, 95th percentile and maximum of the score.

    `contamination` is the setting the detector was trained with, passed on as text.
    """
    setting = None if contamination is None else str(contamination)
    df = materialize(df.select(score, flag), "scored")
    p95 = exact_quantile(df, [score], 0.95).select(F.col(score)).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.col(flag).cast("int").cast("double")).alias("anomaly_rate"),
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
    ).withColumn("score_p95", p95).select(
        F.lit("unsupervised").alias("mode"), "n_samples", "anomaly_rate", "score_mean", "score_p95", "score_max",
        F.lit(setting).cast("string").alias("contamination_setting"))


# ------------------------------------------------------------------ synthetic anomalies
def _digits(n: int, *parts: Column) -> Column:
    """The first n hex digits of the md5 of the parts' texts, as a number; the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def _uniform(key: str, seed: int, stream: int, low: float, high: float) -> Column:
    """A number in [low, high) that depends only on the row key, the copy, the seed and the stream."""
    u = _digits(8, F.col(key), F.col("_copy"), F.lit(seed), F.lit(stream))
    return F.lit(low) + u.cast("double") / F.lit(float(2 ** 32)) * F.lit(high - low)


def first_by_hash(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A reproducible sample of n rows by hash order, found with range totals instead of a sort."""
    hashed = df.withColumn("_h", _digits(15, F.col(key), F.lit(seed)))
    ranks = running_totals(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_w")), "_h", {"_w": "_r"})
    return (hashed.join(ranks.filter(F.col("_r") <= n).select("_h"), "_h", "left_semi").drop("_h"))


def inject_synthetic(features: DataFrame, key: str = "time_window", n_synthetic: int | None = None,
                     factor: float = 10.0, seed: int = SEED) -> DataFrame:
    """Real rows (label 0) and spiked copies of a sample of them (label 1)."""
    signals = [c for c in INCIDENT_FEATURES if c in features.columns]
    if not signals:
        raise ValueError(f"None of the expected incident-signal columns are present: {INCIDENT_FEATURES}")
    rows = features.count()
    if rows == 0:
        raise ValueError("Input is empty; nothing to evaluate.")
    wanted = n_synthetic or max(5, int(round(0.15 * rows)))
    wanted = max(1, min(wanted, max(rows, 5)))
    medians = exact_quantile(features, signals, 0.5).select(F.struct(*signals).alias("m")).scalar()

    copies = -(-wanted // rows)
    sample = (first_by_hash(features, key, wanted, seed) if copies == 1 else features)
    sample = sample.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    if copies > 1:
        sample = sample.orderBy("_copy", key).limit(wanted)   # fewer than five rows in all
    sample = sample.withColumn("_m", medians)
    spiked = sample.withColumns({
        c: F.col(c).cast("double") + F.greatest(F.col("_m").getField(c), F.lit(1.0)) * factor
        * _uniform(key, seed, i, 0.7, 1.3) for i, c in enumerate(signals)})
    if "logs_per_window" in features.columns:
        spiked = spiked.withColumn("logs_per_window", F.col("logs_per_window").cast("double")
                                   * _uniform(key, seed, len(signals), 2.0, 4.0))
        for name in ("error", "warning", "fatal"):
            if {f"{name}_ratio", f"{name}_count"} <= set(features.columns):
                spiked = spiked.withColumn(f"{name}_ratio", F.least(
                    F.try_divide(F.col(f"{name}_count"), F.col("logs_per_window")), F.lit(1.0)))
    spiked = spiked.drop("_m", "_copy").withColumn("label", F.lit(1))
    real = features.withColumns({c: F.col(c).cast(spiked.schema[c].dataType)
                                 for c in features.columns}).withColumn("label", F.lit(0))
    return real.unionByName(spiked)


def synthetic_report(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Separation of injected anomalies: ranking metrics, recall at k, threshold metrics.

    `scored` is the scored result of `inject_synthetic`; k defaults to the number of injected rows.
    """
    table = score_table(scored)
    base = _confusion(table)
    k = F.col("n_positive") if top_k is None else F.least(F.lit(top_k), F.col("n_samples"))
    curve = _curve(table)
    # A score tie across the cut is split by label-free share, so the figure does not depend on order.
    counts = base.select(k.alias("k")).scalar()
    curve = curve.withColumn("_k", counts).withColumn("_before", F.col("tp") + F.col("fp")
                                                      - F.col("p") - F.col("n"))
    taken = F.least(F.greatest(F.col("_k") - F.col("_before"), F.lit(0)), F.col("p") + F.col("n"))
    hits = curve.agg(F.sum(F.col("p") * F.try_divide(taken.cast("double"), F.col("p") + F.col("n")))
                     .alias("h")).scalar()
    ranks = _ranking(table).select(F.struct("roc_auc", "pr_auc").alias("r")).scalar()
    return (base.withColumn("_r", ranks).withColumn("_hits", hits).select(
        F.lit("synthetic").alias("mode"), F.lit(SYNTHETIC_CAVEAT).alias("caveat"),
        (F.col("n_samples") - F.col("n_positive")).alias("n_real_samples"),
        F.col("n_positive").alias("n_synthetic_anomalies"),
        F.col("_r.roc_auc").alias("roc_auc"), F.col("_r.pr_auc").alias("pr_auc"),
        k.alias("top_k"), F.try_divide(F.col("_hits"), F.col("n_positive")).alias("recall_at_top_k"),
        F.col("precision").alias("precision_at_trained_threshold"),
        F.col("recall").alias("recall_at_trained_threshold"), "tp", "fp", "fn", "tn"))


def combined_report(**parts: DataFrame) -> DataFrame:
    """Any number of one-row reports as (section, metric, value) rows."""
    out = None
    for section, row in parts.items():
        cols = [c for c, t in row.dtypes if t in ("double", "bigint", "int")]
        long = (row.select(*[F.col(c).cast("double").alias(c) for c in cols])
                .unpivot([], cols, "metric", "value").select(F.lit(section).alias("section"),
                                                             "metric", "value"))
        out = long if out is None else out.unionByName(long)
    return out


# ------------------------------------------------------------------ retrieval
def retrieval_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """First rank of the expected source per case, and the sources retrieved in rank order.

    A case without hits is a miss with an empty list.
    """
    found = (hits.join(cases.select("query_id", "expected_source"), "query_id")
             .filter(F.col("source") == F.col("expected_source"))
             .groupBy("query_id").agg(F.min("rank").cast("int").alias("first_rank")))
    listed = hits.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda h: h["source"]).alias("retrieved_sources"))
    out = cases.join(found, "query_id", "left").join(listed, "query_id", "left")
    return out.withColumns({
        "retrieved_sources": F.coalesce("retrieved_sources", F.array().cast("array<string>")),
        "hit_at_1": F.coalesce(F.col("first_rank") == 1, F.lit(False)),
        "hit_at_k": F.col("first_rank").isNotNull(),
        "reciprocal_rank": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))})


def retrieval_report(hits: DataFrame, cases: DataFrame, top_k: int) -> DataFrame:
    """One row: queries, hit rate at 1 and at k, mean reciprocal rank."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be >= 1.")
    rows = retrieval_cases(hits.filter(F.col("rank") <= top_k), cases)
    return rows.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("hit_at_1").cast("int").cast("double")).alias("top_1_accuracy"),
        F.avg(F.col("hit_at_k").cast("int").cast("double")).alias("top_k_recall"),
        F.lit(top_k).alias("top_k"), F.avg("reciprocal_rank").alias("mrr"))
