"""A small literal forest: scoring and attribution that a second engine can repeat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..constants import EULER_GAMMA, FEATURES, INCIDENT_FEATURES, SEED, SYNTHETIC_CAVEAT
from ..operators import attribution, forest, metrics
from ..sources.materialize import materialize
from . import prepare

#: tree, node, feature (-1: leaf), threshold, left, right, training rows, depth.
NODES = [
    (0, 0, 0, 2.0, 1, 2, 64, 0), (0, 1, 1, 0.0, 3, 4, 40, 1), (0, 2, 1, 1.0, 5, 6, 24, 1),
    (0, 3, -1, 0.0, -1, -1, 30, 2), (0, 4, -1, 0.0, -1, -1, 10, 2), (0, 5, -1, 0.0, -1, -1, 20, 2), (0, 6, -1, 0.0, -1, -1, 4, 2),
    (1, 0, 12, 2.0, 1, 2, 64, 0), (1, 1, -1, 0.0, -1, -1, 50, 1), (1, 2, 0, 4.0, 3, 4, 14, 1),
    (1, 3, -1, 0.0, -1, -1, 12, 2), (1, 4, -1, 0.0, -1, -1, 2, 2),
    (2, 0, 13, 0.25, 1, 2, 64, 0), (2, 1, 0, 3.0, 3, 4, 44, 1), (2, 2, 0, 1.0, 5, 6, 20, 1),
    (2, 3, -1, 0.0, -1, -1, 43, 2), (2, 4, -1, 0.0, -1, -1, 1, 2), (2, 5, -1, 0.0, -1, -1, 15, 2), (2, 6, -1, 0.0, -1, -1, 5, 2),
]
NAMES = ["tree_id", "node_id", "feature", "threshold", "left_id", "right_id", "n", "depth"]
SUBSAMPLE, OFFSET, SCALE = 64, -0.5, 0.08
MEDIANS = {c: float(i % 3) / 2 for i, c in enumerate(FEATURES)}


def model() -> forest.Forest:
    return forest.Forest(pd.DataFrame(NODES, columns=NAMES), list(FEATURES), MEDIANS, OFFSET, SCALE, SUBSAMPLE)


def queries(window_table, numbered, r6, window_labels) -> dict:
    """The registered queries, over the window features that the catalogue builds."""
    def scores(spark, sf):
        return forest.predict(model(), window_table(spark, sf)).select("time_window", r6("decision"), r6("anomaly_score"), "is_anomaly")

    def verdicts(spark, sf):
        return forest.verdicts(model(), materialize(numbered(spark, sf), "incidents"))

    def top(spark, sf):
        found = forest.top_anomalies(model(), window_table(spark, sf))
        return found.withColumn("anomaly_score", r6("anomaly_score"))

    def most(spark, sf):
        return forest.max_score(model(), window_table(spark, sf)).select(r6("anomaly_score"))

    def contributions(method):
        def run(spark, sf):
            rows = attribution.contributions(model(), window_table(spark, sf), method)
            return rows.select("time_window", F.posexplode("contributions").alias("feature_no", "c")).filter(
                F.abs("c") > 1e-9).select("time_window", "feature_no", F.round("c", 6).alias("contribution"))
        return run

    def summary(spark, sf):
        found = metrics.unsupervised_summary(forest.predict(model(), window_table(spark, sf)))
        return found.select("n_samples", *[r6(c) for c in ("anomaly_rate", "score_mean", "score_p95", "score_max")])

    def injected(spark, sf):
        return metrics.inject_synthetic(materialize(window_table(spark, sf), "features"))

    def synthetic_rows(spark, sf):
        """Real windows and spiked copies of a sample of them."""
        return injected(spark, sf).select("time_window", "label", *[r6(c) for c in FEATURES])

    def separation(spark, sf):
        """How well the scores tell spiked copies from real windows."""
        found = metrics.synthetic_report(forest.predict(model(), injected(spark, sf)))
        return found.select(*[r6(c) if t == "double" else F.col(c) for c, t in found.dtypes])

    def report(spark, sf):
        """The unsupervised, synthetic and labelled sections in one table."""
        table = materialize(window_table(spark, sf), "features")
        return prepare.evaluate_detector(model(), table, window_labels(table)).select("section", "metric", r6("value"))

    def top_factors(spark, sf):
        """The first three factors of every window, those that count for nothing left out."""
        explained = materialize(attribution.explain(model(), window_table(spark, sf)).select("time_window", "factors"), "explained")
        return attribution.top_factors(explained, 3).select("time_window", F.posexplode("factors").alias("no", "f")).filter(F.abs("f.share") > 0).select(
            "time_window", (F.col("no") + 1).alias("rank"), "f.feature", F.round("f.value", 6).alias("value"),
            (F.col("f.contribution") + 0.0).alias("contribution"), "f.direction", "f.share", "f.strength")

    return {"synthetic_rows": synthetic_rows, "fixed_forest_separation": separation, "fixed_forest_report": report,
            "fixed_forest_top_factors": top_factors, "fixed_forest_scores": scores, "fixed_forest_verdicts": verdicts, "fixed_forest_top": top, "fixed_forest_max": most,
            "fixed_forest_shapley": contributions("shap"), "fixed_forest_substitution": contributions("permutation"),
            "fixed_forest_summary": summary}


def oracle(feats: str, incidents: str) -> dict[str, str]:
    """SQL of the queries; `feats` and `incidents` are WITH clauses that end in those tables."""
    def c(n: str) -> str:
        return f"(CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} <= 2 THEN 1.0::DOUBLE ELSE 2 * (ln({n} - 1.0::DOUBLE) + {EULER_GAMMA}::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END)"

    values = ", ".join("(" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in NODES)
    x = "[" + ", ".join(f"coalesce({f}::DOUBLE, {MEDIANS[f]}::DOUBLE)" for f in FEATURES) + "]"
    decision = f"(-pow(2.0::DOUBLE, -path / {c(str(SUBSAMPLE))}) - ({OFFSET}::DOUBLE))"
    score = f"(1 / (1 + exp(greatest(-50.0::DOUBLE, least(50.0::DOUBLE, {decision} / {SCALE}::DOUBLE)))))"
    nodes = f"nodes({', '.join(NAMES)}) AS (VALUES {values})"

    def start(head: str, source: str) -> str:
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + f", {nodes}, points AS (SELECT *, {x} AS x, -1 AS changed FROM {source})"

    def walk(points: str) -> str:
        return f""", walk AS (SELECT time_window, changed, x, tree_id, 0 AS node_id FROM {points}, (SELECT DISTINCT tree_id FROM nodes)
  UNION ALL SELECT time_window, changed, x, w.tree_id, CASE WHEN x[feature + 1] <= threshold THEN left_id ELSE right_id END
  FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE feature >= 0),
paths AS (SELECT time_window, changed, sum(depth + {c('n')}) / 3 AS path FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id
  WHERE feature < 0 GROUP BY ALL),
scored AS (SELECT time_window, changed, {decision} AS decision, {score} AS anomaly_score, {decision} < 0 AS is_anomaly FROM paths)
"""

    def uniform(stream: int, low: float, high: float) -> str:
        digits = f"('0x' || substr(md5(concat_ws('|', time_window, 0, {SEED}, {stream})), 1, 8))::BIGINT"
        return f"({low}::DOUBLE + {digits}::DOUBLE / 4294967296.0::DOUBLE * ({high}::DOUBLE - {low}::DOUBLE))"

    signals = [f for f in INCIDENT_FEATURES if f in FEATURES]
    spikes = ", ".join(f"{f}::DOUBLE + greatest((SELECT quantile_cont({f}::DOUBLE, 0.5) FROM feats), 1.0) * 10.0 * {uniform(i, 0.7, 1.3)} AS {f}"
                       for i, f in enumerate(signals))
    # The fewest rows that are copied, five, need a table of five windows or more, as the given ones are.
    synth = f"""
picked AS (SELECT * FROM feats QUALIFY row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', time_window, {SEED})), 1, 15))::BIGINT)
  <= (SELECT greatest(5, round_even(0.15 * count(*), 0)) FROM feats)),
spiked0 AS (SELECT * REPLACE ({spikes}, logs_per_window::DOUBLE * {uniform(len(signals), 2.0, 4.0)} AS logs_per_window) FROM picked),
spiked AS (SELECT * REPLACE ({', '.join(f'least({x}_count / logs_per_window, 1.0) AS {x}_ratio' for x in ("error", "warning", "fatal"))}) FROM spiked0),
synth AS (SELECT 0 AS label, time_window, {', '.join(f'{f}::DOUBLE AS {f}' for f in FEATURES)} FROM feats
  UNION ALL SELECT 1, time_window, {', '.join(FEATURES)} FROM spiked)"""

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0.0 END"

    def judged(src: str, name: str) -> str:
        """One row `name` of counts and metrics of src(label, s, hit); scores are equal to nine digits."""
        return f""",
{name}_t AS (SELECT round(s, 9) AS s, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM {src} GROUP BY 1),
{name}_c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS p0, sum(n) OVER () AS n0 FROM {name}_t),
{name}_r AS (SELECT sum(n / n0 * (tp - p / 2) / p0) AS roc_auc, sum(p / p0 * tp / (tp + fp)) AS pr_auc,
  sum(p * least(greatest(p0 - (tp + fp - p - n), 0), p + n) / (p + n)) / any_value(p0) AS recall_at_top_k FROM {name}_c),
{name}_n AS (SELECT count(*) AS n_samples, sum(label)::BIGINT AS n_positive, count(*) FILTER (hit AND label = 1) AS tp,
  count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 1) AS fn, count(*) FILTER (NOT hit AND label = 0) AS tn FROM {src}),
{name} AS (SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
  {ratio('tp + tn', 'n_samples')} AS accuracy, n_samples - n_positive AS n_real_samples, n_positive AS n_synthetic_anomalies, n_positive AS top_k,
  {ratio('tp', 'tp + fp')} AS precision_at_trained_threshold, {ratio('tp', 'tp + fn')} AS recall_at_trained_threshold FROM {name}_n, {name}_r)"""

    def long(section: str, row: str, columns: list[str]) -> str:
        return " UNION ALL ".join(f"SELECT '{section}' AS section, '{c}' AS metric, round({c}::DOUBLE, 6) AS value FROM {row}" for c in columns)

    both = (feats.replace("WITH ", "WITH RECURSIVE ", 1) + f", {synth}, {nodes}, points AS (SELECT time_window, {x} AS x, label AS changed FROM synth)" + walk("points")
            + ", sy AS (SELECT changed AS label, anomaly_score AS s, is_anomaly AS hit FROM scored)" + judged("sy", "sm"))
    labelled = f""", lb AS (SELECT (error_count > 1)::INT AS label, anomaly_score AS s, is_anomaly AS hit FROM scored JOIN feats USING (time_window)
  WHERE changed = 0 AND minute(time_window) % 20 = 0)""" + judged("lb", "lm") + """,
un AS (SELECT count(*) AS n_samples, avg(is_anomaly::INT) AS anomaly_rate, avg(anomaly_score) AS score_mean,
  quantile_cont(anomaly_score, 0.95) AS score_p95, max(anomaly_score) AS score_max FROM scored WHERE changed = 0)
"""
    separate = ["n_real_samples", "n_synthetic_anomalies", "roc_auc", "pr_auc", "top_k", "recall_at_top_k",
                "precision_at_trained_threshold", "recall_at_trained_threshold", "tp", "fp", "fn", "tn"]
    base, inc = start(feats, "feats") + walk("points"), start(incidents, "inc") + walk("points")
    used = sorted({row[2] for row in NODES if row[2] >= 0})
    k = len(used)
    bit = "CASE feature " + " ".join(f"WHEN {f} THEN {1 << i}" for i, f in enumerate(used)) + " END"
    weight = "CASE bit_count(s::INT) " + " ".join(
        f"WHEN {m} THEN {_factorial(m) * _factorial(k - m - 1) / _factorial(k)!r}::DOUBLE" for m in range(k)) + " END"
    changes = ", ".join(f"({i}, {MEDIANS[f]}::DOUBLE)" for i, f in enumerate(FEATURES))
    swapped = "list_transform(x, lambda v, i: CASE WHEN i = no + 1 THEN m ELSE v END)"
    share = "abs(c) / sum(abs(c)) OVER (PARTITION BY time_window)"
    factors = f""", ranked AS (SELECT time_window, feature, c, {share} AS sh, row_number() OVER (PARTITION BY time_window ORDER BY round(abs(c), 9) DESC, feature) AS rank FROM shares)
SELECT r.time_window, rank, [{', '.join(repr(f) for f in FEATURES)}][feature + 1] AS feature, round(x[feature + 1], 6) AS value,
  format('{{:.4f}}', c)::DOUBLE + 0.0 AS contribution, CASE WHEN c > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  format('{{:.4f}}', sh)::DOUBLE AS share, CASE WHEN sh >= 0.6 THEN 'Strong' WHEN sh >= 0.3 THEN 'Medium' ELSE 'Weak' END AS strength
FROM ranked r JOIN points USING (time_window) WHERE rank <= 3 AND format('{{:.4f}}', sh)::DOUBLE > 0"""
    found = {
        "synthetic_rows": feats + f", {synth} SELECT time_window, label, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM synth",
        "fixed_forest_separation": both + f"SELECT 'synthetic' AS mode, '{SYNTHETIC_CAVEAT.replace(chr(39), chr(39) * 2)}' AS caveat, "
                                   + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" if c.endswith(("auc", "k", "threshold")) and c != "top_k" else c for c in separate) + " FROM sm",
        "fixed_forest_report": both + labelled + " UNION ALL ".join([
            long("unsupervised", "un", ["n_samples", "anomaly_rate", "score_mean", "score_p95", "score_max"]), long("synthetic", "sm", separate),
            long("labeled", "lm", ["n_samples", "n_positive", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "roc_auc", "pr_auc"])]),
        "fixed_forest_scores": base + "SELECT time_window, round(decision, 6) AS decision, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM scored",
        "fixed_forest_verdicts": inc + "SELECT incident_no, incident_id, format('{:.4f}', anomaly_score)::DOUBLE AS anomaly_score, is_anomaly FROM scored JOIN inc USING (time_window)",
        "fixed_forest_top": base + """SELECT time_window, logs_per_window, error_count, block_errors, heartbeat_failures, round(anomaly_score, 6) AS anomaly_score, is_anomaly
FROM scored JOIN feats USING (time_window) ORDER BY scored.anomaly_score DESC, time_window LIMIT 10""",
        "fixed_forest_max": base + "SELECT round(max(anomaly_score), 6) AS anomaly_score FROM scored",
        "fixed_forest_summary": base + """SELECT count(*) AS n_samples, round(avg(is_anomaly::INT), 6) AS anomaly_rate, round(avg(anomaly_score), 6) AS score_mean,
round(quantile_cont(anomaly_score, 0.95), 6) AS score_p95, round(max(anomaly_score), 6) AS score_max FROM scored""",
        "fixed_forest_substitution": start(feats, "feats") + f""", swaps(no, m) AS (VALUES {changes}),
every AS (SELECT time_window, changed, x FROM points UNION ALL SELECT time_window, no, {swapped} FROM points, swaps)"""
        + walk("every") + """SELECT b.time_window, o.changed AS feature_no, round(b.anomaly_score - o.anomaly_score, 6) AS contribution
FROM scored b JOIN scored o USING (time_window) WHERE b.changed = -1 AND o.changed >= 0 AND abs(b.anomaly_score - o.anomaly_score) > 1e-9""",
        # Path-dependent expectation of every subset of the used features, then the weighted differences.
        "fixed_forest_shapley": start(feats, "feats") + f""",
routes AS (SELECT tree_id, node_id, feature, n, depth, [] ::STRUCT(f INT, t DOUBLE, lower BOOLEAN, share DOUBLE)[] AS steps, left_id, right_id, threshold FROM nodes WHERE node_id = 0
  UNION ALL SELECT c.tree_id, c.node_id, c.feature, c.n, c.depth,
    list_append(r.steps, {{'f': r.feature, 't': r.threshold, 'lower': c.node_id = r.left_id, 'share': c.n / r.n::DOUBLE}}), c.left_id, c.right_id, c.threshold
  FROM routes r JOIN nodes c ON c.tree_id = r.tree_id AND (c.node_id = r.left_id OR c.node_id = r.right_id) WHERE r.feature >= 0),
leaves AS (SELECT steps, (depth + {c('n')}) / 3 AS value FROM routes WHERE feature < 0),
subsets AS (SELECT unnest(range({1 << k})) AS s),
worth AS (SELECT time_window, s, sum(value * list_product(list_transform(steps, lambda e: CASE
    WHEN s & ({bit.replace('feature', 'e.f')}) = 0 THEN e.share WHEN (x[e.f + 1] <= e.t) = e.lower THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS v
  FROM points, subsets, leaves GROUP BY ALL),
bits(feature, b) AS (VALUES {', '.join(f'({f}, {1 << i})' for i, f in enumerate(used))}),
shares AS (SELECT a.time_window, feature, -sum(({weight.replace('s::INT', 'a.s::INT')}) * (w.v - a.v)) AS c
  FROM worth a JOIN bits ON a.s & b = 0 JOIN worth w ON w.time_window = a.time_window AND w.s = a.s + b GROUP BY ALL)
SELECT time_window, feature AS feature_no, round(c, 6) AS contribution FROM shares WHERE abs(c) > 1e-9""",
    }
    shapley, last = found["fixed_forest_shapley"].rsplit("\nSELECT", 1)
    found["fixed_forest_top_factors"] = shapley + factors
    return found


def _factorial(n: int) -> int:
    return n * _factorial(n - 1) if n > 1 else 1
