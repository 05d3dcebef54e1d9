"""Isolation forest: distributed sampling and growing, broadcast scoring (M1..M8).

The forest itself is bounded (trees x at most 511 nodes), which is why it may be collected and
broadcast; rows are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CONTAMINATION, EULER_GAMMA, FEATURES, MIN_SCALE, MIN_TRAIN_ROWS, N_TREES,
                         SEED, SUBSAMPLE)
from ..functions.numeric import round_even
from ..functions.ordering import exact_quantile
from ..schemas import NODE_SCHEMA
from ..sources.materialize import materialize
from .clean import REQUIRED_COLUMNS
from .features import coerce_features, feature_medians, preprocess


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def grow(x: np.ndarray, depth_limit: int, rng: np.random.Generator) -> list[tuple]:
    """Node rows (node_id, feature, threshold, left, right, n, depth) of one random tree."""
    nodes: list[list] = []
    queue = [(np.arange(len(x)), 0, -1, 0)]
    while queue:
        rows, depth, parent, side = queue.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        if len(rows) <= 1 or depth >= depth_limit:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.nonzero(high > low)[0]
        if not len(open_features):
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        if cut >= high[f]:
            cut = float(low[f])
        left = x[rows, f] <= cut
        nodes[me][1], nodes[me][2] = f, cut
        queue.append((rows[~left], depth + 1, me, 1))
        queue.append((rows[left], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class Forest:
    """A trained detector: node table as arrays, medians, offset, score scale, parameters."""

    nodes: pd.DataFrame
    columns: list[str]
    medians: dict[str, float]
    offset: float
    scale: float
    subsample: int
    params: dict = field(default_factory=dict)

    @cached_property
    def arrays(self) -> dict[str, np.ndarray]:
        """Padded [tree, node] arrays; `path` is depth plus the expected rest of the path."""
        t = int(self.nodes["tree_id"].max()) + 1
        m = int(self.nodes["node_id"].max()) + 1
        out = {"feature": np.full((t, m), -1, np.int32), "threshold": np.zeros((t, m)),
               "left": np.zeros((t, m), np.int32), "right": np.zeros((t, m), np.int32),
               "n": np.ones((t, m)), "path": np.zeros((t, m))}
        at = (self.nodes["tree_id"].to_numpy(), self.nodes["node_id"].to_numpy())
        for name, col in (("feature", "feature"), ("threshold", "threshold"), ("left", "left_id"),
                          ("right", "right_id"), ("n", "n")):
            out[name][at] = self.nodes[col].to_numpy()
        out["path"][at] = self.nodes["depth"].to_numpy() + average_path(self.nodes["n"].to_numpy())
        return out


def path_lengths(a: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean path length per row: all trees step down one level at a time."""
    trees = np.arange(a["feature"].shape[0])[None, :]
    at = np.zeros((len(x), a["feature"].shape[0]), np.int32)
    rows = np.arange(len(x))[:, None]
    while True:
        f = a["feature"][trees, at]
        if (f < 0).all():
            return a["path"][trees, at].mean(axis=1)
        right = x[rows, np.maximum(f, 0)] > a["threshold"][trees, at]
        step = np.where(right, a["right"][trees, at], a["left"][trees, at])
        at = np.where(f < 0, at, step)


def decisions(a: dict[str, np.ndarray], subsample: int, offset: float, x: np.ndarray) -> np.ndarray:
    return -np.power(2.0, -path_lengths(a, x) / average_path(subsample)) - offset


def _stack(cols: tuple[pd.Series, ...]) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype=float) for c in cols])


def _sampled(data: DataFrame, key: str, columns: list[str], n: int, trees: int, psi: int,
             seed: int) -> DataFrame:
    """psi rows per tree without replacement, by hash priority.

    Only pairs under a priority bound leave the scan: about 4 x psi per tree are expected, so falling
    short of psi is out of the question, and the shuffle does not grow with the data.
    """
    span = 2 ** 40
    bound = span if n <= 4 * psi else int(span * (4.0 * psi / n))
    pairs = (data.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
             .withColumn("_p", F.pmod(F.xxhash64(F.lit(seed), "tree_id", F.col(key)), F.lit(span)))
             .filter(F.col("_p") < bound))
    order = Window.partitionBy("tree_id").orderBy("_p", key)
    return (pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= psi)
            .select("tree_id", "_n", *columns))


def train(df: DataFrame, key: str = "time_window", contamination: float | str = CONTAMINATION,
          trees: int = N_TREES, seed: int = SEED, columns: list[str] | None = None) -> Forest:
    """Fit a forest on feature rows and calibrate its scores (M1, M2, M6)."""
    if contamination != "auto" and not (isinstance(contamination, (int, float))
                                        and 0 < contamination <= 0.5):
        raise ValueError("contamination must be in (0, 0.5] or 'auto'.")
    if trees < 1:
        raise ValueError("n_estimators must be >= 1.")
    columns = list(columns or FEATURES)
    rows = coerce_features(df, columns).select(key, *columns)
    first = feature_medians(df, columns).select(F.struct(*columns).alias("m")).scalar()
    head = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("m", first).first()
    n, medians = head["n"], {c: float(head["m"][c]) for c in columns}
    if n < MIN_TRAIN_ROWS:
        raise ValueError(f"Need at least {MIN_TRAIN_ROWS} training rows, got {n}.")
    data = rows.fillna(medians)

    psi = min(SUBSAMPLE, n)
    limit = int(np.ceil(np.log2(max(psi, 2))))

    def build(key_: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("_n")[columns].to_numpy(dtype=float)
        made = grow(x, limit, np.random.default_rng([seed, int(key_[0])]))
        out = pd.DataFrame(made, columns=["node_id", "feature", "threshold", "left_id", "right_id",
                                          "n", "depth"])
        out.insert(0, "tree_id", int(key_[0]))
        return out

    nodes = (_sampled(data, key, columns, n, trees, psi, seed)
             .groupBy("tree_id").applyInPandas(build, NODE_SCHEMA).toPandas()
             .sort_values(["tree_id", "node_id"], ignore_index=True))

    raw_model = Forest(nodes, columns, medians, 0.0, 1.0, psi)
    raw = materialize(data.select(decision_column(raw_model, df).alias("raw")), "decisions")
    if contamination == "auto":
        offset = F.lit(-0.5)
    else:
        offset = exact_quantile(raw, ["raw"], float(contamination)).scalar()
    stats = (raw.withColumn("offset", offset)
             .agg(F.stddev_pop("raw").alias("sd"), F.max("offset").alias("offset"),
                  F.avg((F.col("raw") < F.col("offset")).cast("int").cast("double")).alias("rate"))
             .first())
    cut, rate = float(stats["offset"]), stats["rate"]
    return Forest(nodes, columns, medians, cut, max(float(stats["sd"]), MIN_SCALE), psi, {
        "contamination": str(contamination), "n_estimators": trees, "random_state": seed,
        "n_samples": n, "n_features": len(columns), "train_anomaly_rate": float(rate)})


def decision_column(model: Forest, df: DataFrame) -> Column:
    """Decision value of a row (negative = anomaly), scored in Arrow batches (M3).

    Only the feature columns travel to Python; the others stay where they are.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.arrays, model.subsample, model.offset))

    @F.pandas_udf("double")
    def decide(*cols: pd.Series) -> pd.Series:
        arrays, psi, offset = sent.value
        return pd.Series(decisions(arrays, psi, offset, _stack(cols)))

    return decide(*[F.col(c) for c in model.columns])


def score_expr(decision: Column, scale: Column | float) -> Column:
    """Sigmoid of the scaled decision: above 0.5 exactly when anomalous (M4)."""
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), decision / scale))
    return 1.0 / (1.0 + F.exp(z))


def filled(model: Forest, df: DataFrame) -> DataFrame:
    return coerce_features(df, model.columns).fillna(model.medians, subset=model.columns)


def predict(model: Forest, df: DataFrame) -> DataFrame:
    """Input rows with decision, anomaly_score and is_anomaly (M3, M4, M7)."""
    scored = filled(model, df).withColumn("decision", decision_column(model, df))
    return scored.withColumns({"anomaly_score": score_expr(F.col("decision"), model.scale),
                               "is_anomaly": F.col("decision") < 0})


def max_score(model: Forest, df: DataFrame) -> DataFrame:
    """Highest score over all rows (M7)."""
    return predict(model, df).agg(F.max("anomaly_score").alias("anomaly_score"))


def verdicts(model: Forest, incidents: DataFrame) -> DataFrame:
    """(incident_no, incident_id, anomaly_score to 4 places, is_anomaly) of every incident (M8)."""
    return predict(model, incidents).select(
        "incident_no", "incident_id", round_even(F.col("anomaly_score"), 4).alias("anomaly_score"), "is_anomaly")


def top_anomalies(model: Forest, features: DataFrame, n: int = 10) -> DataFrame:
    """The n most anomalous windows; scored in place, no join by position."""
    return (predict(model, features)
            .select("time_window", "logs_per_window", "error_count", "block_errors",
                    "heartbeat_failures", "anomaly_score", "is_anomaly")
            .orderBy(F.desc("anomaly_score"), F.asc("time_window")).limit(n))


def prepare_training_data(df: DataFrame, window: str, columns: list[str] | None = None,
                          pos: str = "pos") -> DataFrame:
    """Feature tables pass through; raw lines are turned into features (M5)."""
    columns = columns or FEATURES
    if all(c in df.columns for c in columns):
        return df
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns and c != "EventTemplate"]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return preprocess(df, window, pos)
