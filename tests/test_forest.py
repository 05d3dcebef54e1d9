import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import feature_rows, log_frame
from faultline.constants import FEATURES
from faultline.operators import attribution, features, forest, metrics
from faultline.sources import store


def test_scores_and_flags(trained):
    model, table = trained
    got = forest.predict(model, table).orderBy("time_window").toPandas()
    s = got.anomaly_score
    assert s.between(0, 1).all() and got.is_anomaly.iloc[-3:].all()
    assert ((s > 0.5) == got.is_anomaly).all() and got.is_anomaly.mean() <= 0.15
    assert s.iloc[-3:].min() > s.iloc[:-3].median()
    assert model.params["n_samples"] == 63 and model.nodes.tree_id.nunique() == 200
    assert forest.max_score(model, table).first()[0] == pytest.approx(s.max())


def test_training_is_reproducible_over_partitions(spark, trained):
    model, table = trained
    again = forest.train(table.repartition(7))
    assert again.nodes.equals(model.nodes) and again.offset == pytest.approx(model.offset, abs=1e-12)


def test_bad_values(spark, trained):
    model, table = trained
    bad = table.limit(3).withColumns({
        "error_count": F.lit("abc"), "logs_per_window": F.lit(float("inf")), "info_count": F.lit(None)})
    assert all(np.isfinite(r.anomaly_score) for r in forest.predict(model, bad).collect())
    with pytest.raises(ValueError):
        forest.predict(model, table.drop("error_count"))


def test_train_errors(spark, trained):
    _, table = trained
    with pytest.raises(ValueError):
        forest.train(table.limit(3))
    for bad in (0.9, 0, "sometimes"):
        with pytest.raises(ValueError):
            forest.train(table, contamination=bad)
    with pytest.raises(ValueError):
        forest.train(table, trees=0)
    assert forest.train(table, contamination="auto", trees=20).offset == -0.5


def test_large_table_samples_psi_rows(spark):
    df = spark.range(20000).select(F.col("id").alias("k"), *[
        F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(f"f{i}") for i in range(3)])
    model = forest.train(df, key="k", trees=12, columns=["f0", "f1", "f2"])
    roots = model.nodes[model.nodes.node_id == 0]
    assert (roots.n == 256).all() and model.nodes.depth.max() <= 8
    got = forest.predict(model, df).agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0]
    assert abs(got - 0.05) < 0.01


def test_save_and_load(spark, trained, tmp_path):
    model, table = trained
    store.save_model(spark, model, str(tmp_path / "nested" / "m"))
    loaded = store.load_model(spark, str(tmp_path / "nested" / "m"))
    a, b = (sorted((r.time_window, r.anomaly_score) for r in forest.predict(m, table).collect())
            for m in (model, loaded))
    assert a == b and loaded.columns == model.columns and loaded.params == model.params
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, str(tmp_path / "none"))
    for part in ("nodes", "params"):
        spark.range(1).write.parquet(str(tmp_path / "wrong" / part))
    with pytest.raises(ValueError):
        store.load_model(spark, str(tmp_path / "wrong"))


def test_prepare_training_data(spark):
    rows = [(i + 1, "081109", f"{20 + i // 360:02d}{i // 6 % 60:02d}{i % 6 * 10:02d}", i % 20,
             "INFO" if i < 390 else "ERROR", "dfs.A" if i % 2 else "dfs.B",
             "Receiving block blk_1" if i < 390 else "heartbeat block timeout", f"E{i % 5}", "t")
            for i in range(400)]
    x = forest.prepare_training_data(log_frame(spark, rows), "5min")
    assert x.count() > 5 and "logs_per_window" in x.columns
    assert forest.prepare_training_data(x, "5min") is x
    with pytest.raises(ValueError):
        forest.prepare_training_data(spark.range(3), "5min")


# ------------------------------------------------------------------ attribution
def exact_shapley(model, x):
    """Brute force over feature subsets for one row: expected path length given followed features."""
    from itertools import combinations
    from math import factorial

    def expected(nodes, path, at, known):
        f = int(nodes.feature[at])
        if f < 0:
            return path[at]
        l, r = int(nodes.left_id[at]), int(nodes.right_id[at])
        if f in known:
            return expected(nodes, path, l if x[f] <= nodes.threshold[at] else r, known)
        n = nodes.n[at]
        return (nodes.n[l] * expected(nodes, path, l, known) + nodes.n[r] * expected(nodes, path, r, known)) / n

    d = len(model.columns)
    trees = [(g.sort_values("node_id").reset_index(drop=True), model.arrays["path"][t])
             for t, g in model.nodes.groupby("tree_id")]
    value = {s: np.mean([expected(n, p, 0, set(s)) for n, p in trees])
             for k in range(d + 1) for s in combinations(range(d), k)}
    out = np.zeros(d)
    for i in range(d):
        for s in value:
            if i not in s:
                w = factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d)
                out[i] -= w * (value[tuple(sorted((*s, i)))] - value[s])
    return out


def test_shapley_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.integers(0, 9, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    model = forest.train(df, key="k", trees=6, columns=["a", "b", "c", "d"])
    got = {r.k: r.contributions for r in attribution.contributions(model, df.filter("k < 5")).collect()}
    for r in rows[:5]:
        assert np.allclose(got[r[0]], exact_shapley(model, np.array(r[1:])), atol=1e-10)


def test_shapley_additivity(trained):
    model, table = trained
    got = attribution.contributions(model, table).toPandas()
    tabs = attribution.shapley_tables(model)
    x = got[FEATURES].to_numpy(float)
    gap = attribution.base_path(tabs) - forest.path_lengths(model.arrays, x)
    assert np.allclose(np.stack(got.contributions).sum(axis=1), gap, atol=1e-9)


@pytest.mark.parametrize("method", ["shap", "permutation"])
def test_explanations(trained, method):
    model, table = trained
    rows = attribution.explain(model, table, method).orderBy("time_window").collect()
    spike, normal = rows[-1], rows[0]
    assert spike.is_anomaly and spike.method == method and not normal.is_anomaly
    assert len(spike.factors) == 16 and spike.factors[0].direction == "increases"
    shares = [f.share for f in spike.factors]
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1, abs=1e-3)
    text = attribution.top_factors(attribution.explain(model, table, method)).orderBy(
        F.desc("time_window")).select(attribution.factor_text(F.col("factors")), "factors").first()
    assert "abnormal" in text[0] and len(text[1]) == 5
    with pytest.raises(ValueError):
        attribution.top_factors(table, 0)
    with pytest.raises(ValueError):
        attribution.contributions(model, table, "guess")


def test_factor_text_edges(spark):
    kind = attribution_type = ("array<struct<feature:string,value:double,contribution:double,"
                               "direction:string,share:double,strength:string>>")
    df = spark.createDataFrame([(1, []), (2, [("x", 1.0, -0.5, "decreases", 1.0, "Strong")]),
                                (3, [("a_b", 12000000.0, 0.5, "increases", 1.0, "Strong")])],
                               f"k int, f {kind}")
    got = {r.k: r.t for r in df.select("k", attribution.factor_text(F.col("f")).alias("t")).collect()}
    assert got[1] == "No contributing factors were found." and "No factor pushed" in got[2]
    assert got[3].endswith("- a b = 12000000.0 → Strong") and attribution_type


# ------------------------------------------------------------------ evaluation
def test_synthetic_separation(spark):
    rows, ddl = feature_rows(80, 0)
    table = spark.createDataFrame(rows, ddl)
    model = forest.train(table)
    mixed = metrics.inject_synthetic(table)
    r = metrics.synthetic_report(forest.predict(model, mixed)).first()
    assert (r.n_real_samples, r.n_synthetic_anomalies, r.top_k) == (80, 12, 12)
    assert r.roc_auc > 0.8 and r.recall_at_top_k > 0.5
    again = metrics.inject_synthetic(table.repartition(9))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    spiked = mixed.filter("label = 1").toPandas()
    assert (spiked.error_ratio <= 1).all() and (spiked.error_count >= 7).all()


def test_synthetic_short_input(spark):
    rows, ddl = feature_rows(3, 0)
    mixed = metrics.inject_synthetic(spark.createDataFrame(rows, ddl))
    assert mixed.filter("label = 1").count() == 5 and mixed.count() == 8
    with pytest.raises(ValueError):
        metrics.inject_synthetic(spark.createDataFrame([], ddl))
    with pytest.raises(ValueError):
        metrics.inject_synthetic(spark.range(3).withColumnRenamed("id", "time_window"))


def test_labelled_metrics(spark, trained):
    model, table = trained
    y = table.withColumn("label", (F.col("logs_per_window") > 500).cast("int"))
    r = metrics.labelled_report(forest.predict(model, y)).first()
    assert r.recall == 1.0 and r.n_positive == 3 and r.roc_auc == 1.0 and 0 <= r.precision <= 1
    one = metrics.labelled_report(forest.predict(model, y.withColumn("label", F.lit(0)))).first()
    assert one.roc_auc is None and one.pr_auc is None and one.recall == 0
    with pytest.raises(ValueError):
        metrics.require_binary(y.withColumn("label", F.lit(5)))


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 20, 500) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, anomaly_score double")
    got = metrics.ranking_metrics(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    steps, prev, ap = np.unique(s)[::-1], 0.0, 0.0
    for t in steps:
        rec, prec = (pos >= t).mean(), (y[s >= t] == 1).mean()
        ap, prev = ap + (rec - prev) * prec, rec
    assert got.roc_auc == pytest.approx(auc) and got.pr_auc == pytest.approx(ap)


def test_combined_report(spark, trained):
    from faultline.plans.prepare import evaluate_detector
    model, table = trained
    labels = table.filter(F.minute("time_window") % 2 == 0).select(
        "time_window", (F.col("logs_per_window") > 500).cast("int").alias("label"))
    got = {(r.section, r.metric): r.value for r in evaluate_detector(model, table, labels).collect()}
    assert got[("labeled", "recall")] == 1.0 and ("synthetic", "roc_auc") in got
    assert got[("unsupervised", "n_samples")] == 63
    with pytest.raises(ValueError):
        evaluate_detector(model, table, labels.withColumn(
            "time_window", F.expr("time_window + interval 1 year")))


def test_zscores_and_top(spark, trained):
    model, table = trained
    z = features.zscores(table).agg(*[F.avg(c) for c in FEATURES]).first()
    assert all(abs(v) < 1e-9 for v in z)
    assert forest.top_anomalies(model, table, 3).filter("logs_per_window = 900").count() == 3
