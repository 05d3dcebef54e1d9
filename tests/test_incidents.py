import pytest
from pyspark.sql import functions as F

from faultline.constants import NO_INCIDENT, UNDETERMINED
from faultline.operators import attribution, evidence, forest, incidents, neighbours
from faultline.plans import investigate as inv

HOT, NET, QUIET = "INC-026", "INC-011", "INC-004"


def stub_retriever(queries):
    """Two fixed hits for every query, the DataNode runbook first."""
    return queries.select("query_id", F.explode(F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("hdfs_datanode_failure.md").alias("source"),
                 F.lit(1).cast("long").alias("chunk_id")),
        F.struct(F.lit(2).alias("rank"), F.lit("hdfs_network_failure.md").alias("source"),
                 F.lit(2).cast("long").alias("chunk_id")))).alias("h")).select("query_id", "h.*")


@pytest.fixture(scope="module")
def reports(spark, storm):
    _, inc, cases = storm
    model = forest.train(inc)
    scores = forest.verdicts(model, inc)
    factors = attribution.explain(model, inc).select("incident_no", "factors")
    df = inv.incident_reports(cases, stub_retriever, scores, factors, neighbours.similar_incidents(inc))
    return {r.incident_id: r for r in df.collect()}


def test_numbers_and_summary(spark, storm):
    lines, inc, _ = storm
    assert incidents.incident_count(inc).first()[0] == 40
    numbers = [r.incident_no for r in inc.orderBy("time_window").collect()]
    assert numbers == list(range(1, 41))
    s = {r.incident_id: r for r in incidents.incident_summary(lines, inc, "1min").collect()}
    assert s[HOT].n_errors == 25 and s[HOT].signals["heartbeat"] == 25 and s[HOT].n_logs == 35
    assert s[NET].n_warnings == 8 and s[NET].components == ["dfs.DataNode"]
    assert s[HOT].level_counts == {"ERROR": 25, "INFO": 10}
    assert (s[HOT].window_end - s[HOT].window_start).total_seconds() == 60
    assert incidents.list_incidents(inc, sort_by="severity").first().incident_id == HOT
    assert incidents.list_incidents(inc, limit=5).count() == 5


def test_ids(spark, storm):
    _, inc, _ = storm
    asked = ["inc-26", "26", "INC_026", " inc 26 ", "INC-999", "abc", "INC-000", "0", "-1", "  ", None,
             "99999999999999999999"]
    df = spark.createDataFrame([(a,) for a in asked], "raw_id string")
    got = {r.raw_id: r.incident_id for r in incidents.resolve_ids(df, inc).collect()}
    assert [got[a] for a in asked[:4]] == [HOT] * 4 and all(got[a] is None for a in asked[4:])
    assert incidents.incident_features(inc, "inc-26").first().heartbeat_failures == 25
    big = spark.createDataFrame([(1000,)], "n long").select(incidents.incident_id(F.col("n"))).first()[0]
    assert big == "INC-1000"


def test_lines(spark, storm):
    lines, inc, _ = storm
    first = incidents.incident_lines(lines, inc, limit=5).filter(F.col("incident_id") == HOT).collect()
    assert len(first) == 5 and [r.Timestamp for r in first] == sorted(r.Timestamp for r in first)
    top = incidents.with_line_totals(incidents.top_lines(lines, 10), inc, 10)
    rows = top.filter(F.col("incident_id") == HOT).collect()
    assert len(rows) == 10 and all(r.Level == "ERROR" for r in rows)
    assert {(r.total_logs, r.shown) for r in rows} == {(35, 10)}
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            incidents.top_lines(lines, bad)
    with pytest.raises(ValueError):
        incidents.list_incidents(inc, sort_by="size")


def test_line_ranking_is_cut_before_the_shuffle(storm):
    plan = incidents.top_lines(storm[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_similar(storm):
    _, inc, _ = storm
    rows = neighbours.similar_incidents(inc).collect()
    assert len(rows) == 120 and all(r.similar_no != r.incident_no for r in rows)
    assert {r.rank for r in rows} == {1, 2, 3} and all(0 <= r.similarity <= 1 for r in rows)


def test_plan_and_query(storm):
    cases = {r.incident_id: r for r in storm[2].withColumn(
        "plan", evidence.investigation_plan()).collect()}
    assert [s.query for s in cases[HOT].suspicious] == ["HDFS DataNode heartbeat failure"]
    assert cases[QUIET].suspicious == [] and len(cases[QUIET].plan) == 5 and len(cases[HOT].plan) == 6
    assert [s.tool for s in cases[HOT].plan][:3] == ["get_logs", "get_features", "detect_anomaly"]
    assert cases[HOT].plan[-1].tool == "find_similar_incidents"
    auto = cases[HOT].auto_query
    assert auto.startswith("HDFS heartbeat failure DataNode") and "blk_<id>" in auto and "<ip>" in auto
    assert cases[QUIET].auto_query == "HDFS abnormal behaviour troubleshooting"


def test_reports(reports):
    hot, net, quiet = reports[HOT], reports[NET], reports[QUIET]
    assert hot.root_cause == "DataNode failure" and hot.is_anomaly and hot.confidence > 0.5
    assert "hdfs_datanode_failure.md" in hot.runbooks and hot.similar_incidents and hot.recommendations
    assert net.root_cause == "Network failure"                # although the DataNode runbook ranks first
    assert quiet.root_cause == NO_INCIDENT and quiet.is_anomaly is False
    assert 0.5 <= quiet.confidence <= 0.9
    assert any(e.startswith("ML factor:") for e in hot.evidence)
    assert hot.ml_explanation.method == "shap" and len(hot.ml_explanation.top_factors) == 5
    assert "Only the 30 most severe of 35 log lines were analysed." in hot.limitations
    # 30 listed ERROR lines at 3 points... 25 exist; 5 routine lines add nothing; the feature adds 5.
    # Two searches give the same two chunks, so only one position per chunk counts.
    assert hot.cause_scores["DataNode failure"] == 25 * 3 + 5 + 1.5
    assert hot.cause_scores["Network failure"] == 0.5
    assert hot.explanation[0].startswith("Root-cause scores: DataNode failure 81.5, Network failure 0.5")
    notes = next(x for x in hot.explanation if x.startswith("Supported by"))
    assert "[ERROR] Lost heartbeat from datanode <ip> block " in notes


def test_missing_parts_still_give_a_cause(storm):
    rows = {r.incident_id: r for r in inv.incident_reports(storm[2]).collect()}
    r = rows[HOT]
    assert r.root_cause == "DataNode failure" and r.anomaly_score is None and r.ml_explanation is None
    assert any("anomaly detection was unavailable" in x for x in r.limitations)
    assert any("No runbook" in x for x in r.limitations) and r.similar_incidents == []
    assert not any(e.startswith("ML") for e in r.evidence)


def test_factors_without_score_stay(spark, storm):
    _, inc, cases = storm
    factors = attribution.explain(forest.train(inc, trees=20), inc).select("incident_no", "factors")
    r = inv.incident_reports(cases, factors=factors).filter(F.col("incident_id") == HOT).first()
    assert r.ml_explanation.top_factors and not any("ML factor" in e for e in r.evidence)


def test_analyze(spark, storm):
    reports = inv.incident_reports(storm[2])
    asked = [(1, "please look at inc-26 for me"), (2, "DataNode heartbeat failure"),
             (3, "something feels slow"), (4, "   "), (5, None), (6, "what about INC_999?"),
             (7, "network timeout")]
    df = spark.createDataFrame(asked, "query_id long, query string")
    got = {r.query_id: r for r in inv.analyze(df, reports, stub_retriever).collect()}
    assert set(got) == {1, 2, 3, 6, 7}
    assert got[1].incident_id == HOT and got[1].root_cause == "DataNode failure"
    assert got[2].root_cause == "DataNode failure" and got[2].incident_id is None
    assert got[2].cause_scores["DataNode failure"] == 2 + 1 + 1.5
    assert got[3].root_cause == UNDETERMINED and got[3].confidence == 0.2
    assert got[6].found is False and got[6].root_cause is None
    assert got[7].root_cause == "Network failure"
    for i in (2, 7):  # what the hits say is evidence, and the answer names its one step
        assert list(got[i].evidence) == [f"Runbook match: {s}" for s in got[i].runbooks]
        assert [e.type for e in got[i].evidence_details] == ["runbook"] * len(got[i].runbooks)
        assert [(s.step, s.tool) for s in got[i].plan] == [(1, "search_runbook")] and list(got[i].similar_incidents) == []
    assert got[1].evidence and got[1].plan and got[6].evidence is None


def test_history(spark, storm, tmp_path):
    path = str(tmp_path / "history")
    reports = inv.incident_reports(storm[2])
    for day, part in (("2035-01-01", "incident_no <= 2"), ("2035-01-02", "incident_no = 26")):
        inv.append_history(reports.filter(part), path, F.lit(f"{day} 08:00:00").cast("timestamp"))
    asked = spark.createDataFrame([(7, "network timeout"), (8, "what about INC_999?"), (9, "look at inc-26")], "query_id long, query string")
    inv.append_history(inv.analyze(asked, reports), path, F.lit("2035-01-03 08:00:00").cast("timestamp"))
    log = inv.read_history(spark, path)
    assert log.count() == 6
    newest = inv.history(log, 3).collect()
    assert [(r.entry, r.incident_id, r.query) for r in newest] == [
        (9, HOT, None), (8, None, "what about INC_999?"), (7, None, "network timeout")]
    assert [r.entry for r in inv.history(log, 5).collect()] == [9, 8, 7, 26, 2]
    plan = inv.history(log, 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2035-01-02" in plan
    inv.append_history(reports.filter("incident_no = 3"), path)  # now
    assert inv.read_history(spark, path).count() == 7
    with pytest.raises(ValueError):
        inv.history(log, 0)


def test_labels(storm):
    _, inc, _ = storm
    labels = inc.filter("incident_no % 2 = 0").select(
        F.col("time_window").cast("string").alias("time_window"), F.lit(1).alias("label"))
    assert incidents.join_labels(inc, labels).count() == 20
    assert incidents.label_coverage(inc, labels).first().coverage == 0.5
    with pytest.raises(ValueError):
        incidents.join_labels(inc, labels.drop("label"))
