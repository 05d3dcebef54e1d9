import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from helpers import FOUR, log_frame
from faultline.constants import FEATURES
from faultline.functions.timeparse import parse_clock, window_interval
from faultline.operators import clean, features, validate


def report(df):
    return validate.validation_report(df).first().asDict()


def test_clean_report(four):
    r = report(four)
    assert r["is_valid"] and r["can_process"] and r["n_rows"] == 4 and not r["warnings"]


def test_missing_column_and_empty(spark, four):
    r = report(four.drop("Level"))
    assert not r["can_process"] and r["missing_columns"] == ["Level"]
    assert report(four.limit(0))["errors"] == ["DataFrame is empty."]


def test_bad_level_and_time_are_warnings(spark):
    rows = [list(r) for r in FOUR]
    rows[0][4], rows[1][2] = "BOGUS", "999999"
    r = report(log_frame(spark, [tuple(x) for x in rows]))
    assert r["can_process"] and not r["is_valid"]
    assert (r["invalid_log_levels"], r["invalid_timestamps"]) == (1, 1)


def test_no_valid_time_blocks(spark):
    df = log_frame(spark, [(*r[:1], "garbage", *r[2:]) for r in FOUR])
    assert "No valid timestamps found." in report(df)["errors"]
    with pytest.raises(ValueError):
        validate.require_valid(df)


def test_duplicates_and_strict(spark):
    df = log_frame(spark, FOUR + [FOUR[0], (1, *FOUR[1][1:])])
    r = report(df)
    assert (r["duplicate_rows"], r["duplicate_line_ids"]) == (1, 2)
    assert validate.duplicate_rows(df).first()[0] == 1
    assert validate.duplicate_line_ids(df).first()[0] == 2
    assert validate.require_valid(df)["can_process"]
    with pytest.raises(ValueError):
        validate.require_valid(df, strict=True)


def test_clock_forms(spark):
    cases = [("81109.0", "203615", dt.datetime(2008, 11, 9, 20, 36, 15)),
             (" 081109 ", "3615.0", dt.datetime(2008, 11, 9, 0, 36, 15)),
             ("990101", "000000", dt.datetime(1999, 1, 1)), ("680101", "000000", dt.datetime(2068, 1, 1)),
             ("690101", "1", dt.datetime(1969, 1, 1, 0, 0, 1)),
             ("081109", "999999", None), ("garbage", "203615", None), (None, "203615", None),
             ("0811091", "203615", None), ("081345", "203615", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, d string, t string")
    got = {r.i: r.ts for r in df.select("i", parse_clock(F.col("d"), F.col("t")).alias("ts")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_windows_and_errors():
    assert window_interval("5min") == "5 minute" and window_interval("1 hour") == "1 hour"
    for bad in ("", "five", "0min", None):
        with pytest.raises(ValueError):
            window_interval(bad)


def test_two_windows(four):
    rows = features.preprocess(four, "5min").orderBy("time_window").collect()
    a, b = rows
    assert (a.logs_per_window, a.error_count, a.heartbeat_failures, a.block_errors, a.error_ratio) == \
        (2, 1, 1, 1, 0.5)
    assert (b.fatal_count, b.disk_errors, b.warning_count) == (1, 1, 1)
    assert a.time_window == dt.datetime(2008, 11, 9, 20, 35)


def test_null_level_content_and_duplicates(spark):
    rows = [list(r) for r in FOUR]
    rows[0][4], rows[1][6] = None, None
    df = log_frame(spark, [tuple(r) for r in rows] + [tuple(rows[0])])
    got = clean.preprocess_logs(df, "5min")
    assert got.count() == 4
    assert got.filter("LineId = 1").first().Level == "UNKNOWN"


def test_first_line_id_wins_even_when_untimed(spark):
    df = log_frame(spark, [(1, "bad", *FOUR[0][2:]), FOUR[0], FOUR[1]])
    assert [r.LineId for r in clean.preprocess_logs(df, "5min").collect()] == [2]


def test_null_line_ids_count_as_one(spark):
    df = log_frame(spark, [(None, *FOUR[0][1:]), (None, *FOUR[1][1:]), FOUR[2]])
    assert clean.clean_logs(df).count() == 2
    blank = (None,) * 9
    assert clean.clean_logs(log_frame(spark, [blank, FOUR[0]])).count() == 1


def test_empty_features_keep_columns(spark):
    df = log_frame(spark, [(*r[:1], "bad", *r[2:]) for r in FOUR])
    out = features.preprocess(df, "5min")
    assert out.count() == 0 and out.columns == ["time_window", *FEATURES]
    with pytest.raises(ValueError):
        clean.preprocess_logs(df.drop("Pid"), "5min")


def test_partitioning_does_not_matter(spark):
    from helpers import SF_SMALL
    from faultline.sources.tables import log_lines
    raw = log_lines(spark, SF_SMALL)
    results = []
    for n in (1, 4, 32):
        rows = features.preprocess(raw.repartition(n), "10min").collect()
        results.append(sorted(map(tuple, rows)))
    assert results[0] == results[1] == results[2]
    assert sum(r[1] for r in results[0]) == clean.preprocess_logs(raw, "10min").count()


def test_hot_line_id_leaves_map_side(spark, four):
    """The first-row filter must be planned below the shuffle."""
    plan = clean.clean_logs(four)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_message_text_is_not_shuffled_for_features(spark):
    from helpers import SF_SMALL
    from faultline.sources.tables import log_lines
    import re
    plan = features.preprocess(log_lines(spark, SF_SMALL), "10min")._jdf.queryExecution().optimizedPlan()
    window = [ln for ln in plan.toString().splitlines() if re.search(r"Window \[", ln)]
    assert window and "Content" not in plan.output().toString()


def test_impute_and_coerce(spark):
    rows = [(1, "3", float("nan"), None), (2, "abc", 1.0, None), (3, "5", float("inf"), None),
            (4, "10", 2.0, None)]
    df = spark.createDataFrame(rows, "k int, a string, b double, c double")
    got = {r.k: (r.a, r.b, r.c) for r in features.impute(df, ["a", "b", "c"]).collect()}
    assert got == {1: (3.0, 1.5, 0.0), 2: (5.0, 1.0, 0.0), 3: (5.0, 1.5, 0.0), 4: (10.0, 2.0, 0.0)}
    with pytest.raises(ValueError):
        features.impute(df, ["missing"])


def test_row_digests(spark):
    """Values don't run into each other, null isn't empty, and equal rows have equal digests."""
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("-", ""), (None, ""), ("1:a", "-"), ("ab", "c"), (None, None), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a string, b string, pos int")
    digests = [bytes(r[0]) for r in df.orderBy("pos").select(validate.row_digest(df)).collect()]
    assert len(set(digests)) == len(set(rows)) == 8
    assert [digests.index(d) for d in digests] == [rows.index(r) for r in rows]
    assert validate.duplicate_rows(df).first()[0] == 2


def test_no_text_is_shuffled_for_the_report(spark, four):
    for df in (validate.duplicate_rows(four), validate.validation_report(four)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.splitlines() if "HashAggregate" in line or "SortAggregate" in line or "Exchange" in line]
        assert sent and not any(re.search(r"(?<!_null_)Content#", line) for line in sent)


def test_gate_rows(spark, four):
    def gated(df):
        return {r.mode: (r.passed, r.reason) for r in validate.gate(validate.validation_report(df)).collect()}

    assert gated(four) == {"lenient": (True, None), "strict": (True, None)}
    twice = gated(four.union(four))
    assert twice["lenient"] == (True, None) and twice["strict"][1].startswith("Strict validation failed: 4 duplicate rows")
    assert gated(four.drop("Level"))["lenient"] == (False, "Validation failed: Missing required columns: Level")
