import pytest
from pyspark.sql import functions as F

from helpers import FOUR, storm_rows
from faultline.constants import FEATURES, REQUIRED_COLUMNS
from faultline.plans import prepare
from faultline.sources import logs, store


def write_csv(folder, rows, extra=""):
    lines = [",".join(REQUIRED_COLUMNS) + (",Extra" if extra else "")]
    lines += [",".join("" if v is None else f'"{v}"' for v in r) + (f",{extra}" if extra else "") for r in rows]
    (folder / logs.STRUCTURED_FILE).write_text("\n".join(lines) + "\n")


def test_structured_logs(spark, tmp_path):
    write_csv(tmp_path, FOUR, "x")
    df = logs.load_structured_logs(spark, str(tmp_path / logs.STRUCTURED_FILE))
    row = df.orderBy("LineId").first()
    assert row.Date == "081109" and row.LineId == 1 and row.Extra == "x"
    assert [r.LineId for r in df.orderBy("pos").collect()] == [1, 2, 3, 4]


def test_bad_bytes_are_replaced(spark, tmp_path):
    path = tmp_path / logs.STRUCTURED_FILE
    path.write_bytes((",".join(REQUIRED_COLUMNS) + "\n").encode()
                     + b"1,081109,203615,1,INFO,dfs.A,caf\xe9 text,E1,t\n")
    assert logs.load_structured_logs(spark, str(path)).first().Content.startswith("caf�")


def test_missing_empty_and_header_only(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        logs.load_structured_logs(spark, str(tmp_path / "none.csv"))
    (tmp_path / "zero.csv").write_text("")
    with pytest.raises(ValueError):
        logs.load_structured_logs(spark, str(tmp_path / "zero.csv"))
    write_csv(tmp_path, [])
    assert logs.load_structured_logs(spark, str(tmp_path / logs.STRUCTURED_FILE)).count() == 0


def test_load_all(spark, tmp_path):
    write_csv(tmp_path, FOUR)
    loose = logs.load_all(spark, str(tmp_path), strict=False)
    assert loose.raw is None and loose.templates is None and loose.structured.count() == 4
    with pytest.raises(FileNotFoundError):
        logs.load_all(spark, str(tmp_path))
    (tmp_path / logs.RAW_FILE).write_text("one line\nanother\n")
    (tmp_path / logs.TEMPLATES_FILE).write_text("EventId,EventTemplate\nE1,<*> text\n")
    full = logs.load_all(spark, str(tmp_path))
    assert full.raw.count() == 2 and full.templates.first().EventTemplate == "<*> text"


def test_prepare_honours_window(spark, tmp_path):
    write_csv(tmp_path, storm_rows())
    lines, feats, report = prepare.prepare(spark, str(tmp_path), str(tmp_path / "out"), "1min")
    assert lines.count() == 433 and feats.count() == 40 and report["can_process"]
    _, wide, _ = prepare.prepare(spark, str(tmp_path), str(tmp_path / "out5"), "5min", strict=True)
    assert wide.count() == 8 and set(wide.columns) == {"time_window", *FEATURES}
    model, summary = prepare.train_model(spark, str(tmp_path / "out" / "features"),
                                         str(tmp_path / "model"), "1min")
    assert summary.first().n_samples == 40
    assert store.load_model(spark, str(tmp_path / "model")).offset == model.offset


def test_strict_prepare_blocks(spark, tmp_path):
    write_csv(tmp_path, FOUR + [FOUR[0]])
    with pytest.raises(ValueError):
        prepare.prepare(spark, str(tmp_path), str(tmp_path / "o"), "5min", strict=True)
    write_csv(tmp_path, [(*r[:1], "garbage", *r[2:]) for r in FOUR])
    with pytest.raises(ValueError):
        prepare.prepare(spark, str(tmp_path), str(tmp_path / "o"), "5min")


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2.5)], "a int, b double, c double")
    store.write_report(df, str(tmp_path / "r"))
    row = spark.read.schema("a int, b double, c double").json(str(tmp_path / "r")).first()
    assert row.b is None and row.c == 2.5


def test_prepared_logs_are_pruned_by_date(spark, tmp_path):
    write_csv(tmp_path, FOUR)
    prepare.prepare(spark, str(tmp_path), str(tmp_path / "o"), "5min")
    one_day = spark.read.parquet(str(tmp_path / "o" / "logs")).filter(F.col("date") == "2008-11-09")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and one_day.count() == 4


def test_one_odd_quote_leaves_other_files_splittable(spark, tmp_path):
    """Only the file with a record over two lines is read whole; records that don't fit are counted per file."""
    folder = tmp_path / "logs"
    folder.mkdir()
    header = "LineId,Date,Time,Pid,Level,Component,Content,EventId,EventTemplate"
    line = "{},081109,203615,143,INFO,dfs.A,{},E1,t"
    (folder / "a b%.csv").write_text("\n".join([header, *(line.format(i, "x" * 200) for i in range(5_000))]) + "\n")
    (folder / "odd.csv").write_text("\n".join([header, line.format(9001, '"two\nlines, ""quoted"""'), line.format(9002, "plain")]) + "\n")
    (folder / "bad.csv").write_text("\n".join([header, "9003,081109,203615", line.format(9004, "ok"), line.format(9005, "ok") + ",more"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = logs.load_structured_logs(spark, str(folder))
        blocks = df.select("pos.file", "pos.block").distinct().groupBy("file").count().collect()
        assert sorted((r.file.rsplit("/", 1)[1].startswith("a"), r["count"] > 5) for r in blocks) == [(False, False), (False, False), (True, True)]
        got = {r.LineId: r.Content for r in df.filter("LineId > 9000").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {9001: 'two\nlines, "quoted"', 9002: "plain", 9003: None, 9004: "ok", 9005: "ok"}
    damaged = {r.file.rsplit("/", 1)[1]: (r.n_records, r.n_damaged) for r in logs.damaged_records(spark, str(folder)).collect()}
    assert damaged.pop("bad.csv") == (3, 2) and damaged.pop("odd.csv") == (2, 0) and list(damaged.values()) == [(5_000, 0)]
