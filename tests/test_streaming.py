import pytest
from pyspark.sql import functions as F

from helpers import LOG_DDL, SF_SMALL
from faultline.operators import features, forest
from faultline.sources.tables import log_lines
from faultline.streaming.windows import epoch_folder, score_batches, stream_features


def drain(query):
    query.awaitTermination(300)
    if query.exception():
        raise query.exception()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Lines as a folder of files, plus two far-future lines that push the watermark past all others."""
    path = str(tmp_path_factory.mktemp("stream") / "lines")
    raw = log_lines(spark, SF_SMALL)
    raw.repartition(3).select(*[c.split()[0] for c in LOG_DDL.split(", ")][:-1],
                              F.col("pos").cast("long").alias("pos")).write.parquet(path)
    late = [(10 ** 9 + i, "350101", f"00{i:02d}00", 1, "INFO", "dfs.x", "text", "E1", "T1", 0) for i in (0, 1)]
    for row in late:
        spark.createDataFrame([row], LOG_DDL).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_equals_batch_on_closed_windows(spark, stored, tmp_path):
    lines = spark.readStream.schema(LOG_DDL).option("maxFilesPerTrigger", 2).parquet(stored)
    out = stream_features(lines, "10min", "60 days")
    assert out.isStreaming
    drain(out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
          .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append")
          .trigger(availableNow=True).start())
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, features.preprocess(
        log_lines(spark, SF_SMALL), "10min").collect()))
    assert len(want) > 100 and got == want


def test_scored_stream(spark, trained, tmp_path):
    model, table = trained
    src = str(tmp_path / "rows")
    table.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(table.schema).parquet(src)
    sink = score_batches(model, lambda df, epoch: df.select("time_window", "anomaly_score").write.mode(
        "append").parquet(str(tmp_path / "scored")))
    drain(stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp"))
          .trigger(availableNow=True).start())
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "scored")).collect()))
    want = sorted(map(tuple, forest.predict(model, table).select("time_window", "anomaly_score").collect()))
    assert got == want


def test_replayed_epochs_are_written_once(spark, trained, tmp_path):
    """The log of finished epochs is lost, so the last one runs again, as after a failure between sink and log."""
    model, table = trained
    src, out, state = (str(tmp_path / x) for x in ("rows", "scored", "cp"))
    table.repartition(4).write.parquet(src)
    ran = []

    def run():
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(src)
        write = score_batches(model, epoch_folder(out))
        drain(stream.writeStream.foreachBatch(lambda df, epoch: (ran.append(epoch), write(df, epoch))[1])
              .option("checkpointLocation", state).trigger(availableNow=True).start())

    run()
    last = max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())
    for f in (tmp_path / "cp" / "commits").iterdir():
        if str(last) in f.name:
            f.unlink()
    run()
    assert ran.count(last) == 2
    got = sorted(map(tuple, spark.read.parquet(out).select("time_window", "anomaly_score").collect()))
    assert got == sorted(map(tuple, forest.predict(model, table).select("time_window", "anomaly_score").collect()))
