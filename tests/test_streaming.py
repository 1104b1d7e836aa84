from pyspark.sql import functions as F

from spantrack import streaming
from spantrack.operators.coverage import coverage_runs


def test_stream_equals_batch(spark, tmp_path):
    rows = [("c", i * 3, i * 3 + 10) for i in range(40)]
    df = spark.createDataFrame(rows, "seqid string, start int, end int")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.append_coverage(stream, ["seqid"], str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["start"], r["end"]): r["depth"] for r in streaming.read_coverage(spark, ["seqid"], str(tmp_path / "out")).collect()}
    want = {(r["start"], r["end"]): r["depth"] for r in coverage_runs(df, ["seqid"]).collect()}
    assert got == want


def test_windows(spark):
    df = spark.range(100).select((F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    assert sum(r["n"] for r in streaming.windowed_counts(df, "ts", "k", "v").collect()) == 100
    assert streaming.sessions(df, "ts", "k", "5 minutes").count() == 100
