from pyspark.sql import functions as F

from seepkit.streaming.limits import windowed_limits


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    hit = F.col("value") > 50
    want = {tuple(r) for r in windowed_limits(table, hit, "event_type").collect()}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = windowed_limits(stream, hit, "event_type").writeStream.outputMode("complete").format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM limits").collect()} == want
