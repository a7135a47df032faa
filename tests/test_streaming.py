"""The streamed matrix equals the one of the whole table."""

from matloom import functions, streaming


def test_stream_equals_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    whole = streaming.counts(spark.read.parquet(path), "user_id", "event_type", "ts", "1 day")
    spark.read.parquet(path).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(str(tmp_path / "in"))
    q = streaming.counts(stream, "user_id", "event_type", "ts", "1 day").writeStream.outputMode("complete").format("memory").queryName("grown").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("grown").collect())) == sorted(map(tuple, whole.collect()))


def test_clamp_and_binarize(spark):
    x = spark.createDataFrame([(0, 0, -1.0), (0, 1, 3.0), (0, 2, 1.0)], "id long, dim int, value double")
    assert sorted(r.value for r in functions.clamp_to_simplex(x).collect()) == [0, 0.5, 0.5]
    assert [r.value for r in functions.binarize(x.where("dim > 0")).collect()] == [1.0, 1.0]
