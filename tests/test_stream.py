from pyspark.sql import functions as F

from srcloom.streaming import rowlocal


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("src/a.ts", "token = abc"), ("README.md", "plain"), ("config/x.json", '"secret": "v"')]
    batch = spark.createDataFrame(rows, "file_path string, content string")
    batch.write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    q = (
        rowlocal.classify_files(stream)
        .writeStream.format("memory").queryName("got").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.awaitTermination()
    got = {tuple(map(str, r)) for r in spark.table("got").collect()}
    assert got == {tuple(map(str, r)) for r in rowlocal.classify_files(batch).collect()}
