from cladeframe import schemas
from cladeframe.streaming import running_counts


def test_running_counts(spark, tmp_path):
    path = str(tmp_path / "muts")
    rows = [(0, 0, i, 0, i, -1, t, 1, "A") for i, t in enumerate("SSID")]
    spark.createDataFrame(rows, schemas.NUC_MUT).write.parquet(path)
    stream = running_counts(spark, path).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        stream.processAllAvailable()
        spark.createDataFrame(rows[:1], schemas.NUC_MUT).write.mode("append").parquet(path)
        stream.processAllAvailable()
        assert {r.type: r.n for r in spark.table("counts").collect()} == {"S": 3, "I": 1, "D": 1}
    finally:
        stream.stop()
