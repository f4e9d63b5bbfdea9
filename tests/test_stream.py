"""The streaming aggregation run as a stream: files arrive one after the other, late ones within the watermark count."""

from datetime import datetime, timedelta

from modweave.streaming.sites import stream_site_counts


def test_sites_of_a_stream(spark, tmp_path):
    shape = "contig string, ref_position long, motif string, methylated boolean, probability double, ts timestamp"
    begin = datetime(2024, 5, 1)
    at = lambda minutes: begin + timedelta(minutes=minutes)
    rows = [[("c", 5, "m", True, 0.9, at(5)), ("c", 5, "m", True, 0.1, at(10))], [("c", 5, "m", True, 0.8, at(70))], [("c", 5, "m", False, None, at(20))], [("c", 7, "m", True, 0.7, at(600))], [("c", 5, "m", True, 0.9, at(1))]]
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/in")
    stream = stream_site_counts(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for part in rows:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = sorted((r.begin, r.ref_position, r.meth, r.unmeth) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the last row comes ten hours late, after its window was closed
    assert got == [(at(0), 5, 1, 2), (at(60), 5, 1, 0)]
