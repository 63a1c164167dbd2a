"""Streams give what one batch over everything gives."""

import json

from pyspark.sql import functions as F

from quillmass.operators import inventory
from quillmass.streaming import arrivals

SCHEMA = "chunk_id string, source_file string, text string"


def test_mined_stream_equals_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(f"c{i}", f"f{i % 2}", f"A diagnostic ion at m/z {150 + i % 3}.05 of betacyanin.") for i in range(9)]
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("chunk_id", "source_file", "text"), r, strict=True))) for r in rows[3 * k : 3 * k + 3]))
    for _ in range(2):  # the second run finds nothing new
        arrivals.mine_stream(arrivals.read_chunk_stream(spark, str(folder), SCHEMA, 1), "cls", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(r.fragment_mz, tuple(r.evidence_ids)) for r in arrivals.merged_claims(spark, str(tmp_path / "out")).collect()}
    whole = inventory.mine_diagnostics(spark.createDataFrame(rows, SCHEMA), "cls")
    assert found == {(r.fragment_mz, tuple(r.evidence_ids)) for r in whole.collect()} and len(found) == 3


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    counted = arrivals.windowed_counts(stream, "ts", ["event_type"], "1 day", value=F.col("value"))
    counted.writeStream.format("memory").queryName("counted_events").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.start, r.event_type, r.events) for r in spark.table("counted_events").collect()} == {(r.w.start, r.event_type, r.n) for r in want.collect()}
