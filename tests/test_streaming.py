"""The event mix over a streaming source (complete-mode aggregation)."""

import os

from conftest import EVENT_SCHEMA, at, event
from tidemark.operators import event_mix


def test_event_mix_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [event(f"E{i}", "C1", "S1", at(f"0{i}:00"), t) for i, t in
            enumerate(["page_view", "page_view", "purchase", "page_view", "add_to_cart"])]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(src)
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(src)
    query = (event_mix(stream).writeStream.outputMode("complete").format("memory")
             .queryName("tidemark_event_mix")
             .option("checkpointLocation", os.path.join(str(tmp_path), "ckpt")).start())
    try:
        query.processAllAvailable()
        got = {r["event_type"]: r["count"] for r in spark.sql("SELECT * FROM tidemark_event_mix").collect()}
    finally:
        query.stop()
    assert got == {"page_view": 3, "purchase": 1, "add_to_cart": 1}
