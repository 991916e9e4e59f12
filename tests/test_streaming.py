"""ST1: streaming hourly aggregation equals the batch operator on a replayed table."""

import tempfile

from fleetrisk.operators.hourly import aggregate_hourly
from fleetrisk.sources.events_fixture import load_readings
from fleetrisk.streaming.hourly_stream import hourly_stream

SF = "/root/testdata/sf0.001"


def test_stream_hourly_matches_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    from fleetrisk.sources.events_fixture import readings_from_events
    stream = hourly_stream(readings_from_events(src), watermark="100 days")
    ckpt = tempfile.mkdtemp(prefix="fleetrisk-stream-")
    q = (stream.writeStream.outputMode("update").format("memory").queryName("hourly_st1")
         .option("checkpointLocation", ckpt).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM hourly_st1")
    batch = aggregate_hourly(load_readings(spark, SF))
    cols = ["inverter_id", "datetime", "inv_power", "inv_alarm_code", "inv_kwh_today"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert len(a) == len(b) == 951
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(x[2] - y[2]) < 1e-9 and x[3:] == y[3:] for x, y in zip(a, b))


def test_scoring_stream_matches_batch(spark):
    import tempfile
    from fleetrisk.operators.serving import complete_readings, readings_from_featured
    from fleetrisk.plans.store import baseline_table, featured_table
    from fleetrisk.streaming.hourly_stream import scoring_stream
    feat = featured_table(spark, SF)
    src_dir = tempfile.mkdtemp(prefix="fleetrisk-readings-")
    readings_from_featured(feat).write.mode("overwrite").parquet(src_dir + "/r")
    batch_in = spark.read.parquet(src_dir + "/r")
    base = baseline_table(spark, SF)
    stream_in = spark.readStream.schema(batch_in.schema).parquet(src_dir + "/r")
    q = (scoring_stream(stream_in, base).writeStream.format("memory").queryName("serve_st2")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="fleetrisk-st2-")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM serve_st2").collect())
    want = sorted(tuple(r) for r in complete_readings(batch_in, base).collect())
    assert got == want and len(got) == 951
