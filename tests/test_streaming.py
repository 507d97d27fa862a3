"""The stream's counts are those of the batch."""

from datetime import datetime, timedelta

from crestline.streaming.online import streaming_counts


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=13 * i), i % 5, "view" if i % 3 else "click") for i in range(400)]
    events = spark.createDataFrame(rows + rows[:20], "event_id long, ts timestamp, user_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = streaming_counts(stream).writeStream.outputMode("update").format("memory").queryName("stream_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.topic, r.start): (r.n_all, r.n_feat) for r in spark.sql("SELECT topic, window.start, n_all, n_feat FROM stream_counts").collect()}
    want: dict = {}
    for _, ts, user, kind in rows:
        key = (str(user), ts.replace(hour=ts.hour // 6 * 6, minute=0))
        n, f = want.get(key, (0, 0))
        want[key] = (n + 1, f + (kind == "view"))
    assert got == want
