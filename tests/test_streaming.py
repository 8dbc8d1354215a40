from datetime import datetime, timedelta

from vecquarry.streaming import windows


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, f"e{i % 2}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    got = windows.running_queries(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "check"), "tumbled", width="1 hour")
    batch = {tuple(r) for r in windows.tumbling(df).collect()}
    streamed = {tuple(r) for r in got.collect()}
    # the last window is still open when the stream ends
    assert streamed <= batch and len(batch) - len(streamed) <= 4 and streamed
    assert windows.sliding(df, "1 hour", "30 minutes").agg({"n": "sum"}).first()[0] == 400
    s = windows.sessions(df, "10 minutes")
    assert s.count() == 200 and windows.sessions(df, "22 minutes").count() == 3
