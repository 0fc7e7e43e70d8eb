import time

from geoloom.streaming import requests as S


def test_a_restart_goes_on_where_it_stopped(spark, tmp_path):
    schema = "event_id long, slot long, kind string, version long"
    src = tmp_path / "in"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    run = lambda: S.run_available(S.drop_stale(spark.readStream.schema(schema).parquet(str(src))), str(tmp_path / "out"), str(tmp_path / "state"))
    put([(1, 1, "assign", 3), (2, 1, "answer", 3), (3, 1, "answer", 2), (4, 2, "answer", 5)])
    assert {(r["event_id"], r["verdict"]) for r in run().collect()} == {(1, "assigned"), (2, "kept"), (3, "stale"), (4, "stale")}
    put([(5, 1, "answer", 3), (6, 1, "assign", 4), (7, 1, "answer", 3)])
    assert {(r["event_id"], r["verdict"]) for r in run().filter("event_id > 4").collect()} == {(5, "kept"), (6, "assigned"), (7, "stale")}


def test_caught_up_is_told(spark, tmp_path):
    told = []
    listener = S.CaughtUp(told.append)
    spark.streams.addListener(listener)
    try:
        spark.range(7).write.parquet(str(tmp_path / "in"))
        S.run_available(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        for _ in range(50):
            if told:
                break
            time.sleep(0.1)
        assert sum(told) == 7
    finally:
        spark.streams.removeListener(listener)
