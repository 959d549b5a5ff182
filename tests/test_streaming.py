import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkloom.streaming import watch

T0 = datetime(2024, 1, 1)


def rows(*events):
    return [("p", path, kind, T0 + timedelta(seconds=s)) for path, kind, s in events]


def frame(spark, data):
    return spark.createDataFrame(data, "project string, path string, kind string, ts timestamp")


def test_watched_paths(spark):
    cases = {"src/a.rs": True, "a.tsx": True, "x.toml": True, "x.png": False, "target/a.rs": False, "src/target/a.rs": True, ".git/x.json": False, "src/.cache/a.py": False, "noext": False}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert dict(df.select("path", watch.watched(F.col("path"))).collect()) == cases


def test_debounce_keeps_events_one_gap_apart(spark):
    e = frame(spark, rows(("a", "Create", 0), ("b", "Modify", 2), ("a", "Modify", 4), ("c", "Modify", 7)))
    got = [(r["n_events"], r["paths"]) for r in watch.debounce(e).orderBy("first_ts").collect()]
    assert got == [(3, ["a", "b"]), (1, ["c"])]
    assert watch.drain(e, T0 + timedelta(seconds=5)).count() == 1


def test_stream_of_event_files(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for i, (path, kind, s) in enumerate([("a.rs", "Create", 0), ("b.rs", "Access", 1), ("a.rs", "Modify", 1), ("z.rs", "Modify", 60), ("y.rs", "Modify", 120)]):
        (folder / f"{i}.json").write_text(json.dumps({"path": path, "kind": kind, "ts": (T0 + timedelta(seconds=s)).isoformat() + "Z"}))
    seen = []
    bursts = watch.debounce_stream(watch.read_events(spark, str(folder)))
    q = bursts.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, i: seen.extend(b.collect())).start()
    q.awaitTermination(120)
    assert sorted((r["n_events"], tuple(r["paths"])) for r in seen)[:2] == [(1, ("z.rs",)), (2, ("a.rs",))]


def test_processing_time_timer(spark, tmp_path):
    import time

    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join(json.dumps({"path": p, "kind": "Modify", "ts": "2024-01-01T00:00:00Z"}) for p in ("b.rs", "a.rs", "a.rs", "x.png")))
    seen = []
    q = watch.debounce_timer(watch.read_events(spark, str(folder)), 500).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").foreachBatch(lambda b, i: seen.extend(b.collect())).start()
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    q.stop()
    assert [(r["project"], r["paths"]) for r in seen] == [("default", ["a.rs", "b.rs"])]
