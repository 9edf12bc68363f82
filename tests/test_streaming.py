from datetime import datetime, timedelta

from weftline.streaming import transitions

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows():
    start = datetime(2024, 1, 1)
    return [(k, start + timedelta(minutes=7 * k), k % 3, ("view", "click", "buy")[k % 3 if k % 2 else 0], 1.0) for k in range(40)]


def run(spark, tmp_path, build, name):
    events = spark.createDataFrame(rows(), SCHEMA)
    events.unionByName(events.limit(5)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_count_each_event_once(spark, tmp_path):
    got = run(spark, tmp_path, transitions.windowed_counts, "w")
    # Windows that the watermark has passed are out, whole.
    want = {}
    for _, ts, _, kind, _ in rows():
        want[ts.replace(minute=0), kind] = want.get((ts.replace(minute=0), kind), 0) + 1
    assert got and all(want[r.start, r.event_type] == r.n for r in got)


def test_sessions_end_after_a_gap(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: transitions.sessions(s, "10 minutes"), "s")
    assert got and all(r.n >= 1 for r in got)


def test_transitions(spark):
    got = {(r.src, r.dst): r.n for r in transitions.transitions(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert sum(got.values()) == 37
