import pytest
from pyspark.sql import functions as F

from pointspark.streaming import sessions
from tests.conftest import SMALL


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_sessions_equal_the_batch_twin_but_for_open_ones(spark):
    path = f"{SMALL}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(SMALL + "/event*.parquet")
    _run(sessions.sessions_stream(events, "user_id", "ts", "6 hours"), "s1")
    batch = {tuple(r) for r in sessions.sessions_batch(spark.read.parquet(path), "user_id", "ts", "6 hours").collect()}
    got = {tuple(r) for r in spark.table("s1").collect()}
    last = spark.read.parquet(path).agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    assert got <= batch and all(end > last for _, _, end, _ in batch - got)


def test_sweeps_meet_their_samples(spark, tmp_path):
    spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", "2024-01-01 00:00:01")], "s string, sweep long, b string, e string").withColumns({"b": F.to_timestamp("b"), "e": F.to_timestamp("e")}).write.parquet(str(tmp_path / "w"))
    spark.range(30).select(F.lit("a").alias("s"), (F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 0.1)).alias("at"), F.col("id").alias("k")).write.parquet(str(tmp_path / "i"))
    w = spark.readStream.schema(spark.read.parquet(str(tmp_path / "w")).schema).parquet(str(tmp_path / "w"))
    i = spark.readStream.schema(spark.read.parquet(str(tmp_path / "i")).schema).parquet(str(tmp_path / "i"))
    _run(sessions.sync_samples(w, i, "s", "b", "e", "at"), "s2")
    assert spark.table("s2").count() == 10
    assert sessions.enough_samples(spark.table("s2"), ["sweep"]).first()["samples"] == 10


def test_reset_twin(spark):
    bad = [0, 0, 1, 1, 0, 1, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([("a", i, bool(b)) for i, b in enumerate(bad)], "stream string, scan_id long, degenerate boolean")
    got = sessions.reset_sessions(df, "stream", "scan_id", "degenerate", 3, 2).orderBy("scan_id").collect()
    assert [r["session"] for r in got] == [0] * 9 + [1, 1] and [r["saved"] for r in got][:3] == [False, False, True]
    p = sessions.SessionReset()

    class Value:
        v = None
        exists = lambda s: s.v is not None
        get = lambda s: s.v

        def update(s, v):
            s.v = v

    p.state = Value()
    pdf = df.toPandas()
    out = [r for i in (0, 4, 7) for r in next(p.handleInputRows(("a",), iter([pdf.iloc[i : {0: 4, 4: 7, 7: 11}[i]]]), None)).itertuples(index=False)]
    assert [(r.session, r.saved) for r in out] == [(r["session"], r["saved"]) for r in got]


def test_late_sweeps(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 2, 0.995, 2.0), ("a", 3, 1.5, 2.5), ("a", 4, 2.0, 3.0)], "s string, k long, b double, e double")
    assert [r["k"] for r in sessions.drop_late(df, "s", "b", "e", "k").orderBy("k").collect()] == [1, 2, 4]


def test_map_state_evicts_after_the_path(spark):
    pd = pytest.importorskip("pandas")
    m = sessions.MapState()
    held = {}
    m.state = type("V", (), {"exists": lambda s: "v" in held, "get": lambda s: held["v"], "update": lambda s, v: held.update(v=v)})()
    frame = lambda path, n: iter([pd.DataFrame({"x": [1.0] * n, "y": [0.0] * n, "z": [0.0] * n, "path": [path] * n})])
    assert next(m.handleInputRows((0, 0, 0), frame(0.0, 3), None)).n[0] == 3
    assert next(m.handleInputRows((0, 0, 0), frame(100.0, 2), None)).n[0] == 5
    assert next(m.handleInputRows((0, 0, 0), frame(900.0, 2), None)).n[0] == 2
