"""Streaming: sweep and inertial samples in step, late sweeps, session resets, keyframes, evicted map state.

Batch twins have the same rules; a stream withholds what is still open at its final watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pointspark.session import scratch

LATE_SECONDS = 0.010


def as_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP, Parquet may deliver TIMESTAMP_NTZ."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


#: Keyed state with timers needs a state store of several column families.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files_stream(spark: SparkSession, path: str, at_once: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, so many in a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(path)


def drained(stream: DataFrame, mode: str, keyed: bool = False) -> DataFrame:
    """What a stream gives of the input that is there now, written to files in the shared checkpoint folder and read back.

    ``keyed``: the stream holds keyed state, for whose run the session's state store is exchanged.
    """
    spark = stream.sparkSession
    out, state, name = scratch(spark), scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if keyed:
        spark.conf.set(name, STATE_STORE)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        if keyed:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(out)


def sync_samples(sweeps: DataFrame, samples: DataFrame, by: str, start: str, end: str, at: str, delay: str = "1 second", longest: str = "10 seconds") -> DataFrame:
    """Each sweep with the samples in (start, end] (J15, X2): a stream-stream interval join with watermarks on both sides.

    The sweep leaves the state once the samples' watermark has passed its end, hence never before all samples are there. Samples stay for
    the ``longest`` sweep; a longer one is an error and not a loss of its samples.
    """
    span = F.expr(f"INTERVAL {longest}")
    checked = F.when(F.col(end).cast("timestamp") - F.col(start).cast("timestamp") > span, F.raise_error(F.lit(f"a sweep is longer than {longest}")).cast("timestamp")).otherwise(F.col(end).cast("timestamp"))
    a = as_event_time(sweeps.withColumn(end, checked), end, delay).alias("a")
    b = as_event_time(samples, at, delay).alias("b")
    cond = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"b.{at}") > F.col(f"a.{start}").cast("timestamp")) & (F.col(f"b.{at}") <= F.col(f"a.{end}")) & (F.col(f"b.{at}") >= F.col(f"a.{end}") - span)
    return a.join(b, cond).select("a.*", *[F.col(f"b.{c}") for c in samples.columns if c != by])


def enough_samples(joined: DataFrame, key: list[str], least: int = 5) -> DataFrame:
    """(key, samples) of sweeps with more than four samples."""
    return joined.groupBy(*key).agg(F.count("*").alias("samples")).where(F.col("samples") >= least)


def drop_late(sweeps: DataFrame, by: str, start: str, end: str, order: str) -> DataFrame:
    """Sweeps that begin no more than 10 ms before the end of the last one that was kept (X3), batch form.

    Each decision depends on the one before it, so one stream's sweeps (one narrow row each) are folded in order.
    """
    fields = {f.name: f.dataType.simpleString() for f in sweeps.schema.fields}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, keep = pdf.sort_values(order), None, []
        for a, b in zip(pdf[start], pdf[end]):
            keep.append(last is None or not last - a > LATE_SECONDS)
            last = b if keep[-1] else last
        return pdf.loc[keep, [by, order]]

    kept = sweeps.select(by, start, end, order).groupBy(by).applyInPandas(fold, f"`{by}` {fields[by]}, `{order}` {fields[order]}")
    return sweeps.join(kept, [by, order], "left_semi")


def sessions_batch(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """(by, start, end, n): sessions by inactivity, batch twin of sessions_stream."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    return e.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions_stream(events: DataFrame, by: str, at: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    e = as_event_time(events, at, delay)
    return e.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reset_sessions(scans: DataFrame, by: str, order: str, degenerate: str, bound: int, warm_up: int) -> DataFrame:
    """Adds session and saved: more than ``bound`` degenerate scans in a row end a session (X9), whose first ``warm_up``
    scans aren't saved. Batch form: gaps and islands over the scans of one stream (one row a scan)."""
    w = W.partitionBy(by).orderBy(order)
    rows = scans.withColumn("_ok", F.sum((~F.col(degenerate)).cast("int")).over(w))
    run = F.row_number().over(W.partitionBy(by, "_ok").orderBy(order)) - F.when(F.col("_ok") > 0, 1).otherwise(0)
    rows = rows.withColumn("_run", run)
    # every (bound + 1)-th degenerate scan of a run resets; the next scan begins a session
    rows = rows.withColumn("_reset", (F.col(degenerate) & (F.col("_run") % (bound + 1) == 0)).cast("int"))
    rows = rows.withColumn("session", F.coalesce(F.sum("_reset").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy(by, "session").orderBy(order))
    return rows.withColumn("saved", place > warm_up).drop("_ok", "_run", "_reset")


class SessionReset(StatefulProcessor):
    """Streaming form of reset_sessions: (degenerate scans in a row, session, scans so far) per key."""

    bound, warm_up = 3, 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "run int, session long, place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, session, place = self.state.get() if self.state.exists() else (0, 0, 0)
        out = []
        for pdf in [pd.concat(list(rows)).sort_values("scan_id")]:  # a batch's scans of one stream, in their order
            for scan, bad in zip(pdf.scan_id, pdf.degenerate):
                place += 1
                out.append((key[0], int(scan), session, place > self.warm_up))
                run = run + 1 if bad else 0
                if run > self.bound:
                    run, session, place = 0, session + 1, 0
        self.state.update((run, session, place))
        yield pd.DataFrame(out, columns=["stream", "scan_id", "session", "saved"])

    def close(self) -> None:
        pass


def reset_stream(scans: DataFrame) -> DataFrame:
    """scans: stream, scan_id, degenerate, in order of arrival."""
    return scans.groupBy("stream").transformWithStateInPandas(SessionReset(), "stream string, scan_id long, session long, saved boolean", "Append", "None")


class MapState(StatefulProcessor):
    """Voxel clusters as keyed state (X6, X8): sums that are added to, closed once ``reach`` metres of path have passed.

    A voxel that comes back later begins anew; one that never does is evicted by a timer on the path, which serves as event time (a
    metre is a second). Rows: the voxel's figures after each batch (open), and those of a closed episode.
    """

    reach = 700.0
    columns = ["ix", "iy", "iz", "n", "cx", "cy", "cz", "open"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("c", "n long, sx double, sy double, sz double, seen double")

    def _row(self, key, held: tuple, is_open: bool) -> tuple:
        n, sx, sy, sz, _ = held
        return (*key, n, sx / n, sy / n, sz / n, is_open)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0)
        pdf, closed = pd.concat(list(rows)).sort_values("path"), []
        path = pdf.path.to_numpy(dtype=float)
        before = [held[4] if held[0] else path[0], *path[:-1]]
        episode = (path - before > self.reach).cumsum()
        for e in range(int(episode[-1]) + 1):
            part = pdf[episode == e]
            if e or not len(part):  # a gap longer than the reach lies before this part
                closed += [self._row(key, held, False)] if held[0] else []
                held = (0, 0.0, 0.0, 0.0, 0.0)
            if len(part):
                held = (held[0] + len(part), held[1] + float(part.x.sum()), held[2] + float(part.y.sum()), held[3] + float(part.z.sum()), max(held[4], float(part.path.max())))
        self.state.update(held)
        if getattr(self, "handle", None) is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int((held[4] + self.reach) * 1000))
        yield pd.DataFrame([self._row(key, held, True), *closed], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else (0,)
        self.state.clear()
        yield pd.DataFrame([self._row(key, held, False)] if held[0] else [], columns=self.columns)

    def close(self) -> None:
        pass


def map_stream(points: DataFrame, size: float, reach: float = MapState.reach, mode: str = "Append") -> DataFrame:
    """points: x, y, z, path; emits each touched voxel's count and centroid, and closed episodes (``open`` false)."""
    from pointspark.operators.grid import CELL, with_cell

    processor = MapState()
    processor.reach = reach
    timed = with_cell(points, size).withColumn("at", F.timestamp_seconds("path")).withWatermark("at", "0 seconds")
    return timed.groupBy(*CELL).transformWithStateInPandas(processor, "ix long, iy long, iz long, n long, cx double, cy double, cz double, open boolean", mode, "EventTime")


def keyframes(poses: pd.DataFrame, every: int, move: float, turn: float) -> pd.DataFrame:
    """Poses of one session -> keyframes: every ``every``-th scan if it moved or turned enough since the last one."""
    import numpy as np

    p = poses.sort_values("scan_id")
    last, keep = None, []
    for i, r in enumerate(p.itertuples(index=False)):
        if (i + 1) % every:
            continue
        q = np.array([r.qx, r.qy, r.qz, r.qw])
        at = np.array([r.x, r.y, r.z])
        if last is not None:
            dot = abs(q @ last[1]) / max(np.linalg.norm(q) * np.linalg.norm(last[1]), 1e-12)
            if np.linalg.norm(at - last[0]) < move and np.degrees(2 * np.arccos(min(1.0, dot))) < turn:
                continue
        last = (at, q)
        keep.append((r.cloud_id, r.scan_id))
    return pd.DataFrame(keep, columns=["cloud_id", "scan_id"])


def session_keyframes(poses: DataFrame, every: int = 10, move: float = 0.1, turn: float = 5.0) -> DataFrame:
    """Sequential by nature: one row a scan, grouped by session."""
    return poses.groupBy("cloud_id").applyInPandas(lambda pdf: keyframes(pdf, every, move, turn), "cloud_id string, scan_id long")
