"""Progress of running meetings: batch forms and streams. The watermark only bounds state; nothing here is an event-time window.

The streams with state of their own are stateful processors on RocksDB: a value for each key, an event-time timer that forgets a
key which stays quiet, and an initial state from a batch, so that a stream can go on where a table ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.sources.tables import overwrite_buckets, path_exists, with_bucket

EVERY_SECONDS = 2.0
STAGES = ("transcribing", "categorizing")
LEAST_STEP = 0.005
ETA_SCHEMA = "meeting_id long, stage string, ts timestamp, progress double, eta_seconds double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS_SCHEMA = "meeting_id long, ts timestamp, stage string, progress double, bucket int"


def progress_eta(events: DataFrame) -> DataFrame:
    """Events (meeting_id, ts, stage, progress) of the two long stages with eta_seconds, null while it can't be told.

    The base is the first event with the least progress so far; the estimate is the rest at the rate since the base.
    """
    order = Window.partitionBy("meeting_id", "stage").orderBy("ts", "progress").rowsBetween(Window.unboundedPreceding, 0)
    told = events.where(F.col("stage").isin(*STAGES)).withColumn("_base", F.min(F.struct("progress", "ts")).over(order))
    gained, passed = F.col("progress") - F.col("_base.progress"), F.timestamp_diff("MICROSECOND", F.col("_base.ts"), F.col("ts"))
    eta = F.when((gained > LEAST_STEP) & (passed > 0), F.round((1 - F.col("progress")) * (passed / 1_000_000) / gained, 3))
    return told.withColumn("eta_seconds", eta).drop("_base")


def latest_status(events: DataFrame) -> DataFrame:
    """The last stage and progress of each meeting; the same for a batch and (in update mode) a stream."""
    return events.groupBy("meeting_id").agg(F.max(F.struct("ts", "stage", "progress")).alias("last")).select("meeting_id", "last.*")


def clamp(events: DataFrame) -> DataFrame:
    """Progress held within 0 and 1."""
    return events.withColumn("progress", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("progress"))))


def measured(events: DataFrame) -> DataFrame:
    """Events with progress within 0 and 1: seconds / total_seconds where they come with these columns, and then without the
    events that have no total; else their own progress, clamped."""
    if "total_seconds" in events.columns:
        share = F.col("seconds") / F.col("total_seconds")
        events = events.where("total_seconds > 0").withColumn("progress", share).select("meeting_id", "ts", "stage", "progress")
    return clamp(events)


def _passed(times: list[float], last: float | None, every: float) -> tuple[list[bool], float | None]:
    """Which of the ordered times are at least `every` seconds after the last one that passed, and that time at the end."""
    keep = []
    for t in times:
        ok = last is None or t - last >= every
        keep.append(ok)
        last = t if ok else last
    return keep, last


def throttle_batch(events: DataFrame, every: float = EVERY_SECONDS) -> DataFrame:
    """T1 for a batch: of each meeting the events at least `every` seconds after the last one that passed, as `measured`."""
    told = measured(events)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "stage", "progress"])
        keep, _ = _passed([t.value / 1e9 for t in group["ts"]], None, every)
        return group[keep]

    return told.groupBy("meeting_id").applyInPandas(run, told.schema)


class _Remembering(StatefulProcessor):
    """One value for each key, kept until the watermark has passed the key's latest event by keep_for."""

    schema = ""

    def __init__(self, keep_for: str):
        self.keep_ms = int(pd.Timedelta(keep_for).total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", self.schema)

    def remember(self, value: tuple, latest: float, timers) -> None:
        """Keeps the value and moves the key's timer; latest: seconds of event time."""
        self.state.update(value)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(int(latest * 1000) + self.keep_ms, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Throttle(_Remembering):
    schema = "t double"

    def __init__(self, every: float, keep_for: str):
        super().__init__(keep_for)
        self.every = every

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        last = initialState["ts"].max().value / 1e9
        self.remember((last,), last, timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(list(rows)).sort_values(["ts", "stage", "progress"])
        last = self.state.get()[0] if self.state.exists() else None
        keep, last = _passed([t.value / 1e9 for t in told["ts"]], last, self.every)
        self.remember((last,), last, timerValues)
        yield told[keep]


def _stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema, keep_for: str, initial: DataFrame | None) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = None if initial is None else initial.groupBy(*keys)
    return stream.withWatermark("ts", keep_for).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime", initialState=known)


def throttle_progress(stream: DataFrame, every: float = EVERY_SECONDS, keep_for: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """T1 for a stream, as `measured`: state is the time of the last event that passed; a meeting quiet for `keep_for` of event
    time is forgotten. initial: meeting_id, ts of events that have passed before the stream begins."""
    told = measured(stream)
    return _stateful(told, ["meeting_id"], _Throttle(every, keep_for), told.schema, keep_for, initial)


def progress_eta_batch(events: DataFrame) -> DataFrame:
    """T3 for a batch: the state machine of the stream over each meeting's and stage's events in order.

    A task goes once over the sorted events of many keys and holds a batch of them and the state of the last key: neither a call
    for each key nor a whole key in memory.
    """
    told = events.where(F.col("stage").isin(*STAGES)).select("meeting_id", "stage", "ts", "progress")
    ordered = told.repartition("meeting_id", "stage").sortWithinPartitions("meeting_id", "stage", F.asc_nulls_last("ts"), F.asc_nulls_last("progress"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, base = None, None
        for rows in batches:
            if len(rows):
                if last is not None and _begins(pd.concat([last, rows.head(1)]))[1]:
                    base = None
                out, base, _ = _estimates(rows, base)
                last = rows.tail(1)
                yield out

    return _rounded(ordered.mapInPandas(run, ETA_SCHEMA))


def _rounded(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("eta_seconds", F.round("eta_seconds", 3))


def _begins(rows: pd.DataFrame) -> np.ndarray:
    """Which of the ordered rows is the first of its meeting and stage."""
    new = np.zeros(len(rows), bool)
    for c in ("meeting_id", "stage"):
        now, before = rows[c], rows[c].shift()
        new |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(bool)
    new[:1] = True
    return new


def _estimates(rows: pd.DataFrame, base: tuple | None) -> tuple[pd.DataFrame, tuple, float]:
    """Estimates, not rounded, for ordered rows of one key after another from the first key's base (time, progress) so far, the last
    key's base behind them, the last time. A key that begins without progress gets no estimate."""
    us, p = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy("float64"), rows["progress"].to_numpy("float64", na_value=np.nan)
    first = _begins(rows)
    first[0] = base is None
    key = first.cumsum()
    level = np.where(np.isnan(p), np.where(first, -np.inf, np.inf), p)
    base_us, base_p = (0, np.inf) if base is None else (round(base[0] * 1e6), -np.inf if np.isnan(base[1]) else base[1])
    least = pd.Series(np.where(key == 0, np.minimum(level, base_p), level)).groupby(key).cummin()
    before = least.shift(fill_value=base_p).to_numpy()
    at = np.maximum.accumulate(np.where(first | (level < before), np.arange(len(p)), -1))  # the base's row; before the rows: -1
    from_us, from_p = np.where(at < 0, base_us, us[at]), np.where(at < 0, base_p, level[at])
    gained, passed = p - from_p, (us - from_us) / 1e6
    told = (gained > LEAST_STEP) & np.isfinite(from_p) & (passed > 0)
    with np.errstate(all="ignore"):
        eta = np.where(told, (1 - p) * passed / gained, np.nan)
    out = rows[["meeting_id", "stage", "ts", "progress"]].assign(eta_seconds=eta)
    return out, (float(from_us[-1]) / 1e6, float(from_p[-1])), float(us[-1]) / 1e6


class _Estimating(_Remembering):
    schema = "t double, p double"

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        _, base, t = _estimates(initialState.sort_values(["ts", "progress"]), None)
        self.remember(base, t, timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(list(rows)).sort_values(["ts", "progress"])
        out, base, t = _estimates(told, tuple(self.state.get()) if self.state.exists() else None)
        self.remember(base, t, timerValues)
        yield out


def progress_eta_stream(stream: DataFrame, keep_for: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """W8 on a stream; state is the base's time and progress for each meeting and stage. initial: earlier events (meeting_id,
    stage, ts, progress) whose base counts."""
    wanted = stream.where(F.col("stage").isin(*STAGES))
    known = None if initial is None else initial.where(F.col("stage").isin(*STAGES))
    return _rounded(_stateful(wanted, ["meeting_id", "stage"], _Estimating(keep_for), ETA_SCHEMA, keep_for, known))


def upsert_status(batch: DataFrame, path: str, buckets: int = 64) -> None:
    """T2 into a table: the last status of the batch's meetings goes into the table at path, by hash bucket of the meeting.

    Only the buckets that the batch has are read and written again, through a staged folder. What a meeting has with a later
    time stays, so that a batch given twice, or after a later one, changes nothing.
    """
    spark = batch.sparkSession
    new = with_bucket(latest_status(batch), buckets)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    both = new.select("meeting_id", "ts", "stage", "progress")
    if path_exists(spark, path):
        old = spark.read.schema(STATUS_SCHEMA).parquet(path).where(F.col("bucket").isin(touched))
        both = both.unionByName(old.select("meeting_id", "ts", "stage", "progress"))
    overwrite_buckets(with_bucket(latest_status(both), buckets), path)


def status_table(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """A writer of the stream's statuses into the table at path; `.start()` or a trigger runs it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_status(batch, path, buckets))
