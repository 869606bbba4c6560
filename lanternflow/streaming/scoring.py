"""Stateful scoring of event streams.

Per entity the state holds the last seq_len events (token, destination, log bytes) and the instant of the
newest one; for the cooldown, the instant of the last alert. Everything else - tokens, features,
z-scores - uses the same column expressions as the batch plan. Within a micro-batch an
entity's rows are ordered by time and row id; a row older than what its entity was scored on in
earlier batches is late and left out. One entity's share of a micro-batch is handled together, so the batch size
limits (maxFilesPerTrigger, maxOffsetsPerTrigger) bound the memory of a task.

With an ``idle`` time, a silence of more than that many seconds ends an entity's context, wherever the batches
are cut. So state that is older than the watermark by ``idle`` can matter to no accepted row, and an event-time
timer of the entity drops it. The cooldown's state goes in the same way when the cooldown has passed. Both need a
stream with a watermark on ``timestamp``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanternflow.functions import scores as S
from lanternflow.functions import values as V
from lanternflow.operators import alerts as A
from lanternflow.operators import nextevent as N
from lanternflow.operators import tokens as K
from lanternflow.plans.detection import WINDOW_COLUMNS, Detector, score_profiled, with_profiles

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ARRAYS = "toks array<int>, dsts array<string>, logs array<double>"
_IN = ["entity_id", "timestamp", "event_row_id", "event_type", "dst_id", "label", "token_str", "token_id", "x"]


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with transformWithState needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


# The instant of a row without a timestamp.
_NO_TIME = np.iinfo(np.int64).min


def _in_time_order(rows: Iterator[Row]) -> list[Row]:
    """By instant and row id, nulls last."""
    batch = list(rows)
    if len(batch) > 1:
        at, tie = (batch[0].__fields__.index(c) for c in ("at", "event_row_id"))
        batch.sort(key=lambda r: (r[at] is None, r[at] or 0, r[tie] is None, r[tie] or 0))
    return batch


def _column(batch: list[Row], name: str) -> list:
    i = batch[0].__fields__.index(name)
    return [r[i] for r in batch]


def _longs(values: list) -> np.ndarray:
    return np.array([_NO_TIME if v is None else v for v in values], np.int64)


class _Expiring(StatefulProcessor):
    """State that is of use for ``keep`` seconds after an instant; an entity has at most one timer."""

    keep: int | None = None

    def _expire(self, new: bool, last: int) -> None:
        """Set the timer of state that has just come up; ``last`` in microseconds."""
        if new and self.keep is not None:
            self.handle.registerTimer(last // 1000 + self.keep * 1000 + 1)

    def _last(self) -> int | None:
        raise NotImplementedError

    def _clear(self) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self._last()
        if last is not None:
            if last // 1000 + self.keep * 1000 < timerValues.getCurrentWatermarkInMs():
                self._clear()
            else:
                self._expire(True, last)
        yield from ()

    def close(self) -> None:
        pass


def _sessions(at: np.ndarray, last: int | None, idle: int | None) -> np.ndarray:
    """For each row, how many rows of this batch its unbroken run holds before it; -1 per row if the run began earlier."""
    n = len(at)
    if idle is None:
        return np.full(n, -1) if last is not None else np.arange(n)
    before = np.r_[at[0] if last is None else last, at[:-1]]
    breaks = at - before > idle * 1_000_000
    breaks[0] |= last is None
    begin = np.maximum.accumulate(np.where(breaks, np.arange(n), -1))
    return np.where(begin >= 0, np.arange(n) - begin, -1)


class ContextWindows(_Expiring):
    """Emit each event with a full context together with its window arrays."""

    def __init__(self, seq_len: int, idle: int | None = None):
        self.seq_len, self.keep = seq_len, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", _ARRAYS + ", last_at bigint")

    def _last(self) -> int | None:
        held = self.recent.get()
        return None if held is None else held[3]

    def _clear(self) -> None:
        self.recent.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = _in_time_order(rows)
        *held, last = self.recent.get() or ([], [], [], None)
        at = _longs(_column(batch, "at"))
        if last is not None:
            on_time = at >= last
            batch, at = [r for r, kept in zip(batch, on_time.tolist()) if kept], at[on_time]
            if not batch:
                return
        own = _sessions(at, last, self.keep)
        carried = len(held[0])
        toks, dsts, logs = ([*h, *_column(batch, c)] for h, c in zip(held, ("token_id", "dst_id", "x")))
        context = np.where(own >= 0, own, carried + np.arange(len(at)))
        fields = batch[0].__fields__
        kept = [i for i, c in enumerate(fields) if c not in ("x", "timestamp")]
        out = Row(*[fields[i] for i in kept], "toks", "dsts", "logs")
        for i in np.flatnonzero(context >= self.seq_len).tolist():
            span, row = slice(carried + i - self.seq_len, carried + i + 1), batch[i]
            yield out(*[row[k] for k in kept], toks[span], dsts[span], logs[span])
        left = min(self.seq_len, int(context[-1]) + 1)
        self.recent.update((*[x[len(x) - left:] for x in (toks, dsts, logs)], int(at[-1])))
        self._expire(last is None, int(at[-1]))


class Cooldown(_Expiring):
    """Set is_anomaly and suppressed from the last emitted alert of the entity."""

    def __init__(self, seconds: int, expire: bool = False):
        self.seconds, self.keep = seconds, seconds if expire else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def _last(self) -> int | None:
        held = self.last.get()
        return None if held is None else held[0]

    def _clear(self) -> None:
        self.last.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = _in_time_order(rows)
        gap, before = self.seconds * 1_000_000, self._last()
        at = _longs(_column(batch, "at"))
        listed = np.array(_column(batch, "listed"), bool)
        open_ = np.flatnonzero(np.array(_column(batch, "candidate"), bool) & ~listed)
        times = at[open_]
        alert, i = np.zeros(len(at), bool), 0 if before is None else int(np.searchsorted(times, before + gap))
        follows = np.searchsorted(times, times + gap).tolist()  # the next candidate that a kept one lets through
        while i < len(times):
            alert[open_[i]] = True
            i = follows[i]
        # The last alert strictly before each row.
        fired = np.where(alert, at, np.iinfo(np.int64).min)
        newest = np.maximum.accumulate(np.r_[np.iinfo(np.int64).min if before is None else before, fired[:-1]])
        known = newest > np.iinfo(np.int64).min
        repeat = known & (at - np.where(known, newest, 0) < gap)
        if alert.any():
            last = int(at[alert][-1])
            self.last.update((last,))
            self._expire(before is None, last)
        fields = batch[0].__fields__
        kept = [i for i, c in enumerate(fields) if c not in ("candidate", "listed", "at")]
        out = Row(*[fields[i] for i in kept], "is_anomaly", "suppressed")
        for row, fires, off in zip(batch, alert.tolist(), (listed | repeat).tolist()):
            yield out(*[row[k] for k in kept], fires, off)


class RecentEvents(_Expiring):
    """Bounded buffer of each entity's latest events; emits its size and time range per batch."""

    def __init__(self, limit: int = 1000, idle: int | None = None):
        self.limit, self.keep = limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "ids array<bigint>, at array<bigint>")

    def _last(self) -> int | None:
        held = self.kept.get()
        return None if held is None else held[1][-1]

    def _clear(self) -> None:
        self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = _in_time_order(rows)
        ids, at = [list(part) for part in self.kept.get() or ([], [])]
        last = at[-1] if at else None
        now, new_ids = _longs(_column(batch, "at")), _longs(_column(batch, "event_row_id"))
        if at:
            on_time = now >= last
            now, new_ids = now[on_time], new_ids[on_time]
            if not len(now):
                return
        own = _sessions(now, last, self.keep)
        held = int(own[-1]) + 1 if own[-1] >= 0 else len(at) + len(now)
        keep = min(self.limit, held)
        ids, at = [(old + new.tolist())[-keep:] for old, new in ((ids, new_ids), (at, now))]
        self.kept.update((ids, at))
        self._expire(last is None, at[-1])
        yield Row(entity_id=key[0], buffered=len(ids), first_at=at[0], last_at=at[-1], last_id=ids[-1])


class Tally(StatefulProcessor):
    """Events and anomalies of an entity in one micro-batch, and whether the entity is new.

    The state is one flag for each entity ever seen, which is what an exact count of distinct entities needs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "flag boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = not self.seen.exists()
        if fresh:
            self.seen.update((True,))
        events, anomalies = 0, 0
        for row in rows:
            events, anomalies = events + 1, anomalies + bool(row.is_anomaly)
        yield Row(entity_id=key[0], events=events, anomalies=anomalies, fresh=int(fresh))

    def close(self) -> None:
        pass


def _time_mode(keep: int | None) -> str:
    return "None" if keep is None else "EventTime"


def stream_windows(events: DataFrame, d: Detector, idle: int | None = None) -> DataFrame:
    """Full windows of a stream with the seven features, from keyed state (see above for ``idle``)."""
    tokens = K.tokenize(events, d.tokenizer).withColumn("x", V.log_bytes(F.col("bytes")))
    extra = [c for c in ("split",) if c in events.columns]
    rows = tokens.select(*_IN, F.unix_micros("timestamp").alias("at"), *extra)
    out = T.StructType([f for f in rows.schema.fields if f.name not in ("x", "timestamp")] + T._parse_datatype_string(_ARRAYS).fields)
    held = rows.groupBy("entity_id").transformWithState(ContextWindows(d.seq_len, idle), out, "Append", _time_mode(idle))
    features = {
        "timestamp": F.timestamp_micros("at"),
        "tok_uniq": S.distinct_count(F.col("toks")), "tok_top_share": S.top_share(F.col("toks")),
        "dst_uniq": S.distinct_count(F.col("dsts")), "dst_top_share": S.top_share(F.col("dsts")),
        "bytes_mean": S.array_mean(F.col("logs")), "bytes_std": S.array_std(F.col("logs")),
        "t1": F.element_at("toks", -2), "t2": F.element_at("toks", -3),
        "repeat_last": (F.element_at("toks", -2) == F.col("token_id")).cast("double")}
    return held.withColumns(features).select(
        *WINDOW_COLUMNS, *extra, "tok_uniq", "tok_top_share", "dst_uniq", "dst_top_share", "bytes_mean", "bytes_std",
        "repeat_last")


def score_stream(events: DataFrame, d: Detector, ablations: dict[str, Sequence[str]] | None = None,
                 idle: int | None = None) -> DataFrame:
    """Streaming twin of ``score_events``: state for the context, static joins for the model."""
    return score_profiled(with_profiles(stream_windows(events, d, idle), d), d, ablations, add_nll=N.with_nll_by_lookup)


def with_stream_cooldown(scored: DataFrame, d: Detector, expire: bool = False) -> DataFrame:
    """Policy on a scored stream (usually the table the scoring query writes).

    ``expire`` drops the last alert when the watermark has passed its cooldown.
    """
    t = F.lit(float(d.threshold))
    listed = ~A.passes_allowlist("score", t, d.allowlist, d.allowlist_margin)
    rows = scored.withColumns({"threshold": t, "candidate": F.col("score") >= t, "listed": listed})
    if d.cooldown_seconds <= 0:
        return rows.withColumns({"is_anomaly": F.col("candidate") & ~F.col("listed"), "suppressed": F.col("listed")}
                                ).drop("candidate", "listed")
    rows = rows.withColumn("at", F.unix_micros("timestamp"))
    fields = [f for f in rows.schema.fields if f.name not in ("candidate", "listed", "at")]
    out = T.StructType(fields + [T.StructField("is_anomaly", T.BooleanType()), T.StructField("suppressed", T.BooleanType())])
    return rows.groupBy("entity_id").transformWithState(
        Cooldown(d.cooldown_seconds, expire), out, "Append", _time_mode(d.cooldown_seconds if expire else None))


def recent_events(events: DataFrame, limit: int = 1000, idle: int | None = None) -> DataFrame:
    rows = events.select("entity_id", "timestamp", "event_row_id", F.unix_micros("timestamp").alias("at"))
    return rows.groupBy("entity_id").transformWithState(
        RecentEvents(limit, idle), "entity_id string, buffered int, first_at bigint, last_at bigint, last_id bigint",
        "Update", _time_mode(idle))


def tally(scored: DataFrame) -> DataFrame:
    """``entity_id, events, anomalies, fresh`` of every micro-batch of a stream with ``is_anomaly``."""
    return scored.select("entity_id", "is_anomaly").groupBy("entity_id").transformWithState(
        Tally(), "entity_id string, events long, anomalies long, fresh long", "Update", "None")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is available and stop; the sink is a Parquet table."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
