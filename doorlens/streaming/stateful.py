"""Streaming runs of the batch step functions, on typed state.

Every key (a camera, or a camera and a track) has state variables with schemas of their own: ``progress`` (last frame,
late rows, newest event time, timer), ``waiting`` (rows of the newest frame), and what the rule itself remembers, a
``value`` row and ``entries`` by id (``Memory`` says how). Spark's state reader shows them as columns.

Rows of a micro-batch are sorted by frame inside their key. Where a frame has several rows, its rows may arrive in
several micro-batches: the newest frame of a key waits until a later frame of that key arrives. Rows at or before the
last processed frame are late: they are dropped and counted in ``late_rows`` of the next output row of that key.

With ``Timing`` the stream has a watermark and keys have timers: a key without rows for ``idle_ms`` is closed once the
watermark has passed, without any new row of it. Its waiting frame is processed, the rule says what follows from the
silence (a door is unknown then), and its state is dropped; the tracker keeps its id counter only. Without ``Timing``,
``ttl_ms`` lets state variables expire so long (processing time) after they were last written: a key that never comes
back leaves nothing either (but the tracker's id counter). A stream with ``ttl_ms`` must not stand still for longer
than that, and Spark then runs a batch at every trigger, with or without new rows: give it a trigger interval.

The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``). A micro-batch's rows of one
key are sorted in memory, so the trigger's size limit bounds them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any, Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from doorlens.config import AlertConfig, DoorConfig, TrackerConfig, WarningConfig
from doorlens.functions.geometry import c
from doorlens.operators import stateful as S
from doorlens.operators.folds import column_names

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Timing:
    column: str = "event_time"  # timestamp column of the stream
    delay: str = "10 seconds"  # how late a row may come
    idle_ms: int = 60_000  # silence that closes a key


@dataclass(frozen=True)
class Memory:
    """How a rule's state is stored: schemas of one row and of the rows by id, and the way there and back.

    ``save`` gives (row or None, {id: row}), ``load`` takes the same; entries keep their order.
    """

    save: Callable[[Any], tuple[tuple | None, dict[int, tuple]]]
    load: Callable[[tuple | None, dict[int, tuple]], Any]
    value: str | None = None
    entries: str | None = None


def boxed(values: Any) -> tuple | None:
    return None if values is None else tuple(values)


TRACKS = Memory(
    value="next_id bigint, last_frame bigint",
    entries="x1 int, y1 int, x2 int, y2 int, conf double, age bigint, hits bigint, missed bigint",
    save=lambda s: ((s.next_id, s.last_frame), {i: (*t[0], *t[1:]) for i, t in s.tracks.items()}),
    load=lambda v, e: S.TrackerState(v[0], v[1], {i: [tuple(t[:4]), *t[4:]] for i, t in e.items()}),
)
DOOR = Memory(
    value="state string, history array<struct<label:string,conf:double>>, box array<int>, stable_frames int, "
    "cooldown_until bigint, last_ok_ms bigint, last_ms bigint",
    save=lambda s: ((s.state, s.history, boxed(s.box), s.stable_frames, s.cooldown_until, s.last_ok_ms, s.last_ms), {}),
    load=lambda v, e: S.DoorState(v[0], [boxed(h) for h in v[1]], boxed(v[2]), *v[3:]),
)
CARS = Memory(
    entries="votes array<string>, raised_at bigint, closed_from bigint, age bigint, speed double, center array<double>, "
    "seen bigint, box array<int>, door string, door_box array<int>",
    save=lambda s: (None, {i: tuple(getattr(m, f.name) for f in fields(m)) for i, m in s.cars.items()}),
    load=lambda v, e: S.WarningState(
        {i: S.CarMemory(list(m[0]), *m[1:5], boxed(m[5]), m[6], boxed(m[7]), m[8], boxed(m[9])) for i, m in e.items()}
    ),
)
ALERT = Memory(
    value="door string, door_symbol string, door_run int, alarm boolean, alarm_symbol boolean, alarm_run int",
    save=lambda s: ((s.door.value, s.door.symbol, s.door.run, s.alarm.value, s.alarm.symbol, s.alarm.run), {}),
    load=lambda v, e: S.AlertState(S.RunLatch(*v[:3]), S.RunLatch(*v[3:])),
)
MODE = Memory(
    value="mode string, candidate string, run int",
    save=lambda s: ((s.value, s.symbol, s.run), {}),
    load=lambda v, e: S.RunLatch(*v),
)
PATH = Memory(value="gap array<double>", save=lambda s: ((list(s.gap),), {}), load=lambda v, e: S.SmoothState(list(v[0])))
TURNS = Memory(entries="frame bigint", save=lambda s: (None, {i: (f,) for i, f in s.items()}), load=lambda v, e: {i: r[0] for i, r in e.items()})


def to_rows(pdf: pd.DataFrame, schema: StructType) -> list[tuple]:
    """Rows for a list state: plain Python values, missing ones None."""

    def plain(v: Any, whole: bool) -> Any:
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return None
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime()
        return int(v) if whole else v

    whole = [f.dataType.typeName() in ("long", "integer", "short", "byte") for f in schema.fields]
    names = schema.fieldNames()
    return [tuple(plain(v, w) for v, w in zip(r, whole)) for r in pdf[names].itertuples(index=False, name=None)]


def to_frame(rows: Sequence[tuple], schema: StructType) -> pd.DataFrame:
    """Rows of a list state as Spark hands them to pandas."""
    out = pd.DataFrame.from_records([tuple(r) for r in rows], columns=schema.fieldNames())
    for f in schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out[f.name] = out[f.name].astype(float)
        elif kind in ("long", "integer", "short", "byte"):
            out[f.name] = out[f.name].astype(float if out[f.name].isna().any() else "int64")
        elif kind.startswith("timestamp"):
            out[f.name] = pd.to_datetime(out[f.name])
    return out


@dataclass
class Fold:
    """What a rule needs to run over a stream; see ``stream_fold``."""

    order: Sequence[str]
    start: Callable[[], Any]
    step: Callable[[Any, Any], list[tuple]]
    names: list[str]
    rows: StructType
    memory: Memory
    group: bool
    timing: Timing | None
    ttl_ms: int | None
    silent: Callable[[tuple, Any, int], list[tuple]]
    keep: Callable[[Any], Any] | None

    def steps(self, s: Any, pdf: pd.DataFrame) -> list[tuple]:
        out: list[tuple] = []
        if self.group:
            for _, part in pdf.groupby(self.order[0], sort=True):
                out += self.step(s, list(part.itertuples(index=False)))
        else:
            for row in pdf.itertuples(index=False):
                out += self.step(s, row)
        return out


class FoldProcessor(StatefulProcessor):
    """Runs a ``Fold`` on typed state variables."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        f, ttl = self.fold, self.fold.ttl_ms
        self.handle = handle
        self.progress = handle.getValueState("progress", "last_frame bigint, late_rows bigint, newest_ms bigint, timer_ms bigint", ttl)
        self.waiting = handle.getListState("waiting", f.rows, ttl) if f.group else None
        # what a rule keeps beyond a silence does not expire
        self.value = handle.getValueState("value", f.memory.value, None if f.keep else ttl) if f.memory.value else None
        entries = f.memory.entries and f"place int, {f.memory.entries}"
        self.entries = handle.getMapState("entries", "id bigint", entries, ttl) if entries else None

    def load(self) -> tuple[Any, dict[int, tuple]]:
        """The rule's state and its entries as they are stored."""
        value = tuple(self.value.get()) if self.value and self.value.exists() else None
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()} if self.entries and self.entries.exists() else {}
        if value is None and (self.value or not stored):
            return self.fold.start(), stored
        in_order = sorted(stored.items(), key=lambda kv: kv[1][0])
        return self.fold.memory.load(value, {i: row[1:] for i, row in in_order}), stored

    def save(self, s: Any, stored: dict[int, tuple]) -> None:
        value, entries = self.fold.memory.save(s)
        if self.value:
            self.value.update(value)
        if self.entries:
            now = {int(i): (place, *row) for place, (i, row) in enumerate(entries.items())}
            for i in stored.keys() - now.keys():
                self.entries.removeKey((i,))
            for i, row in now.items():
                if self.fold.ttl_ms or stored.get(i) != row:  # writing again renews the time to live
                    self.entries.updateValue((i,), row)

    def output(self, rows: list[tuple], late: int) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame.from_records([(*r, 0 if i else late) for i, r in enumerate(rows)], columns=self.fold.names)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        f, frame = self.fold, self.fold.order[0]
        last, late, newest, timer = tuple(self.progress.get()) if self.progress.exists() else (None, 0, None, None)
        s, stored = self.load()
        held = to_frame(list(self.waiting.get()), f.rows) if f.group and self.waiting.exists() else None
        parts = [held] if held is not None and len(held) else []
        for part in rows:
            part = part[f.rows.fieldNames()]
            old = part[frame] <= last if last is not None else pd.Series(False, index=part.index)
            late += int(old.sum())
            parts.append(part[~old])
            if f.timing and len(part):
                newest = max(newest or 0, int(part[f.timing.column].max().timestamp() * 1000))
        pdf = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True).sort_values(list(f.order), kind="stable")
        if f.group and len(pdf):
            waits = pdf[frame] == pdf[frame].max()
            self.waiting.put(to_rows(pdf[waits], f.rows))
            pdf = pdf[~waits]
        out = f.steps(s, pdf) if len(pdf) else []
        if len(pdf):
            last = int(pdf[frame].max())
        if f.timing:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = max(newest + f.timing.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(timer)
        self.save(s, stored)
        self.progress.update((last, 0 if out else late, newest, timer))
        yield from self.output(out, late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Closes a silent key."""
        f = self.fold
        last, late, newest, _ = tuple(self.progress.get())
        s, stored = self.load()
        out: list[tuple] = []
        if f.group and self.waiting.exists():
            pdf = to_frame(list(self.waiting.get()), f.rows)
            out, last = f.steps(s, pdf), int(pdf[f.order[0]].max())
            self.waiting.clear()
        out += f.silent(tuple(key), s, last)
        left = f.keep(s) if f.keep else None
        if left is None:
            for variable in (self.progress, self.value, self.entries):
                if variable:
                    variable.clear()
        else:
            self.save(left, stored)
            self.progress.update((last, 0 if out else late, newest, None))
        yield from self.output(out, late)

    def close(self) -> None:
        pass


def on_rocksdb(spark: SparkSession) -> None:
    if not str(spark.conf.get(PROVIDER, "")).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"{PROVIDER} must name the RocksDB provider: typed state needs it")


def stream_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Any],
    step: Callable[[Any, Any], list[tuple]],
    schema: str,
    memory: Memory,
    group: bool = False,
    timing: Timing | None = None,
    silent: Callable[[tuple, Any, int], list[tuple]] = lambda key, s, last: [],
    keep: Callable[[Any], Any] | None = None,
    ttl_ms: int | None = None,
) -> DataFrame:
    """``ordered_fold`` over a stream. Output has the batch columns and ``late_rows``.

    When a key is closed by its timer, ``silent(key, state, last frame)`` gives the rows that follow from the silence
    and ``keep(state)`` the state that stays (None: none). Without ``timing``, state expires after ``ttl_ms``.
    """
    on_rocksdb(df.sparkSession)
    out_schema = f"{schema}, late_rows bigint"
    mode = "EventTime" if timing else "ProcessingTime" if ttl_ms else "None"
    fold = Fold(order, start, step, column_names(out_schema), df.schema, memory, group, timing, None if timing else ttl_ms, silent, keep)
    if timing:
        df = df.withWatermark(timing.column, timing.delay)
    return df.groupBy(*keys).transformWithStateInPandas(FoldProcessor(fold), out_schema, "append", mode)


def track_stream(dets: DataFrame, cfg: TrackerConfig = TrackerConfig(), timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Track ids are counted per camera over the whole stream, as in batch."""
    d = dets.withColumn("episode", F.lit(0).cast("bigint"))
    out = stream_fold(
        d, ["camera_id"], ["frame_seq", "det_no"], S.TrackerState, lambda s, g: S.track_step(cfg, s, g),
        S.TRACK_SCHEMA, TRACKS, group=True, timing=timing, keep=lambda s: S.TrackerState(next_id=s.next_id), ttl_ms=ttl_ms,
    )
    return out.withColumnRenamed("local_id", "track_id").drop("episode")


def door_stream(tracks: DataFrame, cfg: DoorConfig = DoorConfig(), timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    """With ``timing`` (``idle_ms`` is the rule's timeout then), a door that is silent for the timeout gets one row that
    says UNKNOWN, at the time the timeout ran out; its frame is the last one seen."""

    def step(s: S.DoorState, r: Any) -> list[tuple]:
        # the silence that separates batch episodes
        if cfg.timeout == "spec" and s.last_ms is not None and r.timestamp_ms - s.last_ms >= cfg.timeout_ms:
            for f in fields(S.DoorState):
                setattr(s, f.name, getattr(S.DoorState(), f.name))
        return S.door_step(cfg, s, r)

    def silent(key: tuple, s: S.DoorState, last: int) -> list[tuple]:
        if s.state == "UNKNOWN":
            return []
        at, box = s.last_ms + cfg.timeout_ms, s.box or (None,) * 4
        return [(*key, last, "UNKNOWN", 0.0, 0, *box, at, at < s.cooldown_until, "none", "none", 0.0, 0.0, "no_observation", "state_timeout_unknown")]

    if timing and cfg.timeout == "spec":
        timing = replace(timing, idle_ms=cfg.timeout_ms)
    says = silent if cfg.timeout == "spec" else lambda key, s, last: []
    d = S.observations(tracks, cfg)
    return stream_fold(d, ["camera_id", "track_id"], ["frame_seq"], S.DoorState, step, S.DOOR_SCHEMA, DOOR, timing=timing, silent=says, ttl_ms=ttl_ms)


def warning_stream(tracks: DataFrame, cfg: WarningConfig = WarningConfig(), timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    d = S.warning_input(tracks, cfg)
    return stream_fold(
        d, ["camera_id"], ["frame_seq", "track_id"], S.WarningState, lambda s, g: S.warning_step(cfg, s, g),
        S.WARNING_SCHEMA, CARS, group=True, timing=timing, ttl_ms=ttl_ms,
    )


def alert_stream(intents: DataFrame, cfg: AlertConfig = AlertConfig(), timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Asymmetric alert; a closed camera starts afresh, unknown and without alert."""
    return stream_fold(
        intents, ["camera_id"], ["frame_seq"], S.AlertState, lambda s, r: S.alert_of_frame(cfg, s, r), S.ALERT_SCHEMA,
        ALERT, timing=timing, ttl_ms=ttl_ms,
    )


def mode_stream(modes: DataFrame, timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Motion mode with hysteresis; the mode of a closed camera starts afresh."""
    return stream_fold(
        modes, ["camera_id"], ["frame_seq"], lambda: S.RunLatch("normal"), S.mode_of_frame,
        "camera_id bigint, frame_seq bigint, candidate string, mode string", MODE, timing=timing, ttl_ms=ttl_ms,
    )


def smooth_stream(motion: DataFrame, alpha: float = 0.8, timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Smoothed path correction; the path of a closed camera starts afresh."""
    return stream_fold(
        S.smoothing_input(motion, alpha), ["camera_id"], ["frame_seq"], S.SmoothState,
        lambda s, r: [(r.camera_id, *row) for row in S.smooth_step(s, r)],
        f"camera_id bigint, {S.SMOOTH_SCHEMA}", PATH, timing=timing, ttl_ms=ttl_ms,
    )


def budget_stream(tracks: DataFrame, interval: int = 3, budget: int = 3, timing: Timing | None = None, ttl_ms: int | None = None) -> DataFrame:
    return stream_fold(
        tracks, ["camera_id"], ["frame_seq", "track_id"], dict, lambda s, g: S.budget_step(interval, budget, s, g),
        S.BUDGET_SCHEMA, TURNS, group=True, timing=timing, ttl_ms=ttl_ms,
    )
