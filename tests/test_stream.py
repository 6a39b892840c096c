"""The same rows through batch and Structured Streaming give the same result; late rows are dropped and counted."""

import pytest
from pyspark.sql import functions as F

from doorlens.operators import stateful as S
from doorlens.operators.repair import gate_detections
from doorlens.plans.fixtures import Tables
from doorlens.sources.readers import read_detections_stream
from doorlens.sources.sinks import EventSink, OncePerBatch, write_batches, write_events
from doorlens.streaming import stateful as X

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SMALL)


def through_stream(spark, tmp_path, df, op, batches=3, cut="frame_seq"):
    """Writes ``df`` as files of increasing frames, streams them one file per micro-batch, returns the output rows."""
    src = str(tmp_path / "in")
    edge = df.agg(F.max(cut)).first()[0] / batches
    for i in range(batches):
        part = df.filter((F.col(cut) > (edge * i if i else -1)) & (F.col(cut) <= edge * (i + 1)))
        part.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"out_{tmp_path.name}".replace("-", "_")
    q = op(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def same(a, b, cols):
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def settled(batch):
    """All but the newest frame of each camera, which waits for more of its rows."""
    newest = batch.groupBy("camera_id").agg(F.max("frame_seq").alias("m"))
    return batch.join(newest, "camera_id").filter("frame_seq < m").select(batch.columns)


def test_tracks(spark, t, tmp_path):
    d = t.frame_dets
    batch = S.track(d)
    same(through_stream(spark, tmp_path, d, X.track_stream), settled(batch), batch.columns)


def test_a_frame_may_arrive_in_parts(spark, t, tmp_path):
    d = t.frame_dets
    batch = S.track(d)
    split = d.withColumn("_part", F.col("frame_seq") * 2 + F.col("det_no") % 2)  # half of a frame, then the other half
    out = through_stream(
        spark, tmp_path, split, lambda s: X.track_stream(s.drop("_part")), batches=7, cut="_part"
    )
    same(out, settled(batch), batch.columns)
    assert out.agg(F.sum("late_rows")).first()[0] == 0


def test_doors(spark, t, tmp_path):
    d = t.frame_obs.drop("ts")
    batch = S.door_states(d)
    same(through_stream(spark, tmp_path, d.withColumn("track_id", F.lit(1).cast("bigint")), X.door_stream), batch, batch.columns)


def test_warnings_and_alarms(spark, t, tmp_path):
    d = t.car_frames
    batch = S.early_warning(d)
    out = through_stream(spark, tmp_path, d, X.warning_stream)
    same(out, settled(batch), batch.columns)
    assert S.alarms(out).count() == S.alarms(settled(batch)).count() > 0


def test_alerts(spark, t, tmp_path):
    d = S.frame_intents(gate_detections(t.frame_obs))
    batch = S.asym_alert(d)
    same(through_stream(spark, tmp_path, d, X.alert_stream), batch, batch.columns)


def test_modes_paths_and_budget(spark, t, tmp_path):
    modes = t.frame_motion.select("camera_id", "frame_seq", F.when(F.col("dx") > 0, "violent").otherwise("normal").alias("candidate"))
    for name, d, op, batch in [
        ("m", modes, X.mode_stream, S.mode_hysteresis(modes)),
        ("p", t.frame_motion, X.smooth_stream, S.smooth_trajectory(t.frame_motion)),
    ]:
        (tmp_path / name).mkdir()
        rounded = [F.round(x, 9).alias(x) if x.startswith("out_") else F.col(x) for x in batch.columns]  # the batch form adds in another order
        same(through_stream(spark, tmp_path / name, d, op).select(rounded), batch.select(rounded), batch.columns)
    tracks = S.track(t.frame_dets).select("camera_id", "frame_seq", "track_id", "missed", "det_conf")
    batch = S.secondary_budget(tracks)
    (tmp_path / "b").mkdir()
    out = through_stream(spark, tmp_path / "b", tracks, X.budget_stream)
    newest = tracks.groupBy("camera_id").agg(F.max("frame_seq").alias("m"))
    same(out, batch.join(newest, "camera_id").filter("frame_seq < m"), batch.columns)


def timed(spark, tmp_path, batches, schema, op):
    """Rows of a stream whose files come one per micro-batch, in the order given."""
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_millis("timestamp_ms")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"out_{tmp_path.name}".replace("-", "_")
    q = op(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name), state_of(spark, tmp_path, "progress").count()


def state_of(spark, tmp_path, variable):
    """A state variable as Spark's state reader shows it."""
    return spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / "cp"))


DOOR = "camera_id bigint, track_id bigint, frame_seq bigint, timestamp_ms bigint, label string, conf double, x1 int, y1 int, x2 int, y2 int, frame_w int, frame_h int"


def door_row(camera, frame, ms):
    return (camera, 1, frame, ms, "close", 0.9, 100, 100, 300, 300, 1280, 720)


def test_a_silent_door_becomes_unknown_without_a_new_frame(spark, tmp_path):
    batches = [[door_row(1, f, f * 400) for f in range(1, 6)], [door_row(2, 1, 60_000)], [door_row(2, 2, 60_400)]]
    out, keys = timed(spark, tmp_path, batches, DOOR, lambda s: X.door_stream(s, timing=X.Timing(delay="1 second")))
    rows = out.filter("camera_id = 1").orderBy("timestamp_ms").collect()
    assert [r.state for r in rows] == ["UNKNOWN", "UNKNOWN", "CLOSED", "CLOSED", "CLOSED", "UNKNOWN"]
    assert (rows[-1].debug_reason, rows[-1].timestamp_ms, rows[-1].frame_seq) == ("state_timeout_unknown", 5000, 5)
    assert keys == 1  # the silent door's state is gone
    kept = state_of(spark, tmp_path, "value").select("key.camera_id", "value.*").collect()  # typed columns
    assert [(r.camera_id, r.state, r.last_ms, [h.label for h in r.history]) for r in kept] == [(2, "UNKNOWN", 60_400, ["close"] * 2)]


def test_a_silent_camera_gives_its_last_frame_and_keeps_only_the_id_counter(spark, tmp_path):
    schema = "camera_id bigint, frame_seq bigint, timestamp_ms bigint, det_no int, conf double, x1 int, y1 int, x2 int, y2 int"
    box = (0, 0.9, 100, 100, 300, 300)
    batches = [[(1, f, f * 400, *box) for f in (1, 2)], [(2, 1, 200_000, *box)], [(2, 2, 200_400, *box)], [(1, 900, 300_000, *box), (1, 901, 300_400, *box)]]
    out, _ = timed(spark, tmp_path, batches, schema, lambda s: X.track_stream(s, timing=X.Timing(delay="1 second")))
    rows = out.filter("camera_id = 1").orderBy("frame_seq").collect()
    assert [(r.frame_seq, r.track_id, r.age) for r in rows] == [(1, 1, 1), (2, 1, 2), (900, 2, 1)]


def test_state_expires_without_event_time(spark, tmp_path):
    import time

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "OPEN", 0.2), (2, 1, "OPEN", 0.2)], "camera_id bigint, frame_seq bigint, intent string, max_area double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    writer = X.alert_stream(stream, ttl_ms=1500).writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "cp"))
    q = writer.trigger(processingTime="1 second").start()
    try:
        rows, seen = None, 0
        for _ in range(60):
            time.sleep(0.5)
            if q.lastProgress and q.lastProgress["stateOperators"]:
                rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
                seen = max(seen, rows)
            if seen and rows == 0:
                break
    finally:
        q.stop()
    assert seen > 0 and rows == 0 and spark.table("ttl").count() == 2


def test_typed_state_needs_rocksdb(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS camera_id", "value AS frame_seq", "'OPEN' AS intent", "0.1D AS max_area")
    old = spark.conf.get(X.PROVIDER)
    try:
        spark.conf.set(X.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        with pytest.raises(ValueError, match="RocksDB"):
            X.alert_stream(stream)
    finally:
        spark.conf.set(X.PROVIDER, old)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    cols = "camera_id bigint, frame_seq bigint, intent string, max_area double"
    first = spark.createDataFrame([(1, 5, "OPEN", 0.2), (1, 4, "OPEN", 0.2)], cols)  # out of order inside a batch
    second = spark.createDataFrame([(1, 3, "CLOSE", 0.2), (1, 6, "OPEN", 0.2)], cols)  # frame 3 is late
    src = str(tmp_path / "in")
    stream = None
    for d in (first, second):
        d.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = X.alert_stream(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("late").orderBy("frame_seq").collect()
    assert [r.frame_seq for r in rows] == [4, 5, 6]
    assert [r.late_rows for r in rows] == [0, 0, 1]
    assert [r.state for r in rows] == ["UNKNOWN", "OPEN", "OPEN"]


def test_file_source_and_event_sink(spark, t, tmp_path):
    src, out = str(tmp_path / "json"), str(tmp_path / "events")
    t.frame_obs.select("camera_id", "frame_seq", "timestamp_ms", "det_no", "label", "conf", "x1", "y1", "x2", "y2", "frame_w", "frame_h").write.json(src)
    stream = read_detections_stream(spark, src)
    q = write_events(stream.filter("conf > 0.9"), out, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(out).count() == t.frame_obs.filter("conf > 0.9").count() > 0
    write_events(t.frame_obs.select("camera_id", "frame_seq").limit(3), str(tmp_path / "b"))
    write_events(t.frame_obs.select("camera_id", "frame_seq").limit(2), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 5


def test_writer_plugin(spark, t, tmp_path):
    t.frame_obs.select("camera_id", "frame_seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("camera_id bigint, frame_seq bigint").parquet(str(tmp_path / "in"))
    q = write_batches(stream, lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), str(tmp_path / "log"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == t.frame_obs.count()


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    sink, schema = EventSink(str(tmp_path / "events")), "camera_id bigint, event string"
    rows = spark.createDataFrame([(1, "OPEN"), (2, "ALARM")], schema)
    once = sink.once()
    once(rows, 0)
    once(rows, 0)  # Spark hands the batch over again
    assert sink.read(spark, schema).count() == 2
    # a writer that died half-way: its folder is there, its id is not in the log
    rows.limit(1).write.json(f"{sink.path}/data/app=default/batch=1")
    assert sink.read(spark, schema).count() == 2
    once(rows, 1)
    assert sink.read(spark, schema).count() == 4
    EventSink(sink.path, "other").once()(rows, 0)  # another stream counts its batches for itself
    assert sink.read(spark, schema).groupBy("app").count().count() == 2
    calls = []
    plugin = OncePerBatch(lambda df, batch: calls.append(batch), str(tmp_path / "log"))
    for batch in (0, 1, 1, 0, 2):
        plugin(rows, batch)
    assert calls == [0, 1, 2]


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    src, sink, schema = str(tmp_path / "in"), EventSink(str(tmp_path / "events")), "camera_id bigint, event string"
    spark.createDataFrame([(i, "OPEN") for i in range(20)], schema).write.json(src)
    for checkpoint in ("a", "b"):  # the second start has lost its checkpoint and reads the first batch again
        q = sink.start(spark.readStream.schema(schema).json(src), str(tmp_path / checkpoint))
        q.processAllAvailable()
        q.stop()
    assert sink.read(spark, schema).count() == 20
