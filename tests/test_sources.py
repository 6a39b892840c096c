"""Readers, writers, UDF hooks and small edge cases on hand-written files."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from doorlens.config import LIVE_THRESHOLDS
from doorlens.functions import geometry as G
from doorlens.functions.udf import luma_stats, score
from doorlens.operators import audit, governance, joins, match, mining, repair, split
from doorlens.sources import files, packs, readers, sinks

BOX = "image_id bigint, box_id bigint, cls_id int, cx double, cy double, w double, h double"
DET = "image_id bigint, det_id bigint, cls_id int, conf double, cx double, cy double, w double, h double"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "v1/images").mkdir(parents=True)
    (tmp_path / "v1/labels").mkdir()
    for n in ("a.jpg", "b.PNG", "c.jpg", "notes.doc"):
        (tmp_path / "v1/images" / n).write_bytes(b"x")
    (tmp_path / "v1/labels/a.txt").write_text("﻿0 0.5 0.5 0.2 0.2\n\n1 0.1 0.1\n7 0.5 0.5 0.1 0.1\n0.0 0.5 0.5 0.1 0.1\n0 0.1 0.1 0.9 0.1 0.5 0.8\n", encoding="utf-8")
    (tmp_path / "v1/labels/b.txt").write_text("")
    (tmp_path / "v1/labels/classes.txt").write_text("open\nclose\n")
    return tmp_path


def test_scan_and_media(spark, folder):
    got = {r.file_name: r for r in readers.scan_images(spark, str(folder)).collect()}
    assert set(got) == {"a.jpg", "b.PNG", "c.jpg"}
    assert got["a.jpg"].label_path.endswith("a.txt") and got["b.PNG"].label_path.endswith("b.txt") and got["c.jpg"].label_path is None
    assert {n: r.label_state for n, r in got.items()} == {"a.jpg": "filled", "b.PNG": "empty", "c.jpg": "absent"}
    plan = readers.list_media(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "content" not in plan.split("ReadSchema")[1]
    assert [r.file_name for r in readers.list_media(spark, str(folder)).collect()] == ["a.jpg", "b.PNG", "c.jpg"]


def test_a_listing_tells_empty_from_absent_labels(spark):
    files = [("/d/train/images/a.jpg", 9), ("/d/train/labels/a.txt", 0), ("/d/val/images/b.jpg", 9), ("/d/ok/images/c.jpg", 9), ("/d/ok/labels/c.txt", 20)]
    got = readers.scan_images(spark, "/d", spark.createDataFrame(files, "path string, length bigint"))
    assert {r.stem: r.label_state for r in got.collect()} == {"a": "empty", "b": "absent", "c": "filled"}
    images = got.withColumn("split", F.regexp_extract("path", "/d/([a-z]+)/", 1)).withColumn("image_id", F.ascii("stem").cast("bigint"))
    lines = spark.createDataFrame([(ord("c"), 1, "0 0.5 0.5 0.2 0.2")], "image_id bigint, line_no bigint, line string")
    found = {(r.split, r.rule) for r in governance.validate(images, lines).collect()}
    assert {("train", "all_labels_empty"), ("val", "no_label_files")} <= found
    assert not any(s == "ok" for s, _ in found)


def test_label_lines_parse_and_repair(spark, folder):
    lines = readers.read_review_labels(spark, str(folder))
    assert {r.file_name for r in lines.collect()} == {"a.txt"}
    d = lines.withColumn("image_id", F.lit(1).cast("bigint"))
    assert [r.line_no for r in repair.parse_labels(d).orderBy("line_no").collect()] == [1, 6]
    assert [r.line_no for r in repair.parse_labels(d, on_error="stop").collect()] == [1]
    fixed = {r.line_no: r.clean for r in repair.repair_labels(d).collect()}
    assert fixed[4] is None and fixed[5] == "0 0.5 0.5 0.1 0.1"
    poly = {r.line_no: r for r in repair.repair_polygons(d).collect()}
    assert poly[6].line == "0 0.500000 0.450000 0.800000 0.700000" and poly[6].fixed
    rules = {(r.line_no, r.rule) for r in governance.line_violations(d).collect()}
    assert rules == {(1, "bom"), (3, "field_count"), (4, "class_range"), (6, "field_count")}
    assert repair.polygon_report(repair.repair_polygons(d)).first().asDict() == {"scanned": 1, "fixed": 1}


def test_runs_and_fn_lists(spark, tmp_path):
    run = {"timestamp": "2026-04-10T12:30:00", "dataset": "v1", "dataset_hash": "abc", "base_model": "m", "metrics": {"mAP50": 0.5, "recall": 0.4}, "save_dir": "x/exp_1"}
    (tmp_path / "runs.json").write_text(json.dumps([run, {**run, "metrics": {"mAP50": 0.05}}], indent=1))
    runs = readers.read_runs(spark, str(tmp_path / "runs.json"))
    assert sorted(r.map50 for r in runs.collect()) == [0.05, 0.5]
    rep = governance.run_report(runs.withColumn("run_id", F.monotonically_increasing_id())).collect()
    assert {r.note for r in rep} == {"abnormal", "archived"} and all(r.run_time == "2026-04-10 12:30" and r.name == "exp_1" for r in rep)
    item = {"image_name": "a.jpg", "gt_idx": 1, "max_open_iou": 0.0, "max_open_conf": 0.0, "max_any_iou": 0.05, "max_any_cls": -1}
    (tmp_path / "fn.json").write_text(json.dumps({"Type_A": [item], "Type_B": [], "Type_C": [item], "Type_D": []}))
    fn = readers.read_fn_lists(spark, str(tmp_path / "fn.json"))
    assert sorted(r.fn_type for r in fn.collect()) == ["Type_A", "Type_C"]
    img = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg")], "image_id bigint, file_name string")
    assert {r.file_name: r.is_type_a for r in joins.attach_flags(img, fn).collect()} == {"a.jpg": True, "b.jpg": False}


def test_logs(spark, tmp_path):
    (tmp_path / "training_b.log").write_text("two\n")
    (tmp_path / "training_a.log").write_text("one\nmore\n")
    (tmp_path / "training_master.log").write_text("old\n")
    lines = [r.line for r in readers.consolidate_logs(spark, str(tmp_path)).collect()]
    assert lines == ["--- [LOG START: training_a.log] ---", "one", "more", "--- [LOG END: training_a.log] ---",
                     "--- [LOG START: training_b.log] ---", "two", "--- [LOG END: training_b.log] ---"]


def test_dataset_roundtrip_keeps_background(spark, tmp_path):
    d = spark.createDataFrame([("train", "v1", 1, 10), ("train", "v1", 2, None), ("val", "v2", 3, 11)], "split string, version string, image_id bigint, box_id bigint")
    sinks.write_dataset(d, str(tmp_path / "d"))
    sinks.write_dataset(d, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 3 and back.filter("box_id is null").first().image_id == 2
    sinks.promote_version(d.select("image_id", F.lit("v9").alias("version")), str(tmp_path / "p"))
    sinks.promote_version(d.select("image_id", F.lit("v8").alias("version")), str(tmp_path / "p"))
    assert {r.version for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"v8", "v9"}


def test_text_csv_and_json_sinks(spark, tmp_path):
    lines = repair.to_label_text(spark.createDataFrame([(1, 2, 0, 0.5, 0.5, 0.1, 0.1), (1, 1, 1, 0.25, 0.5, 0.1, 0.1)], BOX.replace("box_id", "line_no")))
    sinks.write_label_files(lines, str(tmp_path / "files"))
    text = next((tmp_path / "files/image_id=1").glob("part-*")).read_text()
    assert text == "1 0.250000 0.500000 0.100000 0.100000\n0 0.500000 0.500000 0.100000 0.100000\n"
    sinks.write_label_text(lines, str(tmp_path / "shards"))
    assert spark.read.text(str(tmp_path / "shards")).count() == 2
    entries = spark.createDataFrame([(1, "obj_train_data/a.jpg")], "image_id bigint, entry string")
    sinks.write_review_package(entries, lines, str(tmp_path / "pkg"))
    assert [r.value for r in spark.read.text(str(tmp_path / "pkg/obj_names")).collect()] == ["open", "close"]
    log = spark.createDataFrame([(1, 0, "open", 0.91234, 1, 2, 3, 4, 0.12345, True, False)], "frame_seq int, det_no int, label string, conf double, x1 int, y1 int, x2 int, y2 int, area_ratio double, roi_pass boolean, filtered_pass boolean")
    sinks.write_csv(sinks.detection_log(log), str(tmp_path / "csv"))
    row = spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()
    assert tuple(row.asDict()) == sinks.DETECTION_LOG and row.Conf_Raw == "0.912"
    fr = spark.createDataFrame(
        [(1, 33, "OPEN", True, 0.12345, 1, 0, 1, 30.0, 1.0, 2.0, 3.0, 4.0, 10.0, 512.0, "OK")],
        "frame_seq int, timestamp_ms int, state string, alert boolean, max_area double, open_cands int, close_cands int, danger_opens int, fps double, capture_ms double, infer_ms double, logic_ms double, render_ms double, e2e_ms double, ram_mb double, lag_status string",
    )
    assert tuple(sinks.frame_log(fr).columns) == sinks.FRAME_LOG
    sinks.write_json(log, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_image_source_and_luma(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, rgb):
        raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "white.png").write_bytes(png(4, 3, (255, 255, 255)))
    (tmp_path / "black.png").write_bytes(png(5, 2, (0, 0, 0)))
    dims = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in readers.image_dims(spark, str(tmp_path)).collect()}
    assert dims == {"white.png": (4, 3), "black.png": (5, 2)}
    d = spark.read.format("image").load(str(tmp_path)).select(luma_stats("image.data", "image.nChannels").alias("s")).select("s.*")
    got = sorted((round(r.mean_l, 3), round(r.std_l, 3)) for r in d.collect())
    assert got == [(0.0, 0.0), (255.0, 0.0)]


def test_model_hook(spark):
    def load():
        return lambda pdf: pd.DataFrame({"image_id": pdf["image_id"], "conf": pdf["image_id"] / 10})

    got = score(spark.range(5).withColumnRenamed("id", "image_id"), load, "image_id bigint, conf double")
    assert [r.conf for r in got.orderBy("image_id").collect()] == [0.0, 0.1, 0.2, 0.3, 0.4]


def pair(spark, iou, conf, pred_cls=0):
    """A unit box and a prediction of the same height whose IoU is exactly ``iou``."""
    gt = spark.createDataFrame([(1, 1, 0, 0.5, 0.5, 0.5, 0.5)], BOX)
    shift = 0.5 * (1 - iou) / (1 + iou)
    return gt, spark.createDataFrame([(1, 1, pred_cls, conf, 0.5 + shift, 0.5, 0.5, 0.5)], DET)


@pytest.mark.parametrize(
    "iou, conf, cls, status",
    [(0.9, 0.25, 0, "TP"), (0.9, 0.249, 0, "Type_D"), (0.9, 0.9, 1, "Type_C"), (0.3, 0.9, 0, "Type_B"), (0.05, 0.9, 0, "Type_A")],
)
def test_taxonomy_branches(spark, iou, conf, cls, status):
    row = match.fn_taxonomy(*pair(spark, iou, conf, cls)).first()
    assert row.status == status and abs(row.max_any_iou - iou) < 1e-4


def test_taxonomy_without_predictions(spark):
    gt, pred = pair(spark, 0.9, 0.9)
    row = match.fn_taxonomy(gt, pred.filter("det_id > 5")).first()
    assert (row.status, row.max_any_cls, row.max_any_iou) == ("Type_A", -1, 0.0)


def test_bucket_edges(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate((0.05, 0.049, 0.60, 0.605, 0.61, 1.0))], "image_id bigint, conf double")
    got = {r.image_id: r.bucket for r in mining.mine_buckets(d).collect()}
    assert got == {0: "low_conf_uncertain", 2: "low_conf_uncertain", 4: "high_conf_fp", 5: "high_conf_fp"}


def test_open_tiers(spark):
    d = spark.createDataFrame([(0.6,), (0.3,), (0.31,), (0.1,), (0.11,)], "c double")
    video = [r[0] for r in d.select(mining.open_tier(F.col("c"), True)).collect()]
    still = [r[0] for r in d.select(mining.open_tier(F.col("c"), False)).collect()]
    assert video == ["high", "low", "mid", "edge", "low"] and still == ["high", "low", "mid", "low", "low"]


def test_filter_is_strict_on_area(spark):
    d = spark.createDataFrame([(0, 0.35, 0.25, 0.08), (0, 0.35, 0.25, 0.09), (0, 0.349, 0.5, 0.5), (3, 0.5, 0.5, 0.5)], "cls_id int, conf double, w double, h double")
    assert repair.filter_detections(d, LIVE_THRESHOLDS).count() == 2


def test_polygon_rules(spark):
    square = ((0, 0), (10, 0), (10, 10), (0, 10))
    d = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0)], "x double, y double")
    got = [r[0] for r in d.select(G.in_polygon(F.col("x"), F.col("y"), square)).collect()]
    assert got == [True, False, False]
    assert d.select(G.in_polygon(F.col("x"), F.col("y"), square[:2])).distinct().first()[0]
    ref = [r[0] for r in d.select(G.in_polygon(F.col("x"), F.col("y"), ((0, 0), (10, 0), (8, 10), (2, 10)), "reference")).collect()]
    right = [r[0] for r in d.select(G.in_polygon(F.col("x"), F.col("y"), ((0, 0), (10, 0), (8, 10), (2, 10)))).collect()]
    assert ref != right


def test_single_scene_version_splits_by_image(spark):
    d = spark.createDataFrame([(i, "v1", f"clip_{i}.jpg") for i in range(10)] + [(100, "v2", "x_1.jpg")], "image_id bigint, version string, file_name string")
    got = split.scene_split(split.with_scene(d)).collect()
    assert sum(r.split == "train" for r in got if r.version == "v1") == 8
    assert [r.split for r in got if r.version == "v2"] == ["train"]


def test_splits_are_disjoint_by_scene(spark):
    from doorlens.plans.fixtures import Tables

    d = split.scene_split(split.with_scene(Tables(spark, "/root/testdata/sf0.001").images))
    both = d.groupBy("version", "scene").agg(F.count_distinct("split").alias("k")).filter("k > 1")
    assert both.count() == 0


def test_safeguard_small_and_floor(spark):
    rows = [("v1", f"s{i}", i, 1, "train") for i in range(10)] + [("v1", "z", 90, 0, "val")]
    rows += [("v2", f"s{i}", 200 + i, int(i < 2), "train") for i in range(5)]
    d = spark.createDataFrame(rows, "version string, scene string, image_id bigint, open_cnt int, split string")
    got = split.open_safeguard(d).collect()
    assert sum(r.moved for r in got if r.version == "v1") == 3  # max(3, 15 %) of ten
    assert not any(r.moved for r in got if r.version == "v2")  # fewer than three open images


def test_assertions(spark):
    good = spark.createDataFrame([(0, "open"), (1, "close")], "cls_id int, name string")
    assert governance.assert_class_map(good).count() == 2
    with pytest.raises(Exception, match="unexpected class"):
        governance.assert_class_map(spark.createDataFrame([(0, "close")], "cls_id int, name string")).collect()
    with pytest.raises(Exception, match="is zero"):
        governance.assert_metrics(spark.createDataFrame([(0.0,)], "map50 double")).collect()


def test_assert_metrics_judges_every_run(spark, monkeypatch):
    """The query leaves no run out, and its rows do pass through the assertion."""
    from doorlens.plans.catalog import QUERIES
    from doorlens.plans.fixtures import Tables

    small = "/root/testdata/sf0.001"
    runs = {r.run_id: r.map50 for r in Tables(spark, small).experiments.collect()}
    got = QUERIES["assert_metrics"](spark, small).collect()
    assert {r.run_id: r.map50 for r in got} == runs and len(got) == len(runs)
    zero = Tables(spark, small).experiments.limit(1).withColumn("map50", F.lit(0.0))
    monkeypatch.setattr(Tables, "experiments", zero, raising=False)
    assert [r.ok for r in QUERIES["assert_metrics"](spark, small).collect()] == [False]
    monkeypatch.setattr(governance, "metric_verdicts", lambda df: df.withColumn("ok", F.lit(True)))
    with pytest.raises(Exception, match="is zero"):
        QUERIES["assert_metrics"](spark, small).collect()


def test_close_counts_differ_between_audits(spark):
    """A class-7 line counts as close in label_stats and not at all in audit_versions."""
    img = spark.createDataFrame([(1, "v1")], "image_id bigint, version string")
    lines = spark.createDataFrame([(1, 1, "7 0.5 0.5 0.1 0.1")], "image_id bigint, line_no bigint, line string")
    assert audit.label_stats(img, lines).first().close == 1
    boxes = spark.createDataFrame([(1, 1, 7, 0.5, 0.5, 0.1, 0.1)], BOX)
    assert audit.audit_versions(img, boxes).filter("version = 'v1'").first().close == 0


def test_augmented_boxes_stay_in_frame(spark):
    from doorlens.plans.catalog import QUERIES

    d = QUERIES["augment_boxes"](spark, "/root/testdata/sf0.001")
    bad = d.filter("cx - w / 2 < -1e-9 or cx + w / 2 > 1 + 1e-9 or cy - h / 2 < -1e-9 or cy + h / 2 > 1 + 1e-9 or visible < 0.3 or visible > 1 + 1e-9")
    assert bad.count() == 0 and d.count() > 0
    flipped = d.filter("profile = 'mixed_boundary'").groupBy("image_id", "copy_no").count()
    assert flipped.count() > 0


def test_deployment_switches_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "dataset")
    rows = lambda n, v: spark.range(n).select(F.col("id").alias("image_id"), F.lit("train").alias("split"), F.lit(v).alias("version"))
    with pytest.raises(ValueError):
        sinks.read_dataset(spark, path)
    first = sinks.deploy_dataset(rows(50, "v1"), path)
    assert sinks.read_dataset(spark, path).count() == 50
    broken = rows(50, "v2").withColumn("image_id", F.when(F.col("image_id") == 33, F.raise_error(F.lit("disk full")).cast("bigint")).otherwise(F.col("image_id")))
    with pytest.raises(Exception, match="disk full"):
        sinks.deploy_dataset(broken, path)
    assert {r.version for r in sinks.read_dataset(spark, path).collect()} == {"v1"}  # the old state is still there
    sinks.deploy_dataset(rows(70, "v2"), path)
    assert sinks.read_dataset(spark, path).count() == 70 and sinks.read_dataset(spark, path, first).count() == 50
    assert [(r.number, r.rows) for r in sinks.deployments(spark, path).orderBy("number").collect()] == [(1, 50), (2, 70)]


def test_listing_holds_every_file_once(spark, tmp_path):
    want = {}
    for i in range(30):
        folder = tmp_path / f"f{i % 7}" / f"g{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"x{i}.txt").write_bytes(b"a" * (i % 4))
        want[f"x{i}.txt"] = i % 4
    (tmp_path / "top.txt").write_bytes(b"")
    want["top.txt"] = 0
    for partitions in (1, 5, 64, 1000):
        got = files.list_files(spark, str(tmp_path), partitions).collect()
        assert {r.path.rsplit("/", 1)[1]: r.length for r in got} == want and len(got) == len(want)
    assert got[0].path.startswith("file:/")
    many = files.list_files(spark, [str(tmp_path / "f1"), str(tmp_path / "f2")])
    assert many.count() == sum(1 for i in range(30) if i % 7 in (1, 2))


def test_sizes_come_from_the_heads_of_files(spark, tmp_path):
    import struct

    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 60_002) + b"x" * 60_000 + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, 480, 640, 3)
    data = {
        "a.jpg": (jpeg, 640, 480, None),
        "b.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 31, 17), 31, 17, None),
        "c.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 12, -9) + b"\0" * 8, 12, 9, None),
        "d.webp": (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), 100, 50, None),
        "e.tif": (b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 70, 0) + struct.pack(">HHII", 257, 4, 1, 80), 70, 80, None),
        "f.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (299 | 199 << 14).to_bytes(4, "little") + b"\0" * 8, 300, 200, None),
        "g.jpg": (b"", None, None, "empty file"),
        "h.jpg": (b"not a picture", None, None, "unknown format"),
        "i.jpg": (jpeg[:100], None, None, "the file ends early"),
        "j.jpg": (b"\xff\xd8\xff\xda\0\0", None, None, "JPEG without a frame header"),
        "k.png": (b"\x89PNG\r\n\x1a\n", None, None, "PNG without a header chunk"),
    }
    for name, (raw, *_) in data.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.reason) for r in readers.image_dims(spark, str(tmp_path)).collect()}
    assert got == {name: tuple(want) for name, (_, *want) in data.items()}


def test_label_pack(spark, tmp_path):
    path = str(tmp_path / "pack")
    images = 100_000
    lines = spark.range(images).selectExpr("id * 3 AS image_id", "explode(sequence(1, 1 + CAST(id % 3 AS INT))) AS line_no").withColumn(
        "line", F.concat_ws(" ", F.col("line_no"), F.col("image_id"), F.lit("0.5 0.5"))
    )
    lines = lines.unionByName(spark.createDataFrame([(-7, 1, None), (None, 1, "lost")], "image_id bigint, line_no int, line string"))
    packs.write_label_pack(lines.repartition(5), path)
    containers = packs.manifest(path)
    assert len(containers) <= 8 and sum(x[1] for x in containers) == images + 1  # a bounded number of files
    assert packs.read_label_file(path, 15) == "1 15 0.5 0.5\n2 15 0.5 0.5\n3 15 0.5 0.5\n"
    assert packs.read_label_file(path, -7) == "" and packs.read_label_file(path, 16) is None
    back = packs.read_label_pack(spark, path)
    assert back.count() == images + 1
    want = lines.filter("line is not null").count()
    assert back.select(F.sum(F.regexp_count("labels", F.lit("\n")))).first()[0] == want - 1  # but the row without id
    # a failing write leaves the old state readable and no container behind
    broken = lines.withColumn("line", F.when(F.col("image_id") == 300, F.raise_error(F.lit("no room"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no room"):
        packs.write_label_pack(broken, path)
    assert packs.manifest(path) == containers and packs.read_label_file(path, 0) == "1 0 0.5 0.5\n"
    packs.write_label_pack(lines.filter("image_id < 3000"), path, container_bytes=2000)  # replaced, in small containers
    assert len(packs.manifest(path)) > 8 and packs.read_label_pack(spark, path).count() == 1001
    assert len(list((tmp_path / "pack").glob("*.labels"))) == len(packs.manifest(path))
    packs.write_label_pack(lines.limit(0), path)
    assert packs.read_label_pack(spark, path).count() == 0


def test_regions_of_cameras(spark):
    import random

    rng = random.Random(3)
    shapes = [[(0, 0), (10, 0), (8, 10), (2, 10)], [(20, 20), (30, 20), (25, 30)], [(0, 0), (5, 5)], []]
    shapes = [[(float(x), float(y)) for x, y in s] for s in shapes]
    points = [(rng.uniform(-2, 32), rng.uniform(-2, 32)) for _ in range(200)] + [(5.0, 5.0), (25.0, 22.0)]
    polygon = "array<struct<x:double,y:double>>"
    d = spark.createDataFrame([(x, y, s) for x, y in points for s in shapes + [None]], f"x double, y double, p {polygon}")
    for mode in ("correct", "reference"):
        got = d.select("x", "y", "p", G.in_region(F.col("x"), F.col("y"), F.col("p"), mode).alias("hit")).collect()
        for shape in shapes:
            fixed = spark.createDataFrame(points, "x double, y double").select("x", "y", G.in_polygon(F.col("x"), F.col("y"), shape, mode).alias("hit"))
            want = {(r.x, r.y): r.hit for r in fixed.collect()}
            assert all(r.hit == want[r.x, r.y] for r in got if r.p is not None and [(v.x, v.y) for v in r.p] == shape)
        assert all(r.hit for r in got if r.p is None)
    dets = spark.createDataFrame([(1, 4, 4, 6, 6), (1, 24, 21, 26, 23), (1, 90, 90, 92, 92), (2, 90, 90, 92, 92), (None, 1, 1, 2, 2)], "camera_id bigint, x1 int, y1 int, x2 int, y2 int")
    regions = spark.createDataFrame([(1, shapes[0]), (1, shapes[1])], f"camera_id bigint, polygon {polygon}")
    got = repair.gate_regions(dets, regions)
    assert got.columns == [*dets.columns, "roi_pass"] and got.count() == 5
    assert {(r.camera_id, r.x1): r.roi_pass for r in got.collect()} == {(1, 4): True, (1, 24): True, (1, 90): False, (2, 90): True, (None, 1): True}
