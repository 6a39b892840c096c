"""Counts and rates over splits, versions, scenes, runs and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.functions.geometry import c, lit
from doorlens.functions.text import fps
from doorlens.operators.repair import boxes_per_image, fields_of, once


def _n() -> Column:
    return F.count(F.lit(1))


def split_stats(split: DataFrame) -> DataFrame:
    """Per split and version with totals (version ``GLOBAL``). Input: one row per image with box counts and scene.

    Scenes are first reduced to one row each, so no distinct count is needed.
    """
    scenes = split.groupBy("split", "version", "scene").agg(
        _n().alias("images"),
        F.sum("open_cnt").alias("open_boxes"),
        F.sum("close_cnt").alias("close_boxes"),
        F.count_if((c("open_cnt") == 0) & (c("close_cnt") == 0)).alias("bg_images"),
        F.count_if(c("open_cnt") > 0).alias("open_images"),
    )
    both = scenes.withColumn("version", F.explode(F.array(c("version"), F.lit("GLOBAL"))))
    return both.groupBy("split", "version").agg(
        F.sum("images").alias("images"),
        F.sum("open_boxes").alias("open_boxes"),
        F.sum("close_boxes").alias("close_boxes"),
        F.sum("bg_images").alias("bg_images"),
        F.sum("open_images").alias("open_images"),
        _n().alias("scenes"),
    )


def audit_versions(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Version sizes with a GLOBAL row; classes other than open and close are not counted."""
    d = boxes_per_image(images.select("image_id", "version"), boxes)
    out = d.rollup("version").agg(
        _n().alias("images"),
        F.count_if(c("n_boxes") == 0).alias("bg"),
        F.sum("open_cnt").alias("open"),
        F.sum("close_cnt").alias("close"),
    )
    return out.select(
        F.coalesce("version", F.lit("GLOBAL")).alias("version"),
        "images",
        F.round(c("bg") * 100.0 / c("images"), 1).alias("bg_pct"),
        (c("open") + c("close")).alias("boxes"),
        "open",
        "close",
        F.when(c("close") > 0, F.round(c("open") / c("close"), 3)).otherwise(lit(0)).alias("ratio"),
    )


def label_stats(images: DataFrame, lines: DataFrame) -> DataFrame:
    """Per version from raw label lines; every class but 0 counts as close here."""
    d = once(lines.select("image_id", "line"), _p=fields_of())
    d = d.select(
        "image_id",
        (F.size("_p") >= 5).alias("box"),
        c("_p")[0].try_cast("int").alias("cls"),
        F.try_element_at("_p", F.lit(4)).try_cast("double").alias("w"),
        F.try_element_at("_p", F.lit(5)).try_cast("double").alias("h"),
    )
    d = once(d.select("image_id", "box", "cls", "w", "h"), _box=c("box") & c("cls").isNotNull()).withColumn("box", c("_box"))
    per_image = d.groupBy("image_id").agg(
        F.count_if("box").alias("boxes"),
        F.count_if(c("box") & (c("cls") == 0)).alias("open"),
        F.count_if(c("box") & (c("cls") != 0)).alias("close"),
        F.sum(F.when(c("box"), c("w"))).alias("ws"),
        F.sum(F.when(c("box"), c("h"))).alias("hs"),
        _n().alias("n_lines"),
    )
    out = (
        images.select("image_id", "version")
        .join(per_image, "image_id", "left")
        .groupBy("version")
        .agg(
            _n().alias("images"),
            F.count_if(c("n_lines").isNull()).alias("empty"),
            F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"),
            F.coalesce(F.sum("open"), F.lit(0)).alias("open"),
            F.coalesce(F.sum("close"), F.lit(0)).alias("close"),
            F.sum("ws").alias("ws"),
            F.sum("hs").alias("hs"),
        )
    )
    avg = {n: F.round(F.when(c("boxes") > 0, c(s) / c("boxes")).otherwise(lit(0)), 6) for n, s in (("avg_w", "ws"), ("avg_h", "hs"))}
    return out.select("version", "images", "empty", "boxes", "open", "close", *[v.alias(k) for k, v in avg.items()])


def scene_audit(images: DataFrame) -> DataFrame:
    """Scene sizes, most common first. Input: one row per image with ``version``, ``scene`` and box counts."""
    return (
        images.groupBy("version", "scene")
        .agg(_n().alias("images"), F.sum("open_cnt").alias("open"), F.sum("close_cnt").alias("close"))
        .orderBy(F.desc("images"), "version", "scene")
    )


def val_coverage(split: DataFrame) -> DataFrame:
    val = c("split") == "val"
    return split.groupBy("version").agg(
        F.count_if(val).alias("val_images"), F.count_if(val & (c("open_cnt") > 0)).alias("val_open_images")
    )


def ghost_eval(images: DataFrame, boxes: DataFrame, dets: DataFrame, conf: float = 0.25) -> DataFrame:
    """Background images with at least one detection."""
    background = images.select("image_id").join(boxes, "image_id", "left_anti")
    fired = dets.filter(c("conf") >= lit(conf)).groupBy("image_id").agg(F.lit(1).alias("hit"))
    d = background.join(fired, "image_id", "left")
    out = d.agg(_n().alias("total_images"), F.count("hit").alias("any_hit"))
    rate = F.when(c("total_images") > 0, F.round(c("any_hit") / c("total_images"), 4)).otherwise(lit(0))
    return out.withColumn("fp_rate", rate)


def fitness(map50: Column, map50_95: Column) -> Column:
    return lit(0.1) * F.coalesce(map50, lit(0)) + lit(0.9) * F.coalesce(map50_95, lit(0))


def runtime_counters(frames: DataFrame) -> DataFrame:
    """Totals per camera of the early-warning run: vehicles, priorities, second-stage calls and alarms."""
    per_frame = frames.groupBy("camera_id", "frame_seq").agg(
        _n().alias("vehicles"),
        *[F.count_if(c("priority") == p).alias(p.lower()) for p in ("HIGH", "MEDIUM", "LOW")],
        F.count_if("ran_s2").alias("rois"),
        F.count_if("alarm").alias("alarms"),
    )
    return per_frame.groupBy("camera_id").agg(
        _n().alias("frames"),
        F.sum("vehicles").alias("vehicles"),
        F.sum("high").alias("high"),
        F.sum("medium").alias("medium"),
        F.sum("low").alias("low"),
        F.count_if(c("rois") > 0).alias("s2_batches"),
        F.sum("rois").alias("s2_rois"),
        F.sum("alarms").alias("alarms"),
    )


def lag_band(ms: Column, warn: float = 50, crit: float = 100) -> Column:
    return F.when(ms > lit(crit), "CRIT").when(ms > lit(warn), "WARN").otherwise("OK")


def latency_frames(log: DataFrame) -> DataFrame:
    """Frame log with end-to-end time, rate and lag band."""
    e2e = c("capture_ms") + c("infer_ms") + c("logic_ms") + c("render_ms")
    d = log.withColumn("e2e_ms", e2e)
    return d.withColumn("fps", fps(c("e2e_ms"))).withColumn("lag_status", lag_band(c("e2e_ms")))


def latency_report(log: DataFrame) -> DataFrame:
    return (
        latency_frames(log)
        .groupBy("camera_id", "lag_status")
        .agg(
            _n().alias("frames"),
            F.round(F.avg("e2e_ms"), 9).alias("avg_e2e_ms"),
            F.round(F.max("e2e_ms"), 6).alias("max_e2e_ms"),
            F.round(F.avg("fps"), 9).alias("avg_fps"),
        )
    )


def mining_summary(mined: DataFrame, total: DataFrame) -> DataFrame:
    """Kept items per bucket and the share of all inputs that was filtered out."""
    kept = mined.agg(_n())
    n_all = total.agg(_n())
    cut = F.round((lit(1) - kept.scalar() / n_all.scalar()) * 100.0, 2)
    return mined.groupBy("bucket").agg(_n().alias("n")).withColumn("compression_pct", cut)
