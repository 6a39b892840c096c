"""Label parsing, label repair and row-level filters."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.config import DEFAULT_CONF, DoorConfig, FrameGateConfig
from doorlens.functions import geometry as G
from doorlens.functions.geometry import c, lit
from doorlens.functions.text import box_line


def fields_of(line="line") -> Column:
    """Blank-separated fields of a label line; blanks around it and a byte-order mark are ignored."""
    return F.split(F.trim(c(line), F.lit(" \t\r\n\ufeff")), r"\s+")


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row. Catalyst would inline a plain projection into every later
    use, which repeats string parsing; a one-element generator is not inlined."""
    row = F.struct(*[e.alias(n) for n, e in exprs.items()])
    return df.select("*", F.explode(F.array(row)).alias("_once")).select("*", *[c(f"_once.{n}").alias(n) for n in exprs]).drop("_once")


def _number(x: Column) -> Column:
    return x.try_cast("double")


def parse_labels(
    lines: DataFrame, min_area: float = 5e-5, min_dim: float = 0.008, on_error: str = "quarantine"
) -> DataFrame:
    """Label lines to boxes. Bad lines are left out; ``on_error="stop"`` also drops all later lines of that image."""
    d = once(lines, _p=fields_of()).filter(F.size("_p") >= 5)
    numbers = {f"_{i}": _number(c("_p")[i]) for i in range(1, 5)}
    d = once(d, _cls=c("_p")[0].try_cast("int"), _n=F.size("_p"), **numbers)
    cls, nums = c("_cls"), [c(n) for n in numbers]
    good = cls.isin(0, 1)
    for n in nums:
        good = good & n.isNotNull()
    d = d.withColumn("_ok", F.coalesce(good, F.lit(False)))
    if on_error == "stop":
        first_bad = d.filter(~c("_ok")).groupBy("image_id").agg(F.min("line_no").alias("_bad"))
        d = d.join(first_bad, "image_id", "left").filter(c("_bad").isNull() | (c("line_no") < c("_bad")))
    d = d.filter("_ok")
    lo, hi = lit(1e-6), lit(1 - 1e-6)
    cx, cy, w, h = (F.greatest(lo, F.least(hi, n)) for n in nums)
    d = d.select(
        "image_id",
        "line_no",
        cls.alias("cls_id"),
        cx.alias("cx"),
        cy.alias("cy"),
        w.alias("w"),
        h.alias("h"),
        (c("_n") > 5).alias("is_polygon"),
    )
    d = d.withColumn("area", c("w") * c("h"))
    d = d.filter((c("area") >= lit(min_area)) & (F.least("w", "h") >= lit(min_dim)))
    return d.withColumn("is_near_edge", G.near_edge())


def repair_labels(lines: DataFrame, max_cls: int = 1) -> DataFrame:
    """Normalised class ids; blank, non-numeric and out-of-range classes dropped. ``clean`` is null for a dropped line.

    Keeps one row per input line, so both the clean text (``clean is not null``) and the change report
    (``changed_images``) come from the same narrow pass.
    """
    d = once(lines, _p=F.split(F.trim("line"), r"\s+"))
    p = c("_p")
    cls = _number(p[0]).try_cast("bigint")
    keep = F.coalesce(cls <= max_cls, F.lit(False)) & (F.trim(c("line")) != "")
    rest = F.concat_ws(" ", F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))
    d = once(d, clean=F.when(keep, F.concat(cls.cast("string"), F.lit(" "), rest)))
    clean = c("clean")
    blank = F.trim(c("line")) == ""
    changed = ~blank & (clean.isNull() | (clean != c("line")))
    return d.select("image_id", "line_no", "line", clean, changed.alias("changed"))


def changed_images(repaired: DataFrame) -> DataFrame:
    return repaired.groupBy("image_id").agg(
        F.count("clean").alias("n_clean"), F.bool_or("changed").alias("changed")
    )


def repair_polygons(lines: DataFrame) -> DataFrame:
    """Polygon lines become box lines; other lines are trimmed."""
    d = once(lines.select("image_id", "line_no", "line"), _p=fields_of())
    fixed = F.size("_p") > 5
    coords = F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    d = once(d, _c=F.when(fixed, coords))
    d = once(d, **{f"_{n}": v for n, v in G.polygon_to_box(c("_c"))._asdict().items()})
    box = G.to_centre(G.corners("_x1", "_y1", "_x2", "_y2"))
    text = F.when(
        fixed,
        F.concat(c("_p")[0], F.lit(" "), F.format_string("%.6f %.6f %.6f %.6f", box.cx, box.cy, box.w, box.h)),
    ).otherwise(F.trim(c("line")))
    return d.select("image_id", "line_no", text.alias("line"), fixed.alias("fixed"))


def polygon_report(repaired: DataFrame) -> DataFrame:
    per_image = repaired.groupBy("image_id").agg(F.bool_or("fixed").alias("f"))
    return per_image.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("f").alias("fixed"))


def postprocess_autolabels(lines: DataFrame, images: DataFrame, min_area: float = 200, min_dim: float = 10) -> DataFrame:
    """Model label lines to clipped boxes with a ``kept`` flag; images without lines appear once with null boxes."""
    d = once(lines.select("image_id", "line_no", "line"), _p=fields_of())
    coords = F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda x: x.try_cast("double"))
    d = once(d, _cls=c("_p")[0].try_cast("int"), _c=coords)
    d = d.filter(c("_cls").isNotNull() & (F.size("_c") >= 4) & F.forall("_c", lambda x: x.isNotNull()))
    poly = G.polygon_to_box(c("_c"))
    plain = G.to_xyxy(G.Centre(c("_c")[0], c("_c")[1], c("_c")[2], c("_c")[3]))
    polygon = F.size("_p") > 5
    d = once(d, **{f"_k{i}": F.when(polygon, a).otherwise(b) for i, (a, b) in enumerate(zip(poly, plain))})
    k = [c(f"_k{i}") for i in range(4)]
    zero, one = lit(0), lit(1)
    cut = G.Corners(F.greatest(zero, k[0]), F.greatest(zero, k[1]), F.least(one, k[2]), F.least(one, k[3]))
    box = G.to_centre(cut)
    boxes = d.select(
        "image_id", "line_no", c("_cls").alias("cls_id"), box.cx.alias("cx"), box.cy.alias("cy"), box.w.alias("w"), box.h.alias("h")
    )
    joined = images.select("image_id", "width", "height").join(boxes, "image_id", "left")
    noise = G.is_noise_px("w", "h", "width", "height", min_area, min_dim)
    return joined.withColumn("kept", F.when(c("line_no").isNotNull(), ~noise)).drop("width", "height")


def autolabel_stats(post: DataFrame) -> DataFrame:
    return post.agg(
        F.count_if(c("kept") & (c("cls_id") == 0)).alias("open"),
        F.count_if(c("kept") & (c("cls_id") != 0)).alias("close"),
        F.count_if(c("kept") == F.lit(False)).alias("filtered"),
        F.count_if(c("line_no").isNull()).alias("empty"),
    )


def threshold_of(thresholds: Mapping[int, float], cls="cls_id", default: float = DEFAULT_CONF) -> Column:
    out = None
    for k, v in thresholds.items():
        out = F.when(c(cls) == k, lit(v)) if out is None else out.when(c(cls) == k, lit(v))
    return lit(default) if out is None else out.otherwise(lit(default))


def filter_detections(
    dets: DataFrame, thresholds: Mapping[int, float], min_area: float = 0.02, max_area: float = 0.75
) -> DataFrame:
    """Per-class confidence and an open area band."""
    a = c("w") * c("h")
    return dets.filter((c("conf") >= threshold_of(thresholds)) & (a > lit(min_area)) & (a < lit(max_area)))


def gate_detections(dets: DataFrame, cfg: FrameGateConfig = FrameGateConfig()) -> DataFrame:
    box = G.corners()
    roi = G.in_rect(box, cfg.roi)
    sure = ((c("label") == "open") & (c("conf") >= lit(cfg.open_conf))) | (
        (c("label") == "close") & (c("conf") >= lit(cfg.close_conf))
    )
    ratio = G.area_ratio(box, "frame_w", "frame_h")
    return dets.select("*", ratio.alias("area_ratio"), roi.alias("roi_pass"), (roi & sure).alias("filtered_pass"))


def gate_regions(dets: DataFrame, regions: DataFrame, mode: str = "correct") -> DataFrame:
    """Adds ``roi_pass``: the box's centre lies in one of its camera's regions.

    ``regions``: camera_id and ``polygon``, an array of structs x, y (a rectangle is one of four), any number of rows a
    camera. A camera without regions accepts everything. The regions of a camera travel as one row, so detections stay
    single rows, however many regions there are.
    """
    per_camera = regions.groupBy(c("camera_id").alias("_camera")).agg(F.collect_list("polygon").alias("_regions"))
    box = G.corners()
    mx, my = (box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2
    d = dets.join(per_camera, dets["camera_id"].eqNullSafe(c("_camera")), "left")
    inside = F.exists("_regions", lambda polygon: G.in_region(mx, my, polygon, mode))
    return d.select(*[dets[x] for x in dets.columns], F.coalesce(inside, F.lit(True)).alias("roi_pass"))


def reject_reason(cfg: DoorConfig = DoorConfig(), polygon_mode: str = "correct") -> Column:
    """First failed check of an observation, or ``accepted``. The temporal check needs state and is in door_states."""
    box = G.corners()
    label = F.lower(F.trim(c("label")))
    w, h = F.greatest(F.lit(0), box.x2 - box.x1), F.greatest(F.lit(0), box.y2 - box.y1)
    aspect = G.aspect_ratio(box)
    out = (
        F.when(~label.isin("open", "close"), "unsupported_class")
        .when((label == "open") & (c("conf") < lit(cfg.open_conf)), "below_open_threshold")
        .when((label == "close") & (c("conf") < lit(cfg.close_conf)), "below_close_threshold")
        .when((w <= 0) | (h <= 0), "invalid_bbox")
        .when(G.area_ratio(box, "frame_w", "frame_h") < lit(cfg.min_area_ratio), "small_box")
        .when(~aspect.between(lit(cfg.min_aspect), lit(cfg.max_aspect)), "invalid_aspect_ratio")
    )
    if cfg.roi:
        mx, my = (box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2
        out = out.when(~G.in_polygon(mx, my, cfg.roi, polygon_mode), "outside_roi")
    return out.otherwise("accepted")


def with_confidence(dets: DataFrame) -> DataFrame:
    """Adds ``raw_conf`` and sets ``conf`` and ``det_conf``: the classifier's confidence (``cls_conf``, else ``conf``)
    counts unless the detector's is higher."""
    raw = c("cls_conf") if "cls_conf" in dets.columns else c("conf")
    det = c("det_conf") if "det_conf" in dets.columns else raw
    return dets.withColumn("raw_conf", raw).withColumn("det_conf", det).withColumn("conf", F.greatest(c("raw_conf"), c("det_conf")))


def post_filter(dets: DataFrame, cfg: DoorConfig = DoorConfig(), polygon_mode: str = "correct") -> DataFrame:
    """Adds the reject reason, and the confidence columns of ``with_confidence``."""
    return with_confidence(dets).withColumn("reject_reason", reject_reason(cfg, polygon_mode))


def illumination_band(mean_l="mean_l", std_l="std_l", dark: float = 85) -> Column:
    return (
        F.when((c(mean_l) < 15) & (c(std_l) < 10), "low_confidence_dark")
        .when(c(mean_l) > 220, "glare_ignored")
        .when(c(mean_l) < lit(dark), "clahe_enhanced")
        .otherwise("normal")
    )


def sample_every(frames: DataFrame, n: int, frame="frame_seq") -> DataFrame:
    """Every n-th frame, frames counted from one."""
    return frames.filter(c(frame) % n == 0)


def sample_interval(frames: DataFrame, seconds: float, fps="fps", frame="frame_idx") -> DataFrame:
    """One frame per interval, frames counted from zero; an unknown rate (0) counts as 30."""
    rate = F.when(c(fps) == 0, lit(30)).otherwise(c(fps))
    step = F.greatest(F.floor(rate * lit(seconds)), F.lit(1))
    return frames.filter(c(frame) % step == 0)


def sample_to_fps(frames: DataFrame, target: float, keys: Sequence[str] = ("camera_id",), ts="timestamp_ms") -> DataFrame:
    """First frame of every 1/target second; one partial aggregation, no window."""
    slot = F.floor(c(ts) * lit(target) / 1000)
    row = F.struct(*frames.columns)
    return (
        frames.groupBy(*keys, slot.alias("_slot")).agg(F.min_by(row, c(ts)).alias("_r")).select("_r.*")
    )


def boxes_per_image(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with box counts; the boxes side is aggregated before it meets the images."""
    n = boxes.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        F.count_if(c("cls_id") == 0).alias("open_cnt"),
        F.count_if(c("cls_id") == 1).alias("close_cnt"),
    )
    return images.join(n, "image_id", "left").na.fill(0, ["n_boxes", "open_cnt", "close_cnt"])


def quality_views(images: DataFrame, boxes: DataFrame, low: int = 300, dense: int = 10) -> DataFrame:
    d = boxes_per_image(images, boxes)
    return d.select(
        "image_id",
        "n_boxes",
        ((c("width") < low) | (c("height") < low)).alias("low_res"),
        (c("n_boxes") == 0).alias("background"),
        (c("n_boxes") >= dense).alias("dense"),
    )


def purge_background(images: DataFrame, boxes: DataFrame) -> DataFrame:
    return images.join(boxes, "image_id", "left_semi")


def to_label_text(boxes: DataFrame) -> DataFrame:
    """One text line per box, keyed by image and line order."""
    return boxes.select("image_id", "line_no", box_line(c("cls_id"), c("cx"), c("cy"), c("w"), c("h")).alias("line"))
