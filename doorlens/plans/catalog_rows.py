"""Row-level queries: geometry, text, repair and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.config import LIVE_THRESHOLDS, DoorConfig
from doorlens.functions import geometry as G
from doorlens.functions import hashing as H
from doorlens.functions import text as X
from doorlens.functions.geometry import c, lit
from doorlens.operators import audit, joins, repair
from doorlens.plans import checks  # noqa: F401  (registers the check views)
from doorlens.plans.registry import IS_INT, fields, query

ROI = ((200, 200), (500, 150), (900, 240), (700, 420), (260, 380))
_XY = "(x1 + x2) / 2.0::DOUBLE AS mx, (y1 + y2) / 2.0::DOUBLE AS my"


@query(
    "to_xyxy",
    """SELECT b.image_id, box_id, ROUND((cx - w / 2) * width, 6) AS x1, ROUND((cy - h / 2) * height, 6) AS y1,
  ROUND((cx + w / 2) * width, 6) AS x2, ROUND((cy + h / 2) * height, 6) AS y2
FROM {gt_boxes} b JOIN {images} i ON b.image_id = i.image_id""",
)
def _(t):
    k = G.to_xyxy(G.centre(), c("width"), c("height"))
    d = t.gt_boxes.join(t.images.select("image_id", "width", "height"), "image_id")
    return d.select("image_id", "box_id", *[F.round(v, 6).alias(n) for n, v in k._asdict().items()])


@query(
    "clip_boxes",
    """SELECT image_id, box_id, ROUND((x1 + x2) / 2, 6) AS cx, ROUND((y1 + y2) / 2, 6) AS cy, ROUND(x2 - x1, 6) AS w, ROUND(y2 - y1, 6) AS h
FROM (SELECT image_id, box_id, greatest(0, cx - w / 2) AS x1, greatest(0, cy - h / 2) AS y1, least(1, cx + w / 2) AS x2, least(1, cy + h / 2) AS y2 FROM {gt_boxes})""",
)
def _(t):
    k = G.clip_box(G.centre())
    return t.gt_boxes.select("image_id", "box_id", *[F.round(v, 6).alias(n) for n, v in k._asdict().items()])


@query(
    "iou_pairs",
    "SELECT image_id, box_id, det_id, gt_cls, pred_cls, ROUND(iou, 6) AS iou FROM {pairs}",
)
def _(t):
    from doorlens.operators.match import overlaps

    d = overlaps(t.gt_boxes, t.detections)
    return d.select("image_id", "box_id", "det_id", "gt_cls", "pred_cls", F.round("iou", 6).alias("iou"))


@query(
    "noise_filter",
    """SELECT b.image_id, box_id, (w * width * (h * height) < 200 OR least(w * width, h * height) < 10) AS noise
FROM {gt_boxes} b JOIN {images} i ON b.image_id = i.image_id""",
)
def _(t):
    d = t.gt_boxes.join(t.images.select("image_id", "width", "height"), "image_id")
    return d.select("image_id", "box_id", G.is_noise_px("w", "h", "width", "height").alias("noise"))


@query(
    "area_aspect",
    """SELECT camera_id, frame_seq, ROUND(greatest(0, x2 - x1) * greatest(0, y2 - y1) / (frame_w * frame_h)::DOUBLE, 6) AS area_ratio,
  ROUND(greatest(0, x2 - x1)::DOUBLE / greatest(1, greatest(0, y2 - y1))::DOUBLE, 6) AS aspect FROM {frame_obs}""",
)
def _(t):
    box = G.corners()
    return t.frame_obs.select(
        "camera_id",
        "frame_seq",
        F.round(G.area_ratio(box, "frame_w", "frame_h"), 6).alias("area_ratio"),
        F.round(G.aspect_ratio(box), 6).alias("aspect"),
    )


@query(
    "near_edge",
    "SELECT image_id, box_id, (cx < 0.1::DOUBLE OR cx > 0.9::DOUBLE OR cy < 0.1::DOUBLE OR cy > 0.9::DOUBLE) AS near_edge FROM {gt_boxes}",
)
def _(t):
    return t.gt_boxes.select("image_id", "box_id", G.near_edge().alias("near_edge"))


@query(
    "in_rect",
    f"SELECT camera_id, frame_seq, (mx BETWEEN 100 AND 1180 AND my BETWEEN 200 AND 700) AS inside FROM (SELECT camera_id, frame_seq, {_XY} FROM {{frame_obs}})",
)
def _(t):
    return t.frame_obs.select("camera_id", "frame_seq", G.in_rect(G.corners(), (100, 200, 1180, 700)).alias("inside"))


def _crossings() -> str:
    out = []
    for (px, py), (qx, qy) in zip(ROI, (*ROI[1:], ROI[0])):
        out.append(
            f"CASE WHEN ({py} > my) <> ({qy} > my) AND mx < {qx - px}::DOUBLE * (my - {py}) / {qy - py}::DOUBLE + {px} THEN 1 ELSE 0 END"
        )
    return " + ".join(out)


@query(
    "gate_regions",
    """WITH cam AS (SELECT DISTINCT camera_id AS k FROM {frame_obs} WHERE camera_id % 3 <> 0),
  e AS (SELECT k, 1 AS r, 100 + 10 * (k % 7) AS px, 80 AS py, 1200 AS qx, 120 AS qy FROM cam UNION ALL SELECT k, 1, 1200, 120, 900 - 20 * (k % 5), 700 FROM cam
    UNION ALL SELECT k, 1, 900 - 20 * (k % 5), 700, 100 + 10 * (k % 7), 80 FROM cam UNION ALL SELECT k, 2, 0, 400, 300, 400 FROM cam
    UNION ALL SELECT k, 2, 300, 400, 300, 720 FROM cam UNION ALL SELECT k, 2, 300, 720, 0, 720 FROM cam UNION ALL SELECT k, 2, 0, 720, 0, 400 FROM cam),
  d AS (SELECT camera_id, frame_seq, det_no, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM {frame_obs}),
  h AS (SELECT camera_id, frame_seq, det_no, r, COUNT(*) FILTER ((py > my) <> (qy > my) AND mx < (qx - px) * (my - py) / NULLIF(qy - py, 0) + px) % 2 = 1 AS hit
    FROM d JOIN e ON e.k = d.camera_id GROUP BY ALL),
  g AS (SELECT camera_id, frame_seq, det_no, bool_or(hit) AS hit FROM h GROUP BY ALL)
SELECT d.camera_id, d.frame_seq, d.det_no, COALESCE(g.hit, TRUE) AS roi_pass FROM d LEFT JOIN g ON g.camera_id = d.camera_id AND g.frame_seq = d.frame_seq AND g.det_no = d.det_no""",
)
def _(t):
    """Two regions for two of three cameras, a triangle and a rectangle; the third accepts everything."""
    k = F.col("camera_id")

    def region(*points):
        return F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in points])

    triangle = F.array(*[F.struct(x.cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((100 + 10 * (k % 7), 80), (F.lit(1200), 120), (900 - 20 * (k % 5), 700))])
    cameras = t.frame_obs.filter("camera_id % 3 <> 0").select("camera_id").distinct()
    both = F.explode(F.array(triangle, region((0, 400), (300, 400), (300, 720), (0, 720)))).alias("polygon")
    return repair.gate_regions(t.frame_obs, cameras.select("camera_id", both)).select("camera_id", "frame_seq", "det_no", "roi_pass")


@query(
    "in_polygon",
    f"SELECT camera_id, frame_seq, (({_crossings()}) % 2 = 1) AS inside FROM (SELECT camera_id, frame_seq, {_XY} FROM {{frame_obs}})",
)
def _(t):
    box = G.corners()
    inside = G.in_polygon((box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2, ROI)
    return t.frame_obs.select("camera_id", "frame_seq", inside.alias("inside"))


@query(
    "center_shift",
    """SELECT camera_id, frame_seq, ROUND(sqrt(dx * dx + dy * dy), 6) AS shift FROM (
  SELECT o.camera_id, o.frame_seq, ((o.x1 + o.x2) / 2.0::DOUBLE - (p.x1 + p.x2) / 2.0::DOUBLE) / 1280 AS dx,
    ((o.y1 + o.y2) / 2.0::DOUBLE - (p.y1 + p.y2) / 2.0::DOUBLE) / 720 AS dy
  FROM {frame_obs} o JOIN {frame_obs} p ON o.camera_id = p.camera_id AND o.frame_seq = p.frame_seq + 1)""",
)
def _(t):
    from doorlens.operators.ranking import look_back

    def build(d, w):
        for n in ("x1", "y1", "x2", "y2"):
            d = d.withColumn(f"p{n}", F.first(n).over(w(-1, -1)))
        return d

    d = look_back(t.frame_obs.select("camera_id", "frame_seq", "x1", "y1", "x2", "y2", "frame_w", "frame_h"), ["camera_id"], "frame_seq", 1, build)
    shift = G.center_shift(G.corners("px1", "py1", "px2", "py2"), G.corners(), "frame_w", "frame_h")
    return d.filter(c("px1").isNotNull()).select("camera_id", "frame_seq", F.round(shift, 6).alias("shift"))


@query(
    "clamp_xyxy",
    """SELECT * FROM (SELECT camera_id, frame_seq, CAST(greatest(0, least(960, x1)) AS INT) AS x1, CAST(greatest(0, least(320, y1)) AS INT) AS y1,
  CAST(greatest(0, least(960, x2)) AS INT) AS x2, CAST(greatest(0, least(320, y2)) AS INT) AS y2 FROM {frame_obs})
WHERE x2 - x1 >= 10 AND y2 - y1 >= 10""",
)
def _(t):
    k = G.clamp_xyxy(G.corners(), F.lit(960), F.lit(320))
    d = t.frame_obs.select("camera_id", "frame_seq", *[v.alias(n) for n, v in k._asdict().items()])
    return d.filter(G.wide_enough(G.corners()))


@query(
    "offset_box",
    """SELECT camera_id, frame_seq, x1 + det_no * 10 AS x1, y1 + 20 AS y1, x2 + det_no * 10 AS x2, y2 + 20 AS y2 FROM {frame_obs}""",
)
def _(t):
    k = G.offset_box(G.corners(), c("det_no") * 10, F.lit(20))
    return t.frame_obs.select("camera_id", "frame_seq", *[v.alias(n) for n, v in k._asdict().items()])


@query("scene_key", "SELECT image_id, file_name, scene FROM {scened}")
def _(t):
    return t.images.select("image_id", "file_name", X.scene_key().alias("scene"))


@query(
    "sample_name",
    """SELECT image_id, 'replay_open_' || file_name AS replay, 'boost_open_' || file_name AS boost, 'm072_high_' || file_name AS mined,
  stem || '_open_normal_aug_2' AS augmented, stem || '_f' || CAST(image_id AS VARCHAR) || '.jpg' AS frame FROM {stems}""",
)
def _(t):
    return t.images.select(
        "image_id",
        X.replay_name(F.lit("open")).alias("replay"),
        X.boost_name().alias("boost"),
        X.mined_name(F.lit("high")).alias("mined"),
        X.augmented_name(c("file_name"), F.lit("open_normal"), F.lit(2)).alias("augmented"),
        X.frame_name(c("file_name"), c("image_id")).alias("frame"),
    )


@query(
    "contact_state",
    """SELECT event_id, CASE label WHEN 'close' THEN 'contact' WHEN 'open' THEN 'separated' ELSE 'unknown' END AS contact,
  CASE label WHEN 'open' THEN 0 WHEN 'close' THEN 1 END AS cls_id FROM {frame_obs}""",
)
def _(t):
    return t.frame_obs.select("event_id", X.contact_state().alias("contact"), X.class_id().alias("cls_id"))


@query(
    "norm_label",
    """SELECT event_id, CASE WHEN lower(trim(s)) IN ('open', 'close') THEN lower(trim(s)) ELSE 'unknown' END AS label
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ' ' || upper(label) || ' ' ELSE label END AS s FROM {frame_obs})""",
)
def _(t):
    s = F.when(c("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("label"), F.lit(" "))).otherwise(c("label"))
    return t.frame_obs.select("event_id", X.norm_label(s).alias("label"))


@query(
    "content_hash",
    """SELECT version, COUNT(*) AS n_images,
  substr(sha256(concat_ws('|', CAST(COUNT(*) AS VARCHAR), CAST(SUM(CAST(('0x' || substr(sha256(concat_ws('|', CAST(image_id AS VARCHAR), file_name)), 1, 12)) AS BIGINT)) AS VARCHAR))), 1, 12) AS dataset_hash
FROM {images} GROUP BY version""",
)
def _(t):
    return t.images.groupBy("version").agg(
        F.count(F.lit(1)).alias("n_images"), H.set_hash("image_id", "file_name").alias("dataset_hash")
    )


@query(
    "softmax",
    """SELECT vec_id, ROUND(exp(s[1] - m) / z, 6) AS p0, ROUND(exp(s[2] - m) / z, 6) AS p1, ROUND(exp(s[3] - m) / z, 6) AS p2
FROM (SELECT *, exp(s[1] - m) + exp(s[2] - m) + exp(s[3] - m) AS z FROM (
  SELECT vec_id, [embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, embedding[3]::DOUBLE * 10] AS s,
    greatest(embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10, embedding[3]::DOUBLE * 10) AS m FROM {embeddings}))""",
)
def _(t):
    scores = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 10)
    d = t.embeddings.select("vec_id", H.softmax(scores).alias("p"))
    return d.select("vec_id", *[F.round(c("p")[i], 6).alias(f"p{i}") for i in range(3)])


@query(
    "fmt_run",
    """SELECT run_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M') AS run_time, regexp_extract(save_dir, '([^/]*)$', 1) AS name FROM {experiments}""",
)
def _(t):
    return t.experiments.select(
        "run_id",
        X.fmt_run_time(F.to_timestamp_ntz("ts")).alias("run_time"),
        X.basename(c("save_dir")).alias("name"),
    )


@query(
    "frame_ts",
    """SELECT camera_id, frame_seq, frame_seq * 33 AS frame_ms, ROUND(CASE WHEN infer_ms > 0 THEN 1000.0::DOUBLE / infer_ms ELSE 0 END, 6) AS fps FROM {latency_log}""",
)
def _(t):
    return t.latency_log.select(
        "camera_id", "frame_seq", X.frame_ts().alias("frame_ms"), F.round(X.fps(c("infer_ms")), 6).alias("fps")
    )


@query("strip_bom", "SELECT image_id, line_no, line FROM {label_lines}")
def _(t):
    bom = F.when(c("line_no") % 2 == 0, F.concat(F.lit("\ufeff"), c("line"))).otherwise(c("line"))
    return t.label_lines.select("image_id", "line_no", X.strip_bom(bom).alias("line"))


@query("fitness", "SELECT run_id, ROUND(0.1::DOUBLE * map50 + 0.9::DOUBLE * map50_95, 6) AS fitness FROM {experiments}")
def _(t):
    return t.experiments.select("run_id", F.round(audit.fitness(c("map50"), c("map50_95")), 6).alias("fitness"))


# -- repair ------------------------------------------------------------------------------------------------------

_PARSED = f"""SELECT image_id, line_no, p, CAST(p[1] AS INT) AS cls_id,
    greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, TRY_CAST(p[2] AS DOUBLE))) AS cx, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, TRY_CAST(p[3] AS DOUBLE))) AS cy,
    greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, TRY_CAST(p[4] AS DOUBLE))) AS w, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, TRY_CAST(p[5] AS DOUBLE))) AS h
  FROM (SELECT image_id, line_no, {fields('line')} AS p FROM {{label_lines}})
  WHERE len(p) >= 5 AND {IS_INT.format('p[1]')} AND TRY_CAST(p[1] AS INT) IN (0, 1) AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL
    AND TRY_CAST(p[3] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[4] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[5] AS DOUBLE) IS NOT NULL"""


@query(
    "parse_labels",
    f"""SELECT image_id, line_no, cls_id, cx, cy, w, h, len(p) > 5 AS is_polygon, ROUND(w * h, 6) AS area,
  (cx < 0.1::DOUBLE OR cx > 0.9::DOUBLE OR cy < 0.1::DOUBLE OR cy > 0.9::DOUBLE) AS is_near_edge
FROM ({_PARSED}) WHERE w * h >= 5e-5::DOUBLE AND least(w, h) >= 0.008::DOUBLE""",
)
def _(t):
    return repair.parse_labels(t.label_lines).withColumn("area", F.round("area", 6))


_CLEAN = r"""SELECT image_id, line_no, line, CASE WHEN cls <= 1 THEN CAST(cls AS VARCHAR) || ' ' || array_to_string(p[2:], ' ') END AS clean
  FROM (SELECT *, CAST(trunc(TRY_CAST(p[1] AS DOUBLE)) AS BIGINT) AS cls FROM (SELECT *, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS p FROM {label_lines}))"""


@query(
    "repair_labels",
    f"""SELECT image_id, COUNT(clean) AS n_clean, bool_or(clean IS NULL OR clean <> line) AS changed,
  CAST(SUM(length(clean)) AS BIGINT) AS clean_chars FROM ({_CLEAN}) GROUP BY image_id""",
)
def _(t):
    d = repair.repair_labels(t.label_lines)
    return d.groupBy("image_id").agg(
        F.count("clean").alias("n_clean"),
        F.bool_or("changed").alias("changed"),
        F.sum(F.length("clean").cast("bigint")).alias("clean_chars"),
    )


@query(
    "repair_polygons",
    f"""SELECT image_id, line_no, CASE WHEN len(p) > 5 THEN p[1] || ' ' || printf('%.6f %.6f %.6f %.6f', (list_min(xs) + list_max(xs)) / 2, (list_min(ys) + list_max(ys)) / 2, list_max(xs) - list_min(xs), list_max(ys) - list_min(ys))
  ELSE trim(line) END AS line, len(p) > 5 AS fixed
FROM (SELECT *, [TRY_CAST(p[i] AS DOUBLE) for i in range(2, len(p) + 1) if i % 2 = 0] AS xs, [TRY_CAST(p[i] AS DOUBLE) for i in range(2, len(p) + 1) if i % 2 = 1] AS ys
  FROM (SELECT *, {fields('line')} AS p FROM {{label_lines}}))""",
)
def _(t):
    return repair.repair_polygons(t.label_lines)


_AUTO = f"""SELECT i.image_id, b.line_no, b.cls_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, width, height
FROM {{images}} i LEFT JOIN (
  SELECT image_id, line_no, TRY_CAST(p[1] AS INT) AS cls_id,
    greatest(0, CASE WHEN len(p) > 5 THEN list_min(xs) ELSE v[1] - v[3] / 2 END) AS x1, greatest(0, CASE WHEN len(p) > 5 THEN list_min(ys) ELSE v[2] - v[4] / 2 END) AS y1,
    least(1, CASE WHEN len(p) > 5 THEN list_max(xs) ELSE v[1] + v[3] / 2 END) AS x2, least(1, CASE WHEN len(p) > 5 THEN list_max(ys) ELSE v[2] + v[4] / 2 END) AS y2
  FROM (SELECT *, [v[i] for i in range(1, len(v) + 1) if i % 2 = 1] AS xs, [v[i] for i in range(1, len(v) + 1) if i % 2 = 0] AS ys
    FROM (SELECT *, [TRY_CAST(x AS DOUBLE) for x in p[2:]] AS v FROM (SELECT *, {fields('line')} AS p FROM {{label_lines}})))
  WHERE {IS_INT.format('p[1]')} AND len(v) >= 4 AND len([x for x in v if x IS NULL]) = 0) b ON i.image_id = b.image_id"""


@query(
    "repair_autolabels",
    f"""SELECT COUNT(*) FILTER (kept AND cls_id = 0) AS open, COUNT(*) FILTER (kept AND cls_id <> 0) AS close,
  COUNT(*) FILTER (NOT kept) AS filtered, COUNT(*) FILTER (line_no IS NULL) AS empty
FROM (SELECT *, CASE WHEN line_no IS NOT NULL THEN NOT (w * width * (h * height) < 200 OR least(w * width, h * height) < 10) END AS kept FROM ({_AUTO}))""",
)
def _(t):
    return repair.autolabel_stats(repair.postprocess_autolabels(t.label_lines, t.images))


@query(
    "postprocess_autolabels",
    f"""SELECT image_id, line_no, cls_id, ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy, ROUND(w, 6) AS w, ROUND(h, 6) AS h,
  CASE WHEN line_no IS NOT NULL THEN NOT (w * width * (h * height) < 200 OR least(w * width, h * height) < 10) END AS kept FROM ({_AUTO})""",
)
def _(t):
    d = repair.postprocess_autolabels(t.label_lines, t.images)
    return d.select("image_id", "line_no", "cls_id", *[F.round(n, 6).alias(n) for n in ("cx", "cy", "w", "h")], "kept")


@query(
    "label_text",
    "SELECT image_id, box_id AS line_no, printf('%d %.6f %.6f %.6f %.6f', cls_id, cx, cy, w, h) AS line FROM {gt_boxes}",
)
def _(t):
    return repair.to_label_text(t.gt_boxes.withColumnRenamed("box_id", "line_no"))


@query(
    "filter_detections",
    """SELECT image_id, det_id, cls_id, conf FROM {detections}
WHERE conf >= CASE cls_id WHEN 0 THEN 0.35::DOUBLE WHEN 1 THEN 0.60::DOUBLE ELSE 0.5::DOUBLE END AND w * h > 0.02::DOUBLE AND w * h < 0.75::DOUBLE""",
)
def _(t):
    return repair.filter_detections(t.detections, LIVE_THRESHOLDS).select("image_id", "det_id", "cls_id", "conf")


_GATED = f"""SELECT camera_id, frame_seq, label, ratio, roi, roi AND ((label = 'open' AND conf >= 0.80::DOUBLE) OR (label = 'close' AND conf >= 0.85::DOUBLE)) AS ok
FROM (SELECT *, mx BETWEEN 100 AND 1180 AND my BETWEEN 100 AND 700 AS roi FROM (SELECT *, {_XY}, (x2 - x1) * greatest(0, y2 - y1) / (frame_w * frame_h)::DOUBLE AS ratio FROM {{frame_obs}}))"""


@query(
    "gate_detections",
    f"SELECT camera_id, frame_seq, ROUND(ratio, 6) AS area_ratio, roi AS roi_pass, ok AS filtered_pass FROM ({_GATED})",
)
def _(t):
    d = repair.gate_detections(t.frame_obs)
    return d.select("camera_id", "frame_seq", F.round("area_ratio", 6).alias("area_ratio"), "roi_pass", "filtered_pass")


_REASON = f"""CASE WHEN label NOT IN ('open', 'close') THEN 'unsupported_class' WHEN label = 'open' AND conf < 0.80::DOUBLE THEN 'below_open_threshold'
  WHEN label = 'close' AND conf < 0.55::DOUBLE THEN 'below_close_threshold' WHEN x2 <= x1 OR y2 <= y1 THEN 'invalid_bbox'
  WHEN (x2 - x1) * (y2 - y1) / (frame_w * frame_h)::DOUBLE < 0.03::DOUBLE THEN 'small_box'
  WHEN NOT ((x2 - x1)::DOUBLE / greatest(1, y2 - y1) BETWEEN 0.60::DOUBLE AND 2.50::DOUBLE) THEN 'invalid_aspect_ratio'
  WHEN ({_crossings()}) % 2 = 0 THEN 'outside_roi' ELSE 'accepted' END"""


@query(
    "post_filter",
    f"SELECT camera_id, frame_seq, {_REASON} AS reject_reason FROM (SELECT *, {_XY} FROM {{frame_obs}})",
)
def _(t):
    cfg = DoorConfig(min_area_ratio=0.03, min_aspect=0.60, roi=ROI)
    return repair.post_filter(t.frame_obs, cfg).select("camera_id", "frame_seq", "reject_reason")


BAND = "CASE WHEN mean_l < 15 AND std_l < 10 THEN 'low_confidence_dark' WHEN mean_l > 220 THEN 'glare_ignored' WHEN mean_l < 85 THEN 'clahe_enhanced' ELSE 'normal' END"


@query("illumination_band", f"SELECT camera_id, frame_seq, {BAND} AS band FROM {{frame_obs}}")
def _(t):
    return t.frame_obs.select("camera_id", "frame_seq", repair.illumination_band().alias("band"))


@query("sample_every", "SELECT camera_id, frame_seq, event_id FROM {frame_obs} WHERE frame_seq % 10 = 0")
def _(t):
    return repair.sample_every(t.frame_obs, 10).select("camera_id", "frame_seq", "event_id")


@query(
    "sample_interval",
    """SELECT camera_id, frame_idx, fps FROM (SELECT camera_id, frame_seq - 1 AS frame_idx, CAST((camera_id % 4) * 2 AS DOUBLE) AS fps FROM {frame_obs})
WHERE frame_idx % CAST(floor(CASE WHEN fps = 0 THEN 30 ELSE fps END * 2.5::DOUBLE) AS BIGINT) = 0""",
)
def _(t):
    d = t.frame_obs.select("camera_id", (c("frame_seq") - 1).alias("frame_idx"), ((c("camera_id") % 4) * 2).cast("double").alias("fps"))
    return repair.sample_interval(d, 2.5)


@query(
    "sample_to_fps",
    """SELECT camera_id, slot, frame_seq FROM (SELECT camera_id, frame_seq, CAST(floor(timestamp_ms * 0.5::DOUBLE / 1000) AS BIGINT) AS slot,
  ROW_NUMBER() OVER (PARTITION BY camera_id, floor(timestamp_ms * 0.5::DOUBLE / 1000) ORDER BY timestamp_ms) AS rn FROM {frame_obs}) WHERE rn = 1""",
)
def _(t):
    d = repair.sample_to_fps(t.frame_obs.select("camera_id", "frame_seq", "timestamp_ms"), 0.5)
    return d.select("camera_id", F.floor(c("timestamp_ms") * lit(0.5) / 1000).alias("slot"), "frame_seq")


@query(
    "distance_bucket",
    "SELECT image_id, box_id, CASE WHEN w * h > 0.25::DOUBLE THEN 'near' WHEN w * h > 0.05::DOUBLE THEN 'mid' ELSE 'far' END AS distance FROM {gt_boxes}",
)
def _(t):
    return t.gt_boxes.select("image_id", "box_id", G.distance_bucket(c("w") * c("h")).alias("distance"))


@query(
    "quality_views",
    """SELECT i.image_id, COALESCE(n, 0) AS n_boxes, (width < 300 OR height < 300) AS low_res, COALESCE(n, 0) = 0 AS background, COALESCE(n, 0) >= 10 AS dense
FROM {images} i LEFT JOIN (SELECT image_id, COUNT(*) AS n FROM {gt_boxes} GROUP BY 1) b ON i.image_id = b.image_id""",
)
def _(t):
    return repair.quality_views(t.images, t.gt_boxes)


@query(
    "purge_background",
    "SELECT image_id, file_name FROM {images} WHERE image_id IN (SELECT image_id FROM {gt_boxes})",
)
def _(t):
    return repair.purge_background(t.images, t.gt_boxes).select("image_id", "file_name")


# -- joins -------------------------------------------------------------------------------------------------------


@query(
    "attach_labels",
    "SELECT i.image_id, i.version, b.box_id, b.cls_id FROM {images} i LEFT JOIN {gt_boxes} b ON i.image_id = b.image_id",
)
def _(t):
    return joins.attach_labels(t.images, t.gt_boxes).select("image_id", "version", "box_id", "cls_id")


@query(
    "select_negatives",
    "SELECT image_id, file_name FROM {images} WHERE image_id NOT IN (SELECT image_id FROM {detections} WHERE cls_id IN (0, 2, 5, 7) AND conf >= 0.25::DOUBLE)",
)
def _(t):
    return joins.select_negatives(t.images, t.detections, (0, 2, 5, 7)).select("image_id", "file_name")


_STATUS = """SELECT r.image_id, CASE WHEN g.image_id IS NOT NULL THEN 'applied' WHEN w.image_id IS NOT NULL THEN 'promoted' ELSE 'ghost' END AS status
FROM (SELECT DISTINCT image_id FROM {reviewed_labels}) r LEFT JOIN {gold_images} g ON r.image_id = g.image_id LEFT JOIN {raw_images} w ON r.image_id = w.image_id"""


@query(
    "merge_reviewed",
    f"""WITH st AS ({_STATUS})
SELECT l.image_id, l.line_no, l.line, 'kept' AS status FROM {{gold_labels}} l WHERE l.image_id NOT IN (SELECT image_id FROM st WHERE status <> 'ghost')
UNION ALL SELECT r.image_id, r.line_no, r.line, st.status FROM {{reviewed_labels}} r JOIN st ON r.image_id = st.image_id WHERE st.status <> 'ghost'""",
)
def _(t):
    return joins.merge_reviewed(t.reviewed_labels, t.gold_images, t.raw_images, t.gold_labels)


@query(
    "merge_report",
    f"""SELECT COUNT(*) FILTER (status <> 'ghost') AS merged, COUNT(*) FILTER (status = 'promoted') AS promoted, COUNT(*) FILTER (status = 'ghost') AS skipped FROM ({_STATUS})""",
)
def _(t):
    return joins.merge_report(t.reviewed_labels, t.gold_images, t.raw_images)


@query(
    "recover_labels",
    """SELECT f.file_id, f.file_name, CASE WHEN f.text = '' THEN COALESCE(b.text, '') ELSE f.text END AS text,
  CASE WHEN f.text = '' THEN b.version END AS from_version,
  CASE WHEN f.text <> '' THEN 'kept' WHEN b.text IS NOT NULL THEN 'recovered' ELSE 'not_found' END AS status
FROM {version_files} f LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_name ORDER BY version, file_id) AS rn FROM {version_files} WHERE text <> '') WHERE rn = 1) b
  ON f.file_name = b.file_name""",
)
def _(t):
    return joins.recover_labels(t.version_files.select("file_id", "file_name", "text"), t.version_files)


@query(
    "exclude_existing",
    """SELECT r.image_id, r.file_name FROM {raw_images} r WHERE NOT EXISTS (SELECT 1 FROM {gold_images} g
  WHERE (CASE WHEN g.image_id % 3 = 0 THEN 'boost_open_' WHEN g.image_id % 3 = 1 THEN 'miner_open_' ELSE '' END || g.file_name) IN (r.file_name, 'miner_open_' || r.file_name, 'boost_open_' || r.file_name))""",
)
def _(t):
    prefix = F.when(c("image_id") % 3 == 0, "boost_open_").when(c("image_id") % 3 == 1, "miner_open_").otherwise("")
    pool = t.gold_images.select(F.concat(prefix, c("file_name")).alias("file_name"))
    return joins.exclude_existing(t.raw_images, pool).select("image_id", "file_name")


@query(
    "exclude_contained",
    """SELECT r.image_id, r.name FROM (SELECT image_id, regexp_extract(file_name, '^([^.]*)', 1) AS name FROM {raw_images}) r
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT file_name FROM {gold_images}) g WHERE contains(g.file_name, r.name))""",
)
def _(t):
    cands = t.raw_images.select("image_id", F.regexp_extract("file_name", "^([^.]*)", 1).alias("file_name"))
    return joins.exclude_contained(cands, t.gold_images).select("image_id", c("file_name").alias("name"))


@query(
    "remove_leakage",
    "SELECT image_id, file_name FROM {gold_images} WHERE file_name NOT IN (SELECT file_name FROM {raw_images})",
)
def _(t):
    return joins.remove_leakage(t.gold_images, t.raw_images).select("image_id", "file_name")


@query(
    "diff_labels",
    """SELECT a.image_id, CASE WHEN b.image_id IS NULL THEN 'missing' WHEN a.txt = b.txt THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT image_id, string_agg(CAST(line_no AS VARCHAR) || ' ' || line, chr(10) ORDER BY line_no, line) AS txt FROM {reviewed_labels} GROUP BY 1) a
LEFT JOIN (SELECT image_id, string_agg(CAST(line_no AS VARCHAR) || ' ' || line, chr(10) ORDER BY line_no, line) AS txt FROM {gold_labels} GROUP BY 1) b ON a.image_id = b.image_id""",
)
def _(t):
    return joins.diff_labels(t.gold_labels, t.reviewed_labels)


@query(
    "inject_replay",
    """SELECT image_id, file_name, 'train' AS source FROM {gold_images}
UNION ALL SELECT image_id, 'replay_open_' || file_name, 'replay' FROM {raw_images} WHERE image_id IN (SELECT image_id FROM {gt_boxes})""",
)
def _(t):
    return joins.inject_replay(t.gold_images, joins.replay_core(t.raw_images, t.gt_boxes, "open"))


@query(
    "review_package",
    "SELECT image_id, 'obj_train_data/' || file_name AS entry FROM {images} WHERE image_id IN (SELECT image_id FROM {label_lines})",
)
def _(t):
    return joins.review_package(t.images, t.label_lines)


@query(
    "dataset_descriptor",
    """SELECT '/data/current' AS path, 'images' AS train, '/data/frozen/images' AS val, CAST(2 AS INT) AS nc, 'open,close' AS names, COUNT(*) AS n_images,
  substr(sha256(concat_ws('|', CAST(COUNT(*) AS VARCHAR), CAST(SUM(CAST(('0x' || substr(sha256(concat_ws('|', CAST(image_id AS VARCHAR), file_name)), 1, 12)) AS BIGINT)) AS VARCHAR))), 1, 12) AS dataset_hash
FROM {gold_images}""",
)
def _(t):
    return joins.dataset_descriptor(t.gold_images, "/data/current", "/data/frozen/images")
