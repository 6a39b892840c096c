"""Matching, audits, split, balance, augmentation and mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.config import MINING_BUCKETS, SWEEP_CONFS, SplitConfig
from doorlens.functions.geometry import c
from doorlens.operators import audit, augment, balance, governance, joins, match, mining, split
from doorlens.plans import checks  # noqa: F401  (registers the check views)
from doorlens.plans.check_rules import augmented
from doorlens.plans.registry import digest, fields, query

# -- matching ----------------------------------------------------------------------------------------------------


@query(
    "fn_taxonomy",
    """SELECT image_id, box_id, status, ROUND(oi, 4) AS max_open_iou, ROUND(oc, 4) AS max_open_conf, ROUND(ai, 4) AS max_any_iou, ac AS max_any_cls FROM {taxo}""",
)
def _(t):
    return match.fn_taxonomy(t.gt_boxes, t.detections)


@query(
    "fn_lists",
    """SELECT status AS fn_type, file_name AS image_name, box_id AS gt_idx, ROUND(oi, 4) AS max_open_iou, ROUND(oc, 4) AS max_open_conf, ROUND(ai, 4) AS max_any_iou, ac AS max_any_cls
FROM {taxo} t JOIN {images} i ON t.image_id = i.image_id WHERE status <> 'TP'""",
)
def _(t):
    return match.fn_lists(match.fn_taxonomy(t.gt_boxes, t.detections), t.images)


@query(
    "strict_missed",
    """SELECT image_id, COUNT(*) FILTER (NOT hit) AS missed_count, COUNT(*) AS total_gt_in_img
FROM (SELECT g.image_id, EXISTS (SELECT 1 FROM {pairs} p WHERE p.image_id = g.image_id AND p.box_id = g.box_id AND pred_cls = 0 AND iou > 0.45::DOUBLE) AS hit FROM {gt_boxes} g WHERE cls_id = 0)
GROUP BY image_id HAVING COUNT(*) FILTER (NOT hit) > 0""",
)
def _(t):
    return match.strict_missed(t.gt_boxes, t.detections)


@query(
    "class_fn_report",
    """SELECT cls_id, COUNT(*) AS total, COUNT(*) FILTER (hit) AS matched, COUNT(*) FILTER (NOT hit) AS fn, COUNT(*) FILTER (NOT hit AND small) AS small_fn, ROUND(COUNT(*) FILTER (hit) / COUNT(*), 6) AS recall
FROM (SELECT cls_id, w * h < 0.02::DOUBLE AS small, EXISTS (SELECT 1 FROM {pairs} p WHERE p.image_id = g.image_id AND p.box_id = g.box_id AND pred_cls = gt_cls AND conf >= 0.4::DOUBLE AND iou >= 0.5::DOUBLE) AS hit FROM {gt_boxes} g)
GROUP BY cls_id""",
)
def _(t):
    return match.class_fn_report(t.gt_boxes, t.detections)


@query(
    "confusion",
    """WITH best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, box_id) AS rn FROM {pairs} WHERE conf >= 0.25::DOUBLE) WHERE rn = 1 AND iou >= 0.45::DOUBLE),
  won AS (SELECT * FROM (SELECT * EXCLUDE (rn), ROW_NUMBER() OVER (PARTITION BY image_id, box_id ORDER BY conf DESC, det_id) AS k FROM best) WHERE k = 1)
SELECT gt_cls, pred_cls, COUNT(*) AS n FROM won GROUP BY 1, 2
UNION ALL SELECT cls_id, -1, COUNT(*) FROM {gt_boxes} g WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.image_id = g.image_id AND w.box_id = g.box_id) GROUP BY 1
UNION ALL SELECT -1, cls_id, COUNT(*) FROM {detections} p WHERE conf >= 0.25::DOUBLE AND NOT EXISTS (SELECT 1 FROM won w WHERE w.image_id = p.image_id AND w.det_id = p.det_id) GROUP BY 2""",
)
def _(t):
    return match.confusion(t.gt_boxes, t.detections)


@query(
    "detection_metrics",
    """WITH pts AS (SELECT r.cls_id, r.t, CAST(r.tp * 100 AS BIGINT) // n_gt AS q, MAX(r.tp / r.rk) AS p FROM {pred_rank} r JOIN {gt_n} n ON r.cls_id = n.cls_id WHERE is_tp GROUP BY 1, 2, 3),
  grid AS (SELECT c.cls_id, i.t, q FROM {gt_n} c, {ious} i, (SELECT UNNEST(range(0, 101)) AS q)),
  ap AS (SELECT cls_id, t, AVG(p) AS ap FROM (SELECT g.cls_id, g.t, g.q, COALESCE(MAX(p.p), 0) AS p FROM grid g LEFT JOIN pts p ON p.cls_id = g.cls_id AND p.t = g.t AND p.q >= g.q GROUP BY 1, 2, 3) GROUP BY 1, 2),
  cnt AS (SELECT cls_id, COUNT(*) AS n_pred, COUNT(*) FILTER (is_tp) AS tp FROM {pred_rank} WHERE t = 0 GROUP BY 1)
SELECT n.cls_id, n_gt, n_pred, tp, ROUND(tp / n_pred, 6) AS precision, ROUND(tp / n_gt, 6) AS recall,
  ROUND((SELECT ap FROM ap WHERE ap.cls_id = n.cls_id AND t = 0), 6) AS ap50, ROUND((SELECT SUM(ap) / 10 FROM ap WHERE ap.cls_id = n.cls_id), 6) AS ap50_95
FROM {gt_n} n JOIN cnt ON n.cls_id = cnt.cls_id""",
)
def _(t):
    return match.detection_metrics(t.gt_boxes, t.detections)


_CUTS = "(SELECT UNNEST([" + ", ".join(f"{x}::DOUBLE" for x in SWEEP_CONFS) + "]) AS cut)"


@query(
    "threshold_sweep",
    f"""WITH cuts AS {_CUTS},
  r AS (SELECT * FROM {{pred_rank}} WHERE t = 0),
  base AS (SELECT cut, cls_id, n_gt FROM cuts, {{gt_n}}),
  pr AS (SELECT cut, r.cls_id, COUNT(*) AS n_pred, COUNT(*) FILTER (is_tp) AS tp FROM r JOIN cuts ON r.conf >= cut GROUP BY 1, 2),
  pts AS (SELECT cut, r.cls_id, CAST(r.tp * 100 AS BIGINT) // n_gt AS q, MAX(r.tp / r.rk) AS p FROM r JOIN cuts ON r.conf >= cut JOIN {{gt_n}} n ON n.cls_id = r.cls_id WHERE is_tp GROUP BY 1, 2, 3),
  ap AS (SELECT cut, cls_id, AVG(p) AS ap FROM (SELECT b.cut, b.cls_id, g.q, COALESCE(MAX(p.p), 0) AS p FROM base b CROSS JOIN (SELECT UNNEST(range(0, 101)) AS q) g
    LEFT JOIN pts p ON p.cut = b.cut AND p.cls_id = b.cls_id AND p.q >= g.q GROUP BY 1, 2, 3) GROUP BY 1, 2),
  d AS (SELECT b.cut, b.cls_id, COALESCE(tp / n_pred, 0) AS p, COALESCE(tp, 0) / n_gt AS r, COALESCE(ap, 0) AS ap
    FROM base b LEFT JOIN pr ON pr.cut = b.cut AND pr.cls_id = b.cls_id LEFT JOIN ap ON ap.cut = b.cut AND ap.cls_id = b.cls_id),
  won AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, box_id ORDER BY conf DESC, det_id) AS k FROM {{best_any}} WHERE iou >= 0.5::DOUBLE) WHERE k = 1 AND gt_cls = 1 AND pred_cls = 0),
  m AS (SELECT cut, MAX(CASE WHEN cls_id = 0 THEN p END) AS op, MAX(CASE WHEN cls_id = 0 THEN r END) AS orc, AVG(p) AS mp, AVG(r) AS mr, AVG(ap) AS map50 FROM d GROUP BY 1)
SELECT cut AS conf, ROUND(orc, 6) AS open_recall, ROUND(op, 6) AS open_precision, ROUND(2 * op * orc / (op + orc + 1e-16), 6) AS open_f1, ROUND(mp, 6) AS precision, ROUND(mr, 6) AS recall,
  ROUND(2 * mp * mr / (mp + mr + 1e-16), 6) AS overall_f1, (SELECT COUNT(*) FROM won WHERE won.conf >= m.cut) AS close_to_open, ROUND(map50, 6) AS map50 FROM m""",
)
def _(t):
    return match.threshold_sweep(t.gt_boxes, t.detections)


_RESIDUAL = """WITH pr AS MATERIALIZED (SELECT image_id, box_id, det_id, iou FROM {pairs} WHERE gt_cls = pred_cls AND conf >= 0.4::DOUBLE),
  best AS (SELECT image_id, box_id, MAX(iou) AS iou FROM pr GROUP BY 1, 2),
  gt AS (SELECT g.image_id, g.box_id AS item_id, COALESCE(b.iou, 0) AS iou FROM {gt_boxes} g LEFT JOIN best b ON b.image_id = g.image_id AND b.box_id = g.box_id),
  hit AS (SELECT DISTINCT image_id, det_id FROM pr WHERE iou >= 0.5::DOUBLE),
  fp AS (SELECT d.image_id, d.det_id AS item_id FROM {detections} d LEFT JOIN hit h ON h.image_id = d.image_id AND h.det_id = d.det_id WHERE conf >= 0.4::DOUBLE AND h.det_id IS NULL),
  items AS MATERIALIZED (SELECT image_id, item_id, CASE WHEN iou < 0.5::DOUBLE THEN 'miss_recovery' ELSE 'box_refinement' END AS b FROM gt WHERE iou < 0.7::DOUBLE UNION ALL SELECT image_id, item_id, 'background_suppression' AS b FROM fp),
  mixed AS (SELECT image_id FROM {gt_boxes} GROUP BY 1 HAVING bool_or(cls_id = 0) AND bool_or(cls_id = 1)),
  res AS (SELECT i.image_id, i.item_id, CASE WHEN i.b <> 'box_refinement' AND m.image_id IS NOT NULL THEN 'mixed_state_review' ELSE i.b END AS bucket
    FROM items i LEFT JOIN mixed m ON m.image_id = i.image_id)
"""


@query("residual_buckets", _RESIDUAL + "SELECT bucket, COUNT(*) AS rows, COUNT(DISTINCT image_id) AS images FROM res GROUP BY 1")
def _(t):
    return match.residual_buckets(match.residual_items(t.gt_boxes, t.detections))


@query("residual_items", _RESIDUAL + "SELECT image_id, item_id, bucket FROM res")
def _(t):
    return match.residual_items(t.gt_boxes, t.detections)


@query(
    "attach_flags",
    "SELECT image_id, file_name, is_error, is_type_a FROM {flagged}",
)
def _(t):
    fn = match.fn_lists(match.fn_taxonomy(t.gt_boxes, t.detections), t.images)
    return joins.attach_flags(t.images, fn).select("image_id", "file_name", "is_error", "is_type_a")


@query(
    "top_detection",
    """SELECT image_id, state, det_id, conf FROM (SELECT d.image_id, s.state, d.det_id, d.conf, ROW_NUMBER() OVER (PARTITION BY d.image_id ORDER BY conf DESC, det_id) AS rn
  FROM {detections} d JOIN (SELECT image_id, CASE WHEN is_error THEN 'OPEN' ELSE 'CLOSE' END AS state FROM {images}) s ON d.image_id = s.image_id AND d.cls_id = CASE s.state WHEN 'OPEN' THEN 0 ELSE 1 END) WHERE rn = 1""",
)
def _(t):
    states = t.images.select("image_id", F.when(c("is_error"), "OPEN").otherwise("CLOSE").alias("state"))
    return mining.top_detection(t.detections, states)


# -- audits ------------------------------------------------------------------------------------------------------


def features(t, flags: bool = True):
    """Images with scene, box counts and flags: the input of split, balance and augmentation."""
    d = balance.image_features(split.with_scene(t.images), t.gt_boxes)
    if not flags:
        return d
    fn = match.fn_lists(match.fn_taxonomy(t.gt_boxes, t.detections), t.images)
    return joins.attach_flags(d, fn)


@query(
    "split_stats",
    """SELECT split, COALESCE(version, 'GLOBAL') AS version, CAST(SUM(images) AS BIGINT) AS images, CAST(SUM(o) AS BIGINT) AS open_boxes, CAST(SUM(cl) AS BIGINT) AS close_boxes,
  CAST(SUM(bg) AS BIGINT) AS bg_images, CAST(SUM(oi) AS BIGINT) AS open_images, COUNT(*) AS scenes
FROM (SELECT split, version, scene, COUNT(*) AS images, SUM(open_cnt) AS o, SUM(close_cnt) AS cl, COUNT(*) FILTER (open_cnt = 0 AND close_cnt = 0) AS bg, COUNT(*) FILTER (open_cnt > 0) AS oi FROM {split0} GROUP BY 1, 2, 3)
GROUP BY GROUPING SETS ((split, version), (split))""",
)
def _(t):
    return audit.split_stats(split.scene_split(features(t, False)))


@query(
    "audit_versions",
    """SELECT COALESCE(version, 'GLOBAL') AS version, COUNT(*) AS images, ROUND(COUNT(*) FILTER (n_boxes = 0) * 100.0 / COUNT(*), 1) AS bg_pct, CAST(SUM(open_cnt + close_cnt) AS BIGINT) AS boxes,
  CAST(SUM(open_cnt) AS BIGINT) AS open, CAST(SUM(close_cnt) AS BIGINT) AS close, CASE WHEN SUM(close_cnt) > 0 THEN ROUND(SUM(open_cnt) / SUM(close_cnt), 3) ELSE 0 END AS ratio
FROM {feats} GROUP BY ROLLUP (version)""",
)
def _(t):
    return audit.audit_versions(t.images, t.gt_boxes)


@query(
    "label_stats",
    f"""SELECT i.version, COUNT(DISTINCT i.image_id) AS images, COUNT(DISTINCT i.image_id) FILTER (l.line_no IS NULL) AS empty, COUNT(cls) AS boxes,
  COUNT(*) FILTER (cls = 0) AS open, COUNT(*) FILTER (cls <> 0) AS close, ROUND(SUM(w) / COUNT(cls), 6) AS avg_w, ROUND(SUM(h) / COUNT(cls), 6) AS avg_h
FROM {{images}} i LEFT JOIN (SELECT image_id, line_no, cls, CASE WHEN cls IS NOT NULL THEN TRY_CAST(p[4] AS DOUBLE) END AS w, CASE WHEN cls IS NOT NULL THEN TRY_CAST(p[5] AS DOUBLE) END AS h
  FROM (SELECT image_id, line_no, p, CASE WHEN len(p) >= 5 AND regexp_full_match(p[1], '[+-]?[0-9]+') THEN CAST(p[1] AS INT) END AS cls FROM (SELECT *, {fields('line')} AS p FROM {{label_lines}}))) l ON i.image_id = l.image_id
GROUP BY 1""",
)
def _(t):
    return audit.label_stats(t.images, t.label_lines)


@query(
    "scene_audit",
    "SELECT version, scene, COUNT(*) AS images, CAST(SUM(open_cnt) AS BIGINT) AS open, CAST(SUM(close_cnt) AS BIGINT) AS close FROM {feats} GROUP BY 1, 2 ORDER BY images DESC, version, scene",
)
def _(t):
    return audit.scene_audit(features(t, False))


@query(
    "val_coverage",
    "SELECT version, COUNT(*) FILTER (split = 'val') AS val_images, COUNT(*) FILTER (split = 'val' AND open_cnt > 0) AS val_open_images FROM {split0} GROUP BY 1",
)
def _(t):
    return audit.val_coverage(split.scene_split(features(t, False)))


@query(
    "ghost_eval",
    """SELECT COUNT(*) AS total_images, COUNT(*) FILTER (hit) AS any_hit, ROUND(COUNT(*) FILTER (hit) / COUNT(*), 4) AS fp_rate
FROM (SELECT EXISTS (SELECT 1 FROM {detections} d WHERE d.image_id = i.image_id AND conf >= 0.25::DOUBLE) AS hit FROM {images} i WHERE image_id NOT IN (SELECT image_id FROM {gt_boxes}))""",
)
def _(t):
    return audit.ghost_eval(t.images, t.gt_boxes, t.detections)


@query(
    "mining_summary",
    """WITH m AS (SELECT CASE WHEN c BETWEEN 0.61 AND 1.0 THEN 'high_conf_fp' WHEN c BETWEEN 0.05 AND 0.6 THEN 'low_conf_uncertain' END AS bucket FROM (SELECT MAX(conf) AS c FROM {detections} GROUP BY image_id))
SELECT bucket, COUNT(*) AS n, ROUND((1 - (SELECT COUNT(bucket) FROM m) / (SELECT COUNT(*) FROM {images})) * 100, 2) AS compression_pct FROM m WHERE bucket IS NOT NULL GROUP BY 1""",
)
def _(t):
    return audit.mining_summary(mining.mine_buckets(t.detections), t.images)


# -- split and balance -------------------------------------------------------------------------------------------


@query("scene_split", "SELECT image_id, version, scene, split FROM {split0}")
def _(t):
    return split.scene_split(split.with_scene(t.images)).select("image_id", "version", "scene", "split")


@query("open_safeguard", "SELECT image_id, version, scene, split, moved FROM {split1}")
def _(t):
    cfg = SplitConfig(ratio=0.9)
    d = split.open_safeguard(split.scene_split(features(t, False), cfg), cfg)
    return d.select("image_id", "version", "scene", "split", "moved")


@query(
    "domain_cap",
    f"""SELECT image_id, version, split FROM (SELECT image_id, version, split, ROW_NUMBER() OVER (PARTITION BY version, split ORDER BY {digest(109, 'version', 'image_id')}, image_id) AS rk FROM {{split0}})
WHERE split = 'val' OR rk <= floor((SELECT COUNT(*) FROM {{images}}) * 0.8::DOUBLE * 0.19::DOUBLE)""",
)
def _(t):
    cfg = SplitConfig(domain_share=0.19)
    return split.domain_cap(split.scene_split(split.with_scene(t.images), cfg), cfg).select("image_id", "version", "split")


@query("oversample_open", "SELECT image_id, open_cnt, replica_id FROM {balanced} WHERE role = 'open'")
def _(t):
    return balance.oversample_open(features(t)).select("image_id", "open_cnt", "replica_id")


@query("score_close", "SELECT image_id, score, ROUND(priority, 6) AS priority FROM {prio}")
def _(t):
    d = balance.score_close(features(t, False))
    return d.select("image_id", "score", F.round("priority", 6).alias("priority"))


@query("fill_close", "SELECT image_id, scene, close_cnt, CAST(close_before AS BIGINT) AS close_before FROM {close_fill}")
def _(t):
    return balance.fill_close(features(t)).select("image_id", "scene", "close_cnt", "close_before")


@query("cap_background", "SELECT image_id, bg_rank FROM {bg_ranked} WHERE bg_rank <= floor((SELECT COUNT(*) FROM {feats} WHERE open_cnt > 0 OR close_cnt > 0) * 0.2::DOUBLE)")
def _(t):
    d = features(t, False)
    kept = d.filter((c("open_cnt") > 0) | (c("close_cnt") > 0)).agg(F.count(F.lit(1))).scalar()
    return balance.cap_background(d, F.floor(kept * F.lit(0.2))).select("image_id", "bg_rank")


@query("balance", "SELECT image_id, version, scene, open_cnt, close_cnt, is_error, is_type_a, replica_id, role FROM {balanced}")
def _(t):
    return balance.balance(features(t))


@query(
    "gate_balance",
    """SELECT o AS open_boxes, cl AS close_boxes, n AS close_only_sampled, r AS final_ratio, 2.0::DOUBLE AS target_ratio, (SELECT CAST(SUM(close_cnt) AS BIGINT) FROM {feats}) AS source_close_boxes,
  ROUND(abs(r - 2.0::DOUBLE) / 2.0::DOUBLE, 6) AS drift, abs(r - 2.0::DOUBLE) / 2.0::DOUBLE <= 0.2::DOUBLE AS passed, (n = 0 AND cl > 0) AS low_variety
FROM (SELECT CAST(SUM(open_cnt) AS BIGINT) AS o, CAST(SUM(close_cnt) AS BIGINT) AS cl, COUNT(*) FILTER (role = 'close') AS n, ROUND(SUM(close_cnt) / SUM(open_cnt), 6) AS r FROM {balanced})""",
)
def _(t):
    d = features(t)
    return governance.gate_balance(balance.balance_manifest(balance.balance(d), features(t, False)))


_AUGMENT = """SELECT image_id, profile, m AS multiplier, k AS copy_no, CASE WHEN k = 0 THEN file_name ELSE stem || '_' || profile || '_aug_' || CAST(k - 1 AS VARCHAR) || '.jpg' END AS out_name
FROM (SELECT f.image_id, f.file_name, s.stem, CAST(CASE WHEN open_cnt > 0 THEN 5 ELSE 1 END AS INT) AS m, CAST(UNNEST(range(0, CASE WHEN open_cnt > 0 THEN 5 ELSE 1 END)) AS INT) AS k,
  CASE WHEN open_cnt > 0 AND is_type_a THEN 'augment_fn_open' WHEN open_cnt > 0 AND close_cnt > 0 THEN 'mixed_boundary' WHEN open_cnt > 0 AND min_open_area < 0.05::DOUBLE THEN 'small_object_open'
    WHEN open_cnt > 0 THEN 'open_normal' WHEN close_cnt > 0 THEN 'close_fp_like' ELSE 'hard_negative' END AS profile
  FROM {flagged} f JOIN {stems} s ON f.image_id = s.image_id)"""


@query("augment_plan", _AUGMENT)
def _(t):
    return augment.augment_plan(features(t))


@query("augment_boxes", augmented(_AUGMENT))
def _(t):
    d = augment.augment_boxes(augment.augment_plan(features(t)), t.gt_boxes)
    return d.withColumns({x: F.round(x, 9) for x in ("cx", "cy", "w", "h", "visible")})


# -- mining ------------------------------------------------------------------------------------------------------


@query(
    "mine_buckets",
    """SELECT image_id, max_conf, bucket FROM (SELECT *, CASE WHEN max_conf BETWEEN 0.61::DOUBLE AND 1.0 THEN 'high_conf_fp' WHEN max_conf BETWEEN 0.05::DOUBLE AND 0.6::DOUBLE THEN 'low_conf_uncertain' END AS bucket
  FROM (SELECT image_id, MAX(conf) AS max_conf FROM {detections} GROUP BY 1)) WHERE bucket IS NOT NULL""",
)
def _(t):
    return mining.mine_buckets(t.detections, MINING_BUCKETS)


@query(
    "mine_hard_negatives",
    """SELECT image_id, max_conf, bucket FROM (
  SELECT image_id, conf AS max_conf, CASE WHEN cls_id = 1 AND conf >= 0.35::DOUBLE THEN 'fp_close_high' WHEN cls_id = 0 AND conf >= 0.25::DOUBLE THEN 'fp_open_high' WHEN conf >= 0.15::DOUBLE AND conf < 0.35::DOUBLE THEN 'uncertain_review' END AS bucket
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS k FROM {detections} WHERE conf >= 0.15::DOUBLE) WHERE k = 1) WHERE bucket IS NOT NULL""",
)
def _(t):
    return mining.mine_hard_negatives(t.detections)


@query(
    "mine_open",
    """SELECT image_id, max_conf, tier, 'm072_' || tier || '_' || file_name AS new_name FROM (SELECT i.image_id, i.file_name, max_conf, CASE WHEN max_conf >= 0.6::DOUBLE THEN 'high' WHEN max_conf > 0.3::DOUBLE THEN 'mid' ELSE 'low' END AS tier
  FROM {raw_images} i JOIN (SELECT image_id, MAX(conf) AS max_conf FROM {detections} WHERE cls_id = 0 AND conf >= 0.1::DOUBLE GROUP BY 1) d ON i.image_id = d.image_id
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT file_name FROM {gold_images}) g WHERE contains(g.file_name, i.file_name)))""",
)
def _(t):
    return mining.mine_open(t.detections, t.raw_images, t.gold_images)


@query(
    "boost_open",
    """SELECT i.image_id, n_open, 'boost_open_' || file_name AS new_name
FROM {raw_images} i JOIN (SELECT image_id, COUNT(*) AS n_open FROM {detections} WHERE cls_id = 0 AND conf >= 0.45::DOUBLE AND w * h >= 0.005::DOUBLE GROUP BY 1) d ON i.image_id = d.image_id
WHERE file_name NOT IN (SELECT file_name FROM {gold_images})""",
)
def _(t):
    return mining.boost_open(t.detections, t.raw_images, t.gold_images)


@query(
    "route_by_embedding",
    """WITH pr AS (SELECT label, i, AVG(v) AS v FROM (SELECT label, UNNEST(range(1, len(embedding) + 1)) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM {embeddings} WHERE label IN (0, 1, 2)) GROUP BY 1, 2),
  x AS (SELECT vec_id, UNNEST(range(1, len(embedding) + 1)) AS i, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM {embeddings}),
  s AS (SELECT vec_id, label, SUM(x.v * pr.v) / (sqrt(SUM(x.v * x.v)) * sqrt(SUM(pr.v * pr.v))) * 10 AS s FROM x JOIN pr USING (i) GROUP BY 1, 2),
  e AS (SELECT vec_id, label, exp(s) / SUM(exp(s)) OVER (PARTITION BY vec_id) AS p FROM s),
  w AS (SELECT vec_id, MAX(CASE WHEN label = 0 THEN p END) AS p0, MAX(CASE WHEN label = 1 THEN p END) AS p1 FROM e GROUP BY 1)
SELECT vec_id, ROUND(p0, 5) AS p0, ROUND(p1, 5) AS p1, CASE WHEN p0 > 0.3::DOUBLE THEN 'positive' WHEN p1 > 0.4::DOUBLE THEN 'negative' ELSE 'dropped' END AS route FROM w""",
)
def _(t):
    protos = mining.prototypes(t.embeddings, (0, 1, 2))
    d = mining.route_by_embedding(t.embeddings, protos, scale=10.0)
    return d.select("vec_id", F.round(c("probs")[0], 5).alias("p0"), F.round(c("probs")[1], 5).alias("p1"), "route")


@query(
    "dedup_by_priority",
    "SELECT kind, file_name, version, priority, file_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind, file_name ORDER BY priority, file_id) AS rn FROM {version_files}) WHERE rn = 1",
)
def _(t):
    return mining.dedup_by_priority(t.version_files)


@query(
    "check_disjoint",
    "SELECT kind, file_name, MIN(version) AS first_version, MAX(version) AS last_version FROM {version_files} GROUP BY 1, 2 HAVING COUNT(DISTINCT version) > 1",
)
def _(t):
    return mining.check_disjoint(t.version_files)


@query("promote", "SELECT file_id, file_name, 'v9' AS version FROM {version_files}")
def _(t):
    return mining.promote(t.version_files, "v9").select("file_id", "file_name", "version")
