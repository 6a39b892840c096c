"""Views that only the SQL checks use: plain restatements of shared intermediate results."""

from __future__ import annotations

from doorlens.plans import fixtures
from doorlens.plans.registry import digest, u01

_STEM = r"regexp_replace(regexp_extract(file_name, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"


def _split(ratio: float) -> str:
    return f"""
SELECT f.*, CASE WHEN d.n_scenes <= 1 AND d.v_images > 1 THEN CASE WHEN r.rk <= floor(d.v_images * {ratio}::DOUBLE) THEN 'train' ELSE 'val' END
  WHEN d.rk <= greatest(1, floor(d.n_scenes * {ratio}::DOUBLE)) THEN 'train' ELSE 'val' END AS split
FROM {{feats}} f JOIN {{scene_draws}} d ON f.version = d.version AND f.scene = d.scene JOIN {{image_draws}} r ON f.image_id = r.image_id"""


CHECK_VIEWS = {
    "stems": f"SELECT *, {_STEM} AS stem FROM {{images}}",
    "scened": r"""
SELECT * EXCLUDE (stem, seg), CASE
  WHEN seg IS NOT NULL THEN regexp_extract(stem, '^(.*?_Video Project)_([0-9]+)$', 1) || '_seg' || CASE WHEN length(seg) < 3 THEN lpad(seg, 3, '0') ELSE seg END
  WHEN regexp_matches(stem, '^.*?-[a-zA-Z0-9]+$') THEN regexp_extract(stem, '^(.*?)-[a-zA-Z0-9]+$', 1)
  WHEN regexp_matches(stem, '^.*?_[0-9]+$') THEN regexp_extract(stem, '^(.*?)_[0-9]+$', 1)
  ELSE stem END AS scene
FROM (SELECT *, CASE WHEN regexp_matches(stem, '^(.*?_Video Project)_([0-9]+)$')
        THEN CAST(CAST(regexp_extract(stem, '^(.*?_Video Project)_([0-9]+)$', 2) AS BIGINT) // 30 AS VARCHAR) END AS seg FROM {stems})""",
    "box_counts": """
SELECT image_id, COUNT(*) AS n_boxes, COUNT(*) FILTER (cls_id = 0) AS open_cnt, COUNT(*) FILTER (cls_id = 1) AS close_cnt,
  bool_or(cls_id = 1 AND (cx < 0.1::DOUBLE OR cx > 0.9::DOUBLE OR cy < 0.1::DOUBLE OR cy > 0.9::DOUBLE)) AS close_near_edge,
  MIN(CASE WHEN cls_id = 0 THEN w * h END) AS min_open_area
FROM {gt_boxes} GROUP BY image_id""",
    "feats": """
SELECT s.*, COALESCE(n_boxes, 0) AS n_boxes, COALESCE(open_cnt, 0) AS open_cnt, COALESCE(close_cnt, 0) AS close_cnt,
  COALESCE(close_near_edge, FALSE) AS close_near_edge, min_open_area
FROM {scened} s LEFT JOIN {box_counts} b ON s.image_id = b.image_id""",
    "v_seeds": "SELECT version, 9 + ROW_NUMBER() OVER (ORDER BY version) AS v_seed, n AS v_images FROM (SELECT version, COUNT(*) AS n FROM {images} GROUP BY version)",
    "scene_draws": f"""
SELECT s.version, s.scene, v_seed, v_images, COUNT(*) OVER (PARTITION BY s.version) AS n_scenes,
  ROW_NUMBER() OVER (PARTITION BY s.version ORDER BY {digest('$v_seed', 's.version', 's.scene')}, s.scene) AS rk
FROM (SELECT DISTINCT version, scene FROM {{scened}}) s JOIN {{v_seeds}} v ON s.version = v.version""",
    "image_draws": f"""
SELECT i.image_id, ROW_NUMBER() OVER (PARTITION BY i.version ORDER BY {digest('$v_seed', 'i.version', 'i.image_id')}, i.image_id) AS rk
FROM {{images}} i JOIN {{v_seeds}} v ON i.version = v.version""",
    "split0": _split(0.8),
    "split9": _split(0.9),
    "safe_moves": """
SELECT version, scene FROM (
  SELECT t.*, SUM(opens) OVER (PARTITION BY t.version ORDER BY n, md5(scene), scene ROWS UNBOUNDED PRECEDING) AS run, all_open, val_open
  FROM (SELECT version, scene, COUNT(*) AS n, COUNT(*) FILTER (open_cnt > 0) AS opens FROM {split9} WHERE split = 'train' GROUP BY 1, 2) t
  JOIN (SELECT version, COUNT(*) FILTER (open_cnt > 0) AS all_open, COUNT(*) FILTER (open_cnt > 0 AND split = 'val') AS val_open FROM {split9} GROUP BY 1) a ON t.version = a.version
  WHERE opens > 0 AND all_open >= 3)
WHERE val_open + run - opens < greatest(3, round_even(all_open * 0.15::DOUBLE, 0))
  AND all_open - val_open - run >= greatest(3, round_even(all_open * 0.60::DOUBLE, 0))""",
    "split1": """
SELECT s.* EXCLUDE (split), m.scene IS NOT NULL AS moved, CASE WHEN m.scene IS NOT NULL THEN 'val' ELSE s.split END AS split
FROM {split9} s LEFT JOIN {safe_moves} m ON s.version = m.version AND s.scene = m.scene""",
    "taxo": """
SELECT * , CASE WHEN oi >= 0.45::DOUBLE AND oc >= 0.25::DOUBLE THEN 'TP' WHEN oi >= 0.45::DOUBLE THEN 'Type_D' WHEN ai >= 0.45::DOUBLE THEN 'Type_C' WHEN ai > 0.1::DOUBLE THEN 'Type_B' ELSE 'Type_A' END AS status
FROM (SELECT g.image_id, g.box_id, COALESCE(oi, 0) AS oi, COALESCE(oc, 0) AS oc, COALESCE(ai, 0) AS ai, COALESCE(ac, -1) AS ac
  FROM {gt_boxes} g LEFT JOIN (
    SELECT image_id, box_id, MAX(iou) FILTER (pred_cls = 0) AS oi, arg_min(conf, (-iou, det_id)) FILTER (pred_cls = 0) AS oc,
      MAX(iou) AS ai, arg_min(pred_cls, (-iou, det_id)) AS ac
    FROM {pairs} WHERE gt_cls = 0 GROUP BY 1, 2) p ON p.image_id = g.image_id AND p.box_id = g.box_id
  WHERE g.cls_id = 0)""",
    "flagged": """
SELECT f.*, EXISTS (SELECT 1 FROM {taxo} t JOIN {images} i ON t.image_id = i.image_id WHERE t.status = 'Type_A' AND i.file_name = f.file_name) AS is_type_a
FROM {feats} f""",
    "copies": f"""
SELECT *, CASE WHEN is_type_a THEN 4 WHEN is_error THEN 3 WHEN {u01(digest(10, "'copy'", 'image_id'))} < 0.5 THEN 2 ELSE 1 END AS k
FROM {{flagged}} WHERE open_cnt > 0""",
    "scored": f"""
SELECT *, greatest(0.1::DOUBLE, 10.0::DOUBLE + CASE WHEN is_error THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN close_near_edge THEN -0.6::DOUBLE ELSE 0 END) AS score
FROM {{flagged}} WHERE open_cnt = 0 AND close_cnt > 0""",
    "prio": f"SELECT *, score * {u01(digest(10, chr(39) + 'close' + chr(39), 'image_id'))} AS priority FROM {{scored}}",
    "close_fill": """
SELECT * FROM (
  SELECT *, COALESCE(SUM(close_cnt) OVER (ORDER BY priority DESC, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS close_before
  FROM (SELECT p.*, ROW_NUMBER() OVER (PARTITION BY p.scene ORDER BY priority DESC, image_id) AS rn, COALESCE(u.used, 0) AS used
        FROM {prio} p LEFT JOIN (SELECT scene, SUM(k) AS used FROM {copies} GROUP BY scene) u ON p.scene = u.scene)
  WHERE rn <= 2 - used)
WHERE close_before < (SELECT SUM(k * open_cnt) * 2.0 - SUM(k * close_cnt) FROM {copies})""",
    "bg_ranked": f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY {digest(10, "'bg'", 'image_id')}, image_id) AS bg_rank FROM {{flagged}} WHERE open_cnt = 0 AND close_cnt = 0""",
    "balanced": """
SELECT image_id, version, scene, open_cnt, close_cnt, is_error, is_type_a, CAST(UNNEST(range(1, k + 1)) AS INT) AS replica_id, 'open' AS role FROM {copies}
UNION ALL SELECT image_id, version, scene, open_cnt, close_cnt, is_error, is_type_a, 1, 'close' FROM {close_fill}
UNION ALL SELECT image_id, version, scene, open_cnt, close_cnt, is_error, is_type_a, 1, 'background' FROM {bg_ranked}
  WHERE bg_rank <= floor(((SELECT SUM(k) FROM {copies}) + (SELECT COUNT(*) FROM {close_fill})) * 0.2::DOUBLE)""",
    "gt_xy": "SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM {gt_boxes}",
    "det_xy": "SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM {detections}",
    "pairs": """
SELECT image_id, box_id, det_id, gt_cls, pred_cls, conf, inter / (a + b - inter) AS iou FROM (
  SELECT g.image_id, g.box_id, p.det_id, g.cls_id AS gt_cls, p.cls_id AS pred_cls, p.conf,
    greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1)) AS inter,
    (g.x2 - g.x1) * (g.y2 - g.y1) AS a, (p.x2 - p.x1) * (p.y2 - p.y1) AS b
  FROM {gt_xy} g JOIN {det_xy} p ON g.image_id = p.image_id)
WHERE inter > 0""",
    "best_box": """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, box_id) AS rn FROM {pairs} WHERE gt_cls = pred_cls) WHERE rn = 1""",
    "best_any": """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, box_id) AS rn FROM {pairs}) WHERE rn = 1""",
    "ious": "SELECT i AS t, (0.5::DOUBLE * 20 + i) / 20 AS iou_t FROM (SELECT UNNEST(range(0, 10)) AS i)",
    "winners": """
SELECT image_id, det_id, t FROM (
  SELECT b.image_id, b.det_id, t, ROW_NUMBER() OVER (PARTITION BY b.image_id, b.box_id, t ORDER BY conf DESC, det_id) AS rn
  FROM {best_box} b JOIN {ious} i ON b.iou >= i.iou_t) WHERE rn = 1""",
    "pred_rank": f"""
SELECT p.image_id, p.det_id, p.cls_id, p.conf, t, (w.det_id IS NOT NULL) AS is_tp,
  ROW_NUMBER() OVER (PARTITION BY p.cls_id, t ORDER BY p.conf DESC, {digest('ap', 'p.image_id', 'p.det_id')}, p.image_id, p.det_id) AS rk,
  SUM(CASE WHEN w.det_id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.cls_id, t ORDER BY p.conf DESC, {digest('ap', 'p.image_id', 'p.det_id')}, p.image_id, p.det_id ROWS UNBOUNDED PRECEDING) AS tp
FROM {{detections}} p CROSS JOIN (SELECT t FROM {{ious}}) LEFT JOIN {{winners}} w USING (image_id, det_id, t)""",
    "gt_n": "SELECT cls_id, COUNT(*) AS n_gt FROM {gt_boxes} GROUP BY cls_id",
}

fixtures.CHECK_VIEWS.update(CHECK_VIEWS)
