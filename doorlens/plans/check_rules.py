"""Restatements of the keyed state rules for the SQL checks: recursive queries that step through all cameras at once."""

from __future__ import annotations

from doorlens.operators.augment import PROFILES
from doorlens.plans import fixtures
from doorlens.plans.catalog_rows import BAND
from doorlens.plans.registry import digest, u01


def _iou(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = " + ".join(f"greatest(0, {t}.x2 - {t}.x1) * greatest(0, {t}.y2 - {t}.y1)" for t in (a, b))
    return f"CASE WHEN {w} > 0 AND {h} > 0 THEN ({w} * {h})::DOUBLE / ({size} - {w} * {h}) ELSE 0 END"


_BOX = "x1 := {0}.x1, y1 := {0}.y1, x2 := {0}.x2, y2 := {0}.y2"
_BOX_TYPE = "x1 INT, y1 INT, x2 INT, y2 INT"


def _track(box: str, conf: str, age: str, hits: str, missed: str, used: str, number: str = "t.id") -> str:
    return f"struct_pack(id := {number}, {_BOX.format(box)}, conf := {conf}, age := {age}, hits := {hits}, missed := {missed}, used := {used})"


# One detection per step. ``used`` marks the tracks that this frame has matched or begun.
_TRACKED = f"""WITH RECURSIVE d AS (SELECT camera_id, frame_seq, struct_pack({_BOX.format('f')}, conf := f.conf) AS b, ROW_NUMBER() OVER o AS k,
    frame_seq IS DISTINCT FROM LAG(frame_seq) OVER o AS head, frame_seq IS DISTINCT FROM LEAD(frame_seq) OVER o AS tail, COALESCE(greatest(0, frame_seq - LAG(frame_seq) OVER o - 1), 0) AS idle
    FROM {{frame_dets}} f WINDOW o AS (PARTITION BY camera_id ORDER BY frame_seq, det_no)),
  r AS (SELECT DISTINCT camera_id, 0::BIGINT AS k, 0::BIGINT AS frame_seq, FALSE AS tail, 1::BIGINT AS next_id,
      []::STRUCT(id BIGINT, {_BOX_TYPE}, conf DOUBLE, age BIGINT, hits BIGINT, missed BIGINT, used BOOLEAN)[] AS ts FROM d
    UNION ALL SELECT camera_id, k, frame_seq, tail, next_id + CASE WHEN hit IS NULL THEN 1 ELSE 0 END,
      CASE WHEN tail THEN list_filter(list_transform(u, lambda t: CASE WHEN t.used THEN t ELSE {_track('t', 't.conf', 't.age + 1', 't.hits', 't.missed + 1', 't.used')} END), lambda t: t.missed <= 12) ELSE u END
    FROM (SELECT *, CASE WHEN hit IS NULL THEN list_append(a, {_track('b', 'b.conf', '1', '1', '0', 'TRUE', 'next_id')})
        ELSE list_transform(a, lambda t: CASE WHEN t.id = hit THEN {_track('b', 'b.conf', 't.age + 1', 't.hits + 1', '0', 'TRUE')} ELSE t END) END AS u
      FROM (SELECT *, list_sort(list_filter(list_transform(a, lambda t: struct_pack(n := CASE WHEN t.used THEN 0 ELSE -({_iou('t', 'b')}) END, id := t.id)), lambda x: x.n <= -0.3::DOUBLE))[1].id AS hit
        FROM (SELECT d.*, r.next_id, CASE WHEN d.head THEN list_filter(list_transform(r.ts, lambda t: {_track('t', 't.conf', 't.age + d.idle', 't.hits', 't.missed + d.idle', 'FALSE')}), lambda t: t.missed <= 12) ELSE r.ts END AS a
          FROM r JOIN d ON d.camera_id = r.camera_id AND d.k = r.k + 1))))
SELECT camera_id, frame_seq, t.id AS track_id, t.x1 AS x1, t.y1 AS y1, t.x2 AS x2, t.y2 AS y2, t.conf AS det_conf, t.age AS age, t.hits AS hits, t.missed AS missed
FROM (SELECT camera_id, frame_seq, UNNEST(ts) AS t FROM r WHERE tail)"""

_BUDGET = """WITH RECURSIVE f AS (SELECT camera_id, frame_seq, ROW_NUMBER() OVER (PARTITION BY camera_id ORDER BY frame_seq) AS k, ids
    FROM (SELECT camera_id, frame_seq, list(track_id ORDER BY missed, det_conf DESC, track_id) AS ids FROM {tracked} GROUP BY 1, 2)),
  r AS (SELECT DISTINCT camera_id, 0::BIGINT AS frame_seq, 0::BIGINT AS k, []::BIGINT[] AS due, []::STRUCT(id BIGINT, ran_at BIGINT)[] AS ran FROM f
    UNION ALL SELECT camera_id, frame_seq, k, due, list_concat(live, list_transform(due, lambda i: struct_pack(id := i, ran_at := frame_seq)))
    FROM (SELECT *, list_slice(list_filter(ids, lambda i: NOT list_contains(list_transform(live, lambda x: x.id), i)), 1, 3) AS due
      FROM (SELECT f.*, list_filter(r.ran, lambda x: f.frame_seq - x.ran_at < 3) AS live FROM r JOIN f ON f.camera_id = r.camera_id AND f.k = r.k + 1)))
SELECT camera_id, frame_seq, UNNEST(due) AS track_id, CAST(UNNEST(range(1, len(due) + 1)) AS INT) AS rank FROM r WHERE len(due) > 0"""

_CASCADE = """SELECT * EXCLUDE (answer, sure), COALESCE(LAST_VALUE(answer IGNORE NULLS) OVER w, 'unknown') AS label, COALESCE(LAST_VALUE(sure IGNORE NULLS) OVER w, 0) AS cls_conf
FROM (SELECT t.*, CASE WHEN b.rank IS NULL THEN NULL WHEN t.frame_seq % 70 < 24 THEN 'close' ELSE 'open' END AS answer, CASE WHEN b.rank IS NOT NULL THEN CAST(60 + (t.x1 * 17) % 40 AS DOUBLE) / 100 END AS sure
  FROM {tracked} t LEFT JOIN {budgeted} b ON b.camera_id = t.camera_id AND b.track_id = t.track_id AND b.frame_seq = t.frame_seq)
WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_seq ROWS UNBOUNDED PRECEDING)"""


def _tail(letter: str) -> str:
    return f"(length(h) - length(rtrim(h, '{letter}')))"


def _count(letter: str) -> str:
    return f"(length(h) - length(replace(h, '{letter}', '')))"


def doors(source: str) -> str:
    """Door states of ``source`` (camera_id, track_id, frame_seq, timestamp_ms, label, raw_conf, det_conf, missed, box, frame size).

    ``h`` holds the last five observations as letters: o open, c close, x nothing accepted.
    """
    rule = f"""CASE WHEN ts < cool THEN 'cooldown_blocked'
      WHEN st = 'UNKNOWN' AND {_count('c')} >= 3 THEN 'unknown_to_closed'
      WHEN st = 'CLOSED' AND {_count('o')} >= 3 THEN 'closed_to_opening_candidate' WHEN st = 'CLOSED' AND {_count('c')} >= 3 THEN 'still c'
      WHEN st = 'OPENING_CANDIDATE' AND {_tail('o')} >= 3 THEN 'opening_candidate_to_open' WHEN st = 'OPENING_CANDIDATE' AND {_count('o')} < 3 THEN 'opening_candidate_reverted_to_closed'
      WHEN st = 'OPEN' AND {_tail('c')} >= 3 THEN 'open_to_closing_candidate' WHEN st = 'OPEN' AND {_count('o')} >= 3 THEN 'still o'
      WHEN st = 'CLOSING_CANDIDATE' AND {_tail('c')} >= 3 THEN 'closing_candidate_to_closed' WHEN st = 'CLOSING_CANDIDATE' AND {_count('o')} >= 3 THEN 'closing_candidate_reverted_to_open' END"""
    return f"""WITH RECURSIVE c AS (SELECT *, lower(trim(label)) AS l, greatest(raw_conf, det_conf) AS conf, greatest(0, x2 - x1) AS bw, greatest(0, y2 - y1) AS bh FROM ({source})),
  o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY camera_id, track_id ORDER BY frame_seq) AS k, CASE WHEN missed > 0 THEN 'coasting' WHEN l NOT IN ('open', 'close') THEN 'unsupported_class'
      WHEN l = 'open' AND conf < 0.80::DOUBLE THEN 'below_open_threshold' WHEN l = 'close' AND conf < 0.55::DOUBLE THEN 'below_close_threshold' WHEN bw <= 0 OR bh <= 0 THEN 'invalid_bbox'
      WHEN (bw * bh)::DOUBLE / (frame_w * frame_h) < 0.010::DOUBLE THEN 'small_box' WHEN NOT (bw::DOUBLE / bh BETWEEN 0.20::DOUBLE AND 2.50::DOUBLE) THEN 'invalid_aspect_ratio' ELSE 'accepted' END AS base FROM c),
  r AS (SELECT DISTINCT camera_id, track_id, 0::BIGINT AS k, 0::BIGINT AS frame_seq, CAST(NULL AS BIGINT) AS ts, 'UNKNOWN' AS st, '' AS h, []::DOUBLE[] AS confs, CAST(NULL AS STRUCT({_BOX_TYPE})) AS box, 0::BIGINT AS stable,
      0::BIGINT AS cool, CAST(NULL AS BIGINT) AS ok_ts, FALSE AS cooling, '' AS reason, '' AS why, CAST(NULL AS STRUCT({_BOX_TYPE})) AS own, '' AS l, '' AS label, 0::DOUBLE AS raw_conf, 0::DOUBLE AS det_conf FROM o
    UNION ALL SELECT camera_id, track_id, k, frame_seq, ts,
      CASE hit WHEN 'unknown_to_closed' THEN 'CLOSED' WHEN 'closed_to_opening_candidate' THEN 'OPENING_CANDIDATE' WHEN 'opening_candidate_to_open' THEN 'OPEN' WHEN 'opening_candidate_reverted_to_closed' THEN 'CLOSED'
        WHEN 'open_to_closing_candidate' THEN 'CLOSING_CANDIDATE' WHEN 'closing_candidate_to_closed' THEN 'CLOSED' WHEN 'closing_candidate_reverted_to_open' THEN 'OPEN' ELSE st END, h, confs,
      CASE WHEN reason = 'accepted' THEN own ELSE box END,
      CASE WHEN hit IS NULL OR hit = 'cooldown_blocked' THEN stable WHEN hit = 'opening_candidate_reverted_to_closed' THEN greatest(1, {_tail('c')})
        WHEN hit IN ('closed_to_opening_candidate', 'opening_candidate_to_open', 'still o', 'closing_candidate_reverted_to_open') THEN {_tail('o')} ELSE {_tail('c')} END,
      CASE WHEN hit IN ('unknown_to_closed', 'opening_candidate_to_open', 'closing_candidate_to_closed') THEN ts + 2000 ELSE cool END, ok_ts, ts < cool, reason,
      CASE WHEN hit IS NULL OR hit LIKE 'still _' THEN why ELSE hit END, own, l, label, raw_conf, det_conf
    FROM (SELECT *, {rule} AS hit
      FROM (SELECT * REPLACE (CASE WHEN late THEN 'UNKNOWN' ELSE st END AS st, CASE WHEN late THEN 0 ELSE stable END AS stable), CASE WHEN late AND st <> 'UNKNOWN' THEN 'state_timeout_unknown' ELSE 'state=' || st END AS why
        FROM (SELECT *, right(h0 || CASE WHEN reason = 'accepted' THEN left(l, 1) ELSE 'x' END, 5) AS h, list_slice(list_append(confs0, CASE WHEN reason = 'accepted' THEN conf END), -5, -1) AS confs,
            CASE WHEN reason = 'accepted' THEN ts ELSE ok0 END AS ok_ts, reason <> 'accepted' AND ok0 IS NOT NULL AND ts - ok0 >= 3000 AS late
          FROM (SELECT *, CASE WHEN base = 'accepted' AND box IS NOT NULL AND {_iou('box', 'own')} < 0.5::DOUBLE
                AND sqrt(pow((own.x1 + own.x2 - box.x1 - box.x2) / 2.0::DOUBLE / frame_w, 2) + pow((own.y1 + own.y2 - box.y1 - box.y2) / 2.0::DOUBLE / frame_h, 2)) > 0.15::DOUBLE THEN 'temporal_not_stable' ELSE base END AS reason
            FROM (SELECT o.camera_id, o.track_id, o.k, o.frame_seq, o.timestamp_ms AS ts, o.l, o.label, o.conf, o.raw_conf, o.det_conf, o.base, o.frame_w, o.frame_h, struct_pack({_BOX.format('o')}) AS own,
                CASE WHEN fresh THEN 'UNKNOWN' ELSE p.st END AS st, CASE WHEN fresh THEN '' ELSE p.h END AS h0, CASE WHEN fresh THEN [] ELSE p.confs END AS confs0, CASE WHEN fresh THEN NULL ELSE p.box END AS box,
                CASE WHEN fresh THEN 0 ELSE p.stable END AS stable, CASE WHEN fresh THEN 0 ELSE p.cool END AS cool, CASE WHEN fresh THEN NULL ELSE p.ok_ts END AS ok0
              FROM (SELECT r.*, n.k AS nk, n.timestamp_ms - r.ts >= 3000 AS fresh FROM r JOIN o n ON n.camera_id = r.camera_id AND n.track_id = r.track_id AND n.k = r.k + 1) p
                JOIN o ON o.camera_id = p.camera_id AND o.track_id = p.track_id AND o.k = p.nk))))))
SELECT camera_id, track_id, frame_seq, st AS state, ROUND(COALESCE(list_sum(list_filter(confs, lambda x: x IS NOT NULL)) / len(list_filter(confs, lambda x: x IS NOT NULL)), 0), 4) AS confidence, CAST(stable AS INT) AS stable_frames,
  COALESCE(box, own).x1 AS x1, COALESCE(box, own).y1 AS y1, COALESCE(box, own).x2 AS x2, COALESCE(box, own).y2 AS y2, ts AS timestamp_ms, cooling AS cooldown_active, CASE WHEN reason = 'accepted' THEN l ELSE 'none' END AS source_class,
  label AS raw_class, ROUND(raw_conf, 4) AS raw_confidence, ROUND(det_conf, 4) AS det_confidence, reason AS reject_reason, why AS debug_reason FROM r WHERE k > 0"""


_CAR = "struct_pack(id := {id}, {box}, cx := {cx}, cy := {cy}, speed := {speed}, age := {age}, seen := {seen}, door := {door}, door_box := {door_box}, votes := {votes}, raised_at := {raised_at}, closed_from := {closed_from})"
_CAR_TYPE = f"STRUCT(id BIGINT, {_BOX_TYPE}, cx DOUBLE, cy DOUBLE, speed DOUBLE, age BIGINT, seen BIGINT, door VARCHAR, door_box STRUCT({_BOX_TYPE}), votes VARCHAR[], raised_at BIGINT, closed_from BIGINT)"
_NEW_CAR = _CAR.format(
    id="track_id", box=_BOX.format("own"), cx="mx", cy="my", speed="nspeed", age="nage", seen="frame_seq", door="ndoor", door_box="nbox",
    votes="nvotes", raised_at="CASE WHEN raised THEN nage ELSE raised0 END", closed_from="closed0",
)


def warnings(band: str) -> str:
    """Early warnings, one vehicle row per step; ``cars`` is the memory of a camera."""
    return f"""WITH RECURSIVE v AS (SELECT *, {band} AS light, ROW_NUMBER() OVER o AS k, frame_seq IS DISTINCT FROM LAG(frame_seq) OVER o AS head, list(track_id) OVER (PARTITION BY camera_id, frame_seq) AS present,
    (greatest(0, x1) + least(frame_w, x2)) / 2.0::DOUBLE AS mx, (greatest(0, y1) + least(frame_h, y2)) / 2.0::DOUBLE AS my,
    least(frame_w, x2) - greatest(0, x1) < 40 OR least(frame_h, y2) - greatest(0, y1) < 40 AS tiny FROM {{car_frames}} WINDOW o AS (PARTITION BY camera_id ORDER BY frame_seq, track_id)),
  r AS (SELECT DISTINCT camera_id, 0::BIGINT AS k, 0::BIGINT AS frame_seq, 0::BIGINT AS track_id, '' AS priority, FALSE AS ran, '' AS door, '' AS light, 0::DOUBLE AS luma, 0::DOUBLE AS speed, 0::BIGINT AS age, '' AS event, FALSE AS raised, 0::BIGINT AS ms, CAST(NULL AS STRUCT({_BOX_TYPE})) AS door_box, []::{_CAR_TYPE}[] AS cars FROM v
    UNION ALL SELECT camera_id, k, frame_seq, track_id, priority, nran, ndoor, CASE WHEN tiny THEN 'normal' ELSE light END, CASE WHEN tiny THEN 0 ELSE mean_l END, nspeed, nage, vote, raised, timestamp_ms, nbox, CASE WHEN m.id = track_id THEN list_transform(live, lambda c: CASE WHEN c.id = track_id THEN {_NEW_CAR} ELSE c END) ELSE list_append(list_filter(live, lambda c: c.id <> COALESCE(m.id, -1)), {_NEW_CAR}) END
    FROM (SELECT *, vote IS NOT NULL AND raised0 IS NULL AS raised
     FROM (SELECT *, CASE WHEN rearmed THEN NULL ELSE m.raised_at END AS raised0, CASE WHEN rearmed THEN nage + 1 ELSE closing END AS closed0,
        CASE WHEN len(list_filter(nvotes, lambda x: x = 'door_opening')) >= 3 THEN 'EARLY_WARNING_OPENING' WHEN len(list_filter(nvotes, lambda x: x = 'door_open')) >= 3 THEN 'DANGER_DOOR_OPEN' END AS vote
      FROM (SELECT *, m.raised_at IS NOT NULL AND closing IS NOT NULL AND nage - closing + 1 >= 5 AS rearmed
       FROM (SELECT *, list_slice(list_append(COALESCE(m.votes, []), ndoor), -5, -1) AS nvotes, CASE WHEN ndoor = 'door_closed' THEN COALESCE(m.closed_from, nage) END AS closing
        FROM (SELECT *, CASE WHEN tiny THEN 'door_closed' WHEN NOT nran THEN COALESCE(m.door, 'door_closed') WHEN roi_state IN ('door_opening', 'door_open') THEN roi_state ELSE 'door_closed' END AS ndoor,
          CASE WHEN tiny THEN NULL WHEN NOT nran THEN m.door_box WHEN roi_state IN ('door_opening', 'door_open') THEN struct_pack(x1 := greatest(0, x1) + roi_x1, y1 := greatest(0, y1) + roi_y1, x2 := greatest(0, x1) + roi_x2, y2 := greatest(0, y1) + roi_y2) END AS nbox
         FROM (SELECT *, NOT tiny AND light <> 'low_confidence_dark' AND (priority <> 'LOW' OR frame_seq % 5 = 0) AS nran
          FROM (SELECT *, CASE WHEN nage < 5 OR nspeed < 3 THEN 'HIGH' WHEN nspeed < 15 THEN 'MEDIUM' ELSE 'LOW' END AS priority
           FROM (SELECT *, COALESCE(m.age, 0) + 1 AS nage, 0.8::DOUBLE * COALESCE(m.speed, 0::DOUBLE) + 0.2::DOUBLE * sqrt((mx - COALESCE(m.cx, mx)) * (mx - COALESCE(m.cx, mx)) + (my - COALESCE(m.cy, my)) * (my - COALESCE(m.cy, my))) AS nspeed
            FROM (SELECT *, COALESCE(list_filter(live, lambda c: c.id = track_id)[1],
                list_filter(live, lambda c: c.id = list_sort(list_filter(list_transform(live, lambda c, i: struct_pack(n := CASE WHEN list_contains(present, c.id) THEN 0 ELSE -({_iou('c', 'own')}) END, i := i, id := c.id)), lambda x: x.n < -0.5::DOUBLE))[1].id)[1]) AS m
             FROM (SELECT v.*, struct_pack({_BOX.format('v')}) AS own, CASE WHEN v.head THEN list_filter(r.cars, lambda c: v.frame_seq - 1 - c.seen <= 20) ELSE r.cars END AS live
              FROM r JOIN v ON v.camera_id = r.camera_id AND v.k = r.k + 1)))))))))))
SELECT camera_id, frame_seq, track_id, priority, ran AS ran_s2, door AS door_state, light AS illumination, luma, ROUND(speed, 6) AS speed, age, CASE WHEN raised THEN event END AS event, raised AS alarm,
  CASE WHEN event IS NULL THEN door ELSE 'ALARM' END AS shown_state, ms / 1000.0::DOUBLE AS time, door_box.x1 AS door_x1, door_box.y1 AS door_y1, door_box.x2 AS door_x2, door_box.y2 AS door_y2 FROM r WHERE k > 0"""


def _per_profile(i: int) -> str:
    return "CASE profile " + " ".join(f"WHEN '{name}' THEN {values[i]}::DOUBLE" for name, values in PROFILES.items()) + " END"


def _drawn(tag: str) -> str:
    return u01(digest(10, f"'{tag}'", "image_id", "copy_no"))


def augmented(plan: str) -> str:
    """Boxes of the augmented copies of ``plan``."""
    cut = "greatest(0, cx - w / 2) AS x1, greatest(0, cy - h / 2) AS y1, least(1, cx + w / 2) AS x2, least(1, cy + h / 2) AS y2"
    return f"""WITH p AS (SELECT image_id, profile, copy_no, out_name, {_drawn('flip')} < {_per_profile(0)} AS flip,
    CASE WHEN {_drawn('do_scale')} < {_per_profile(3)} THEN {_per_profile(1)} + ({_per_profile(2)} - {_per_profile(1)}) * {_drawn('scale')} ELSE 1 END AS s,
    ({_drawn('tx')} * 2 - 1) * {_per_profile(4)} AS tx, ({_drawn('ty')} * 2 - 1) * {_per_profile(4)} AS ty, radians(({_drawn('rot')} * 2 - 1) * {_per_profile(5)}) AS a FROM ({plan}) WHERE copy_no > 0),
  e AS (SELECT image_id, box_id, cls_id, greatest(0.0001::DOUBLE, cx - w / 2) AS x1, greatest(0.0001::DOUBLE, cy - h / 2) AS y1, least(0.9999::DOUBLE, cx + w / 2) AS x2, least(0.9999::DOUBLE, cy + h / 2) AS y2 FROM {{gt_boxes}}),
  q AS (SELECT p.*, box_id, cls_id, CASE WHEN flip THEN 1 - (x1 + x2) / 2 ELSE (x1 + x2) / 2 END - 0.5 AS ux, (y1 + y2) / 2 - 0.5 AS uy, x2 - x1 AS bw, y2 - y1 AS bh FROM p JOIN e ON e.image_id = p.image_id),
  m AS (SELECT *, (ux * cos(a) - uy * sin(a)) * s + 0.5 + tx AS cx, (ux * sin(a) + uy * cos(a)) * s + 0.5 + ty AS cy, (bw * abs(cos(a)) + bh * abs(sin(a))) * s AS w, (bw * abs(sin(a)) + bh * abs(cos(a))) * s AS h FROM q),
  k AS (SELECT *, {cut} FROM m),
  z AS (SELECT *, CASE WHEN w * h > 0 THEN greatest(0, x2 - x1) * greatest(0, y2 - y1) / (w * h) END AS visible FROM k)
SELECT image_id, box_id, cls_id, copy_no, profile, out_name, ROUND((x1 + x2) / 2, 9) AS cx, ROUND((y1 + y2) / 2, 9) AS cy, ROUND(x2 - x1, 9) AS w, ROUND(y2 - y1, 9) AS h, ROUND(visible, 9) AS visible FROM z WHERE visible >= 0.3::DOUBLE"""


fixtures.CHECK_VIEWS |= {"warned": warnings(BAND), "tracked": _TRACKED, "budgeted": _BUDGET, "cascaded": _CASCADE}
