"""Per-camera temporal queries, keyed state queries and run governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from doorlens.config import MOTION_PRESETS
from doorlens.functions.geometry import c
from doorlens.operators import audit, governance, split, stateful, temporal
from doorlens.operators.repair import gate_detections
from doorlens.plans.catalog_rows import _GATED
from doorlens.plans.catalog_sets import features
from doorlens.plans.check_rules import doors
from doorlens.plans.registry import fields, query

# -- windows -----------------------------------------------------------------------------------------------------

_OPINION = """SELECT camera_id, frame_seq, CASE label WHEN 'open' THEN 'OPEN' WHEN 'close' THEN 'CLOSE' END AS opinion FROM {frame_obs}"""
_VOTES = f"""op AS ({_OPINION}),
  cnt AS (SELECT camera_id, frame_seq, CASE WHEN o >= 6 THEN 'OPEN' WHEN n - o >= 6 THEN 'CLOSE' END AS decided FROM (
    SELECT camera_id, frame_seq, COUNT(*) FILTER (opinion = 'OPEN') OVER w AS o, COUNT(*) OVER w AS n FROM op WHERE opinion IS NOT NULL
    WINDOW w AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))),
  voted AS (SELECT op.camera_id, op.frame_seq, op.opinion, COALESCE(LAST_VALUE(decided IGNORE NULLS) OVER (PARTITION BY op.camera_id ORDER BY op.frame_seq ROWS UNBOUNDED PRECEDING), 'CLOSE') AS state
    FROM op LEFT JOIN cnt ON op.camera_id = cnt.camera_id AND op.frame_seq = cnt.frame_seq)"""


def opinions(t):
    op = F.when(c("label") == "open", "OPEN").when(c("label") == "close", "CLOSE")
    return t.frame_obs.select("camera_id", "frame_seq", op.alias("opinion"))


@query("vote_state", f"WITH {_VOTES} SELECT * FROM voted")
def _(t):
    return temporal.vote_state(opinions(t))


_PERSIST = """SELECT camera_id, frame_seq, label, COUNT(*) FILTER (label = 'open') OVER w AS open_count, COUNT(*) FILTER (label = 'close') OVER w AS close_count,
    frame_seq - greatest(COALESCE(MAX(CASE WHEN label <> 'open' THEN frame_seq END) OVER p, 0), frame_seq - 5) AS open_streak,
    frame_seq - greatest(COALESCE(MAX(CASE WHEN label <> 'close' THEN frame_seq END) OVER p, 0), frame_seq - 5) AS close_streak
  FROM {frame_obs} WINDOW w AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), p AS (PARTITION BY camera_id ORDER BY frame_seq ROWS UNBOUNDED PRECEDING)"""


@query("persistence", f"SELECT *, open_count >= 3 AS open_confirmed, close_count >= 3 AS close_confirmed FROM ({_PERSIST})")
def _(t):
    return temporal.persistence(t.frame_obs.select("camera_id", "frame_seq", "label"))


_BEHAVIOR = """flips AS (SELECT camera_id, frame_seq, label, CASE WHEN label IN ('open', 'close') AND LAG(label) OVER (PARTITION BY camera_id ORDER BY frame_seq) = label THEN label END AS flip FROM {frame_obs}),
  prev AS (SELECT *, COALESCE(LAST_VALUE(flip IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unknown') AS before FROM flips),
  ev AS (SELECT camera_id, frame_seq, label, COALESCE(flip, before) AS stable_label, flip IS NOT NULL AND flip <> before AS starts, before, flip FROM prev),
  beh AS (SELECT camera_id, frame_seq, label, stable_label, CASE WHEN starts AND flip = 'open' THEN 'door_opening' WHEN starts THEN 'door_closing' WHEN stable_label = 'open' THEN 'door_open' WHEN stable_label = 'close' THEN 'door_closed' ELSE 'idle' END AS event_name,
    CASE WHEN starts THEN 'Start' ELSE 'Ongoing' END AS state_flag, CASE WHEN starts THEN before || '->' || flip END AS transition FROM ev)"""


@query("behavior_events", f"WITH {_BEHAVIOR} SELECT * FROM beh")
def _(t):
    return temporal.behavior_events(t.frame_obs.select("camera_id", "frame_seq", "label"))


@query(
    "transition_trace",
    f"WITH {_BEHAVIOR} SELECT camera_id, frame_seq, transition, ROW_NUMBER() OVER (PARTITION BY camera_id ORDER BY frame_seq) AS step FROM beh WHERE transition IS NOT NULL",
)
def _(t):
    return temporal.transition_trace(temporal.behavior_events(t.frame_obs.select("camera_id", "frame_seq", "label")))


@query(
    "flicker_count",
    """SELECT camera_id, (frame_seq - 1) // 30 AS bucket, COUNT(*) AS frames, COUNT(*) FILTER (label <> prev) AS flickers
FROM (SELECT camera_id, frame_seq, label, LAG(label) OVER (PARTITION BY camera_id ORDER BY frame_seq) AS prev FROM {frame_obs}) GROUP BY 1, 2""",
)
def _(t):
    return temporal.flicker_count(t.frame_obs.select("camera_id", "frame_seq", "label"), "label")


@query(
    "state_change_events",
    f"""WITH {_VOTES} SELECT camera_id, frame_seq, previous, state, 'STATE_CHANGED_' || state AS event
FROM (SELECT *, LAG(state) OVER (PARTITION BY camera_id ORDER BY frame_seq) AS previous FROM voted) WHERE state <> previous""",
)
def _(t):
    return temporal.state_change_events(temporal.vote_state(opinions(t)).drop("opinion"))


_MOTION = """b AS (SELECT *, da * (180 / pi()) AS deg, sqrt(dx * dx + dy * dy) AS tr FROM {frame_motion}),
  l AS (SELECT *, LAG(dx) OVER o AS pdx, LAG(dy) OVER o AS pdy, LAG(deg) OVER o AS pdeg FROM b WINDOW o AS (PARTITION BY camera_id ORDER BY frame_seq)),
  f AS (SELECT camera_id, frame_seq, dx, dy, da, COUNT(*) OVER w AS samples, AVG(tr) OVER w AS mean_trans, MAX(tr) OVER w AS max_trans, stddev_pop(tr) OVER w AS std_trans, AVG(abs(deg)) OVER w AS mean_rot_deg, MAX(abs(deg)) OVER w AS max_rot_deg,
    AVG(abs(dx - pdx)) OVER i + AVG(abs(dy - pdy)) OVER i + 2 * AVG(abs(deg - pdeg)) OVER i AS jerk,
    (COALESCE(AVG(CASE WHEN abs(dx) > 0.35 AND abs(pdx) > 0.35 THEN CASE WHEN sign(dx) <> sign(pdx) THEN 1.0 ELSE 0.0 END END) OVER i, 0)
     + COALESCE(AVG(CASE WHEN abs(dy) > 0.35 AND abs(pdy) > 0.35 THEN CASE WHEN sign(dy) <> sign(pdy) THEN 1.0 ELSE 0.0 END END) OVER i, 0)
     + COALESCE(AVG(CASE WHEN abs(deg) > 0.05 AND abs(pdeg) > 0.05 THEN CASE WHEN sign(deg) <> sign(pdeg) THEN 1.0 ELSE 0.0 END END) OVER i, 0)) / 3 AS sign_changes,
    AVG(CASE WHEN tr > 0.5 THEN dx / tr END) OVER w AS mc, AVG(CASE WHEN tr > 0.5 THEN dy / tr END) OVER w AS ms
    FROM l WINDOW w AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), i AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  feat AS (SELECT * EXCLUDE (mc, ms), COALESCE(sqrt(mc * mc + ms * ms), 1) AS direction_consistency FROM f),
  sc AS (SELECT *, CAST(max_trans > 8 OR max_rot_deg > 0.8 AS INT) + CAST(jerk > 5 AS INT) + CAST(sign_changes > 0.45 AS INT) + CAST(std_trans > 3 AS INT) + CAST(direction_consistency < 0.45 AND mean_trans > 2 AS INT) AS v,
    CAST(mean_trans > 2.5 OR mean_rot_deg > 0.25 AS INT) + CAST(max_trans > 5 OR max_rot_deg > 0.6 AS INT) + CAST(direction_consistency > 0.65 AS INT) + CAST(sign_changes < 0.35 AS INT) + CAST(jerk < 5.5 AS INT) AS s FROM feat),
  modes AS (SELECT camera_id, frame_seq, dx, dy, da, CASE WHEN samples < 3 THEN 'normal' WHEN v >= 3 OR (v >= 2 AND max_trans > 10) THEN 'violent' WHEN s >= 4 THEN 'large_sway' ELSE 'normal' END AS mode,
    CASE WHEN samples < 3 THEN 0 WHEN v >= 3 OR (v >= 2 AND max_trans > 10) THEN v / 5 WHEN s >= 4 THEN s / 5 ELSE greatest(0, 1 - mean_trans / 8) END AS confidence FROM sc)"""
_FEATURES = ("mean_trans", "max_trans", "std_trans", "mean_rot_deg", "max_rot_deg", "jerk", "sign_changes", "direction_consistency")


@query(
    "motion_features",
    f"WITH {_MOTION} SELECT camera_id, frame_seq, samples, " + ", ".join(f"ROUND({x}, 6) AS {x}" for x in _FEATURES) + " FROM feat",
)
def _(t):
    d = temporal.motion_features(t.frame_motion)
    return d.select("camera_id", "frame_seq", "samples", *[F.round(x, 6).alias(x) for x in _FEATURES])


@query("motion_mode", f"WITH {_MOTION} SELECT camera_id, frame_seq, mode, ROUND(confidence, 6) AS confidence FROM modes")
def _(t):
    d = temporal.motion_mode(temporal.motion_features(t.frame_motion))
    return d.select("camera_id", "frame_seq", "mode", F.round("confidence", 6).alias("confidence"))


def _pick(i: int) -> str:
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {v[i]}::DOUBLE" for m, v in MOTION_PRESETS.items()) + " END"


@query(
    "gain_schedule",
    f"""WITH {_MOTION} SELECT camera_id, frame_seq, mode, {_pick(0)} AS alpha, ROUND(greatest(-{_pick(1)}, least({_pick(1)}, dx * {_pick(3)})), 6) AS out_dx,
  ROUND(greatest(-{_pick(1)}, least({_pick(1)}, dy * {_pick(3)})), 6) AS out_dy, ROUND(greatest(-{_pick(2)} * pi() / 180, least({_pick(2)} * pi() / 180, da * {_pick(4)})), 6) AS out_da FROM modes""",
)
def _(t):
    d = temporal.gain_schedule(temporal.motion_mode(temporal.motion_features(t.frame_motion)))
    return d.select("camera_id", "frame_seq", "mode", "alpha", *[F.round(x, 6).alias(x) for x in ("out_dx", "out_dy", "out_da")])


@query(
    "latency_report",
    """SELECT camera_id, lag_status, COUNT(*) AS frames, ROUND(AVG(e), 9) AS avg_e2e_ms, ROUND(MAX(e), 6) AS max_e2e_ms, ROUND(AVG(CASE WHEN e > 0 THEN 1000.0::DOUBLE / e ELSE 0 END), 9) AS avg_fps
FROM (SELECT camera_id, e, CASE WHEN e > 100 THEN 'CRIT' WHEN e > 50 THEN 'WARN' ELSE 'OK' END AS lag_status FROM (SELECT camera_id, capture_ms + infer_ms + logic_ms + render_ms AS e FROM {latency_log})) GROUP BY 1, 2""",
)
def _(t):
    return audit.latency_report(t.latency_log)


@query(
    "episodes",
    """SELECT camera_id, frame_seq, det_no, CAST(LAST_VALUE(b IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY frame_seq, det_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM (
  SELECT *, CASE WHEN LAG(frame_seq) OVER (PARTITION BY camera_id ORDER BY frame_seq, det_no) IS NULL OR frame_seq - LAG(frame_seq) OVER (PARTITION BY camera_id ORDER BY frame_seq, det_no) > 13 THEN frame_seq END AS b FROM {frame_dets})""",
)
def _(t):
    return temporal.episodes(t.frame_dets, c("frame_seq"), 13.0).select("camera_id", "frame_seq", "det_no", "episode")


# -- keyed state --------------------------------------------------------------------------------------------------


@query("track", "SELECT * FROM {tracked}")
def _(t):
    return stateful.track(t.frame_dets)


@query("door_states", doors("SELECT *, 1::BIGINT AS track_id, conf AS raw_conf, conf AS det_conf, 0 AS missed FROM {frame_obs}"))
def _(t):
    return stateful.door_states(t.frame_obs)


@query("track_door_states", doors("SELECT *, cls_conf AS raw_conf, frame_seq * 400 AS timestamp_ms, 1280 AS frame_w, 720 AS frame_h FROM {cascaded}"))
def _(t):
    """The whole cascade: tracks, second-stage budget, the answers carried on the tracks, door states."""
    tracks = stateful.track(t.frame_dets)
    asked = stateful.secondary_budget(tracks).join(tracks, ["camera_id", "track_id", "frame_seq"])
    answers = asked.select(
        "camera_id", "track_id", "frame_seq",
        F.when(c("frame_seq") % 70 < 24, "close").otherwise("open").alias("label"),
        ((60 + (c("x1") * 17) % 40).cast("double") / 100).alias("cls_conf"),
    )
    d = stateful.second_stage(tracks, answers).withColumn("timestamp_ms", c("frame_seq") * 400)
    return stateful.door_states(d.withColumn("frame_w", F.lit(1280)).withColumn("frame_h", F.lit(720)))


@query("early_warning", "SELECT * FROM {warned}")
def _(t):
    return stateful.early_warning(t.car_frames).withColumn("speed", F.round("speed", 6))


@query(
    "alarms",
    "SELECT event, track_id, camera_id, frame_seq, illumination AS illumination_status, luma, time, door_x1, door_y1, door_x2, door_y2 FROM {warned} WHERE alarm",
)
def _(t):
    return stateful.alarms(stateful.early_warning(t.car_frames))


@query(
    "runtime_counters",
    """SELECT camera_id, COUNT(*) AS frames, CAST(SUM(n) AS BIGINT) AS vehicles, CAST(SUM(hi) AS BIGINT) AS high, CAST(SUM(mid) AS BIGINT) AS medium, CAST(SUM(lo) AS BIGINT) AS low,
  COUNT(*) FILTER (rois > 0) AS s2_batches, CAST(SUM(rois) AS BIGINT) AS s2_rois, CAST(SUM(al) AS BIGINT) AS alarms
FROM (SELECT camera_id, frame_seq, COUNT(*) AS n, COUNT(*) FILTER (priority = 'HIGH') AS hi, COUNT(*) FILTER (priority = 'MEDIUM') AS mid, COUNT(*) FILTER (priority = 'LOW') AS lo,
    COUNT(*) FILTER (ran_s2) AS rois, COUNT(*) FILTER (alarm) AS al FROM {warned} GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return audit.runtime_counters(stateful.early_warning(t.car_frames))


_ASYM = f"""g AS ({_GATED}),
  it AS (SELECT camera_id, frame_seq, MAX(ratio) FILTER (ok AND label = 'open' AND ratio >= 0.05::DOUBLE) AS o, MAX(ratio) FILTER (ok AND label = 'close') AS cl FROM g GROUP BY 1, 2),
  n AS (SELECT camera_id, frame_seq, CASE WHEN o IS NOT NULL THEN 'OPEN' WHEN cl IS NOT NULL THEN 'CLOSE' END AS intent, COALESCE(o, cl, 0) AS max_area FROM it),
  h AS (SELECT camera_id, frame_seq, CASE WHEN COUNT(*) FILTER (intent = 'OPEN') OVER w2 = 2 THEN 'OPEN' WHEN COUNT(*) FILTER (intent = 'CLOSE') OVER w5 = 5 THEN 'CLOSE' END AS d FROM n WHERE intent IS NOT NULL
    WINDOW w2 AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  s AS (SELECT n.*, COALESCE(LAST_VALUE(d IGNORE NULLS) OVER (PARTITION BY n.camera_id ORDER BY n.frame_seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS state FROM n LEFT JOIN h ON n.camera_id = h.camera_id AND n.frame_seq = h.frame_seq),
  z AS (SELECT *, CASE WHEN state = 'OPEN' AND max_area >= 0.10::DOUBLE THEN 'on' WHEN state <> 'OPEN' OR max_area < 0.08::DOUBLE THEN 'off' END AS sig FROM s),
  a AS (SELECT camera_id, frame_seq, CASE WHEN COUNT(*) FILTER (sig = 'on') OVER w3 = 3 THEN 1 WHEN COUNT(*) FILTER (sig = 'off') OVER w5 = 5 THEN 0 END AS d FROM z WHERE sig IS NOT NULL
    WINDOW w3 AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY camera_id ORDER BY frame_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query(
    "asym_alert",
    f"""WITH {_ASYM} SELECT z.camera_id, z.frame_seq, state, COALESCE(LAST_VALUE(a.d IGNORE NULLS) OVER (PARTITION BY z.camera_id ORDER BY z.frame_seq ROWS UNBOUNDED PRECEDING), 0) = 1 AS alert, ROUND(max_area, 6) AS max_area
FROM z LEFT JOIN a ON z.camera_id = a.camera_id AND z.frame_seq = a.frame_seq""",
)
def _(t):
    d = stateful.asym_alert(stateful.frame_intents(gate_detections(t.frame_obs)))
    return d.withColumn("max_area", F.round("max_area", 6))


def mode_candidates(t):
    d = temporal.motion_mode(temporal.motion_features(t.frame_motion))
    return d.select("camera_id", "frame_seq", c("mode").alias("candidate"))


_RUN = "CASE WHEN n.candidate = r.sym THEN r.run + 1 ELSE 1 END"


@query(
    "mode_hysteresis",
    f"""WITH RECURSIVE {_MOTION},
  n AS (SELECT camera_id, frame_seq, mode AS candidate, ROW_NUMBER() OVER (PARTITION BY camera_id ORDER BY frame_seq) AS k FROM modes),
  r AS (SELECT camera_id, k, frame_seq, candidate, candidate AS sym, 1 AS run, 'normal' AS mode FROM n WHERE k = 1
    UNION ALL SELECT n.camera_id, n.k, n.frame_seq, n.candidate, n.candidate, {_RUN},
      CASE WHEN {_RUN} >= CASE WHEN r.mode = 'violent' THEN 5 WHEN r.mode = 'large_sway' AND n.candidate = 'normal' THEN 4 ELSE 3 END THEN n.candidate ELSE r.mode END
    FROM r JOIN n ON n.camera_id = r.camera_id AND n.k = r.k + 1)
SELECT camera_id, frame_seq, candidate, mode FROM r""",
)
def _(t):
    return stateful.mode_hysteresis(mode_candidates(t))


@query(
    "smooth_trajectory",
    """WITH RECURSIVE m AS (SELECT * FROM {frame_motion}),
  s AS (SELECT camera_id, frame_seq, dx AS tx, dy AS ty, da AS ta, 0.2::DOUBLE * dx AS sx, 0.2::DOUBLE * dy AS sy, 0.2::DOUBLE * da AS sa, dx, dy, da FROM m WHERE frame_seq = 1
    UNION ALL SELECT m.camera_id, m.frame_seq, s.tx + m.dx, s.ty + m.dy, s.ta + m.da, 0.8::DOUBLE * s.sx + 0.2::DOUBLE * (s.tx + m.dx), 0.8::DOUBLE * s.sy + 0.2::DOUBLE * (s.ty + m.dy), 0.8::DOUBLE * s.sa + 0.2::DOUBLE * (s.ta + m.da), m.dx, m.dy, m.da
    FROM s JOIN m ON m.camera_id = s.camera_id AND m.frame_seq = s.frame_seq + 1)
SELECT camera_id, frame_seq, ROUND(dx + sx - tx, 6) AS out_dx, ROUND(dy + sy - ty, 6) AS out_dy, ROUND(da + sa - ta, 6) AS out_da FROM s""",
)
def _(t):
    d = stateful.smooth_trajectory(t.frame_motion)
    return d.select("camera_id", "frame_seq", *[F.round(x, 6).alias(x) for x in ("out_dx", "out_dy", "out_da")])


@query("secondary_budget", "SELECT * FROM {budgeted}")
def _(t):
    d = stateful.track(t.frame_dets)
    return stateful.secondary_budget(d.select("camera_id", "frame_seq", "track_id", "missed", "det_conf"))


# -- governance --------------------------------------------------------------------------------------------------

_PROMOTE = """WITH RECURSIVE r AS (SELECT *, 0.1::DOUBLE * map50 + 0.9::DOUBLE * map50_95 AS fit, ROW_NUMBER() OVER (PARTITION BY experiment ORDER BY run_id) AS k FROM {experiments}),
  p AS (SELECT experiment, k, run_id, mode, fit, open_recall, ghost_fp, TRUE AS promoted, 'first_baseline' AS reason, CAST(NULL AS BIGINT) AS parent_run, run_id AS b_run, fit AS b_fit, open_recall AS b_rec, ghost_fp AS b_ghost FROM r WHERE k = 1
    UNION ALL SELECT experiment, k, run_id, mode, fit, open_recall, ghost_fp, ok, reason, b_run, CASE WHEN ok THEN run_id ELSE b_run END, CASE WHEN ok THEN fit ELSE b_fit END, CASE WHEN ok THEN open_recall ELSE b_rec END, CASE WHEN ok THEN ghost_fp ELSE b_ghost END
    FROM (SELECT r.*, p.b_run, p.b_fit, p.b_rec, p.b_ghost, CASE WHEN r.ghost_fp > p.b_ghost + 2 THEN FALSE WHEN r.mode = 'rebuild' THEN r.fit >= p.b_fit ELSE r.open_recall >= p.b_rec - 0.03::DOUBLE END AS ok,
      CASE WHEN r.ghost_fp > p.b_ghost + 2 THEN 'ghost_veto' WHEN r.mode = 'rebuild' THEN CASE WHEN r.fit >= p.b_fit THEN 'rebuild_passed' ELSE 'rebuild_below_best' END
        ELSE CASE WHEN r.open_recall >= p.b_rec - 0.03::DOUBLE THEN 'recall_guard_passed' ELSE 'recall_dropped' END END AS reason
      FROM p JOIN r ON r.experiment = p.experiment AND r.k = p.k + 1))
"""


@query(
    "promotion_history",
    _PROMOTE + "SELECT experiment, run_id, mode, ROUND(fit, 6) AS fitness, open_recall, ghost_fp, promoted, reason, parent_run FROM p",
)
def _(t):
    return governance.promotion_history(t.experiments).withColumn("fitness", F.round("fitness", 6))


@query(
    "registry",
    _PROMOTE
    + """SELECT p.experiment, p.run_id, p.mode, r.dataset, substr(sha256(r.dataset), 1, 12) AS dataset_hash, substr(sha256(concat_ws('|', r.mode, r.dataset, r.save_dir)), 1, 12) AS config_hash, parent_run, r.map50, r.map50_95, r.open_recall, r.ghost_fp
FROM p JOIN r ON p.run_id = r.run_id WHERE promoted""",
)
def _(t):
    runs = t.experiments.withColumn("config", F.concat_ws("|", "mode", "dataset", "save_dir"))
    return governance.registry(governance.promotion_history(t.experiments), runs)


@query(
    "absorption_history",
    """WITH RECURSIVE r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment ORDER BY run_id) AS k FROM {experiments}),
  p AS (SELECT experiment, k, run_id, map50, retry_map50, outcome, CASE outcome WHEN 'absorbed' THEN map50 WHEN 'absorbed_by_rebuild' THEN retry_map50 ELSE 0 END AS best FROM (
      SELECT *, CASE WHEN map50 > 0 THEN 'absorbed' WHEN mode <> 'rebuild' AND retry_map50 > 0 THEN 'absorbed_by_rebuild' ELSE 'stopped' END AS outcome FROM r WHERE k = 1)
    UNION ALL SELECT experiment, k, run_id, map50, retry_map50, outcome, CASE outcome WHEN 'absorbed' THEN map50 WHEN 'absorbed_by_rebuild' THEN retry_map50 ELSE best END FROM (
      SELECT r.*, p.best, CASE WHEN p.outcome IN ('stopped', 'not_run') THEN 'not_run' WHEN r.map50 > p.best THEN 'absorbed' WHEN r.mode <> 'rebuild' AND r.retry_map50 > p.best THEN 'absorbed_by_rebuild' ELSE 'stopped' END AS outcome
      FROM p JOIN r ON r.experiment = p.experiment AND r.k = p.k + 1))
SELECT experiment, run_id, map50, retry_map50, outcome, best AS best_map50 FROM p""",
)
def _(t):
    return governance.absorption_history(t.experiments)


@query(
    "run_report",
    """SELECT run_id, name, run_time, note, '| - | **' || name || '** | ' || run_time || ' | ' || dataset || ' | ' || printf('%.4f', map50) || ' | ' || note || ' |' AS line
FROM (SELECT run_id, dataset, map50, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M') AS run_time, regexp_extract(save_dir, '([^/]*)$', 1) AS name, CASE WHEN map50 < 0.1::DOUBLE THEN 'abnormal' ELSE 'archived' END AS note FROM {experiments})""",
)
def _(t):
    return governance.run_report(t.experiments.withColumn("ts", F.to_timestamp_ntz("ts"))).drop("ts")


@query(
    "latest_run",
    "SELECT experiment, run_id, map50 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment ORDER BY ts DESC, run_id DESC) AS rn FROM {experiments}) WHERE rn = 1",
)
def _(t):
    return governance.latest_run(t.experiments)


@query("assert_metrics", "SELECT run_id, map50, map50 <> 0 AS ok FROM {experiments}")
def _(t):
    """Verdict of every run; the assertion takes the runs said to pass, so a zero among them fails the job."""
    d = governance.metric_verdicts(t.experiments).withColumn("passed", F.when(c("ok"), c("map50")))
    d = governance.assert_metrics(d, "passed")
    return d.select("run_id", F.coalesce("passed", "map50").alias("map50"), "ok")


@query("metric_verdicts", "SELECT run_id, map50, map50 <> 0 AS ok FROM {experiments}")
def _(t):
    return governance.metric_verdicts(t.experiments).select("run_id", "map50", "ok")


@query(
    "gate_autolabel",
    """SELECT version, COUNT(*) AS total_images, COUNT(*) FILTER (hit) AS suspect_fp_count, ROUND(COUNT(*) FILTER (hit) / COUNT(*), 6) AS fp_ratio, COUNT(*) FILTER (hit) / COUNT(*) <= 0.05::DOUBLE AS passed
FROM (SELECT version, n_boxes = 0 AND EXISTS (SELECT 1 FROM {detections} d WHERE d.image_id = f.image_id) AS hit FROM {feats} f) GROUP BY 1""",
)
def _(t):
    seen = t.detections.groupBy("image_id").agg(F.lit(True).alias("seen"))
    d = features(t, False).join(seen, "image_id", "left")
    suspect = (c("open_cnt") == 0) & (c("close_cnt") == 0) & F.coalesce("seen", F.lit(False))
    stats = d.groupBy("version").agg(F.count(F.lit(1)).alias("total_images"), F.count_if(suspect).alias("suspect_fp_count"))
    return governance.gate_autolabel(stats)


_RULES = f"""vl AS (SELECT image_id, line_no, UNNEST(list_filter([
    CASE WHEN len(p) <> 5 THEN 'field_count' END,
    CASE WHEN len(p) = 5 AND len([x for x in n if x IS NULL]) > 0 THEN 'bad_number' END,
    CASE WHEN len(p) = 5 AND (trunc(n[1]) < 0 OR trunc(n[1]) >= 2) THEN 'class_range' END,
    CASE WHEN len(p) = 5 AND len([x for x in n[2:] if x < 0 OR x > 1]) > 0 THEN 'coord_range' END], lambda x: x IS NOT NULL)) AS rule
  FROM (SELECT *, [TRY_CAST(x AS DOUBLE) for x in p] AS n FROM (SELECT *, {fields('line')} AS p FROM {{label_lines}})))"""


@query("line_violations", f"WITH {_RULES} SELECT image_id, line_no, rule FROM vl")
def _(t):
    return governance.line_violations(t.label_lines)


@query(
    "validate",
    f"""WITH {_RULES},
  sp AS (SELECT image_id, file_name, split FROM {{split0}}),
  em AS (SELECT split, COUNT(*) AS a, COUNT(*) FILTER (image_id NOT IN (SELECT image_id FROM {{label_lines}})) AS e FROM sp GROUP BY 1),
  ov AS (SELECT COUNT(*) FILTER (split = 'train') AS t, COUNT(*) FILTER (split = 'val') AS v FROM sp GROUP BY file_name)
SELECT split, rule, COUNT(*) AS n, COUNT(DISTINCT vl.image_id) AS images FROM vl JOIN sp ON vl.image_id = sp.image_id GROUP BY 1, 2
UNION ALL SELECT split, 'empty_labels', e, e FROM em WHERE e > 0
UNION ALL SELECT split, 'no_labels', a, a FROM em WHERE e = a
UNION ALL SELECT 'both', 'train_val_overlap', COUNT(*), CAST(SUM(t + v) AS BIGINT) FROM ov WHERE t > 0 AND v > 0 HAVING COUNT(*) > 0""",
)
def _(t):
    d = split.scene_split(split.with_scene(t.images))
    return governance.validate(d.select("image_id", "file_name", "split"), t.label_lines)
