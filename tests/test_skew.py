"""Bucketed ranks, look-backs and grid matching against plain pandas, with tiny blocks so that every seam is crossed."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from doorlens.functions.hashing import draw
from doorlens.operators import match, ranking, stateful, temporal
from doorlens.sources import sinks

SPAN = 8


@pytest.fixture(scope="module")
def timeline():
    rnd = random.Random(3)
    rows = []
    for cam, n in ((1, 200), (2, 30), (3, 1)):  # camera 1 is the hot key
        for f in range(1, n + 1):
            rows.append((cam, f, rnd.choice(["open", "close", None, None]), rnd.random(), rnd.choice("abc")))
    return pd.DataFrame(rows, columns=["camera_id", "frame_seq", "v", "x", "s"])


def by_frame(df):
    return df.sort_values(["camera_id", "frame_seq"]).reset_index(drop=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "camera_id bigint, frame_seq bigint, v string, x double, s string")


def test_two_level_prefix_and_rank(spark, timeline):
    d = frame(spark, timeline).withColumn("_d", draw(1, "camera_id", "frame_seq"))
    got = ranking.hash_rank(d, ["camera_id"], "_d", "rk", ["frame_seq"]).toPandas()
    want = got.sort_values(["camera_id", "_d"]).groupby("camera_id").cumcount() + 1
    assert (got["rk"] == want.reindex(got.index)).all()
    run = ranking.two_level_prefix(d, [], [F.floor(F.col("x") * 5)], [F.col("x")], {"r": F.col("frame_seq")}, inclusive=False).toPandas()
    run = run.sort_values("x")
    assert (run["r"] == run["frame_seq"].cumsum() - run["frame_seq"]).all()


def test_carry_last(spark, timeline):
    d = ranking.carry_last(frame(spark, timeline), ["camera_id"], "frame_seq", {"a": F.col("v")}, span=SPAN)
    d = ranking.carry_last(d, ["camera_id"], "frame_seq", {"b": F.col("v")}, exclusive=True, span=SPAN)
    got = by_frame(d.toPandas())
    want = by_frame(timeline).groupby("camera_id")["v"].ffill()
    assert got["a"].fillna("-").tolist() == want.fillna("-").tolist()
    shifted = want.groupby(by_frame(timeline)["camera_id"]).shift(1)
    assert got["b"].fillna("-").tolist() == shifted.fillna("-").tolist()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_recent_values(spark, timeline, k):
    got = by_frame(ranking.recent_values(frame(spark, timeline), ["camera_id"], "frame_seq", F.col("v"), k, "h", span=SPAN).toPandas())
    for cam, part in by_frame(timeline).groupby("camera_id"):
        seen, want = [], []
        for v in part["v"]:
            seen += [v] if isinstance(v, str) else []
            want.append(seen[-k:])
        assert [list(h) for h in got[got.camera_id == cam]["h"]] == want


def test_look_back(spark, timeline):
    def build(d, w):
        return d.withColumn("m", F.max("x").over(w(-4, 0)))

    got = by_frame(ranking.look_back(frame(spark, timeline), ["camera_id"], "frame_seq", 4, build, span=SPAN).toPandas())
    want = by_frame(timeline).groupby("camera_id")["x"].rolling(5, min_periods=1).max().reset_index(drop=True)
    assert got["m"].tolist() == want.tolist() and len(got) == len(timeline)


def test_episodes_cross_blocks(spark):
    rnd = random.Random(5)
    rows, f = [], 0
    for _ in range(300):
        f += rnd.choice([1, 1, 1, 3, 20])
        rows += [(1, f)] * rnd.choice([1, 2])
    d = spark.createDataFrame(rows, "camera_id bigint, frame_seq bigint")
    got = temporal.episodes(d, F.col("frame_seq"), 5.0, span=SPAN).toPandas().sort_values("frame_seq")
    want, start, prev = [], None, None
    for _, x in sorted(rows):
        if prev is None or x - prev > 5:
            start = x
        want.append(start)
        prev = x
    assert got["episode"].tolist() == want


def boxes(rnd, n, image, tag):
    return [
        (image, i, rnd.randint(0, 1), rnd.random(), rnd.random() * 1.1, rnd.random(), 0.02 + rnd.random() * 0.5, 0.02 + rnd.random() * 0.3)
        for i in range(n)
    ]


def test_grid_matching_is_exact(spark, monkeypatch):
    """Crowded images are matched through cells; pairs must equal brute force, each once."""
    rnd = random.Random(11)
    g = boxes(rnd, 60, 1, "g") + boxes(rnd, 3, 2, "g")
    p = boxes(rnd, 50, 1, "p") + boxes(rnd, 4, 2, "p")
    gt = spark.createDataFrame(g, "image_id bigint, box_id bigint, cls_id int, v double, cx double, cy double, w double, h double")
    pr = spark.createDataFrame(p, "image_id bigint, det_id bigint, cls_id int, conf double, cx double, cy double, w double, h double")
    monkeypatch.setattr(match, "CROWDED", 20)
    monkeypatch.setattr(match, "CELL_BOXES", 4)
    got = {(r.image_id, r.box_id, r.det_id): r.iou for r in match.overlaps(gt, pr).collect()}
    assert match.overlaps(gt, pr).count() == len(got)
    want = {}
    for a in g:
        for b in p:
            if a[0] != b[0]:
                continue
            w = min(a[4] + a[6] / 2, b[4] + b[6] / 2) - max(a[4] - a[6] / 2, b[4] - b[6] / 2)
            h = min(a[5] + a[7] / 2, b[5] + b[7] / 2) - max(a[5] - a[7] / 2, b[5] - b[7] / 2)
            if w > 0 and h > 0:
                want[(a[0], a[1], b[1])] = w * h / (a[6] * a[7] + b[6] * b[7] - w * h)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 and 0 <= got[k] <= 1 + 1e-12 for k in want)


def test_mode_hysteresis_pieces(spark, monkeypatch):
    rnd = random.Random(2)
    rows = []
    for cam in (1, 2):
        f = 1
        while f < 400:
            m = rnd.choice(["violent", "large_sway", "normal"])
            for _ in range(rnd.choice([1, 2, 3, 4, 5, 7])):
                rows.append((cam, f, m))
                f += 1
    d = spark.createDataFrame(rows, "camera_id bigint, frame_seq bigint, candidate string")
    got = {(r.camera_id, r.frame_seq): r.mode for r in stateful.mode_hysteresis(d).collect()}
    for cam in (1, 2):
        mode, pend, n = "normal", None, 0
        for c, f, m in rows:
            if c != cam:
                continue
            if m == mode:
                pend, n = None, 0
            else:
                n = n + 1 if m == pend else 1
                pend = m
                need = 5 if mode == "violent" else 4 if mode == "large_sway" and m == "normal" else 3
                if n >= need:
                    mode, pend, n = m, None, 0
            assert got[(cam, f)] == mode


def test_look_back_over_frames_with_gaps(spark):
    rnd = random.Random(4)
    rows, f = [], 0
    for i in range(300):
        f += rnd.choice([1, 3, 10, 97])
        rows.append((1, f, i))
    d = spark.createDataFrame(rows, "camera_id bigint, frame_seq bigint, i bigint")
    build = lambda d, w: d.withColumn("n", F.count(F.lit(1)).over(w(-4, 0))).withColumn("first", F.first("i").over(w(-4, 0)))
    got = ranking.look_back(d, ["camera_id"], "frame_seq", 4, build, span=SPAN).collect()
    assert len(got) == len(rows)
    assert all(r.n == min(r.i + 1, 5) and r.first == max(r.i - 4, 0) for r in got)


def test_ranks_of_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 2, None if i % 4 == 0 else i // 5, i) for i in range(60)]
    d = spark.createDataFrame(rows, "g int, b int, i int")
    got = ranking.two_level_prefix(d, ["g"], [F.col("b")], [F.col("b"), F.col("i")], {"r": F.lit(1)}).collect()
    for g in (None, 0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.b is not None, r.b or 0, r.i))
        assert [r.r for r in own] == list(range(1, len(own) + 1))


def test_repeated_ground_truth_rows_count_each(spark):
    box = (1, 7, 0, 0.5, 0.5, 0.2, 0.2)
    gt = spark.createDataFrame([box, box, (1, 8, 1, 0.1, 0.1, 0.1, 0.1)], "image_id bigint, box_id bigint, cls_id int, cx double, cy double, w double, h double")
    pred = gt.filter("box_id = 7").limit(1).withColumnRenamed("box_id", "det_id").withColumn("conf", F.lit(0.9))
    report = {r.cls_id: (r.total, r.matched) for r in match.class_fn_report(gt, pred).collect()}
    assert report == {0: (2, 2), 1: (1, 0)}
    assert match.fn_taxonomy(gt, pred).count() == 2
    assert match.residual_items(gt, pred).count() == 1


def test_alert_windows_equal_the_stream_rule(spark, monkeypatch):
    from doorlens.config import AlertConfig
    from types import SimpleNamespace

    rnd = random.Random(6)
    rows, intent, area = [], "OPEN", 0.2
    for f in range(1, 400):
        intent = intent if rnd.random() < 0.7 else rnd.choice(["OPEN", "CLOSE", "UNKNOWN"])
        area = area if rnd.random() < 0.7 else rnd.choice([0.0, 0.07, 0.09, 0.1, 0.3])
        rows.append((1, "s", f * 3, intent, area))
    d = spark.createDataFrame(rows, "camera_id bigint, session string, frame_seq bigint, intent string, max_area double")
    got = stateful.asym_alert(d, keys=("camera_id", "session")).orderBy("frame_seq").collect()
    s, cfg = stateful.AlertState(), AlertConfig()
    want = [stateful.alert_of_frame(cfg, s, SimpleNamespace(camera_id=1, frame_seq=r[2], intent=r[3], max_area=r[4]))[0] for r in rows]
    assert [(r.state, r.alert) for r in got] == [w[2:4] for w in want] and {r.session for r in got} == {"s"}


def box_tables(spark, seed, images):
    """Ground truth and predictions; image 1 is crowded, confidences and coordinates repeat."""
    rnd = random.Random(seed)
    gt, pred = [], []
    for image in range(1, images + 1):
        n = 30 if image == 1 else rnd.randint(0, 4)
        for rows in (gt, pred):
            for k in range(n):
                x, y = rnd.randint(2, 8) / 10, rnd.randint(2, 8) / 10
                rows.append((image, k, rnd.randint(0, 1), x, y, 0.2, 0.2 + rnd.randint(0, 2) / 20, rnd.randint(1, 4) / 4))
    pred.append((images + 1, 0, 1, 0.5, 0.5, 0.2, 0.2, 0.9))  # an image without ground truth
    cols = "image_id bigint, {} bigint, cls_id int, cx double, cy double, w double, h double, conf double"
    return spark.createDataFrame(gt, cols.format("box_id")).drop("conf"), spark.createDataFrame(pred, cols.format("det_id"))


def true_positives(gt, pred, pairs, t):
    """Plain loops: every prediction claims its best box of its class, the most confident claimant wins the box."""
    claim = {}
    for p in pairs:
        if p.gt_cls == p.pred_cls:
            key = (p.image_id, p.det_id)
            claim[key] = max(claim.get(key, (-1.0, 0)), (p.iou, -p.box_id))
    conf = {(r.image_id, r.det_id): r.conf for r in pred.collect()}
    winner = {}
    for (image, det), (iou, nb) in claim.items():
        if iou >= t:
            winner[image, nb] = max(winner.get((image, nb), (-1.0, 0)), (conf[image, det], -det))
    return {(image, -nd) for (image, _), (_, nd) in winner.items()}


@pytest.mark.parametrize("crowded", [20, 2048])
def test_true_positive_masks(spark, monkeypatch, crowded):
    monkeypatch.setattr(match, "CROWDED", crowded)
    gt, pred = box_tables(spark, 5, 25)
    ious = [0.3, 0.5, 0.8]
    rows = match.per_image(gt, pred, lambda g, p, pairs: match._flagged(pairs(g, p), p, ious)).collect()
    assert len(rows) == pred.count()
    pairs = match.overlaps(gt, pred).collect()
    for i, t in enumerate(ious):
        got = {(r.image_id, r.det_id) for r in rows if r["mask"] >> i & 1}
        assert got and got == true_positives(gt, pred, pairs, t)


def boxes_moved(df):
    """Shuffles on the way of the ordinary images (the first half of the plan) other than the counting of boxes."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    halves = [i for i, line in enumerate(plan) if line.startswith("   +- ")]  # the crowded images
    ordinary = plan[: halves[0]] if halves else plan
    counting = "HashAggregate(keys=[image_id"
    return sum("Exchange hashpartitioning(" in x and counting not in ordinary[i + 1] for i, x in enumerate(ordinary))


def test_bucketed_boxes_meet_without_shuffle(spark, monkeypatch):
    """Tables in as many buckets as shuffle partitions: matching and the taxonomy move no box."""
    gt, pred = box_tables(spark, 6, 40)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"boxes_{random.Random().getrandbits(40):x}" for _ in range(2)]
    want = sorted(match.fn_taxonomy(gt, pred).collect(), key=str)
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    try:
        spark.conf.set(setting, "false")
        for df, name in zip((gt, pred), names):
            sinks.write_by_image(df, name, n)
        got = match.fn_taxonomy(*[spark.table(name) for name in names])
        assert sorted(got.collect(), key=str) == want
        stored, moved = (boxes_moved(match.fn_taxonomy(*x)) for x in ([spark.table(n) for n in names], (gt, pred)))
        assert stored == 0 and moved == 3, (stored, moved)  # boxes with and without corners, predictions
    finally:
        spark.conf.unset(setting)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_substrings_are_not_broadcast(spark):
    """Every pool name stands for all its substrings, which the planner takes for as few rows as there are names."""
    from doorlens.operators import joins
    from doorlens.plans.fixtures import Tables

    pool = spark.createDataFrame([(f"img{i}_{i * 7}.png",) for i in range(50)] + [(None,)], "file_name string")
    names = ["img3", "mg1", "img3_2", "img3_3", "_343.png", "7.pn", "", "img49_343.png!", None]
    out = joins.exclude_contained(spark.createDataFrame([(n,) for n in names], "file_name string"), pool)
    assert {r.file_name for r in out.collect()} == {"img3_3", "img49_343.png!", None}
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = joins.exclude_contained(t.raw_images, t.gold_images)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def shuffles(df):
    return [x.split("Exchange ")[1] for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]


def test_running_sums_shuffle_rows_once(spark):
    """One shuffle for the rows, three for the totals: the window takes the rows as the join with the totals got them."""
    df = spark.createDataFrame([(1, 1, 1.5), (None, 2, None)], "k int, v int, b double")
    out = ranking.two_level_prefix(df, ["k"], [F.col("b")], [F.col("v")], {"run": F.col("v")})
    assert len(shuffles(out)) == 4
    assert sorted((r.k or 0, r.run) for r in out.collect()) == [(0, 2), (1, 1)]


def test_detection_metrics_matches_where_images_lie(spark):
    """The condition on the class deals no box by class once more."""
    gt, pred = box_tables(spark, 6, 40)
    flagged = match.per_image(gt, pred, lambda g, p, pairs: match._flagged(pairs(g, p), p, [0.5]))
    assert not [x for x in shuffles(flagged) if "cls" in x]


def test_threshold_sweep_stores_predictions_and_no_pairs(spark, monkeypatch):
    gt, pred = box_tables(spark, 6, 40)
    stored, settle = [], match.settle
    monkeypatch.setattr(match, "settle", lambda df: stored.append(df.columns) or settle(df))
    assert match.threshold_sweep(gt, pred).count() > 0
    assert stored and not [x for x in stored if "iou" in x]


def test_augmented_names_are_parsed_once_an_image(spark):
    """Augmented boxes: what copies share is made before the copies, and nothing is drawn that the profile fixes."""
    from doorlens.operators import augment

    cols = "image_id bigint, file_name string, open_cnt bigint, close_cnt bigint, is_type_a boolean, min_open_area double"
    images = spark.createDataFrame([(1, "a.b.jpg", 0, 1, False, None), (2, "c.png", 1, 1, True, 0.1)], cols)
    plan = augment.augment_plan(images)
    names = {(r.image_id, r.copy_no): r.out_name for r in plan.collect()}
    assert names[(1, 0)] == "a.b.jpg" and names[(2, 2)] == "c_augment_fn_open_aug_1.jpg"
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    copies = next(i for i, x in enumerate(lines) if "explode(sequence" in x)
    assert not [x for x in lines[:copies] if "regexp" in x] and [x for x in lines[copies:] if "regexp" in x]


def test_second_stage_runs_the_budget_once(spark):
    cols = "camera_id bigint, track_id bigint, frame_seq bigint, missed bigint, det_conf double"
    tracks = spark.createDataFrame([(1, 1, f, 0, 0.9) for f in range(1, 8)], cols)
    asked = stateful.secondary_budget(tracks).select("camera_id", "track_id", "frame_seq", F.lit("open").alias("label"), F.lit(0.5).alias("cls_conf"))
    out = stateful.second_stage(tracks, asked)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.label, r.cls_conf) for r in out.collect()} == {("open", 0.5)}
