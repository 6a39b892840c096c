"""The affine scan and the path smoothing built on it, against a plain loop; no Python in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from doorlens.operators import stateful
from doorlens.operators.ranking import affine_scan, number_rows, block_of


def loop(rows):
    """out per axis for rows (camera, frame, dx, dy, da, alpha) by the recurrence of sums and smoothed sums."""
    out, state = {}, {}
    for camera, frame, *moves, alpha in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total, smooth = state.setdefault(camera, ([0.0] * 3, [0.0] * 3))
        got = []
        for i, v in enumerate(moves):
            v = v or 0.0
            total[i] += v
            smooth[i] = alpha * smooth[i] + (1 - alpha) * total[i]
            got.append(v + smooth[i] - total[i])
        out[camera, frame] = got
    return out


@pytest.mark.parametrize("span,levels", [(4, 1), (3, 2), (256, 2), (2, 5)])
def test_scan_equals_a_loop(spark, span, levels):
    rng = random.Random(span)
    rows = []
    for camera, n in ((1, 150), (2, 1), (None, 40), (3, 64)):
        frame = 0
        for _ in range(n):
            frame += rng.choice([1, 1, 1, 7, 5000])
            rows.append((camera, frame, rng.uniform(-2, 2), rng.choice([0.0, 0.5, 0.9, 1.0, None])))
    d = spark.createDataFrame(rows, "camera_id bigint, frame_seq bigint, v double, a double")
    got = affine_scan(d, ["camera_id"], "frame_seq", F.col("a"), {"x": F.col("v"), "y": -2 * F.col("v")}, span, levels).collect()
    want, x = {}, {}
    for camera, frame, v, a in rows:
        x[camera] = (a or 0.0) * x.get(camera, 0.0) + v
        want[camera, frame] = x[camera]
    assert len(got) == len(rows)
    assert all(abs(r.x - want[r.camera_id, r.frame_seq]) < 1e-9 and abs(r.y + 2 * r.x) < 1e-9 for r in got)


def test_smoothing_equals_the_recurrence(spark):
    rng = random.Random(1)
    rows = [(k % 3 if k % 3 else None, k // 3 * 2, rng.gauss(0, 3), rng.gauss(0, 3), None if k % 50 == 0 else rng.gauss(0, 1)) for k in range(3000)]
    d = spark.createDataFrame(rows, "camera_id bigint, frame_seq bigint, dx double, dy double, da double")
    want = loop([(*r, 0.8) for r in rows])
    got = stateful.smooth_trajectory(d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r.out_dx, r.out_dy, r.out_da] == pytest.approx(want[r.camera_id, r.frame_seq], abs=1e-9)


def test_a_long_camera_is_many_tasks(spark):
    """A million frames of one camera: thousands of blocks, no Python, equal to the loop."""
    n = 1_000_000
    move = lambda m: F.pmod(F.col("id") * m, F.lit(101)) / 10.0 - 5
    d = spark.range(1, n + 1).select(F.lit(1).alias("camera_id"), F.col("id").alias("frame_seq"), move(7).alias("dx"), move(11).alias("dy"), move(13).alias("da"))
    out = stateful.smooth_trajectory(d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    blocks = number_rows(d, ["camera_id"], block_of("frame_seq"), ["frame_seq"], "_no").select(F.floor((F.col("_no") - 1) / 512).alias("b")).distinct().count()
    assert blocks > 200
    at = [1, 2, 257, 512, 513, 65_537, 262_145, 500_000, n]
    got = {r.frame_seq: r.out_dx for r in out.filter(F.col("frame_seq").isin(at)).collect()}
    gap = 0.0
    for k in range(1, n + 1):
        v = (k * 7 % 101) / 10.0 - 5
        gap = 0.8 * (gap - v)
        if k in got:
            assert got[k] == pytest.approx(v + gap, abs=1e-9)
    assert set(got) == set(at) and out.count() == n
