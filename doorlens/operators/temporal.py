"""Per-camera votes, streak events and motion features as window expressions.

Frame columns are dense (every frame of a camera has a row), see ``ranking.number_rows``. Windows with a fixed
look-back use ``look_back`` (one shuffle); rules that remember further back add ``carry_last``.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.config import MOTION_PRESETS
from doorlens.functions.geometry import c, lit
from doorlens.operators.ranking import SPAN, block_of, carry_last, look_back, number_rows, recent_values

KEYS = ("camera_id",)
ORDER = "frame_seq"


def frame_opinions(dets: DataFrame) -> DataFrame:
    """One row per frame: OPEN if any open detection, CLOSE if only others. Frames without detections are added by the
    caller as null opinions."""
    has_open = F.bool_or(c("label") == "open")
    return dets.groupBy("camera_id", "frame_seq").agg(F.when(has_open, "OPEN").otherwise("CLOSE").alias("opinion"))


def vote_state(frames: DataFrame, window: int = 10, ratio: float = 0.6, keys: Sequence[str] = KEYS) -> DataFrame:
    """State after each frame: switches when one opinion fills its share of the last ``window`` opinions."""
    need = window * ratio
    d = recent_values(frames, keys, ORDER, c("opinion"), window, "_h")
    opens = F.size(F.filter("_h", lambda o: o == "OPEN"))
    closes = F.size("_h") - opens
    decided = F.when(opens >= lit(need), "OPEN").when(closes >= lit(need), "CLOSE")
    d = carry_last(d.withColumn("_d", decided), keys, ORDER, {"_s": c("_d")})
    return d.withColumn("state", F.coalesce("_s", F.lit("CLOSE"))).drop("_h", "_d", "_s")


def persistence(frames: DataFrame, window: int = 5, required: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts and tail streaks of open and close over the last ``window`` frames."""

    def build(d: DataFrame, w) -> DataFrame:
        recent = w(-(window - 1), 0)
        for name in ("open", "close"):
            hit = c("label") == name
            d = d.withColumn(f"{name}_count", F.count_if(hit).over(recent))
        d = d.withColumn("_h", F.collect_list("label").over(recent))
        for name in ("open", "close"):
            # rows since the last other label, limited to the window
            pos = F.array_position(F.transform(F.reverse("_h"), lambda x: x == name), F.lit(False))
            d = d.withColumn(f"{name}_streak", F.when(pos == 0, F.size("_h")).otherwise(pos - 1).cast("bigint"))
            d = d.withColumn(f"{name}_confirmed", c(f"{name}_count") >= required)
        return d.drop("_h")

    return look_back(frames, keys, ORDER, window - 1, build)


def behavior_events(frames: DataFrame, min_hits: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Opening/closing start events, steady states in between, ``idle`` before the first decision."""

    def build(d: DataFrame, w) -> DataFrame:
        run = w(-(min_hits - 1), 0)
        same = (F.count("label").over(run) == min_hits) & (
            F.min("label").over(run) == F.max("label").over(run)
        )
        return d.withColumn("_flip", F.when(same & c("label").isin("open", "close"), c("label")))

    d = look_back(frames, keys, ORDER, min_hits - 1, build)
    d = carry_last(d, keys, ORDER, {"_before": c("_flip")}, exclusive=True)
    before = F.coalesce("_before", F.lit("unknown"))
    starts = c("_flip").isNotNull() & (c("_flip") != before)
    stable = F.coalesce("_flip", before)
    event = (
        F.when(starts & (c("_flip") == "open"), "door_opening")
        .when(starts, "door_closing")
        .when(stable == "open", "door_open")
        .when(stable == "close", "door_closed")
        .otherwise("idle")
    )
    d = d.withColumn("event_name", event).withColumn("state_flag", F.when(starts, "Start").otherwise("Ongoing"))
    d = d.withColumn("transition", F.when(starts, F.concat(before, F.lit("->"), c("_flip"))))
    return d.withColumn("stable_label", stable).drop("_flip", "_before")


def transition_trace(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Transitions in order, one row each with its position in the camera's trace."""
    d = events.filter(c("transition").isNotNull()).select(*keys, ORDER, "transition")
    return number_rows(d, keys, block_of(ORDER), [ORDER], "step")


def flicker_count(frames: DataFrame, value: str, size: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """Changes of ``value`` per bucket of ``size`` frames."""

    def build(d: DataFrame, w) -> DataFrame:
        prev = F.first(value).over(w(-1, -1))
        return d.withColumn("_chg", F.coalesce(prev != c(value), F.lit(False)))

    d = look_back(frames, keys, ORDER, 1, build)
    bucket = F.floor((c(ORDER) - 1) / size)
    return d.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("_chg").alias("flickers")
    )


def state_change_events(frames: DataFrame, state: str = "state", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows only where the stable state changed; a fall back to UNKNOWN is reported as a timeout."""

    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_prev", F.first(state).over(w(-1, -1)))

    d = look_back(frames, keys, ORDER, 1, build).filter(c("_prev") != c(state))
    name = F.when(c(state) == "UNKNOWN", "STATE_TIMEOUT_UNKNOWN").otherwise(F.concat(F.lit("STATE_CHANGED_"), c(state)))
    return d.withColumn("event", name).withColumnRenamed("_prev", "previous")


# -- camera motion -----------------------------------------------------------------------------------------------

MOTION_WINDOW = 8


def motion_features(motion: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Statistics of the last eight motions per frame; ``samples`` tells how many there were."""
    n = MOTION_WINDOW

    def build(d: DataFrame, w) -> DataFrame:
        recent, inner, back = w(-(n - 1), 0), w(-(n - 2), 0), w(-1, -1)
        deg = c("da") * lit(180 / math.pi)
        d = d.withColumn("_deg", deg).withColumn("_t", F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))
        for v in ("dx", "dy", "_deg"):
            d = d.withColumn(f"_p{v}", F.first(v).over(back))

        def ratio(v: str, eps: float) -> Column:
            both = (F.abs(c(v)) > lit(eps)) & (F.abs(c(f"_p{v}")) > lit(eps))
            flip = both & (F.signum(v) != F.signum(c(f"_p{v}")))
            k = F.count_if(both).over(inner)
            return F.when(k > 0, F.count_if(flip).over(inner) / k).otherwise(lit(0))

        def diff(v: str) -> Column:
            return F.avg(F.abs(c(v) - c(f"_p{v}"))).over(inner)

        # inside the first frame of the window its predecessor is outside: inner starts one frame later
        moving = c("_t") > lit(0.5)
        cos, sin = F.when(moving, c("dx") / c("_t")), F.when(moving, c("dy") / c("_t"))
        mc, ms = F.avg(cos).over(recent), F.avg(sin).over(recent)
        return d.select(
            *[x for x in motion.columns],
            "_blk",
            F.count(F.lit(1)).over(recent).alias("samples"),
            F.avg("_t").over(recent).alias("mean_trans"),
            F.max("_t").over(recent).alias("max_trans"),
            F.stddev_pop("_t").over(recent).alias("std_trans"),
            F.avg(F.abs("_deg")).over(recent).alias("mean_rot_deg"),
            F.max(F.abs("_deg")).over(recent).alias("max_rot_deg"),
            (diff("dx") + diff("dy") + diff("_deg") * 2).alias("jerk"),
            ((ratio("dx", 0.35) + ratio("dy", 0.35) + ratio("_deg", 0.05)) / 3).alias("sign_changes"),
            F.when(F.count(cos).over(recent) > 0, F.sqrt(mc * mc + ms * ms)).otherwise(lit(1)).alias("direction_consistency"),
        )

    return look_back(motion, keys, ORDER, n, build)


def motion_mode(features: DataFrame) -> DataFrame:
    """Mode candidate and confidence per frame from its motion features."""

    def score(*conds: Column) -> Column:
        return sum((F.when(x, 1).otherwise(0) for x in conds[1:]), F.when(conds[0], 1).otherwise(0))

    t, mx, sd, mr, xr, j, sc, dc = (
        c(x)
        for x in (
            "mean_trans", "max_trans", "std_trans", "mean_rot_deg", "max_rot_deg", "jerk", "sign_changes",
            "direction_consistency",
        )
    )
    violent = score(
        (mx > 8.0) | (xr > 0.8), j > 5.0, sc > lit(0.45), sd > 3.0, (dc < lit(0.45)) & (t > 2.0)
    )
    sway = score((t > 2.5) | (mr > 0.25), (mx > 5.0) | (xr > lit(0.6)), dc > lit(0.65), sc < lit(0.35), j < 5.5)
    short = c("samples") < 3
    d = features.withColumn("_v", violent).withColumn("_s", sway)
    is_v = (c("_v") >= 3) | ((c("_v") >= 2) & (mx > 10.0))
    is_s = c("_s") >= 4
    mode = F.when(short, "normal").when(is_v, "violent").when(is_s, "large_sway").otherwise("normal")
    conf = (
        F.when(short, lit(0))
        .when(is_v, c("_v") / 5)
        .when(is_s, c("_s") / 5)
        .otherwise(F.greatest(lit(0), 1 - t / 8))
    )
    return d.withColumn("mode", mode).withColumn("confidence", conf).drop("_v", "_s")


def preset(index: int, mode: str = "mode") -> Column:
    out = None
    for name, values in MOTION_PRESETS.items():
        cond = c(mode) == name
        out = F.when(cond, lit(values[index])) if out is None else out.when(cond, lit(values[index]))
    return out


def gain_schedule(motion: DataFrame, alpha_offset: float = 0.0) -> DataFrame:
    """Damped and limited correction per frame for the frame's mode."""
    rad = lit(math.pi / 180)

    def limit(v: Column, top: Column) -> Column:
        return F.greatest(-top, F.least(top, v))

    return motion.select(
        "*",
        F.least(lit(0.92), F.greatest(lit(0.60), preset(0) + lit(alpha_offset))).alias("alpha"),
        limit(c("dx") * preset(3), preset(1)).alias("out_dx"),
        limit(c("dy") * preset(3), preset(1)).alias("out_dy"),
        limit(c("da") * preset(4), preset(2) * rad).alias("out_da"),
    )


def episodes(
    df: DataFrame,
    value: Column,
    max_gap: float,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
    unique: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """Adds ``episode``: the order value at which the current run began. A run ends where ``value`` jumps by more
    than ``max_gap``. Rows that share an order value (detections of one frame) stay together; ``unique`` says there
    are none. Works block by block; only a table of block ends is windowed per key."""
    keys = list(keys)
    if unique:
        steps = df.withColumn("_x", value)
    else:
        steps = df.groupBy(*keys, order).agg(F.min(value).alias("_x"))
    steps = steps.withColumn("_blk", block_of(order, span))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    gap = lit(max_gap)
    steps = steps.withColumn("_begin", F.when(c("_x") - F.lag("_x").over(inside) > gap, c(order)))
    ends = steps.groupBy(*keys, "_blk").agg(
        F.min_by("_x", order).alias("_fx"),
        F.max_by("_x", order).alias("_lx"),
        F.min(order).alias("_fo"),
        F.max("_begin").alias("_li"),
    )
    chain = Window.partitionBy(*keys).orderBy("_blk")
    before = F.lag("_lx").over(chain)
    ends = ends.withColumn("_fb", F.when(before.isNull() | (c("_fx") - before > gap), c("_fo")))
    carried = F.last(F.coalesce("_li", "_fb"), True).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "_blk", F.coalesce("_fb", carried).alias("_head"))
    steps = steps.join(ends, [*keys, "_blk"], "left")
    own = F.last("_begin", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("episode", F.coalesce(own, c("_head")))
    if unique:
        return steps.select(*df.columns, "episode")
    return df.join(steps.select(*keys, order, "episode"), [*keys, order])
