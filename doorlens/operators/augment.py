"""Augmentation plan and its effect on boxes. Pixel work is the caller's; this decides what and where."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.config import AugmentConfig
from doorlens.functions import geometry as G
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import draw, u01
from doorlens.functions.text import augmented_stem, stem
from doorlens.operators.repair import once

# Fixed values per profile: flip chance, scale range, share of copies that are scaled, translation, rotation (degrees).
PROFILES = {
    "mixed_boundary": (0.5, 1.0, 1.0, 0.0, 0.0, 0.0),
    "small_object_open": (0.0, 0.8, 1.2, 1.0, 0.0, 0.0),
    "open_normal": (0.0, 0.8, 1.1, 0.7, 0.0, 0.0),
    "close_fp_like": (0.0, 1.0, 1.0, 0.0, 0.0, 0.0),
    "hard_negative": (0.0, 1.0, 1.0, 0.0, 0.0, 0.0),
    "augment_fn_open": (0.0, 0.5, 1.5, 1.0, 0.2, 10.0),
}


def profile_of(cfg: AugmentConfig = AugmentConfig()) -> Column:
    has_open, has_close = c("open_cnt") > 0, c("close_cnt") > 0
    return (
        F.when(has_open & c("is_type_a"), "augment_fn_open")
        .when(has_open & has_close, "mixed_boundary")
        .when(has_open & (c("min_open_area") < lit(cfg.small_area)), "small_object_open")
        .when(has_open, "open_normal")
        .when(has_close, "close_fp_like")
        .otherwise("hard_negative")
    )


def augment_plan(images: DataFrame, cfg: AugmentConfig = AugmentConfig()) -> DataFrame:
    """One row per output image: ``copy_no`` 0 is the original, later ones are augmented copies."""
    times = F.when(c("open_cnt") > 0, cfg.open_multiplier).otherwise(cfg.other_multiplier)
    d = images.withColumn("profile", profile_of(cfg)).withColumn("multiplier", times)
    d = once(d, _stem=stem("file_name"))  # its regular expression runs per image, not per copy
    d = d.withColumn("copy_no", F.explode(F.sequence(F.lit(0), c("multiplier") - 1)))
    name = F.when(c("copy_no") == 0, c("file_name")).otherwise(
        F.concat(augmented_stem(c("_stem"), c("profile"), c("copy_no") - 1), F.lit(".jpg"))
    )
    return d.select("image_id", "profile", "multiplier", "copy_no", name.alias("out_name"))


def _by_profile(i: int) -> Column:
    out = None
    for name, values in PROFILES.items():
        cond = c("profile") == name
        out = F.when(cond, lit(values[i])) if out is None else out.when(cond, lit(values[i]))
    return out.otherwise(lit(0))


def augment_boxes(plan: DataFrame, boxes: DataFrame, cfg: AugmentConfig = AugmentConfig()) -> DataFrame:
    """Boxes of every augmented copy: flip, scale about the centre, shift, rotate corners, clip, drop if mostly cut off.

    All random parameters are hashes of (copy, purpose), so a copy's boxes move together and reruns agree.
    """
    copies = plan.filter(c("copy_no") > 0)

    def u(tag: str) -> Column:
        return u01(draw(cfg.seed, F.lit(tag), "image_id", "copy_no"))

    def spread(i: int, value: Column) -> Column:
        """A draw is made only where the profile leaves something to draw."""
        return F.when(_by_profile(i) != 0, value * _by_profile(i)).otherwise(lit(0))

    share, low, high = (_by_profile(i) for i in (3, 1, 2))
    scaled = (share > 0) & ((share >= 1) | (u("do_scale") < share))
    factor = F.when(scaled, low + (high - low) * u("scale")).otherwise(lit(1))
    p = copies.select(
        "image_id",
        "profile",
        "copy_no",
        "out_name",
        ((_by_profile(0) > 0) & (u("flip") < _by_profile(0))).alias("flip"),
        factor.alias("s"),
        spread(4, u("tx") * 2 - 1).alias("tx"),
        spread(4, u("ty") * 2 - 1).alias("ty"),
        (spread(5, u("rot") * 2 - 1) * lit(math.pi / 180)).alias("a"),
    )
    lo, hi = cfg.margin, 1 - cfg.margin
    base = G.clip_box(G.centre(), lo, hi)
    b = boxes.select("image_id", "box_id", "cls_id", *[v.alias(f"_{n}") for n, v in base._asdict().items()])
    d = p.join(b, "image_id")
    cx = F.when(c("flip"), 1 - c("_cx")).otherwise(c("_cx")) - 0.5
    cy = c("_cy") - 0.5
    cos, sin = F.cos("a"), F.sin("a")
    nx = (cx * cos - cy * sin) * c("s") + 0.5 + c("tx")
    ny = (cx * sin + cy * cos) * c("s") + 0.5 + c("ty")
    # enclosing box of the rotated rectangle
    nw = (c("_w") * F.abs(cos) + c("_h") * F.abs(sin)) * c("s")
    nh = (c("_w") * F.abs(sin) + c("_h") * F.abs(cos)) * c("s")
    d = once(d, cx=nx, cy=ny, w=nw, h=nh)
    cut = G.clip_box(G.centre())
    visible = F.when(c("w") * c("h") > 0, F.greatest(lit(0), cut.w) * F.greatest(lit(0), cut.h) / (c("w") * c("h")))
    out = d.select(
        "image_id", "box_id", "cls_id", "copy_no", "profile", "out_name",
        cut.cx.alias("cx"), cut.cy.alias("cy"), cut.w.alias("w"), cut.h.alias("h"), visible.alias("visible"),
    )
    return out.filter(c("visible") >= lit(cfg.min_visible))
