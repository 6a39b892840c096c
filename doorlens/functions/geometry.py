"""Box geometry as column expressions. Boxes are either centre form (cx, cy, w, h) or corners (x1, y1, x2, y2)."""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Corners(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


class Centre(NamedTuple):
    cx: Column
    cy: Column
    w: Column
    h: Column


def c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def lit(value: float) -> Column:
    return F.lit(float(value))


def corners(x1="x1", y1="y1", x2="x2", y2="y2") -> Corners:
    return Corners(c(x1), c(y1), c(x2), c(y2))


def centre(cx="cx", cy="cy", w="w", h="h") -> Centre:
    return Centre(c(cx), c(cy), c(w), c(h))


def to_xyxy(box: Centre, width=1.0, height=1.0) -> Corners:
    """Centre form to corners, scaled to pixels when a frame size is given."""
    W = width if isinstance(width, Column) else lit(width)
    H = height if isinstance(height, Column) else lit(height)
    return Corners(
        (box.cx - box.w / 2) * W,
        (box.cy - box.h / 2) * H,
        (box.cx + box.w / 2) * W,
        (box.cy + box.h / 2) * H,
    )


def to_centre(box: Corners) -> Centre:
    return Centre((box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2, box.x2 - box.x1, box.y2 - box.y1)


def clip_box(box: Centre, lo: float = 0.0, hi: float = 1.0) -> Centre:
    """Cut a box to the frame and recompute its centre form."""
    k = to_xyxy(box)
    return to_centre(
        Corners(
            F.greatest(lit(lo), k.x1),
            F.greatest(lit(lo), k.y1),
            F.least(lit(hi), k.x2),
            F.least(lit(hi), k.y2),
        )
    )


def intersection(a: Corners, b: Corners) -> Column:
    zero = lit(0)
    w = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def area(box: Corners) -> Column:
    """Area with negative extents read as zero."""
    zero = lit(0)
    return F.greatest(zero, box.x2 - box.x1) * F.greatest(zero, box.y2 - box.y1)


def iou(a: Corners, b: Corners) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(lit(0))


def polygon_to_box(coords: Column) -> Corners:
    """Enclosing box of a flat x1,y1,x2,y2,… array."""
    xs = F.filter(coords, lambda _, i: i % 2 == 0)
    ys = F.filter(coords, lambda _, i: i % 2 == 1)
    return Corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def is_noise_px(w, h, width, height, min_area: float = 200, min_dim: float = 10) -> Column:
    pw, ph = c(w) * c(width), c(h) * c(height)
    return (pw * ph < lit(min_area)) | (F.least(pw, ph) < lit(min_dim))


def area_ratio(box: Corners, width, height) -> Column:
    return area(box) / F.greatest(c(width) * c(height), F.lit(1)).cast("double")


def aspect_ratio(box: Corners) -> Column:
    w = F.greatest(lit(0), (box.x2 - box.x1).cast("double"))
    h = F.greatest(lit(0), (box.y2 - box.y1).cast("double"))
    return w / F.greatest(h, lit(1))


def near_edge(cx="cx", cy="cy", margin: float = 0.1) -> Column:
    lo, hi = lit(margin), lit(1 - margin)
    return (c(cx) < lo) | (c(cx) > hi) | (c(cy) < lo) | (c(cy) > hi)


def in_rect(box: Corners, roi: Sequence[float]) -> Column:
    mx, my = (box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2
    return mx.between(lit(roi[0]), lit(roi[2])) & my.between(lit(roi[1]), lit(roi[3]))


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]], mode: str = "correct") -> Column:
    """Even-odd rule over a fixed polygon; fewer than three vertices accept everything.

    ``mode="reference"`` floors the edge slope's denominator at 1e-6, which is wrong for downward edges but is
    what existing deployments were tuned with.
    """
    if len(polygon) < 3:
        return F.lit(True)
    inside = F.lit(False)
    for (px, py), (qx, qy) in zip(polygon, [*polygon[1:], polygon[0]]):
        rise = float(qy - py)
        if mode == "reference":
            rise = max(rise, 1e-6)
        elif rise == 0.0:
            continue  # a level edge is never crossed
        straddles = (lit(py) > y) != (lit(qy) > y)
        hit = straddles & (x < lit(qx - px) * (y - lit(py)) / lit(rise) + lit(px))
        inside = inside != hit
    return inside


def in_region(x: Column, y: Column, polygon: Column, mode: str = "correct") -> Column:
    """As ``in_polygon`` for a polygon that is data: an array of structs x, y. Null and fewer than three vertices accept
    everything."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))

    def crossed(p: Column, q: Column) -> Column:
        rise = (q["y"] - p["y"]).cast("double")
        rise = F.greatest(rise, lit(1e-6)) if mode == "reference" else rise
        straddles = (p["y"] > y) != (q["y"] > y)  # a level edge is never crossed
        return straddles & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), rise) + p["x"])

    crossings = F.size(F.filter(F.zip_with(polygon, following, crossed), lambda hit: hit))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) < 3, F.lit(True)).otherwise(crossings % 2 == 1)


def center_shift(a: Corners, b: Corners, width, height) -> Column:
    dx = ((b.x1 + b.x2) / 2 - (a.x1 + a.x2) / 2) / F.greatest(c(width), F.lit(1))
    dy = ((b.y1 + b.y2) / 2 - (a.y1 + a.y2) / 2) / F.greatest(c(height), F.lit(1))
    return F.sqrt(dx * dx + dy * dy)


def clamp_xyxy(box: Corners, width, height) -> Corners:
    """Cut integer corners to the frame; the ten-pixel filter is ``wide_enough``."""
    zero = F.lit(0)

    def cut(v, top):
        return F.greatest(zero, F.least(c(top), v)).cast("int")

    return Corners(cut(box.x1, width), cut(box.y1, height), cut(box.x2, width), cut(box.y2, height))


def wide_enough(box: Corners, min_px: int = 10) -> Column:
    return (box.x2 - box.x1 >= min_px) & (box.y2 - box.y1 >= min_px)


def offset_box(box: Corners, dx, dy) -> Corners:
    return Corners(box.x1 + c(dx), box.y1 + c(dy), box.x2 + c(dx), box.y2 + c(dy))


def distance_bucket(ratio: Column, near: float = 0.25, mid: float = 0.05) -> Column:
    return F.when(ratio > lit(near), "near").when(ratio > lit(mid), "mid").otherwise("far")
