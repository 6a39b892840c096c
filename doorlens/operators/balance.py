"""Class balance: oversampling of open images, scored close-only fill and a background cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.config import BalanceConfig
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import draw, u01
from doorlens.operators.ranking import hash_rank, two_level_prefix
from doorlens.operators.settle import settle

# Input of all operators here: one row per image with image_id, scene, open_cnt, close_cnt, is_error, is_type_a and
# close_near_edge (any close box near the frame edge).


def image_features(images: DataFrame, boxes: DataFrame) -> DataFrame:
    from doorlens.functions.geometry import near_edge

    n = boxes.groupBy("image_id").agg(
        F.count_if(c("cls_id") == 0).alias("open_cnt"),
        F.count_if(c("cls_id") == 1).alias("close_cnt"),
        F.bool_or((c("cls_id") == 1) & near_edge()).alias("close_near_edge"),
        F.min(F.when(c("cls_id") == 0, c("w") * c("h"))).alias("min_open_area"),
    )
    d = images.join(n, "image_id", "left").na.fill(0, ["open_cnt", "close_cnt"])
    return d.withColumn("close_near_edge", F.coalesce("close_near_edge", F.lit(False)))


def copies(cfg: BalanceConfig = BalanceConfig()) -> Column:
    """How often an open image is kept: Type-A four times, error images three times, others once or twice."""
    coin = u01(draw(cfg.seed, F.lit("copy"), "image_id")) < lit(0.5)
    return F.when(c("is_type_a"), 4).when(c("is_error"), 3).when(coin, 2).otherwise(1)


def oversample_open(images: DataFrame, cfg: BalanceConfig = BalanceConfig()) -> DataFrame:
    """Open images, one row per copy with ``replica_id``."""
    d = images.filter(c("open_cnt") > 0)
    return d.withColumn("replica_id", F.explode(F.sequence(F.lit(1), copies(cfg))))


def close_score(cfg: BalanceConfig = BalanceConfig()) -> Column:
    bonus = F.when(c("is_error"), lit(cfg.error_bonus)).otherwise(lit(0))
    penalty = F.when(c("close_near_edge"), lit(cfg.edge_penalty)).otherwise(lit(0))
    return F.greatest(lit(0.1), lit(10) + bonus + penalty)


def score_close(images: DataFrame, cfg: BalanceConfig = BalanceConfig()) -> DataFrame:
    """Close-only images with score and drawing priority (score times a repeatable random number)."""
    d = images.filter((c("open_cnt") == 0) & (c("close_cnt") > 0))
    digest = draw(cfg.seed, F.lit("close"), "image_id")
    return d.withColumn("score", close_score(cfg)).withColumn("priority", c("score") * u01(digest))


def fill_close(images: DataFrame, cfg: BalanceConfig = BalanceConfig()) -> DataFrame:
    """Close-only images taken in priority order until the close target is met, at most ``scene_cap`` per scene.

    Skipping a scene at its cap does not depend on the box count, so: rank inside the scene first (Spark keeps only
    the first ``scene_cap`` rows of a scene before the shuffle), then a running close count over priority ranges.
    """
    return _fill_close(settle(images), cfg)


def _fill_close(images: DataFrame, cfg: BalanceConfig) -> DataFrame:
    copies_n = copies(cfg).cast("bigint")
    kept = images.filter(c("open_cnt") > 0)
    need = kept.agg(
        F.coalesce(
            F.sum(copies_n * c("open_cnt")) * lit(cfg.target_ratio) - F.sum(copies_n * c("close_cnt")), lit(0)
        )
    )
    used = kept.groupBy("scene").agg(F.sum(copies_n).alias("used"))
    scored = score_close(images, cfg)
    in_scene = Window.partitionBy("scene").orderBy(F.desc("priority"), "image_id")
    top = scored.withColumn("_rn", F.row_number().over(in_scene)).filter(c("_rn") <= cfg.scene_cap)
    top = top.join(used, "scene", "left")
    top = top.filter(c("_rn") <= F.lit(cfg.scene_cap) - F.coalesce("used", F.lit(0))).drop("_rn", "used")
    run = two_level_prefix(
        settle(top),  # at most scene_cap rows per scene
        [],
        [-F.floor(c("priority") * 200)],
        [F.desc("priority"), c("image_id")],
        {"close_before": c("close_cnt")},
        inclusive=False,
    )
    return run.filter(c("close_before").cast("double") < need.scalar())


def cap_background(images: DataFrame, limit: Column, cfg: BalanceConfig = BalanceConfig()) -> DataFrame:
    """Background images drawn by hash, at most ``limit`` (a scalar column)."""
    d = images.filter((c("open_cnt") == 0) & (c("close_cnt") == 0))
    d = d.withColumn("_d", draw(cfg.seed, F.lit("bg"), "image_id"))
    return hash_rank(d, [], "_d", "bg_rank", ["image_id"]).filter(c("bg_rank") <= limit).drop("_d")


def balance(images: DataFrame, cfg: BalanceConfig = BalanceConfig()) -> DataFrame:
    """Whole balance job: open copies, filled close-only images and capped background, tagged by ``role``."""
    cols = ["image_id", "version", "scene", "open_cnt", "close_cnt", "is_error", "is_type_a", "replica_id"]
    images = settle(images.select(*cols[:-1], "close_near_edge"))  # read by every branch below
    opens = oversample_open(images, cfg)
    close = settle(_fill_close(images, cfg)).withColumn("replica_id", F.lit(1))
    n_open = images.filter(c("open_cnt") > 0).agg(F.coalesce(F.sum(copies(cfg).cast("bigint")), F.lit(0)))
    n_close = close.agg(F.count(F.lit(1)))
    cap = F.floor((n_open.scalar() + n_close.scalar()) * lit(cfg.max_bg_ratio))
    bg = cap_background(images, cap, cfg).withColumn("replica_id", F.lit(1))
    parts = [d.select(*cols, F.lit(r).alias("role")) for d, r in ((opens, "open"), (close, "close"), (bg, "background"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def balance_manifest(balanced: DataFrame, images: DataFrame, cfg: BalanceConfig = BalanceConfig()) -> DataFrame:
    """One row of totals that the balance gate reads."""
    has_close = images.agg(F.coalesce(F.sum("close_cnt"), F.lit(0)))
    d = balanced.agg(
        F.coalesce(F.sum("open_cnt"), F.lit(0)).alias("open_boxes"),
        F.coalesce(F.sum("close_cnt"), F.lit(0)).alias("close_boxes"),
        F.count_if(c("role") == "close").alias("close_only_sampled"),
    )
    ratio = F.when(c("open_boxes") > 0, F.round(c("close_boxes") / c("open_boxes"), 6)).otherwise(lit(0))
    return d.select(
        "open_boxes",
        "close_boxes",
        "close_only_sampled",
        ratio.alias("final_ratio"),
        lit(cfg.target_ratio).alias("target_ratio"),
        has_close.scalar().alias("source_close_boxes"),
    )
