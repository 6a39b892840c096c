"""Train/validation split by scene, open-sample safeguard and per-version cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorlens.config import SplitConfig
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import draw, hash_bucket
from doorlens.functions.text import scene_of_stem, stem
from doorlens.operators.ranking import hash_rank, two_level_prefix
from doorlens.operators.repair import once
from doorlens.operators.settle import settle


def with_scene(images: DataFrame) -> DataFrame:
    """Adds ``scene``; the regular expressions run once per image, however often the scene is used later."""
    d = once(images, _stem=stem("file_name"))
    return once(d, scene=scene_of_stem(c("_stem"))).drop("_stem")


def version_seeds(units: DataFrame, seed: int) -> DataFrame:
    """Image and scene counts and the seed of each version (base plus the version's position in name order).

    ``units`` has one row per version and scene; the result one per version, as many as there are directories.
    """
    names = units.groupBy("version").agg(F.sum("n").alias("v_images"), F.count(F.lit(1)).alias("n_scenes"))
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("version"))
    return names.withColumn("v_seed", (F.lit(seed) + pos - 1).cast("bigint"))


def scene_split(images: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Adds ``split``: whole scenes go to train or val. A version that is one scene is split image by image.

    Input has ``version``, ``scene``, ``image_id``. The drawing order is a hash, so ranks are computed per hash bucket
    and a version of any size stays spread over many tasks.
    """
    units = settle(images.groupBy("version", "scene").agg(F.count(F.lit(1)).alias("n")))
    info = version_seeds(units, cfg.seed)
    units = units.join(info, "version").withColumn("_d", draw(c("v_seed"), "version", "scene"))
    ranked = hash_rank(units, ["version"], "_d", "rk", ["scene"])
    take = F.greatest(F.lit(1), F.floor(c("n_scenes") * lit(cfg.ratio)))
    single = (c("n_scenes") <= 1) & (c("v_images") > 1)
    by_scene = ranked.filter(~single).select("version", "scene", F.when(c("rk") <= take, "train").otherwise("val").alias("split"))
    whole = images.join(by_scene, ["version", "scene"])

    lone = info.filter(single).select("version", "v_seed", "v_images")
    each = images.join(lone, "version").withColumn("_d", draw(c("v_seed"), "version", "image_id"))
    each = hash_rank(each, ["version"], "_d", "_rk", ["image_id"])
    cut = F.when(c("_rk") <= F.floor(c("v_images") * lit(cfg.ratio)), "train").otherwise("val")
    cols = [*images.columns, "split"]
    return whole.select(*cols).unionByName(each.withColumn("split", cut).select(*cols))


def open_safeguard(split: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Moves the smallest open-bearing train scenes to val until val holds its share, within the train floor.

    Both stop rules only tighten as scenes are taken, so the moved scenes are a prefix: a scene moves while the val
    count before it is below target and the train count after it is not below the floor, for it and all before it.
    """
    is_open = c("open_cnt") > 0
    scenes = settle(
        split.groupBy("version", "scene", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_open).alias("opens"))
    )
    totals = scenes.groupBy("version").agg(
        F.sum("opens").alias("all_open"),
        F.sum(F.when(c("split") == "val", c("opens")).otherwise(F.lit(0))).alias("val_open"),
    )
    floor_ = F.lit(cfg.min_images)
    totals = totals.select(
        "version",
        "all_open",
        "val_open",
        (c("all_open") - c("val_open")).alias("train_open"),
        F.greatest(floor_, F.bround(c("all_open") * lit(cfg.val_share)).cast("bigint")).alias("target"),
        F.greatest(floor_, F.bround(c("all_open") * lit(cfg.train_floor)).cast("bigint")).alias("keep"),
    ).filter(c("all_open") >= cfg.min_images)
    train = scenes.filter((c("split") == "train") & (c("opens") > 0)).withColumn("_d", F.md5("scene"))
    run = two_level_prefix(
        train, ["version"], [c("n"), hash_bucket(c("_d"))], [c("n"), c("_d"), c("scene")], {"run": c("opens")}
    )
    run = run.join(totals, "version")
    before = c("run") - c("opens")
    move = (c("val_open") + before < c("target")) & (c("train_open") - c("run") >= c("keep"))
    moved = run.filter(move).select("version", "scene", F.lit(True).alias("_m"))
    d = split.join(moved, ["version", "scene"], "left")
    return d.withColumn("moved", F.coalesce("_m", F.lit(False))).withColumn(
        "split", F.when(c("moved"), "val").otherwise(c("split"))
    ).drop("_m")


def domain_cap(split: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Keeps at most a fixed share of the total as train images of one version, drawn by hash; val is untouched."""
    total = split.agg(F.count(F.lit(1)))
    cap = F.floor(total.scalar() * lit(cfg.ratio) * lit(cfg.domain_share))
    d = split.withColumn("_d", draw(cfg.seed + cfg.cap_seed_offset, "version", "image_id"))
    train = hash_rank(d.filter(c("split") == "train"), ["version"], "_d", "_rk", ["image_id"])
    train = train.filter(c("_rk") <= cap).drop("_rk")
    return train.unionByName(d.filter(c("split") != "train")).drop("_d")
