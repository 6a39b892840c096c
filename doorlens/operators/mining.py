"""Sample mining from detections, and name-based deduplication across versions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.config import MINING_BUCKETS, OPEN
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import cosine, softmax
from doorlens.functions.text import boost_name, mined_name
from doorlens.operators.joins import exclude_contained, exclude_existing


def bucket_of(conf: Column, buckets: Sequence[tuple] = MINING_BUCKETS) -> Column:
    """First bucket that contains ``conf`` (both ends inclusive), else null."""
    out = None
    for name, lo, hi in buckets:
        hit = conf.between(lit(lo), lit(hi))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def mine_buckets(dets: DataFrame, buckets: Sequence[tuple] = MINING_BUCKETS) -> DataFrame:
    top = dets.groupBy("image_id").agg(F.max("conf").alias("max_conf"))
    return top.withColumn("bucket", bucket_of(c("max_conf"), buckets)).filter(c("bucket").isNotNull())


def mine_hard_negatives(
    dets: DataFrame,
    close_conf: float = 0.35,
    open_conf: float = 0.25,
    uncertain: tuple[float, float] = (0.15, 0.35),
    per_bucket: int | None = None,
    total: int | None = None,
) -> DataFrame:
    """Images by the kind of their most confident box; ``per_bucket`` and ``total`` are optional review quotas, which
    take the first ones in image order."""
    seen = dets.filter(c("conf") >= lit(uncertain[0]))
    best = seen.groupBy("image_id").agg(F.max(F.struct("conf", (-c("det_id")).alias("nd"), "cls_id")).alias("b"))
    conf, cls = c("b.conf"), c("b.cls_id")
    bucket = (
        F.when((cls == 1) & (conf >= lit(close_conf)), "fp_close_high")
        .when((cls == 0) & (conf >= lit(open_conf)), "fp_open_high")
        .when((conf >= lit(uncertain[0])) & (conf < lit(uncertain[1])), "uncertain_review")
    )
    d = best.select("image_id", conf.alias("max_conf"), bucket.alias("bucket")).filter(c("bucket").isNotNull())
    if per_bucket is not None:
        first = Window.partitionBy("bucket").orderBy("image_id")
        d = d.withColumn("_rn", F.row_number().over(first)).filter(c("_rn") <= per_bucket).drop("_rn")
    return d if total is None else d.orderBy("image_id").limit(total)


def open_tier(conf: Column, video: bool) -> Column:
    low = F.when(conf >= lit(0.6), "high").when(conf > lit(0.3), "mid")
    return low.when(conf > lit(0.1), "low").otherwise("edge") if video else low.otherwise("low")


def mine_open(
    dets: DataFrame, images: DataFrame, pool: DataFrame | None = None, target: int | None = None, min_conf: float = 0.1,
    video: bool = False,
) -> DataFrame:
    """Images with an open detection by confidence tier; ``target`` is an optional quota in image order.

    Still images whose name occurs inside a pool name are skipped, video frames are not.
    """
    opens = dets.filter((c("cls_id") == OPEN) & (c("conf") >= lit(min_conf)))
    top = opens.groupBy("image_id").agg(F.max("conf").alias("max_conf"))
    cands = images.select("image_id", "file_name").join(top, "image_id")
    if pool is not None and not video:
        cands = exclude_contained(cands, pool)
    d = cands if target is None else cands.orderBy("image_id").limit(target)
    tier = open_tier(c("max_conf"), video)
    return d.select("image_id", "max_conf", tier.alias("tier"), mined_name(tier, "file_name").alias("new_name"))


def boost_open(
    dets: DataFrame, images: DataFrame, pool: DataFrame, target: int | None = None, conf: float = 0.45, min_area: float = 0.005
) -> DataFrame:
    """New images with a sure open box that is not too small; ``target`` is an optional quota in image order."""
    sure = (c("cls_id") == OPEN) & (c("conf") >= lit(conf)) & (c("w") * c("h") >= lit(min_area))
    n = dets.filter(sure).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_open"))
    fresh = exclude_existing(images.select("image_id", "file_name"), pool)
    d = fresh.join(n, "image_id")
    d = d if target is None else d.orderBy("image_id").limit(target)
    return d.select("image_id", "n_open", boost_name("file_name").alias("new_name"))


def prototypes(items: DataFrame, labels: Sequence[int], embedding="embedding", label="label") -> DataFrame:
    """Mean vector of each listed label: one row per label."""
    x = items.filter(c(label).isin(*labels)).select(c(label).alias("label"), F.posexplode(embedding).alias("i", "v"))
    mean = x.groupBy("label", "i").agg(F.avg(c("v").cast("double")).alias("v"))
    cells = F.array_sort(F.collect_list(F.struct("i", "v")))  # one vector
    return mean.groupBy("label").agg(F.transform(cells, lambda e: e["v"]).alias("prototype"))


def route_by_embedding(
    items: DataFrame, protos: DataFrame, positive: float = 0.3, negative: float = 0.4, scale: float = 100.0
) -> DataFrame:
    """Softmax over scaled cosine to the prototypes (in label order): the first decides positive, the second negative."""
    table = protos.agg(F.array_sort(F.collect_list(F.struct("label", "prototype"))))  # one row per prompt
    d = items.withColumn("_p", table.scalar())
    scores = F.transform("_p", lambda e: cosine(c("embedding"), e["prototype"]) * lit(scale))
    d = d.withColumn("probs", softmax(scores)).drop("_p")
    route = F.when(c("probs")[0] > lit(positive), "positive").when(c("probs")[1] > lit(negative), "negative")
    return d.withColumn("route", route.otherwise("dropped"))


def dedup_by_priority(files: DataFrame) -> DataFrame:
    """Each (kind, name) once, from the version that comes first; combines before the shuffle."""
    row = F.struct("priority", "file_id", "version")
    d = files.groupBy("kind", "file_name").agg(F.min(row).alias("r"))
    return d.select("kind", "file_name", "r.version", "r.priority", "r.file_id")


def check_disjoint(files: DataFrame) -> DataFrame:
    """Names that occur in more than one version."""
    d = files.groupBy("kind", "file_name").agg(F.min("version").alias("first_version"), F.max("version").alias("last_version"))
    return d.filter(c("first_version") != c("last_version"))


def top_detection(dets: DataFrame, states: DataFrame) -> DataFrame:
    """Most confident detection of each image's stable state."""
    wanted = F.when(c("state") == "OPEN", 0).otherwise(1)
    d = dets.join(states.select("image_id", wanted.alias("cls_id"), "state"), ["image_id", "cls_id"])
    best = d.groupBy("image_id", "state").agg(F.max(F.struct("conf", (-c("det_id")).alias("nd"))).alias("b"))
    return best.select("image_id", "state", (-c("b.nd")).alias("det_id"), c("b.conf").alias("conf"))


def promote(files: DataFrame, version: str) -> DataFrame:
    """Pool rows as members of a version; the writer overwrites that partition."""
    return files.withColumn("version", F.lit(version))
