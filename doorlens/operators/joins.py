"""Joins between images, labels, pools and review rounds. All are equi-joins; skewed keys are left to AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.config import VEHICLE_CLASSES
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import content_hash
from doorlens.functions.text import replay_name


def attach_labels(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images with their boxes; an image without boxes keeps one row with null box columns."""
    return images.join(boxes, "image_id", "left")


def select_negatives(
    images: DataFrame, dets: DataFrame, classes: tuple[int, ...] = VEHICLE_CLASSES, conf: float = 0.25
) -> DataFrame:
    seen = dets.filter(c("cls_id").isin(*classes) & (c("conf") >= lit(conf))).select("image_id")
    return images.join(seen, "image_id", "left_anti")


def merge_status(incoming: DataFrame, gold: DataFrame, raw: DataFrame) -> DataFrame:
    """Per incoming image: ``applied`` (image in gold), ``promoted`` (found in the raw pool) or ``ghost``."""
    inc = incoming.select("image_id").distinct()
    g = gold.groupBy("image_id").agg(F.lit(True).alias("in_gold"))
    r = raw.groupBy("image_id").agg(F.min("file_name").alias("raw_name"))
    d = inc.join(g, "image_id", "left").join(r, "image_id", "left")
    status = F.when(c("in_gold"), "applied").when(c("raw_name").isNotNull(), "promoted").otherwise("ghost")
    return d.select("image_id", status.alias("status"), F.when(status == "promoted", c("raw_name")).alias("promoted_name"))


def merge_reviewed(incoming: DataFrame, gold: DataFrame, raw: DataFrame, gold_labels: DataFrame) -> DataFrame:
    """Label lines of gold after a review round: reviewed images are replaced whole, ghosts are skipped."""
    status = merge_status(incoming, gold, raw).filter(c("status") != "ghost")
    fresh = incoming.join(status.select("image_id", "status"), "image_id")
    kept = gold_labels.join(status.select("image_id"), "image_id", "left_anti").withColumn("status", F.lit("kept"))
    cols = ["image_id", "line_no", "line", "status"]
    return kept.select(*cols).unionByName(fresh.select(*cols))


def merge_report(incoming: DataFrame, gold: DataFrame, raw: DataFrame) -> DataFrame:
    return merge_status(incoming, gold, raw).agg(
        F.count_if(c("status") != "ghost").alias("merged"),
        F.count_if(c("status") == "promoted").alias("promoted"),
        F.count_if(c("status") == "ghost").alias("skipped"),
    )


def recover_labels(frozen: DataFrame, gold: DataFrame) -> DataFrame:
    """Text for every frozen label: its own, else the first non-empty gold text of that name in version order."""
    best = (
        gold.filter(c("text") != "")
        .groupBy("file_name")
        .agg(F.min(F.struct("version", "file_id", "text")).alias("b"))
        .select("file_name", c("b.version").alias("from_version"), c("b.text").alias("gold_text"))
    )
    empty = c("text") == ""
    d = frozen.join(best, "file_name", "left")
    status = F.when(~empty, "kept").when(c("gold_text").isNotNull(), "recovered").otherwise("not_found")
    return d.select(
        "file_id",
        "file_name",
        F.when(empty, F.coalesce("gold_text", F.lit(""))).otherwise(c("text")).alias("text"),
        F.when(empty, c("from_version")).alias("from_version"),
        status.alias("status"),
    )


def attach_flags(images: DataFrame, fn_list: DataFrame, kind: str = "Type_A") -> DataFrame:
    """Sets ``is_type_a`` for images named in a miss list. Mine that list on held-out training folds."""
    names = fn_list.filter(c("fn_type") == kind).select(c("image_name").alias("file_name")).distinct()
    d = images.join(names.withColumn("_a", F.lit(True)), "file_name", "left")
    return d.withColumn("is_type_a", F.coalesce("_a", F.lit(False))).drop("_a")


def exclude_existing(cands: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates not in the pool under their own name or a mined or boosted one.

    The pool is normalised instead of the candidates: each pool name stands for itself and for its name without
    prefix, so one equi anti-join decides.
    """
    forms = F.array(
        c("file_name"),
        F.regexp_extract("file_name", "(?s)^miner_open_(.*)$", 1),
        F.regexp_extract("file_name", "(?s)^boost_open_(.*)$", 1),
    )
    known = pool.select(F.explode(forms).alias("file_name")).filter(c("file_name") != "")
    return cands.join(known, "file_name", "left_anti")


def exclude_contained(cands: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates whose name is no substring of any pool name.

    Pool names (file names, so at most 255 characters) are expanded to their substrings of the candidates' lengths;
    the test is then an equality join that spreads over the cluster, never candidate × pool. The planner does not see
    how many substrings a name has and would broadcast them all, so the join is asked to be a sorted one.
    """
    n = F.length("file_name")
    lengths = cands.select(n.alias("l")).distinct().agg(F.collect_set("l").alias("ls"))  # at most 255 numbers
    names = pool.select("file_name").distinct().withColumn("_ls", lengths.scalar())
    d = names.select("file_name", F.explode("_ls").alias("_l")).filter(c("_l") <= n)
    d = d.select(F.explode(F.transform(F.sequence(F.lit(1), n - c("_l") + 1), lambda i: F.substr(c("file_name"), i, c("_l")))).alias("file_name"))
    return cands.join(d.distinct().hint("merge"), "file_name", "left_anti")


def remove_leakage(val: DataFrame, intake: DataFrame) -> DataFrame:
    """Validation images whose name does not occur in the intake."""
    return val.join(intake.select("file_name"), "file_name", "left_anti")


def refresh_candidates(cands: DataFrame, *earlier: DataFrame) -> DataFrame:
    """Candidates minus all earlier rounds and gold."""
    for df in earlier:
        cands = remove_leakage(cands, df)
    return cands


def label_digest(lines: DataFrame) -> DataFrame:
    """Order-aware digest of an image's label text, summed from line hashes (line number included)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", c("line_no").cast("string"), c("line")), 256), 1, 12), 16, 10)
    return lines.groupBy("image_id").agg(
        F.sum(h.cast("decimal(20,0)")).alias("digest"), F.count(F.lit(1)).alias("n_lines")
    )


def diff_labels(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images of the review with their change state: changed, unchanged or missing (reviewed, but not in ``before``)."""
    b = label_digest(before).select("image_id", c("digest").alias("b"), c("n_lines").alias("bn"))
    a = label_digest(after).select("image_id", c("digest").alias("a"), c("n_lines").alias("an"))
    d = a.join(b, "image_id", "left")
    same = (c("a") == c("b")) & (c("an") == c("bn"))
    return d.select("image_id", F.when(c("b").isNull(), "missing").when(same, "unchanged").otherwise("changed").alias("state"))


def diff_report(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c("state") == "changed").alias("changed"),
        F.count_if(c("state") == "unchanged").alias("unchanged"),
        F.count_if(c("state") == "missing").alias("missing"),
    )


def replay_core(images: DataFrame, boxes: DataFrame, category: str) -> DataFrame:
    """Images entered into a replay category; only ``ghost`` may come without labels."""
    d = images if category == "ghost" else images.join(boxes, "image_id", "left_semi")
    return d.select("image_id", replay_name(F.lit(category)).alias("file_name"), F.lit("replay").alias("source"))


def inject_replay(train: DataFrame, replay: DataFrame) -> DataFrame:
    return train.select("image_id", "file_name", F.lit("train").alias("source")).unionByName(replay)


def review_package(images: DataFrame, label_lines: DataFrame) -> DataFrame:
    """Image list of a review package: only images that have a label."""
    named = images.join(label_lines.select("image_id"), "image_id", "left_semi")
    return named.select("image_id", F.concat(F.lit("obj_train_data/"), c("file_name")).alias("entry"))


def dataset_descriptor(train: DataFrame, root: str, val: str) -> DataFrame:
    """One descriptor row with the content hash of the training set."""
    from doorlens.functions.hashing import set_hash

    return train.agg(
        F.lit(root).alias("path"),
        F.lit("images").alias("train"),
        F.lit(val).alias("val"),
        F.lit(2).alias("nc"),
        F.lit("open,close").alias("names"),
        F.count(F.lit(1)).alias("n_images"),
        set_hash("image_id", "file_name").alias("dataset_hash"),
    )


def config_hash(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumn("config_hash", content_hash(*[c(x) for x in sorted(cols)]))
