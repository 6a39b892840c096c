"""Ground truth against predictions: overlap pairs, error taxonomy, precision and recall, confusion.

Every report starts from ``overlaps``: box pairs of one image that really intersect. Images are joined on their id;
images crowded enough to hurt are also cut into a grid, so their pairs come from shared cells and not from the whole
image. Everything after the pairs is an aggregation that combines before it shuffles.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.config import CLOSE, COCO_IOUS, OPEN, SWEEP_CONFS
from doorlens.functions import geometry as G
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import draw
from doorlens.operators.ranking import two_level_prefix
from doorlens.operators.repair import once
from doorlens.operators.settle import settle

CROWDED = 2048  # boxes per image from which the grid is used
CELL_BOXES = 256


def _crowded(gt: DataFrame, pred: DataFrame) -> DataFrame:
    n = gt.select("image_id").unionByName(pred.select("image_id")).groupBy("image_id").count()
    side = F.ceil(F.sqrt(c("count") / CELL_BOXES)).cast("int")
    return n.filter(c("count") >= CROWDED).select("image_id", side.alias("_g"))


def _cell(v: Column) -> Column:
    cut = F.least(lit(1), F.greatest(lit(0), v))
    return F.least(F.floor(cut * c("_g")), c("_g") - 1).cast("int")


def _celled(boxes: DataFrame, crowded: DataFrame, prefix: str) -> DataFrame:
    x1, y1, x2, y2 = (f"{prefix}{n}" for n in ("x1", "y1", "x2", "y2"))
    d = boxes.join(crowded, "image_id").withColumn("_gx", F.explode(F.sequence(_cell(c(x1)), _cell(F.greatest(x1, x2)))))
    return d.withColumn("_gy", F.explode(F.sequence(_cell(c(y1)), _cell(F.greatest(y1, y2)))))


Work = Callable[[DataFrame, DataFrame, Callable[[DataFrame, DataFrame], DataFrame]], DataFrame]


def per_image(gt: DataFrame, pred: DataFrame, work: Work) -> DataFrame:
    """Union of ``work(gt, pred, pairs)`` over the ordinary images and over the crowded ones.

    ``work`` may only group and join by the image and further columns; ``pairs`` finds the overlapping boxes of two
    tables. Ordinary images leave one shuffle by ``image_id`` and stay where it put them, whatever ``work`` groups by
    next; tables in ``spark.sql.shuffle.partitions`` buckets by ``image_id`` need not even that. Joins by more columns stay,
    too, if the session sets ``spark.sql.requireAllClusterKeysForCoPartition`` to false, else they move a few columns
    once more. Crowded images, which may hold any share of the rows, meet by grid cell and are spread by each later key.
    Boxes without an image are among the ordinary ones and meet nothing.
    """
    crowded = _crowded(gt, pred)

    few = F.broadcast(crowded.select("image_id"))  # at most one row per ``CROWDED`` rows

    def of(df: DataFrame, how: str) -> DataFrame:
        return df.join(few, "image_id", how)

    here = [of(df, "left_anti").repartition("image_id") for df in (gt, pred)]  # no shuffle for tables in as many buckets
    ordinary = work(*here, lambda g, p: _pairs(g, p, None))
    return ordinary.unionByName(work(of(gt, "left_semi"), of(pred, "left_semi"), lambda g, p: _pairs(g, p, crowded)))


def _pairs(gt: DataFrame, pred: DataFrame, crowded: DataFrame | None) -> DataFrame:
    g = G.to_xyxy(G.centre())
    a = gt.select("image_id", "box_id", c("cls_id").alias("gt_cls"), *[v.alias(f"g{n}") for n, v in g._asdict().items()])
    b = pred.select(
        "image_id", "det_id", c("cls_id").alias("pred_cls"), "conf", *[v.alias(f"p{n}") for n, v in g._asdict().items()]
    )
    ga, pb = G.corners("gx1", "gy1", "gx2", "gy2"), G.corners("px1", "py1", "px2", "py2")
    touching = (ga.x1 < pb.x2) & (pb.x1 < ga.x2) & (ga.y1 < pb.y2) & (pb.y1 < ga.y2)
    if crowded is None:
        found = a.join(b, "image_id").filter(touching)
    else:
        a, b = _celled(a, crowded, "g"), _celled(b, crowded, "p").drop("_g")
        # a pair is reported only by the cell that holds the corner of its intersection
        home = (_cell(F.greatest("gx1", "px1")) == c("_gx")) & (_cell(F.greatest("gy1", "py1")) == c("_gy"))
        found = a.join(b, ["image_id", "_gx", "_gy"]).filter(touching & home)
    return found.select("image_id", "box_id", "gt_cls", "det_id", "pred_cls", "conf", G.iou(ga, pb).alias("iou"))


def overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs with IoU > 0: image_id, box_id, gt_cls, det_id, pred_cls, conf, iou. Each pair appears once."""
    return per_image(gt, pred, lambda g, p, pairs: pairs(g, p))


def same_class() -> Column:
    """Whether the boxes of a pair have one class. Not an equality of columns: the join would deal by it once more."""
    return c("gt_cls").cast("bigint") - c("pred_cls") == 0


def match_boxes(gt: DataFrame, pred: DataFrame, iou_min: float = 0.0) -> DataFrame:
    return overlaps(gt, pred).filter(c("iou") >= lit(iou_min))


def fn_taxonomy(gt: DataFrame, pred: DataFrame, strict: float = 0.45, loose: float = 0.1, conf: float = 0.25) -> DataFrame:
    """Status of every open ground-truth box: TP or the kind of miss (Type_A no box … Type_D suppressed)."""
    opens = gt.filter(c("cls_id") == OPEN)
    best = F.struct("iou", (-c("det_id")).alias("first"), "pred_cls", "conf")

    def boxes_with_best(g: DataFrame, p: DataFrame, pairs: Callable) -> DataFrame:
        found = pairs(g, p).groupBy("image_id", "box_id").agg(F.max(best).alias("any"), F.max(F.when(c("pred_cls") == OPEN, best)).alias("opn"))
        return g.select("image_id", "box_id").join(found, ["image_id", "box_id"], "left")  # one row per box, also for equal keys

    d = per_image(opens, pred, boxes_with_best)
    zero = lit(0)
    o_iou, o_conf = F.coalesce(c("opn.iou"), zero), F.coalesce(c("opn.conf"), zero)
    a_iou = F.coalesce(c("any.iou"), zero)
    status = (
        F.when((o_iou >= lit(strict)) & (o_conf >= lit(conf)), "TP")
        .when(o_iou >= lit(strict), "Type_D")
        .when(a_iou >= lit(strict), "Type_C")
        .when(a_iou > lit(loose), "Type_B")
        .otherwise("Type_A")
    )
    return d.select(
        "image_id",
        "box_id",
        status.alias("status"),
        F.round(o_iou, 4).alias("max_open_iou"),
        F.round(o_conf, 4).alias("max_open_conf"),
        F.round(a_iou, 4).alias("max_any_iou"),
        F.coalesce(c("any.pred_cls"), F.lit(-1)).alias("max_any_cls"),
    )


def fn_lists(taxonomy: DataFrame, images: DataFrame) -> DataFrame:
    """Miss records with image names, one row each; written partitioned by ``fn_type`` they form the four lists."""
    missed = taxonomy.filter(c("status") != "TP")
    return missed.join(images.select("image_id", "file_name"), "image_id").select(
        c("status").alias("fn_type"),
        c("file_name").alias("image_name"),
        c("box_id").alias("gt_idx"),
        "max_open_iou",
        "max_open_conf",
        "max_any_iou",
        "max_any_cls",
    )


def _gt_flags(gt: DataFrame, hits: DataFrame) -> DataFrame:
    """All ground-truth rows with ``hit``; ``hits`` are pairs that count as a match of their box and class."""
    marks = hits.groupBy("image_id", "box_id", c("gt_cls").alias("cls_id")).agg(F.lit(True).alias("hit"))
    return gt.join(marks, ["image_id", "box_id", "cls_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def strict_missed(gt: DataFrame, pred: DataFrame, cls: int = OPEN, iou: float = 0.45) -> DataFrame:
    """Images with a ground-truth box of ``cls`` that no same-class prediction overlaps by more than ``iou``."""
    own = gt.filter(c("cls_id") == cls)
    hits = overlaps(own, pred.filter(c("cls_id") == cls)).filter(c("iou") > lit(iou))
    per_image = (
        _gt_flags(own, hits)
        .groupBy("image_id")
        .agg(F.count_if(~c("hit")).alias("missed_count"), F.count(F.lit(1)).alias("total_gt_in_img"))
    )
    return per_image.filter(c("missed_count") > 0)


def class_fn_report(
    gt: DataFrame, pred: DataFrame, conf: float = 0.4, iou: float = 0.5, small_area: float = 0.02
) -> DataFrame:
    hits = overlaps(gt, pred.filter(c("conf") >= lit(conf))).filter(
        same_class() & (c("iou") >= lit(iou))
    )
    small = (c("w") * c("h")) < lit(small_area)
    d = _gt_flags(gt.select("image_id", "box_id", "cls_id", small.alias("small")), hits)
    out = d.groupBy("cls_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("hit").alias("matched"),
        F.count_if(~c("hit")).alias("fn"),
        F.count_if(~c("hit") & c("small")).alias("small_fn"),
    )
    return out.withColumn("recall", F.round(c("matched") / c("total"), 6))


def claims(pairs: DataFrame, iou_min: float) -> DataFrame:
    """One-to-one matches: each prediction takes its best box, each box keeps its most confident claimant."""
    best = F.max(F.struct("iou", (-c("box_id")).alias("nb"), "gt_cls", "pred_cls", "conf")).alias("m")
    taken = pairs.groupBy("image_id", "det_id").agg(best).filter(c("m.iou") >= lit(iou_min))
    taken = taken.select("image_id", "det_id", (-c("m.nb")).alias("box_id"), "m.gt_cls", "m.pred_cls", "m.conf", "m.iou")
    first = F.max(F.struct("conf", (-c("det_id")).alias("nd"), "gt_cls", "pred_cls", "iou")).alias("m")
    won = taken.groupBy("image_id", "box_id").agg(first)
    return won.select("image_id", "box_id", (-c("m.nd")).alias("det_id"), "m.gt_cls", "m.pred_cls", "m.conf", "m.iou")


def confusion(gt: DataFrame, pred: DataFrame, conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """Counts per (true class, predicted class); -1 is background on either side."""
    kept = pred.filter(c("conf") >= lit(conf))
    won = settle(per_image(gt, kept, lambda g, p, pairs: claims(pairs(g, p), iou)))  # read three times below
    n = F.count(F.lit(1))
    hit = won.groupBy("gt_cls", "pred_cls").agg(n.alias("n"))
    # background = all boxes or predictions of a class minus those that were matched
    gt_all = gt.groupBy(c("cls_id").alias("gt_cls")).agg(n.alias("n")).withColumn("pred_cls", F.lit(-1))
    pr_all = kept.groupBy(c("cls_id").alias("pred_cls")).agg(n.alias("n")).withColumn("gt_cls", F.lit(-1))
    gt_hit = won.groupBy("gt_cls").agg((-n).alias("n")).withColumn("pred_cls", F.lit(-1))
    pr_hit = won.groupBy("pred_cls").agg((-n).alias("n")).withColumn("gt_cls", F.lit(-1))
    cells = hit
    for part in (gt_all, pr_all, gt_hit, pr_hit):
        cells = cells.unionByName(part)
    return cells.groupBy("gt_cls", "pred_cls").agg(F.sum("n").alias("n")).filter(c("n") > 0)


def _flagged(pairs: DataFrame, pred: DataFrame, ious: Sequence[float]) -> DataFrame:
    """Predictions with bit i of ``mask`` set where they are a true positive at the i-th IoU threshold."""
    pairs = pairs.filter(same_class())
    best = F.max(F.struct("iou", (-c("box_id")).alias("nb"), "conf")).alias("m")
    taken = pairs.groupBy("image_id", "det_id").agg(best).filter(c("m.iou") >= lit(min(ious)))
    taken = taken.select("image_id", "det_id", c("m.nb").alias("nb"), c("m.conf").alias("conf"), c("m.iou").alias("iou"))
    # the most confident claimant with enough overlap wins: at thresholds above what all claimants before it reach
    stronger = Window.partitionBy("image_id", "nb").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("iou").over(stronger), lit(-1))
    bits = [F.when((c("iou") >= lit(t)) & (c("before") < lit(t)), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(ious)]
    won = taken.withColumn("before", before).select("image_id", "det_id", sum(bits[1:], bits[0]).alias("mask"))
    d = pred.select("image_id", "det_id", "cls_id", "conf").join(won, ["image_id", "det_id"], "left")
    return d.withColumn("mask", F.coalesce(c("mask"), F.lit(0)))


def _ranked_predictions(flagged: DataFrame, ious: Sequence[float]) -> DataFrame:
    """Adds the rank in the class by confidence and cumulative true positives per IoU threshold."""
    d = once(flagged, _h=F.unhex(draw("ap", "image_id", "det_id")))  # half as long as its digits, in the same order
    sums = {"rank": F.lit(1).cast("bigint")}
    for i in range(len(ious)):
        sums[f"tp{i}"] = F.getbit(c("mask"), F.lit(i)).cast("bigint")
    # ranges of 1e-3; a repeated round value (1.0, 0.95 …) is split further by hash, in the same order
    near = F.round("conf", 3)
    part = F.when(c("conf") > near, "0").when(c("conf") == near, F.concat(F.lit("1"), F.substring(F.hex("_h"), 1, 1))).otherwise("2")
    return two_level_prefix(
        d,
        ["cls_id"],
        [-near, part],
        [-c("conf"), c("_h"), c("image_id"), c("det_id")],
        sums,
    )


def _average_precision(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """101-point interpolated AP from ``q`` (recall in whole percent) and ``p`` (best precision there)."""
    points = settle(points)  # at most 101 rows per key, read twice
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(100).cast("bigint"))
    grid = points.select(*keys).distinct().withColumn("q", F.explode(steps))
    full = grid.join(points, [*keys, "q"], "left")
    right = Window.partitionBy(*keys).orderBy("q").rowsBetween(0, Window.unboundedFollowing)
    full = full.withColumn("p", F.coalesce(F.max("p").over(right), lit(0)))
    return full.groupBy(*keys).agg(F.avg("p").alias("ap"))


def detection_metrics(gt: DataFrame, pred: DataFrame, ious: Sequence[float] = COCO_IOUS) -> DataFrame:
    """Per class: counts, precision, recall and AP at the first threshold, AP averaged over all thresholds."""
    flagged = settle(per_image(gt, pred, lambda g, p, pairs: _flagged(pairs(g, p), p, ious)))
    ranked = _ranked_predictions(flagged, ious)
    totals = gt.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_gt"))
    per_t = F.array(
        *[F.struct(F.lit(i).alias("t"), c(f"tp{i}").alias("k"), F.getbit(c("mask"), F.lit(i)).alias("is_tp")) for i in range(len(ious))]
    )
    hits = ranked.filter(c("mask") > 0).select("cls_id", "rank", F.explode(per_t).alias("x")).filter("x.is_tp = 1")
    hits = hits.join(F.broadcast(totals), "cls_id")  # one row per class
    points = hits.groupBy("cls_id", c("x.t").alias("t"), F.expr("100 * x.k div n_gt").alias("q")).agg(
        F.max(c("x.k") / c("rank")).alias("p")
    )
    ap = _average_precision(points, ["cls_id", "t"])
    ap = ap.groupBy("cls_id").agg(
        F.max(F.when(c("t") == 0, c("ap"))).alias("ap50"), (F.sum("ap") / lit(len(ious))).alias("ap50_95")
    )
    first = F.getbit(c("mask"), F.lit(0)).cast("bigint")
    counts = flagged.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(first).alias("tp"))
    out = totals.join(counts, "cls_id", "left").join(ap, "cls_id", "left")
    out = out.na.fill(0, ["n_pred", "tp"]).na.fill(0.0, ["ap50", "ap50_95"])
    return out.select(
        "cls_id",
        "n_gt",
        "n_pred",
        "tp",
        F.round(F.when(c("n_pred") > 0, c("tp") / c("n_pred")).otherwise(lit(0)), 6).alias("precision"),
        F.round(c("tp") / c("n_gt"), 6).alias("recall"),
        F.round("ap50", 6).alias("ap50"),
        F.round("ap50_95", 6).alias("ap50_95"),
    )


def threshold_sweep(gt: DataFrame, pred: DataFrame, confs: Sequence[float] = SWEEP_CONFS, iou: float = 0.5) -> DataFrame:
    """Precision, recall, F1, mAP50 and close-as-open count per confidence cut-off.

    Predictions are never multiplied by the cut-offs. A confident claim wins its box at every cut-off it passes, so
    one ranking gives all cut-offs: rows are counted by the highest cut-off they pass and summed from the top.
    """
    cuts = sorted(confs)

    def judged(g: DataFrame, p: DataFrame, pairs: Callable) -> DataFrame:
        """The flagged predictions and, as rows of their own, the open ones that won a close box."""
        found = pairs(g, p)
        cols = ["cls_id", "image_id", "det_id", "conf"]
        wrong = claims(found, iou).filter((c("gt_cls") == CLOSE) & (c("pred_cls") == OPEN)).withColumn("cls_id", c("pred_cls"))
        flagged = _flagged(found, p, [iou]).select(*cols, "mask", F.lit(False).alias("wrong"))
        return flagged.unionByName(wrong.select(*cols, F.lit(0).alias("mask"), F.lit(True).alias("wrong")))

    rows = settle(per_image(gt, pred, judged))
    ranked = _ranked_predictions(rows.filter(~c("wrong")).drop("wrong"), [iou])
    level = sum((F.when(c("conf") >= lit(t), 1).otherwise(0) for t in cuts), F.lit(0))
    totals = gt.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_gt"))
    q = F.when(F.getbit(c("mask"), F.lit(0)) == 1, F.expr("100 * tp0 div n_gt"))
    cells = (
        ranked.join(F.broadcast(totals), "cls_id")  # one row per class
        .withColumn("level", level)
        .groupBy("cls_id", "n_gt", "level", q.alias("q"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.getbit(c("mask"), F.lit(0)).cast("bigint")).alias("tp"),
            F.max(F.when(q.isNotNull(), c("tp0") / c("rank"))).alias("p"),
        )
        .filter(c("level") >= 1)
    )
    cells = settle(cells)
    # at most classes × cut-offs × 102 rows from here on
    spread = cells.withColumn("cut", F.explode(F.sequence(F.lit(1), c("level"))))
    pr = spread.groupBy("cls_id", "n_gt", "cut").agg(F.sum("n").alias("n_pred"), F.sum("tp").alias("tp"))
    points = spread.filter(c("q").isNotNull()).groupBy("cls_id", "cut", "q").agg(F.max("p").alias("p"))
    ap = _average_precision(points, ["cls_id", "cut"])
    base = totals.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(len(cuts)))))
    d = base.join(pr.drop("n_gt"), ["cls_id", "cut"], "left").join(ap, ["cls_id", "cut"], "left")
    d = d.na.fill(0, ["n_pred", "tp"]).na.fill(0.0, ["ap"])
    d = d.withColumn("p", F.when(c("n_pred") > 0, c("tp") / c("n_pred")).otherwise(lit(0)))
    d = d.withColumn("r", c("tp") / c("n_gt"))
    opn = c("cls_id") == OPEN
    per_cut = d.groupBy("cut").agg(
        F.max(F.when(opn, c("p"))).alias("op"),
        F.max(F.when(opn, c("r"))).alias("orc"),
        F.avg("p").alias("mp"),
        F.avg("r").alias("mr"),
        F.avg("ap").alias("map50"),
    )
    wrong = (
        rows.filter("wrong")
        .withColumn("level", level)
        .filter(c("level") >= 1)
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cut", F.explode(F.sequence(F.lit(1), c("level"))))
        .groupBy("cut")
        .agg(F.sum("n").alias("close_to_open"))
    )

    def f1(p: str, r: str) -> Column:
        return F.round(2 * c(p) * c(r) / (c(p) + c(r) + lit(1e-16)), 6)

    d = per_cut.join(wrong, "cut", "left").na.fill(0, ["close_to_open"])
    return d.select(
        F.array(*[lit(t) for t in cuts])[c("cut") - 1].alias("conf"),
        F.round("orc", 6).alias("open_recall"),
        F.round("op", 6).alias("open_precision"),
        f1("op", "orc").alias("open_f1"),
        F.round("mp", 6).alias("precision"),
        F.round("mr", 6).alias("recall"),
        f1("mp", "mr").alias("overall_f1"),
        "close_to_open",
        F.round("map50", 6).alias("map50"),
    )


def residual_items(
    gt: DataFrame, pred: DataFrame, conf: float = 0.4, iou: float = 0.5, low_iou: float = 0.7
) -> DataFrame:
    """Residual errors, one row each: box_refinement, miss_recovery, background_suppression, mixed_state_review.

    Misses and background hits on an image that truly holds both classes go to review instead.
    """
    kept = pred.filter(c("conf") >= lit(conf))
    pairs = settle(overlaps(gt, kept).filter(same_class()))
    best = pairs.groupBy("image_id", "box_id").agg(F.max("iou").alias("iou"))
    boxes = gt.select("image_id", "box_id").join(best, ["image_id", "box_id"], "left").withColumn("iou", F.coalesce("iou", lit(0)))
    kind = F.when(c("iou") < lit(iou), "miss_recovery").when(c("iou") < lit(low_iou), "box_refinement")
    from_gt = boxes.select("image_id", c("box_id").alias("item_id"), kind.alias("bucket")).filter(c("bucket").isNotNull())
    hit = pairs.filter(c("iou") >= lit(iou)).select("image_id", "det_id")
    from_pred = (
        kept.join(hit, ["image_id", "det_id"], "left_anti")
        .select("image_id", c("det_id").alias("item_id"), F.lit("background_suppression").alias("bucket"))
    )
    mixed = gt.groupBy("image_id").agg(
        (F.bool_or(c("cls_id") == OPEN) & F.bool_or(c("cls_id") == CLOSE)).alias("mixed")
    )
    d = from_gt.unionByName(from_pred).join(mixed, "image_id", "left")
    review = F.coalesce(c("mixed"), F.lit(False)) & (c("bucket") != "box_refinement")
    return d.select("image_id", "item_id", F.when(review, "mixed_state_review").otherwise(c("bucket")).alias("bucket"))


def residual_buckets(items: DataFrame) -> DataFrame:
    per_image = items.groupBy("bucket", "image_id").agg(F.count(F.lit(1)).alias("n"))
    return per_image.groupBy("bucket").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("images"))
