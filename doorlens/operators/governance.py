"""Run history: promotion gate, absorption rule, lineage, quality gates and dataset validation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.config import GateConfig
from doorlens.functions.geometry import c, lit
from doorlens.functions.hashing import content_hash
from doorlens.functions.text import basename, fmt_run_time
from doorlens.operators.audit import fitness
from doorlens.operators.folds import ordered_fold
from doorlens.operators.repair import fields_of, once

PROMOTION_SCHEMA = (
    "experiment string, run_id bigint, mode string, fitness double, open_recall double, ghost_fp int, promoted boolean, "
    "reason string, parent_run bigint"
)


@dataclass
class Best:
    run_id: int | None = None
    fitness: float = 0.0
    recall: float = 0.0
    ghosts: int = 0


def promotion_step(cfg: GateConfig, best: Best, r: Any) -> list[tuple]:
    if best.run_id is None:
        ok, reason = True, "first_baseline"
    elif r.ghost_fp > best.ghosts + cfg.ghost_slack:
        ok, reason = False, "ghost_veto"
    elif r.mode == "rebuild":
        ok = r.fitness >= best.fitness
        reason = "rebuild_passed" if ok else "rebuild_below_best"
    else:
        ok = r.open_recall >= best.recall - cfg.recall_slack
        reason = "recall_guard_passed" if ok else "recall_dropped"
    row = (r.experiment, r.run_id, r.mode, r.fitness, r.open_recall, r.ghost_fp, ok, reason, best.run_id)
    if ok:
        best.run_id, best.fitness, best.recall, best.ghosts = r.run_id, r.fitness, r.open_recall, r.ghost_fp
    return [row]


def promotion_history(runs: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Gate decision for every run against the best promoted run before it. ``parent_run`` is that best run."""
    d = runs.withColumn("fitness", fitness(c("map50"), c("map50_95")))
    d = d.select("experiment", "run_id", "mode", "fitness", "open_recall", "ghost_fp")
    out = ordered_fold(d, ["experiment"], ["run_id"], Best, lambda s, r: promotion_step(cfg, s, r), PROMOTION_SCHEMA)
    return out


ABSORB_SCHEMA = (
    "experiment string, run_id bigint, map50 double, retry_map50 double, outcome string, best_map50 double"
)


@dataclass
class Absorbed:
    best: float = 0.0
    stopped: bool = False


def absorption_step(s: Absorbed, r: Any) -> list[tuple]:
    retry = None if r.mode == "rebuild" else r.retry_map50
    if s.stopped:
        outcome = "not_run"
    elif r.map50 > s.best:
        s.best, outcome = r.map50, "absorbed"
    elif retry is not None and retry > s.best:
        s.best, outcome = retry, "absorbed_by_rebuild"
    else:
        s.stopped, outcome = True, "stopped"
    return [(r.experiment, r.run_id, r.map50, r.retry_map50, outcome, s.best)]


def absorption_history(runs: DataFrame) -> DataFrame:
    """Versions absorbed one by one: better than the best, else once more as a rebuild, else the loop stops."""
    d = runs.select("experiment", "run_id", "mode", "map50", "retry_map50")
    return ordered_fold(d, ["experiment"], ["run_id"], Absorbed, absorption_step, ABSORB_SCHEMA)


def run_report(runs: DataFrame, abnormal: float = 0.1) -> DataFrame:
    """Report lines, newest first. Input: run_id, ts, save_dir, dataset, map50."""
    note = F.when(c("map50") < lit(abnormal), "abnormal").otherwise("archived")
    name, when = basename(c("save_dir")), fmt_run_time(c("ts"))
    line = F.format_string("| - | **%s** | %s | %s | %.4f | %s |", name, when, c("dataset"), c("map50"), note)
    return runs.select("run_id", "ts", name.alias("name"), when.alias("run_time"), note.alias("note"), line.alias("line")).orderBy(
        F.desc("ts"), F.desc("run_id")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of each experiment and its mAP50."""
    row = F.struct("ts", "run_id", "map50")
    d = runs.groupBy("experiment").agg(F.max(row).alias("r"))
    return d.select("experiment", c("r.run_id").alias("run_id"), c("r.map50").alias("map50"))


def registry(promotions: DataFrame, runs: DataFrame) -> DataFrame:
    """Registry rows of promoted runs: data and config hashes, metrics, ghost statistics and the parent run.

    ``runs`` carries the run's settings as text in ``config``.
    """
    info = runs.select(
        "run_id",
        "dataset",
        content_hash("dataset").alias("dataset_hash"),
        content_hash("config").alias("config_hash"),
        "map50", "map50_95", "open_recall", "ghost_fp",
    )
    d = promotions.filter("promoted").select("experiment", "run_id", "mode", "parent_run").join(info, "run_id")
    metrics = ("map50", "map50_95", "open_recall", "ghost_fp")
    return d.select("experiment", "run_id", "mode", "dataset", "dataset_hash", "config_hash", "parent_run", *metrics)


def gate_autolabel(stats: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Adds ratio and verdict. Input columns: total_images, suspect_fp_count."""
    ratio = F.when(c("total_images") > 0, c("suspect_fp_count") / c("total_images"))
    ok = F.coalesce(ratio <= lit(cfg.max_fp_ratio), F.lit(False))
    return stats.select("*", F.round(ratio, 6).alias("fp_ratio"), ok.alias("passed"))


def gate_balance(manifest: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """Adds drift, verdict and the missing-variety warning to a balance manifest."""
    t = c("target_ratio")
    drift = F.when(t > 0, F.abs(c("final_ratio") - t) / t).otherwise(lit(0))
    warn = (c("close_only_sampled") == 0) & (c("close_boxes") > 0)
    return manifest.select("*", F.round(drift, 6).alias("drift"), (drift <= lit(cfg.max_drift)).alias("passed"), warn.alias("low_variety"))


def assert_metrics(df: DataFrame, column: str = "map50") -> DataFrame:
    """Fails the job when a metric is zero: the validation data is broken then."""
    bad = F.raise_error(F.lit(f"{column} is zero: validation data or labels are broken")).cast("double")
    return df.withColumn(column, F.when(c(column) == 0, bad).otherwise(c(column)))


def metric_verdicts(df: DataFrame, column: str = "map50") -> DataFrame:
    """What ``assert_metrics`` would say of each run, without failing: ``ok`` is false where the metric is zero."""
    return df.withColumn("ok", F.coalesce(c(column) != 0, F.lit(True)))


def assert_class_map(df: DataFrame) -> DataFrame:
    """Fails the job when class ids do not stand for open (0) and close (1)."""
    want = F.when(c("cls_id") == 0, "open").when(c("cls_id") == 1, "close")
    ok = F.coalesce(c("name") == want, F.lit(False))
    bad = F.raise_error(F.concat(F.lit("unexpected class: "), c("name")))
    return df.withColumn("name", F.when(ok, c("name")).otherwise(bad))


def line_violations(lines: DataFrame, nc: int = 2) -> DataFrame:
    """One row per broken rule and line: bom, field_count, bad_number, class_range, coord_range."""
    text = c("line")
    d = lines.select("image_id", "line_no", "line", text.startswith("\ufeff").alias("bom"), (F.trim(text) == "").alias("_blank"))
    d = once(d, _p=fields_of("line"))
    d = once(d, _n=F.transform("_p", lambda x: x.try_cast("double")))
    wrong = F.size("_p") != 5
    unread = F.exists("_n", lambda x: x.isNull())
    cls = c("_n")[0].try_cast("bigint")
    coords = F.slice("_n", 2, F.greatest(F.size("_n") - 1, F.lit(0)))
    rules = [
        (c("bom"), "bom"),
        (~c("_blank") & wrong, "field_count"),
        (~c("_blank") & ~wrong & unread, "bad_number"),
        (~c("_blank") & ~wrong & ((cls < 0) | (cls >= nc)), "class_range"),
        (~c("_blank") & ~wrong & F.exists(coords, lambda v: (v < 0) | (v > 1)), "coord_range"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, name) for cond, name in rules]))
    return d.select("image_id", "line_no", F.explode(found).alias("rule"))


def validate(images: DataFrame, lines: DataFrame, nc: int = 2) -> DataFrame:
    """Violations per rule and split. Input images carry ``split``; all lines are checked.

    Besides the line rules: ``no_labels`` (no label line in the split), ``train_val_overlap`` (same file name in both)
    and ``empty_labels`` (images without lines, for information). Where images carry ``label_state`` (see
    ``readers.scan_images`` with a listing), ``no_label_files`` (no image of the split has a label file) and
    ``all_labels_empty`` (all label files of the split are empty) tell the two cases of ``no_labels`` apart.
    """
    per_line = line_violations(lines, nc).groupBy("image_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    rules = (
        images.select("image_id", "split")
        .join(per_line, "image_id")
        .groupBy("split", "rule")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("images"))
    )
    has = lines.groupBy("image_id").agg(F.count(F.lit(1)).alias("k"))
    per_split = images.select("image_id", "split").join(has, "image_id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(c("k").isNull()).alias("empty")
    )
    empty = per_split.filter(c("empty") > 0).select("split", F.lit("empty_labels").alias("rule"), c("empty").alias("n"), c("empty").alias("images"))
    none = per_split.filter(c("empty") == c("all")).select("split", F.lit("no_labels").alias("rule"), c("all").alias("n"), c("all").alias("images"))
    both = images.groupBy("file_name").agg(
        F.count_if(c("split") == "train").alias("t"), F.count_if(c("split") == "val").alias("v")
    )
    overlap = (
        both.filter((c("t") > 0) & (c("v") > 0))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(c("t") + c("v")), F.lit(0)).alias("images"))
        .filter(c("n") > 0)
        .select(F.lit("both").alias("split"), F.lit("train_val_overlap").alias("rule"), "n", "images")
    )
    out = rules.unionByName(empty).unionByName(none).unionByName(overlap)
    if "label_state" in images.columns:
        files = images.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(c("label_state") != "absent").alias("there"),
            F.count_if(c("label_state") == "filled").alias("filled"),
        )
        rule = F.when(c("there") == 0, "no_label_files").when(c("filled") == 0, "all_labels_empty")
        bad = files.withColumn("rule", rule).filter(c("rule").isNotNull())
        out = out.unionByName(bad.select("split", "rule", "n", c("n").alias("images")))
    return out
