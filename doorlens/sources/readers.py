"""Readers: image folders, label files, run records and detection streams."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.functions.geometry import c
from doorlens.functions.text import stem
from doorlens.sources.files import list_files, picture_sizes

IMAGE_EXTS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VIDEO_EXTS = ("mp4", "avi", "mkv")

# Files of a review package that are not labels.
NOT_LABELS = ("train.txt", "val.txt", "test.txt", "obj.names", "obj.data", "classes.txt")

DETECTION_SCHEMA = (
    "camera_id bigint, frame_seq bigint, timestamp_ms bigint, det_no int, label string, conf double, "
    "x1 int, y1 int, x2 int, y2 int, frame_w int, frame_h int"
)
RUN_SCHEMA = (
    "timestamp string, dataset string, dataset_hash string, base_model string, "
    "metrics struct<mAP50:double,mAP50_95:double,precision:double,recall:double,open_recall:double>, save_dir string"
)
FN_FIELDS = (
    "array<struct<image_name:string,gt_idx:bigint,max_open_iou:double,max_open_conf:double,max_any_iou:double,"
    "max_any_cls:int>>"
)
FN_SCHEMA = (", ".join(f"Type_{x} {FN_FIELDS}" for x in "ABCD"))


def _has_ext(path: Column, exts: Sequence[str]) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(exts) + ")$")


def list_media(spark: SparkSession, paths: str | list[str], exts: Sequence[str] = IMAGE_EXTS + VIDEO_EXTS) -> DataFrame:
    """Media files below the paths, sorted by path. File contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    d = files.select("path", "length", "modificationTime").filter(_has_ext(c("path"), exts))
    return d.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1)).orderBy("path")


def scan_images(spark: SparkSession, paths: str | list[str], listing: DataFrame | None = None) -> DataFrame:
    """Images with the label file of the same stem in the sibling ``labels`` folder, if there is one.

    ``label_state`` is absent, empty or filled. ``listing`` (path, length: an inventory table of the store) takes the
    place of listing the folders.
    """
    if listing is None:
        listing = list_files(spark, paths)
    files = listing.select("path", "length")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    images = files.filter(_has_ext(c("path"), IMAGE_EXTS)).select(
        "path",
        "length",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        stem("path").alias("stem"),
        F.regexp_replace(folder, "/images$", "").alias("_root"),
    )
    labels = files.filter(c("path").endswith(".txt")).select(
        c("path").alias("label_path"),
        c("length").alias("label_length"),
        stem("path").alias("stem"),
        F.regexp_replace(folder, "/labels$", "").alias("_root"),
    )
    state = F.when(c("label_path").isNull(), "absent").when(c("label_length") == 0, "empty").otherwise("filled")
    return images.join(labels, ["_root", "stem"], "left").drop("_root").withColumn("label_state", state)


def read_label_lines(spark: SparkSession, paths: str | list[str], skip: Sequence[str] = ()) -> DataFrame:
    """Lines of label files: file_name, stem, line_no, line. Blank lines keep their number."""
    d = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.txt")
        .text(paths, wholetext=True)
        .select(c("_metadata.file_name").alias("file_name"), c("_metadata.file_path").alias("path"), "value")
    )
    if skip:
        d = d.filter(~c("file_name").isin(*skip))
    lines = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")
    d = d.select("path", "file_name", stem("file_name").alias("stem"), F.posexplode(lines).alias("line_no", "line"))
    return d.withColumn("line_no", c("line_no") + 1).filter(F.trim("line") != "")


def read_review_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_label_lines(spark, paths, NOT_LABELS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run history (a JSON array) as flat rows."""
    d = spark.read.schema(RUN_SCHEMA).option("multiLine", "true").json(path)
    return d.select(
        F.to_timestamp("timestamp").alias("ts"),
        "dataset",
        "dataset_hash",
        "base_model",
        c("metrics.mAP50").alias("map50"),
        c("metrics.mAP50_95").alias("map50_95"),
        c("metrics.precision").alias("precision"),
        c("metrics.recall").alias("recall"),
        c("metrics.open_recall").alias("open_recall"),
        "save_dir",
    )


def read_fn_lists(spark: SparkSession, path: str) -> DataFrame:
    """Miss lists (an object of four arrays) as rows with ``fn_type``."""
    d = spark.read.schema(FN_SCHEMA).option("multiLine", "true").json(path)
    pairs = F.array(*[F.struct(F.lit(f"Type_{x}").alias("fn_type"), c(f"Type_{x}").alias("items")) for x in "ABCD"])
    d = d.select(F.explode(pairs).alias("p")).select("p.fn_type", F.explode("p.items").alias("i"))
    return d.select("fn_type", "i.*")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def image_dims(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, width, height and reason per image file, from the head of the file: pixels are never decoded.

    A broken file is a row with a reason and without a size.
    """
    files = list_files(spark, paths).filter(_has_ext(c("path"), IMAGE_EXTS))
    return picture_sizes(files.hint("rebalance"))


def read_detections_stream(spark: SparkSession, path: str, schema: str = DETECTION_SCHEMA, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def consolidate_logs(spark: SparkSession, path: str, pattern: str = "training_*.log") -> DataFrame:
    """All matching logs as one ordered text: file_name, line_no, line, with a marker before and after each file."""
    d = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(c("_metadata.file_name").alias("file_name"), "value")
        .filter(c("file_name") != "training_master.log")
    )
    body = F.split(F.regexp_replace("value", r"\n$", ""), "\n")

    def mark(word: str) -> Column:
        return F.concat(F.lit(f"--- [LOG {word}: "), c("file_name"), F.lit("] ---"))

    lines = F.concat(F.array(mark("START")), body, F.array(mark("END")))
    return d.select("file_name", F.posexplode(lines).alias("line_no", "line")).orderBy("file_name", "line_no")
