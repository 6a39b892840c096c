"""Writers. All are distributed; none gathers rows on the driver or builds one value per group.

Two of them survive failures and repetitions: ``deploy_dataset`` writes beside the readable data and switches by one
small append, ``EventSink`` writes each micro-batch of a stream once, however often Spark hands it over.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.functions.geometry import c

FRAME_LOG = (
    "Frame_ID", "Timestamp", "Stable_State", "Alert", "Max_Area_Ratio", "Open_Cands", "Close_Cands", "Danger_Opens",
    "FPS", "Capture_ms", "Infer_ms", "Logic_ms", "Render_ms", "E2E_ms", "RAM_MB", "Lag_Status",
)
DETECTION_LOG = (
    "Frame_ID", "Det_ID", "Class_Raw", "Conf_Raw", "x1", "y1", "x2", "y2", "Area_Ratio", "ROI_Pass", "Filtered_Pass",
)


def write_by_image(boxes: DataFrame, table: str, buckets: int) -> None:
    """Stores boxes or predictions as a table bucketed by ``image_id``, one file a bucket.

    Tables with as many buckets as ``spark.sql.shuffle.partitions`` meet in ``operators.match`` without a shuffle. An
    image lies in one bucket, so one that holds much of the table makes a large file.
    """
    placed = boxes.repartition(buckets, "image_id")
    placed.write.mode("overwrite").bucketBy(buckets, "image_id").sortBy("image_id").saveAsTable(table)


def write_dataset(df: DataFrame, path: str) -> None:
    """Replaces the dataset: one row per image and box, background images keep a row with null box columns.

    Rows are balanced by size within a split and version, so a large version is written by many tasks and a small one
    into few files. Readers see nothing while it runs; ``deploy_dataset`` is the way that they can share.
    """
    balanced = df.hint("rebalance", "split", "version")
    balanced.write.mode("overwrite").partitionBy("split", "version").parquet(path)


DEPLOYMENTS = "number bigint, deployment string, rows bigint, written timestamp"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a small JSON table; none if nothing has been written there."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def deployments(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a deployed dataset: number, deployment, rows, written; the highest number is the readable one."""
    return _table(spark, f"{path}/manifest", DEPLOYMENTS)


def deploy_dataset(df: DataFrame, path: str) -> str:
    """Writes a new state of the dataset and makes it the one that ``read_dataset`` sees.

    The rows go to a folder of their own, are read back and counted, and only then one line is appended to the
    manifest; a write that fails anywhere leaves the state before it readable. Returns the deployment's name.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    target = f"{path}/data/{name}"
    df.hint("rebalance", "split", "version").write.partitionBy("split", "version").parquet(target)
    rows = spark.read.parquet(target).count()
    last = deployments(spark, path).agg(F.max("number")).first()[0] or 0
    line = spark.range(1).select(
        F.lit(last + 1).cast("bigint").alias("number"), F.lit(name).alias("deployment"), F.lit(rows).cast("bigint").alias("rows"),
        F.current_timestamp().alias("written"),
    )
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return name


def read_dataset(spark: SparkSession, path: str, deployment: str | None = None) -> DataFrame:
    """The newest deployed state, or the one named: older ones stay readable until their folder is removed."""
    if deployment is None:
        newest = deployments(spark, path).orderBy(F.desc("number")).first()
        if newest is None:
            raise ValueError(f"nothing is deployed at {path}")
        deployment = newest["deployment"]
    return spark.read.parquet(f"{path}/data/{deployment}")


def promote_version(df: DataFrame, path: str) -> None:
    """Overwrites only the version partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def write_label_text(lines: DataFrame, path: str, shards: int = 256) -> None:
    """Label text, sorted by image and line inside shard folders; each row is ``image_id<TAB>line``."""
    shard = F.pmod(F.hash("image_id"), F.lit(shards))
    d = lines.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "image_id", "line_no")
    text = F.concat_ws("\t", c("image_id").cast("string"), c("line"))
    d.select("shard", text.alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def write_label_files(lines: DataFrame, path: str) -> None:
    """One folder per image holding its label lines in order, for tools that want a file per image."""
    d = lines.repartition("image_id").sortWithinPartitions("image_id", "line_no")
    d.select("image_id", c("line").alias("value")).write.mode("overwrite").partitionBy("image_id").text(path)


def write_review_package(entries: DataFrame, lines: DataFrame, path: str) -> None:
    """Image list, label lines and class names of a review package."""
    spark = entries.sparkSession
    entries.select(c("entry").alias("value")).write.mode("overwrite").text(f"{path}/train")
    write_label_text(lines, f"{path}/obj_train_data")
    names = spark.range(2).select(F.when(c("id") == 0, "open").otherwise("close").alias("value"))
    names.coalesce(1).write.mode("overwrite").text(f"{path}/obj_names")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_fn_lists(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("fn_type").json(path)


def write_events(df: DataFrame, path: str, checkpoint: str | None = None):
    """Appends event rows as JSON lines; a streaming frame returns its running query."""
    if df.isStreaming:
        return (
            df.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()
        )
    df.write.mode("append").json(path)
    return None


BATCHES = "app string, batch bigint"


@dataclass(frozen=True)
class OncePerBatch:
    """A ``foreachBatch`` function that hands each batch to ``writer(df, batch id)`` once.

    Spark repeats the last micro-batch after a failure, with the same id and the same rows. Finished ids are appended
    to ``log`` (one line a batch, told apart by ``app``) and passed over from then on. A writer that fails half-way is
    called again with the same id, so it should replace what it wrote under that id, as ``EventSink`` does.
    """

    writer: Callable[[DataFrame, int], None]
    log: str
    app: str = "default"

    def done(self, spark: SparkSession, batch: int) -> bool:
        found = _table(spark, self.log, BATCHES).filter((c("app") == self.app) & (c("batch") == batch))
        return not found.isEmpty()

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if self.done(spark, batch):
            return
        self.writer(df, batch)
        line = spark.range(1).select(F.lit(self.app).alias("app"), F.lit(batch).cast("bigint").alias("batch"))
        line.coalesce(1).write.mode("append").json(self.log)


@dataclass(frozen=True)
class EventSink:
    """Event rows of a stream as JSON lines, every micro-batch exactly once.

    A batch is written to a folder of its own, which a repetition replaces; readers see only the batches that the log
    names, so half-written ones do not show.
    """

    path: str
    app: str = "default"

    def once(self) -> OncePerBatch:
        return OncePerBatch(lambda df, batch: df.write.mode("overwrite").json(f"{self.path}/data/app={self.app}/batch={batch}"), f"{self.path}/log", self.app)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.once()).option("checkpointLocation", checkpoint).start()

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """All finished batches of all apps: the event columns, ``app`` and ``batch``."""
        finished = _table(spark, f"{self.path}/log", BATCHES).distinct()
        events = _table(spark, f"{self.path}/data", f"{schema}, {BATCHES}")
        return events.join(finished, ["app", "batch"], "left_semi")


def write_batches(stream: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, log: str | None = None, app: str = "default"):
    """Hands every micro-batch to the caller's writer (a storage plug-in); with ``log`` a finished batch never again."""
    call = OncePerBatch(writer, log, app) if log else writer
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).start()


def frame_log(df: DataFrame) -> DataFrame:
    """Frame log columns with their text formats."""

    def f(col: str, digits: int):
        return F.format_string(f"%.{digits}f", c(col))

    return df.select(
        c("frame_seq").alias("Frame_ID"),
        c("timestamp_ms").alias("Timestamp"),
        c("state").alias("Stable_State"),
        c("alert").alias("Alert"),
        f("max_area", 3).alias("Max_Area_Ratio"),
        c("open_cands").alias("Open_Cands"),
        c("close_cands").alias("Close_Cands"),
        c("danger_opens").alias("Danger_Opens"),
        f("fps", 1).alias("FPS"),
        f("capture_ms", 1).alias("Capture_ms"),
        f("infer_ms", 1).alias("Infer_ms"),
        f("logic_ms", 1).alias("Logic_ms"),
        f("render_ms", 1).alias("Render_ms"),
        f("e2e_ms", 1).alias("E2E_ms"),
        f("ram_mb", 1).alias("RAM_MB"),
        c("lag_status").alias("Lag_Status"),
    )


def detection_log(df: DataFrame) -> DataFrame:
    return df.select(
        c("frame_seq").alias("Frame_ID"),
        c("det_no").alias("Det_ID"),
        c("label").alias("Class_Raw"),
        F.format_string("%.3f", c("conf")).alias("Conf_Raw"),
        "x1",
        "y1",
        "x2",
        "y2",
        F.format_string("%.3f", c("area_ratio")).alias("Area_Ratio"),
        c("roi_pass").alias("ROI_Pass"),
        c("filtered_pass").alias("Filtered_Pass"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)
