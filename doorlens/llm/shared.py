"""What the operators of this package share: storage that survives lost executors, words, held-out folds."""

from __future__ import annotations

import tempfile
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # what separates words


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (a test) gets a folder of its own; a cluster session must name one.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: computed once, lineage ends, columns prune."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_of(docs: DataFrame) -> Column:
    """The whole row as one struct column ``row``: no name that an operator adds can clash with the caller's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """Stored table (number, row): a number of its own for every row, whatever its id; fixed once it is stored."""
    return stored(docs.select(row_of(docs), F.monotonically_increasing_id().alias("number")), name)


def words(text: Column) -> Column:
    """Words between white space, unchanged; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1)).cast("int")


def slices(sizes: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``budget`` in total size (at least one row each), to bound memory."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + budget, side="right")))
        yield at, to
        at = to


def runs(keys: np.ndarray) -> np.ndarray:
    """Start indices of runs of equal neighbours, followed by the length."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Cuts a stream sorted by column ``key`` so that no group crosses two tables."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if rest and rest[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)
