"""Intermediate tables: computed once, read by several branches, safe when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back; lineage ends there and columns still prune.

    The folder is the session's ``spark.checkpoint.dir``, which a cluster must name; only a local session without it
    (a test) gets a folder of its own. A cluster without one is an error, not another plan.
    """
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
