"""Detection-shaped views over the driver tables.

Each view is one SQL text for Spark and for the SQL check; ``{name}`` stands for a base table or an earlier view. All
views cover their whole tables; pools and misses follow business columns of the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.operators.ranking import number_rows

BASE = ("orders", "lineitem", "part", "events", "embeddings", "customer", "supplier")

VIEWS: dict[str, str] = {
    "images": """
SELECT o_orderkey AS image_id, o_orderstatus AS pool,
  CONCAT('v', CAST(o_orderkey % 5 AS STRING)) AS version,
  CASE WHEN o_orderkey % 3 = 0 THEN CONCAT(CAST(o_custkey % 20 AS STRING), '_Video Project_', LPAD(CAST(o_orderkey % 900 AS STRING), 6, '0'), '.jpg')
       WHEN o_orderkey % 3 = 1 THEN CONCAT('N-', CAST(o_custkey % 200 AS STRING), '-', CAST(o_orderkey AS STRING), '.jpg')
       ELSE CONCAT('img', CAST(o_custkey % 200 AS STRING), '_', CAST(o_orderkey AS STRING), '.png') END AS file_name,
  CAST(200 + (o_orderkey % 12) * 100 AS INT) AS width,
  CAST(160 + (o_custkey % 10) * 100 AS INT) AS height,
  (o_orderpriority = '1-URGENT') AS is_error
FROM {orders}""",
    "gt_boxes": """
SELECT l_orderkey AS image_id,
  ((CAST(l_partkey AS BIGINT) * 100000000 + l_suppkey) * 10 + l_linenumber) AS box_id,
  CAST(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS INT) AS cls_id,
  CAST((l_partkey * 37 + l_linenumber * 101) % 1000 AS DOUBLE) / 1000 AS cx,
  CAST((l_suppkey * 53 + l_partkey * 7) % 1000 AS DOUBLE) / 1000 AS cy,
  CAST(5 + (l_partkey * 11) % 400 AS DOUBLE) / 1000 AS w,
  CAST(5 + (l_suppkey * 29 + l_linenumber * 17) % 400 AS DOUBLE) / 1000 AS h,
  l_quantity AS visibility
FROM {lineitem}""",
    "detections": """
SELECT image_id, box_id AS det_id,
  CAST(CASE WHEN box_id % 11 = 0 THEN 1 - cls_id ELSE cls_id END AS INT) AS cls_id,
  CAST((box_id * 13) % 1000 AS DOUBLE) / 1000 AS conf,
  cx + CAST(box_id % 7 - 3 AS DOUBLE) / 100 AS cx,
  cy + CAST(box_id % 5 - 2 AS DOUBLE) / 100 AS cy, w, h
FROM {gt_boxes} WHERE visibility > 5
UNION ALL
SELECT o_orderkey AS image_id, -1 - o_orderkey AS det_id, CAST(o_custkey % 2 AS INT) AS cls_id,
  CAST((o_orderkey * 7) % 1000 AS DOUBLE) / 1000 AS conf,
  CAST(o_custkey % 97 AS DOUBLE) / 97 AS cx, CAST(o_orderkey % 89 AS DOUBLE) / 89 AS cy,
  CAST(50 + o_custkey % 300 AS DOUBLE) / 1000 AS w, CAST(50 + o_orderkey % 300 AS DOUBLE) / 1000 AS h
FROM {orders} WHERE o_orderpriority = '5-LOW'""",
    "label_lines": """
SELECT image_id, box_id AS line_no,
  CASE WHEN box_id % 97 = 0 THEN 'bad row here'
       WHEN box_id % 89 = 0 THEN CONCAT('7 0.', LPAD(CAST(box_id % 1000 AS STRING), 3, '0'), ' 0.500 0.200 0.200')
       WHEN box_id % 83 = 0 THEN CONCAT('1.0  0.', LPAD(CAST(box_id % 1000 AS STRING), 3, '0'), ' 0.500 0.200 0.200 ')
       WHEN box_id % 13 = 0 THEN CONCAT(CAST(cls_id AS STRING), ' 0.', LPAD(CAST(box_id % 1000 AS STRING), 3, '0'), ' 0.100 0.900 0.', LPAD(CAST((box_id * 7) % 1000 AS STRING), 3, '0'), ' 0.400 0.800')
       WHEN box_id % 17 = 0 THEN CONCAT(CAST(cls_id AS STRING), ' 1.2 0.5 0.3 0.3')
       ELSE CONCAT(CAST(cls_id AS STRING), ' 0.', LPAD(CAST(box_id % 1000 AS STRING), 3, '0'), ' 0.', LPAD(CAST((box_id * 3) % 1000 AS STRING), 3, '0'), ' 0.', LPAD(CAST((box_id * 11) % 1000 AS STRING), 3, '0'), ' 0.', LPAD(CAST((box_id * 19) % 1000 AS STRING), 3, '0')) END AS line
FROM {gt_boxes}""",
    "gold_images": "SELECT image_id, file_name FROM {images} WHERE pool = 'F'",
    "raw_images": "SELECT image_id, file_name FROM {images} WHERE pool = 'O'",
    "gold_labels": "SELECT l.image_id, l.line_no, l.line FROM {label_lines} l JOIN {gold_images} g ON l.image_id = g.image_id",
    "reviewed_labels": """
SELECT l.image_id, l.line_no, CONCAT(l.line, CASE WHEN l.line_no % 3 = 0 THEN '1' ELSE '' END) AS line
FROM {label_lines} l JOIN {images} i ON l.image_id = i.image_id WHERE NOT i.is_error""",
    "experiments": """
SELECT p_partkey AS run_id, CONCAT('exp_', p_type, '_', p_brand) AS experiment, CONCAT('v', CAST(p_size % 5 AS STRING)) AS dataset,
  CASE WHEN p_partkey % 3 = 0 THEN 'rebuild' WHEN p_partkey % 3 = 1 THEN 'incremental' ELSE 'specialized' END AS mode,
  CAST((p_partkey * 17) % 1000 AS DOUBLE) / 1000 AS map50,
  CAST((p_partkey * 53) % 1000 AS DOUBLE) / 1000 AS retry_map50,
  CAST((p_partkey * 29) % 1000 AS DOUBLE) / 1000 AS map50_95,
  CAST((p_partkey * 41) % 1000 AS DOUBLE) / 1000 AS open_recall,
  CAST(p_partkey % 23 AS INT) AS ghost_fp,
  CONCAT('storage/runs/', p_type, '/exp_', CAST(p_partkey AS STRING)) AS save_dir,
  CONCAT('2026-', LPAD(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), '-', LPAD(CAST(1 + p_partkey % 28 AS STRING), 2, '0'), 'T', LPAD(CAST(p_partkey % 24 AS STRING), 2, '0'), ':', LPAD(CAST((p_partkey * 7) % 60 AS STRING), 2, '0'), ':30') AS ts
FROM {part}""",
    "version_files": """
SELECT CONCAT('f', CAST(p_partkey % 700 AS STRING), '.jpg') AS file_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'label' END AS kind,
  CONCAT('v', CAST(p_size % 5 AS STRING)) AS version, CAST(p_size % 5 AS INT) AS priority, p_partkey AS file_id,
  CASE WHEN p_size > 25 THEN '' ELSE p_name END AS text
FROM {part}""",
    "frame_seqs": """
SELECT user_id AS camera_id, event_id, event_type, value AS metric, ts,
  CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_seq
FROM {events}""",
    "frame_obs": """
SELECT camera_id, event_id, frame_seq, event_type,
  frame_seq * 400 + (frame_seq - frame_seq % 30) * 200 AS timestamp_ms,
  CASE WHEN event_id % 9 = 0 THEN 'unknown' WHEN (frame_seq - frame_seq % 12) % 24 = 0 THEN 'close' ELSE 'open' END AS label,
  CASE WHEN event_id % 10 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(80 + (event_id * 17) % 20 AS DOUBLE) / 100 END AS conf,
  CAST(100 + (event_id * 31) % 40 + CASE WHEN event_id % 23 = 0 THEN 700 ELSE 0 END AS INT) AS x1,
  CAST(100 + (event_id * 47) % 40 AS INT) AS y1,
  CAST(260 + (event_id * 13) % 80 + CASE WHEN event_id % 23 = 0 THEN 700 ELSE 0 END AS INT) AS x2,
  CAST(300 + (event_id * 19) % 80 - CASE WHEN event_id % 31 = 0 THEN 190 ELSE 0 END AS INT) AS y2,
  1280 AS frame_w, 720 AS frame_h,
  CAST((event_id * 23) % 240 AS DOUBLE) AS mean_l, CAST((event_id * 5) % 60 AS DOUBLE) AS std_l,
  CAST(frame_seq % 3 AS INT) AS det_no, metric, ts
FROM {frame_seqs}""",
    "frame_motion": """
SELECT camera_id, frame_seq,
  CASE camera_id % 3 WHEN 0 THEN 5 + CAST(event_id % 5 AS DOUBLE) / 4 WHEN 1 THEN CAST((event_id * 7) % 41 - 20 AS DOUBLE) / 40
       ELSE CAST((event_id * 7) % 41 - 20 AS DOUBLE) / 2 END AS dx,
  CASE camera_id % 3 WHEN 0 THEN CAST(event_id % 3 AS DOUBLE) / 4 WHEN 1 THEN CAST((event_id * 11) % 41 - 20 AS DOUBLE) / 40
       ELSE CAST((event_id * 11) % 41 - 20 AS DOUBLE) / 2 END AS dy,
  CAST((event_id * 3) % 21 - 10 AS DOUBLE) / 2000 AS da
FROM {frame_obs}""",
    "frame_dets": """
SELECT camera_id, (frame_seq - frame_seq % 2) / 2 + (frame_seq - frame_seq % 40) / 40 * 15 AS frame_seq,
  CAST(frame_seq % 2 AS INT) AS det_no, conf,
  CAST(x1 + (frame_seq % 2) * 60 AS INT) AS x1, y1, CAST(x2 + (frame_seq % 2) * 60 AS INT) AS x2, y2
FROM {frame_obs}""",
    "car_frames": """
SELECT camera_id, (frame_seq - frame_seq % 3) / 3 + (frame_seq - frame_seq % 90) / 90 * 25 AS frame_seq,
  frame_seq % 3 + (frame_seq - frame_seq % 21) / 21 * 3 AS track_id,
  (frame_seq - frame_seq % 3) / 3 * 400 AS timestamp_ms,
  CAST(event_id % 20 AS INT) AS roi_x1, CAST(event_id % 9 AS INT) AS roi_y1, CAST(30 + event_id % 20 AS INT) AS roi_x2, CAST(60 + event_id % 9 AS INT) AS roi_y2,
  x1, y1, CASE WHEN event_id % 29 = 0 THEN x1 + 30 ELSE x2 END AS x2, y2, frame_w, frame_h, mean_l, std_l,
  CASE WHEN (frame_seq - frame_seq % 24) % 48 = 0 THEN CASE WHEN event_type IN ('click', 'view') THEN 'door_open' ELSE 'door_opening' END
       ELSE 'door_closed' END AS roi_state
FROM {frame_obs}""",
    "latency_log": """
SELECT camera_id, frame_seq, CAST(event_id % 17 AS DOUBLE) AS capture_ms, metric AS infer_ms,
  CAST(event_id % 7 AS DOUBLE) / 2 AS logic_ms, CAST(event_id % 23 AS DOUBLE) / 4 AS render_ms
FROM {frame_obs}""",
}

CHECK_VIEWS: dict[str, str] = {}  # filled by ``checks``

_NEEDS = {n: list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql))) for n, sql in VIEWS.items()}

# Integer division is written `/` in the texts above; both engines get their own spelling.
_INT_DIV = re.compile(r"(\(frame_seq - frame_seq % \d+\)) / (\d+)")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def _closure(names: list[str]) -> list[str]:
    """Views behind ``names`` in an order in which each follows those it reads."""
    texts, done = {**VIEWS, **CHECK_VIEWS}, {}

    def visit(n: str) -> None:
        if n in texts and n not in done:
            for d in _names(texts[n]):
                visit(d)
            done[n] = texts[n]

    for n in names:
        visit(n)
    return list(done)


def check_sql(body: str) -> str:
    """SQL for the check engine: the views used in ``body`` (as ``{name}``) in front of it."""
    texts = {**VIEWS, **CHECK_VIEWS}

    def plain(sql: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", _INT_DIV.sub(r"\1 // \2", sql)).strip()

    ctes = [f"{n} AS ({plain(texts[n])})" for n in _closure(_names(body))]
    head, text = "WITH ", plain(body)
    for word in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(word):
            head, own = word, text[len(word) :]
            return head + ",\n".join([*ctes, own])
    return head + ",\n".join(ctes) + "\n" + text if ctes else text


class Tables:
    """Base tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "frame_seqs":
            d = self.events.select(
                F.col("user_id").alias("camera_id"), "event_id", "event_type", F.col("value").alias("metric"), "ts"
            )
            return number_rows(d, ["camera_id"], F.to_date("ts"), ["ts", "event_id"], "frame_seq")
        text = _INT_DIV.sub(r"(\1 DIV \2)", VIEWS[name])
        return self.spark.sql(text, **{d: self.get(d) for d in _NEEDS[name]})
