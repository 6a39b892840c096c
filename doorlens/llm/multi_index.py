"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut in two halves and each half is quantised by its own centroids; an entry lives in the cell of its
centroid pair. A query visits the pairs in the order of their summed distance, which a heap yields from the two sorted
distance lists, until the visited cells hold the wanted number of entries; these are reranked by exact cosine in
double precision on the original vectors. Equal vectors are one entry with its smallest ids: more could never be among
the nearest. Entries and queries of a cell meet in blocks, so that a cell may hold any share of them.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.shared import stored


@dataclass(frozen=True)
class IndexConfig:
    """``sample`` bounds the vectors that the centroids are fitted on; every vector is indexed."""

    centroids: int = 32
    sample: int = 10_000
    rounds: int = 12
    entries: int = 3000  # that the visited cells of a query hold at least, and
    share: float = 0.45  # of all entries: without clusters near vectors are spread over most cells
    block: int = 4096  # entries, and queries, that one comparison holds
    seed: int = 9


def k_means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            own = points[near == c]
            centres[c] = own.mean(axis=0) if len(own) else points[rng.integers(len(points))]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, safe against overflow of the squares."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def visit(left: np.ndarray, right: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Cells (first centroid * number of seconds + second) by summed distance until they hold ``wanted`` entries."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, pushed, cells, got = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if held[cell]:
            cells.append(cell)
            got += int(held[cell])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in pushed:
                pushed.add((i2, j2))
                heapq.heappush(heap, (left[a[i2]] + right[b[j2]], i2, j2))
    return cells


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (double) of the rows that take part: not null, not zero, all components finite numbers."""
    v = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return v.filter(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: str, k: int = 5, config: IndexConfig = IndexConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each query, ties to the smaller id.

    ``is_query`` is a condition on vec_id. Vectors of other lengths than the most are incomparable and take no part
    with them: each length is searched on its own. Rows without id take no part, repeated ids count once per vector.
    """
    spark = vectors.sparkSession
    v = usable(vectors).withColumn("dim", F.size("vector"))
    dims = [r["dim"] for r in v.select("dim").distinct().collect()]  # lengths of vectors: a few
    out = None
    for dim in sorted(dims):
        part = nearest_of_length(stored(v.filter(F.col("dim") == dim).drop("dim"), "vectors"), dim, is_query, k, config)
        out = part if out is None else out.unionByName(part)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return empty if out is None else out


def nearest_of_length(v: DataFrame, dim: int, is_query: str, k: int, config: IndexConfig) -> DataFrame:
    spark = v.sparkSession
    half = dim // 2
    # Equal vectors are one entry: a query's nearest can only be its k + 1 smallest ids.
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = v.distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sample = entries.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(config.sample).select("vector").toPandas()
    points = unit(np.stack(sample["vector"].to_numpy()))
    books = [
        k_means(points[:, :half], config.centroids, config.rounds, config.seed),
        k_means(points[:, half:], config.centroids, config.rounds, config.seed + 1),
    ]
    shared = spark.sparkContext.broadcast(books)
    width = len(books[1])

    def halves(frame: pd.DataFrame) -> list[np.ndarray]:
        x = unit(np.stack(frame["vector"].to_numpy()))
        return [distances(x[:, :half], shared.value[0]), distances(x[:, half:], shared.value[1])]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                near = [d.argmin(axis=1) for d in halves(frame)]
                yield frame.assign(cell=near[0] * width + near[1])

    indexed = stored(entries.mapInPandas(assign, "vector array<double>, ids array<bigint>, cell int"), "index")
    held = np.zeros(len(books[0]) * width, np.int64)  # one number per cell: a fixed size
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        held[r["cell"]] = r["n"]
    wanted = max(config.entries, math.ceil(config.share * held.sum()))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                near = halves(frame)
                cells = [visit(a, b, held, wanted) for a, b in zip(*near)]
                yield frame.assign(cell=cells).explode("cell").astype({"cell": "int32"})

    queries = v.filter(is_query).distinct()
    visits = queries.mapInPandas(plan, "vec_id bigint, vector array<double>, cell int")
    visits = stored(visits, "visits")
    # Blocks: entries and queries of a cell are dealt so that each comparison holds about ``block`` of both.
    count_e = indexed.groupBy("cell").agg(F.ceil(F.count("*") / config.block).cast("int").alias("ne"))
    count_q = visits.groupBy("cell").agg(F.ceil(F.count("*") / config.block).cast("int").alias("nq"))
    blocks = count_e.join(count_q, "cell")
    e = indexed.join(blocks, "cell").withColumn("eb", F.pmod(F.xxhash64("vector"), F.col("ne")).cast("int"))
    e = e.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("cell", "eb", "qb", "vector", "ids")
    q = visits.join(blocks, "cell").withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.col("nq")).cast("int"))
    q = q.withColumn("eb", F.explode(F.sequence(F.lit(0), F.col("ne") - 1))).select("cell", "eb", "qb", "vec_id", "vector")

    def rerank(key, qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and len(es):
            e_unit, ids = unit(np.stack(es["vector"].to_numpy())), es["ids"].to_numpy()
            q_unit, q_ids = unit(np.stack(qs["vector"].to_numpy())), qs["vec_id"].to_numpy()
            for at in range(0, len(qs), 256):
                rough = q_unit[at : at + 256] @ e_unit.T
                few = min(k + 1, len(es))  # one may be the query itself
                top = np.argpartition(rough, -few, axis=1)[:, -few:]
                floor = np.take_along_axis(rough, top, axis=1).min(axis=1) - 1e-9
                tied = (rough >= floor[:, None]).sum(axis=1) > few
                for i, query in enumerate(q_ids[at : at + 256]):
                    near = np.flatnonzero(rough[i] >= floor[i]) if tied[i] else top[i]
                    score = (e_unit[near] * q_unit[at + i]).sum(axis=1)
                    rows = [(-s, int(x)) for s, n in zip(score.tolist(), near) for x in ids[n] if x != query]
                    found += [(query, x, -s) for s, x in heapq.nsmallest(k, rows)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["cell", "eb", "qb"]
    near = q.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

