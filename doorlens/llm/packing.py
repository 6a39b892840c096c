"""Best-fit packing of token pieces into sequences by a configuration linear program.

Only the length histogram (one row per length, never more rows than the sequence size) decides how pieces share
sequences. A configuration is a multiset of lengths that fits one sequence. The program "fewest configurations that
cover the histogram" is solved by multiplicative weights: lengths carry prices that fall as they are covered, and a
knapsack dynamic program values every room. Each pricing round reads many configurations of nearly the greatest value
off the same table, and they are taken in whole numbers, never more than the histogram still holds: the cover is whole as it
grows, so rounding takes nothing away. Since all lengths are covered at one pace, what is left keeps the shape of the
whole; the last ``residue`` is filled best-fit. The prices of every round also bound the program from below
(``Solution.bound``). The cost depends on the sequence size and the logarithm of the counts, not on the number of
documents; pieces take their places by rank in Spark.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.shared import stored
from doorlens.llm.tokens import END_ID, encoder, packed, tokenizer_file


@dataclass(frozen=True)
class PackingConfig:
    size: int = 4096
    step: float = 0.5  # how far full coverage lowers the price of a length, as an exponent
    round_share: float = 0.05  # of the open length, covered between two pricings
    loss: float = 0.003  # value that a configuration may lack against the best one
    residue: float = 0.01  # of the total length, left to best-fit
    tries: int = 30  # configurations in a row that lack more, then prices are set anew
    seed: int = 1
    ranked_rows: int = 50_000  # pieces that one ranking window holds on average


@dataclass(frozen=True)
class Solution:
    """Configurations with counts; those of the program come first. No packing has fewer than ``bound`` sequences."""

    configurations: list[tuple[list[int], int]]
    sequences: int
    from_program: int
    bound: float


def best_values(lengths: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Greatest value of a multiset of ``lengths`` (ascending) in every room from 0 to ``size``."""
    best = np.zeros(size + 1)
    if len(lengths):
        ends = np.searchsorted(lengths, np.arange(size + 1), side="right")
        for room in range(int(lengths[0]), size + 1):
            n = ends[room]
            best[room] = max(best[room - 1], (best[room - lengths[:n]] + values[:n]).max())
    return best


def configuration(lengths: np.ndarray, values: np.ndarray, left: np.ndarray, best: np.ndarray, loss: float, rng: np.random.Generator) -> tuple[dict[int, int], float]:
    """A random configuration of nearly the best value from what is left: {index of length: times}, and its value.

    From the full room down, a length is drawn among those whose loss against the table still fits the allowance;
    if there is none, the one that loses least is taken.
    """
    room, spare, used, value = len(best) - 1, loss * best[-1], {}, 0.0
    while True:
        n = int(np.searchsorted(lengths, room, side="right"))
        lack = best[room] - best[room - lengths[:n]] - values[:n]
        lack[left[:n] <= 0] = np.inf
        for k, times in used.items():
            if k < n and times >= left[k]:
                lack[k] = np.inf
        fine = np.flatnonzero(lack <= spare)
        if len(fine):
            k = int(fine[rng.integers(len(fine))])
        elif n and np.isfinite(lack).any():
            k = int(lack.argmin())
        else:
            return used, value
        used[k] = used.get(k, 0) + 1
        value += values[k]
        spare -= lack[k]
        room -= int(lengths[k])


def best_fit(left: np.ndarray, size: int) -> list[int]:
    """One configuration from what is left: the longest length, then always the longest that still fits."""
    have = np.flatnonzero(left)
    used: dict[int, int] = {}
    items, room = [], size
    while room:
        k = int(np.searchsorted(have, room, side="right")) - 1
        while k >= 0 and used.get(int(have[k]), 0) >= left[have[k]]:
            k -= 1
        if k < 0:
            break
        length = int(have[k])
        items.append(length)
        used[length] = used.get(length, 0) + 1
        room -= length
    return items


def solve(histogram: dict[int, int], config: PackingConfig = PackingConfig()) -> Solution:
    """Configurations that hold exactly the histogram's pieces."""
    size, rng = config.size, np.random.default_rng(config.seed)
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    need = np.array([histogram[int(k)] for k in lengths], np.int64)
    left, out, bound = need.copy(), [], 0.0
    total = open_length = int(lengths @ need)
    while open_length > config.residue * total and open_length > size:
        # Multiplicative weights: the more of a length is covered, the lower its price.
        values = np.where(left > 0, lengths / size * np.exp(-config.step * (1 - left / need)), 0.0)
        kinds = np.flatnonzero(left)
        best = best_values(lengths[kinds], values[kinds], size)
        bound = max(bound, float(need[kinds] @ values[kinds]) / best[-1])
        goal, failed, taken = open_length * (1 - config.round_share), 0, 0
        while open_length > goal and failed < config.tries:
            used, value = configuration(lengths[kinds], values[kinds], left[kinds], best, config.loss, rng)
            failed += 1
            if value < (1 - config.loss) * best[-1] and (taken or failed < config.tries):
                continue
            at, times = kinds[list(used)], np.array(list(used.values()))
            count = int((left[at] // times).min())
            count = -(-count // 2)  # no length goes at once
            left[at] -= count * times
            open_length -= count * int(lengths[at] @ times)
            out.append((sorted(np.repeat(lengths[at], times).tolist(), reverse=True), count))
            failed, taken = 0, taken + 1
    program = sum(count for _, count in out)
    rest = np.zeros(size + 1, np.int64)
    rest[lengths] = left
    while rest.any():
        items = best_fit(rest, size)
        kinds, times = np.unique(items, return_counts=True)
        count = int((rest[kinds] // times).min())
        rest[kinds] -= count * times
        out.append((items, count))
    return Solution(out, sum(count for _, count in out), program, max(bound, total / size))


def slot_table(configurations: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Places of the pieces of each length: ranks ``first .. first + count - 1`` go to consecutive sequences."""
    rows, next_rank, sequence = [], {}, 0
    for items, count in configurations:
        offset = 0
        for length in items:
            first = next_rank.get(length, 0)
            rows.append((length, first, count, sequence, offset))
            next_rank[length] = first + count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first_rank", "slots", "first_sequence", "offset"]).astype("int64")


def pieces_of(docs: DataFrame, file: str, config: PackingConfig, with_ids: bool = False) -> DataFrame:
    """Token pieces: row (a number of its own for every piece), doc_id, piece, start, length, ids_crc32 (and ids).

    Null texts give only the end id.
    """
    size, end = config.size, packed([END_ID])
    schema = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 7 if with_ids else 6]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row = encoder(file), 0
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            first = batch.column(0)[0].as_py() << 40 if batch.num_rows else 0
            for doc, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                ids = of.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for col, value in zip(cols, (first + row, doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(value)
                    row += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds[: len(names)])], names=names)

    source = docs.select(F.spark_partition_id().cast("bigint"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(cut, schema)


def ranked(pieces: DataFrame, rows_per_window: int) -> DataFrame:
    """Adds ``rank``, 0-based within each length: windows run per (length, bucket of row), a small table carries on.

    A length may hold any share of all pieces; its buckets grow with the number of pieces, and every piece has a row
    number of its own, so repeated documents spread too.
    """
    total = pieces.count()
    buckets = max(1, -(-total // rows_per_window))
    p = pieces.withColumn("_b", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = p.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    offsets = offsets.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("row")
    return (
        p.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_b"])
        .select(*pieces.columns, (F.col("_r") + F.col("_before")).alias("rank"))
    )


def pack(docs: DataFrame, config: PackingConfig = PackingConfig(), file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` and ``offset`` (gapless from 0).

    ``planned`` tells whether the sequence is a configuration of the program or of the residue. Null and empty texts
    are one piece of one id. Repeated rows and null ids are packed as rows of their own. An empty table gives no rows.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, file or tokenizer_file(), config, with_ids), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    solution = solve(histogram, config)
    slots = slot_table(solution.configurations)
    slots_df = spark.createDataFrame(slots, "length bigint, first_rank bigint, slots bigint, first_sequence bigint, offset bigint")
    places = slots_df.groupBy(F.col("length").alias("_length")).agg(
        F.sort_array(F.collect_list(F.struct("first_rank", "slots", "first_sequence", "offset"))).alias("_slots")
    )
    # One row per length, and never more slots than the solver's configurations hold: bounded by the sequence size.
    out = ranked(pieces, config.ranked_rows).join(F.broadcast(places), F.col("length") == F.col("_length"))
    place = slot_at(F.col("_slots"), F.col("rank"))
    sequence = F.col("_place.first_sequence") + F.col("rank") - F.col("_place.first_rank")
    return out.withColumn("_place", place).select(
        *[c for c in pieces.columns if c != "row"],
        sequence.alias("sequence_id"),
        F.col("_place.offset").alias("offset"),
        (sequence < solution.from_program).alias("planned"),
    )


def slot_at(slots: Column, rank: Column) -> Column:
    """The slot range that holds a rank; the ranges of a length cover all its ranks."""
    return F.element_at(F.filter(slots, lambda s: (s.first_rank <= rank) & (rank < s.first_rank + s.slots)), 1)
