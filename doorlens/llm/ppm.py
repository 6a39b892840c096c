"""Language identification by prediction by partial matching.

Per language, a context tree over bytes holds how often each byte followed each context of up to ``order`` bytes. A
byte's code length is -log2 of its share at the longest known context; a byte unseen there costs an escape (distinct
followers against all, method C) and is tried one order lower, down to a uniform byte. The statistics are frozen after
training, so the code length of a text is the sum over its positions of a value that depends on order + 1 bytes only:
known grams are looked up in a table with one column per language, all others walk down the orders. Texts are read
whole; the language of the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.llm.shared import row_of, runs, slices

U = np.uint64


@dataclass(frozen=True)
class PpmConfig:
    """``sample`` bounds the training documents per language (about; smallest hashes); all of their grams are kept."""

    order: int = 4
    sample: int = 1200
    seed: int = 3


class GramTable:
    """Open-addressing hash table from 64-bit grams to row numbers, for whole arrays at once."""

    def __init__(self, grams: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(grams), 1) * 2.5))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        slot, left = self.slot(grams), np.arange(len(grams), dtype=np.int32)
        while len(left):
            free = self.rows[slot[left]] < 0
            trying = left[free]
            self.rows[slot[trying]] = trying  # of several the last one stays
            placed = trying[self.rows[slot[trying]] == trying]
            self.keys[slot[placed]] = grams[placed]
            left = left[self.rows[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram, -1 where unknown."""
        slot = self.slot(grams)
        row = self.rows[slot]
        miss = np.flatnonzero((row >= 0) & (self.keys[slot] != grams))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            row[miss] = self.rows[slot[miss]]
            miss = miss[(row[miss] >= 0) & (self.keys[slot[miss]] != grams[miss])]
        return row


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes at every position, as one number; zero bytes stand before each text's start."""
    grams = data.astype(np.uint64)
    for k in range(1, order + 1):
        grams[k:] |= data[:-k].astype(np.uint64) << U(8 * k)
    starts, ends = offsets[:-1], offsets[1:]
    for k in range(order):  # cut what reaches into the text before
        at = starts[starts + k < ends] + k
        grams[at] &= U((1 << (8 * (k + 1))) - 1)
    return grams


class PpmModel:
    """Frozen statistics of all languages."""

    def __init__(self, languages: list[str], lang_no: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int):
        self.languages, self.order = languages, order
        if not len(gram):  # nothing learned: every byte costs 8 bits
            lang_no, gram, count = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1)
        n = len(languages)
        self.tables: list[GramTable] = []
        self.costs: list[np.ndarray] = []
        self.escapes: list[tuple[GramTable, np.ndarray]] = []
        for k in range(order + 1):
            mask = U((1 << (8 * (k + 1))) - 1)
            keys, pos = np.unique(gram & mask, return_inverse=True)
            seen = np.zeros((len(keys), n))
            np.add.at(seen, (pos, lang_no), count)
            contexts, of = np.unique(keys >> U(8), return_inverse=True)  # the context is what precedes the last byte
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(seen / (total + kinds)[of])
            self.escapes.append((GramTable(contexts), escape))
            lower = self.below(keys, k)
            self.tables.append(GramTable(keys))
            self.costs.append(np.where(seen > 0, hit, escape[of] + lower))

    def below(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last byte at order k - 1 and lower."""
        if k == 0:
            return np.full((len(grams), len(self.languages)), 8.0)
        return self.bits(grams & U((1 << (8 * k)) - 1), k - 1)

    def bits(self, grams: np.ndarray, k: int | None = None) -> np.ndarray:
        """Code length of the last byte of each gram (rows) in each language (columns), from order k down."""
        k = self.order if k is None else k
        row = self.tables[k].find(grams)
        out = self.costs[k][row]
        unknown = np.flatnonzero(row < 0)
        if len(unknown):
            rest = grams[unknown]
            table, escape = self.escapes[k]
            context = table.find(rest >> U(8))
            out[unknown] = self.below(rest, k) + np.where(context[:, None] >= 0, escape[context], 0.0)
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, block: int = 250_000) -> np.ndarray:
        """Bits of each text in each language; what is held at once has the size of a block, however long a text is."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for text, grams in gram_blocks(data, offsets, self.order, block):
            first = runs(text)[:-1]
            out[text[first]] += np.add.reduceat(self.bits(grams), first)
        return out


def gram_blocks(data: np.ndarray, offsets: np.ndarray, order: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, gram) of the bytes of all texts, ``block`` bytes at a time; a block reads ``order`` bytes before it."""
    for lo in range(0, len(data), block):
        hi = min(lo + block, len(data))
        begin = max(lo - order, 0)
        edges = np.unique(np.clip(offsets, begin, hi)) - begin
        grams = grams_of(data[begin:hi], edges, order)[lo - begin :]
        yield np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1, grams


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and their offsets."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def fit(docs: DataFrame, config: PpmConfig = PpmConfig()) -> PpmModel:
    """Counts grams of about ``config.sample`` documents per language (column ``lang``; null languages and texts are ignored)."""
    usable = docs.filter("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return PpmModel(["und"], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), config.order)
    scale = 1 << 30
    limit = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, int(config.sample / sizes[k] * scale))]), F.col("lang"))
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(config.seed), "doc_id"), F.lit(scale)) < limit)
    number = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = batch.column(0).to_numpy()
            for text, grams in gram_blocks(data, offsets, config.order, 4_000_000):
                found, n = np.unique(grams | (langs[text].astype(np.uint64) << U(40)), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])

    counted = chosen.select(number.cast("bigint"), "text").mapInArrow(count, "g bigint, n bigint")
    tree = counted.groupBy("g").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    key = tree["g"].to_numpy(np.int64).view(np.uint64)
    return PpmModel(languages, (key >> U(40)).astype(np.int64), key & U((1 << 40) - 1), tree["n"].to_numpy(float), config.order)


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (posterior of that language by code lengths) to every row.

    Null texts and texts without any letter are ``und`` with score 0. Input columns of these two names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        model = shared.value
        data, offsets = text_bytes(texts)
        best, score = [], []
        for a, b in slices(np.diff(offsets), 2_000_000):
            bits = model.code_lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            k = bits.argmin(axis=1)
            best += [model.languages[i] for i in k]
            score += (1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)).tolist()
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select(row_of(docs), lettered.alias("lettered"), guess(F.coalesce("text", F.lit(""))).alias("guess"))
    return found.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")],
        F.when(F.col("lettered"), F.col("guess.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.col("guess.score")).otherwise(0.0).alias("score"),
    )
