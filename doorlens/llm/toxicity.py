"""Toxicity: a factorization machine over hashed terms.

A text becomes the set of its hashed terms: lower-case words and the prefixes of four and five letters of each word.
The machine adds to the linear weights one inner product per pair of terms, so that pairs (an insult with a group
mention) count beyond their parts. It is trained on a bounded sample of labelled rows; scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm.shared import row_of, runs, slices


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample`` bounds the labelled rows that the model is fitted on (smallest hashes of their ids).

    Every term of ``min_docs`` sampled rows takes part. ``min_z``, ``usual_docs`` and ``least`` size its steps, see ``trust``.
    """

    bits: int = 18
    factors: int = 8
    sample: int = 16_000
    min_docs: int = 3
    min_z: float = 3.0
    usual_docs: int = 100
    least: float = 0.05
    epochs: int = 10
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7


@dataclass
class FactorizationMachine:
    """Scores sets of hashed terms: bias + sum of weights + sum over pairs of inner products."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One logit per row; row i holds ``terms[offsets[i]:offsets[i + 1]]``. Rows without known terms get the bias."""
        out = np.full(len(offsets) - 1, self.bias)
        known = np.flatnonzero(self.weights[terms] != 0)
        if not len(known):
            return out
        row = np.searchsorted(offsets, known, side="right") - 1
        t = terms[known]
        starts = runs(row)[:-1]
        v = self.vectors[t].astype(np.float64)
        pairs = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
        out[row[starts]] += np.add.reduceat(self.weights[t].astype(np.float64), starts) + pairs.sum(axis=1) / 2
        return out


def with_terms(docs: DataFrame, bits: int) -> DataFrame:
    """Adds ``_terms``, the distinct hashed terms of ``text``; empty for null texts and texts without letters."""
    distinct = F.array_distinct(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}]+"))
    found = F.col("_found")

    def hashed(kind: str, w: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), w), F.lit(1 << bits)).cast("int")

    def prefix(n: int) -> Column:
        return F.transform(found, lambda w: hashed(f"p{n}", F.substring(w, 1, n)))

    terms = F.array_distinct(F.concat(F.transform(found, lambda w: hashed("w", w)), prefix(4), prefix(5)))
    return docs.withColumn("_found", F.array_remove(distinct, "")).withColumn("_terms", terms).drop("_found")


def trust(seen: np.ndarray, hit: np.ndarray, p: float, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a full step that the weights and the vectors of terms take, by rows and rows of label 1 that have them.

    A term whose own share of label 1 differs from ``p`` by ``min_z`` standard errors takes half steps, below that
    its weight takes less, but never under ``least``. Its vector takes at least the steps that its number of rows
    warrants, so a frequent term that says nothing alone learns its pairs.
    """
    z = np.abs(hit - seen * p) / np.sqrt(seen * p * (1 - p))
    alone = z**4 / (z**4 + config.min_z**4)
    return np.maximum(alone, config.least).astype(np.float32), np.maximum(alone, seen / (seen + config.usual_docs)).astype(np.float32)


def train(rows: list[np.ndarray], labels: np.ndarray, config: ToxicityConfig) -> FactorizationMachine:
    """Minibatch AdaGrad on the logistic loss; needs both classes, else a constant model."""
    size, k, f = 1 << config.bits, config.factors, np.float32
    rng = np.random.default_rng(config.seed)
    rate = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    weights, vectors = np.zeros(size, f), np.zeros((size, k), f)
    bias = float(np.log(rate / (1 - rate)))
    if not len(labels) or labels.min() == labels.max():
        return FactorizationMachine(bias, weights, vectors)
    flat = np.concatenate(rows).astype(np.int64)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen, hit = np.bincount(flat, minlength=size), np.bincount(flat, weights=labels[row_of], minlength=size)
    used = np.flatnonzero(seen >= config.min_docs)
    number = np.full(size, -1)
    number[used] = np.arange(len(used))
    flat = number[flat]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row_of[flat >= 0], minlength=len(rows)))))
    flat = flat[flat >= 0]
    w_step, v_step = trust(seen[used], hit[used], labels.mean(), config)
    w_step, v_step = f(config.rate) * w_step, f(0.1 * config.rate) * v_step[:, None]
    w, v = np.full(len(used), 1e-6, f), rng.normal(0, 0.02, (len(used), k)).astype(f)
    gw, gv, gb = np.full(len(used), 1e-6, f), np.full((len(used), k), 1e-4, f), 1e-6
    for _ in range(config.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), config.batch):
            part = order[at : at + config.batch]
            count = offsets[part + 1] - offsets[part]
            filled = np.flatnonzero(count)
            total, logit = np.zeros((len(part), k), f), np.full(len(part), bias)
            if len(filled):
                idx = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in part])
                starts = (np.cumsum(count) - count)[filled]
                vi = v.take(idx, axis=0)
                total[filled] = np.add.reduceat(vi, starts)
                square = np.add.reduceat(np.einsum("ij,ij->i", vi, vi), starts)
                logit[filled] += np.add.reduceat(w.take(idx), starts) + ((total[filled] ** 2).sum(axis=1) - square) / 2
            err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) / len(part)).astype(f)
            if len(filled):
                key = np.sort((idx << 32) | np.repeat(np.arange(len(part)), count))  # by term, then row
                first = runs(key >> 32)[:-1]
                t = key[first] >> 32
                both = np.column_stack([err[:, None] * total, err]).take(key & 0xFFFFFFFF, axis=0)
                both = np.add.reduceat(both, first)
                wt, vt = w[t], v[t]
                dw = both[:, k] + f(config.decay) * wt
                dv = both[:, :k] - both[:, k:] * vt + f(config.decay) * vt
                gw[t] += dw**2
                gv[t] += dv**2
                w[t] = wt - w_step[t] * dw / np.sqrt(gw[t])
                v[t] = vt - v_step[t] * dv / np.sqrt(gv[t])
            db = float(err.sum())
            gb += db**2
            bias -= 0.1 * config.rate * db / np.sqrt(gb)
    weights[used], vectors[used] = w, v
    return FactorizationMachine(float(bias), weights, vectors)


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> FactorizationMachine:
    """Fits on at most ``config.sample`` labelled documents; ``labels`` holds the rows to learn from.

    Labels: null ids or labels are ignored, a repeated id counts as toxic if any of its rows is. The sample's terms
    (not its texts) meet in one task, bounded by ``sample``; the model has a fixed size.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(config.sample)
    )
    sampled = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # at most config.sample rows
    rows = with_terms(sampled, config.bits).select("_id", "_y", "_terms")
    columns = config.factors + 1

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        all_rows = pd.concat(parts).sort_values("_id", kind="stable").drop_duplicates("_id")
        if not len(all_rows):
            return
        terms = [np.asarray(t, np.int64) for t in all_rows["_terms"]]
        model = train(terms, all_rows["_y"].to_numpy(float), config)
        used = np.flatnonzero(model.weights)
        yield pd.DataFrame({"term": [-1], "weights": [[model.bias] + [0.0] * config.factors]})
        if len(used):
            both = np.column_stack([model.weights[used], model.vectors[used]]).astype(float)
            yield pd.DataFrame({"term": used, "weights": list(both)})

    learned = rows.repartition(1).mapInPandas(learn, "term int, weights array<double>").toPandas()
    model = FactorizationMachine(-5.0, np.zeros(1 << config.bits, np.float32), np.zeros((1 << config.bits, columns - 1), np.float32))
    if len(learned):
        values, at = np.stack(learned["weights"].to_numpy()), learned["term"].to_numpy()
        model.bias = float(values[at < 0][0, 0])
        model.weights[at[at >= 0]] = values[at >= 0][:, 0]
        model.vectors[at[at >= 0]] = values[at >= 0][:, 1:]
    return model


def score(docs: DataFrame, model: FactorizationMachine, config: ToxicityConfig = ToxicityConfig(), out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row; null and empty texts get the model's base rate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(terms: pa.Array) -> pa.Array:
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        offsets = terms.offsets.to_numpy().astype(np.int64)
        flat = terms.flatten().to_numpy()
        offsets = offsets - offsets[0]
        parts = [
            shared.value.logits(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for a, b in slices(np.diff(offsets), 1_000_000)
        ]
        logit = np.concatenate(parts) if parts else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    return with_terms(docs, config.bits).withColumn(out, probability("_terms")).drop("_terms")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """Documents whose score stays below ``threshold``; columns unchanged."""
    model = fit(docs, labels, config)
    scored = score(docs.select(row_of(docs), "text"), model, config)
    return scored.filter(F.col("score") < threshold).select("row.*")
