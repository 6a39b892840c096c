"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (lower case). A set's MinHash values are tokens of which similar sets
share a share equal to their Jaccard similarity. A path starts with a run; at every level a few coordinates are
sampled for the whole bucket, each with probability 1 / (threshold * coordinates), and a set goes on with its token at
each sampled coordinate. Buckets of bounded size are compared by brute force, larger ones split again, and buckets
that stay large at the deepest level are compared in blocks. Runs repeat until a pair at the threshold is met with the
target recall. What the sketches suggest is then verified exactly on the whole shingle sets.

Equal texts are one set, so copies cost nothing; bucket results leave as stars, never as all pairs of a group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorlens.llm.components import components
from doorlens.llm.shared import numbered_rows, runs, slices, stored, whole_groups, words


@dataclass(frozen=True)
class JoinConfig:
    shingle: int = 5
    threshold: float = 0.8
    coordinates: int = 128
    recall: float = 0.99
    depth: int = 3
    bucket: int = 2048  # sets that one brute-force task compares
    block: int = 1024  # sets in one block of the exact check
    block_words: int = 2_000_000  # words in one block of the exact check
    seed: int = 11

    def runs(self) -> int:
        """Runs after which a pair at the threshold has met, with the target recall, even at the deepest level."""
        met = 1.0
        for _ in range(self.depth):
            met = 1 - math.exp(-met)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - met))

    def sketch_matches(self) -> int:
        """Equal bytes of two sketches that a pair at the threshold reaches but for one in some thousand cases."""
        same = self.threshold + (1 - self.threshold) / 256
        return math.floor(self.coordinates * same - 3.5 * math.sqrt(self.coordinates * same * (1 - same)))


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words per row; rows of fewer words give one shingle of all their words.

    Returns the values and the row offsets; rows without words have none.
    """
    n = np.diff(offsets)
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    out_offsets = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(out_offsets[-1]) - out_offsets[row] + offsets[row]
    room = np.minimum(n[row], width)
    value = room.astype(np.uint64)
    for k in range(width):
        inside = k < room
        word = h[np.where(inside, at + k, at)] if len(h) else value
        value = np.where(inside, mix(value * U(0x9E3779B97F4A7C15) + word), value)
    return value, out_offsets


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def multipliers(config: JoinConfig) -> np.ndarray:
    return np.random.default_rng(config.seed).integers(1, 2**63, config.coordinates, dtype=np.uint64) * U(2) + U(1)


def signatures(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """Per row: doc_id, text_key (equal texts, equal keys), n_words, minhash (32-bit values as bytes; null without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(config)
        for batch in batches:
            hashes, offsets = list_parts(batch.column(2))
            parts: list = []
            for a, b in slices(np.diff(offsets), 200_000):
                inner = offsets[a : b + 1] - offsets[a]
                value, at = shingles(hashes[offsets[a] : offsets[b]], inner, config.shingle)
                full = np.flatnonzero(np.diff(at))
                low = np.zeros((len(full), config.coordinates), "<u4")
                if len(full):
                    for k, factor in enumerate(factors):
                        low[:, k] = np.minimum.reduceat(value * factor, at[full]) >> U(32)
                rows: list = [None] * (b - a)
                for i, r in enumerate(full):
                    rows[r] = low[i].tobytes()
                parts += rows
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(parts, pa.binary())],
                names=["doc_id", "text_key", "n_words", "minhash"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.md5(F.lower(text)), word_hashes(text))
    return source.mapInArrow(sign, "doc_id bigint, text_key string, n_words bigint, minhash binary")


def low_bytes(minhash: Column) -> Column:
    """Sketch of one byte per coordinate."""

    @F.arrow_udf("binary")
    def cut(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x[::4] for x in values.to_pylist()], pa.binary())

    return cut(minhash)


def chosen(paths: np.ndarray, config: JoinConfig) -> np.ndarray:
    """Which coordinates each path samples (rows: paths)."""
    n = config.coordinates
    draws = mix(paths[:, None] + np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return (draws >> U(11)).astype(np.float64) / 2.0**53 < 1 / (config.threshold * n)


def child(paths: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(paths + coordinate.astype(np.uint64) + U(1)) ^ (token.astype(np.uint64) + U(0x632BE59BD9B4E019)))


def minhash_rows(column: pa.Array, config: JoinConfig) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), config.coordinates)


def descend(sets: DataFrame, config: JoinConfig, first: bool) -> DataFrame:
    """One level: (rep, path) for the children of every set's path; at the first level for the root of each run."""
    roots = mix(np.arange(1, config.runs() + 1, dtype=np.uint64) + U(config.seed * 1_000_003))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                token = minhash_rows(part.column(1), config)
                rep = part.column(0).to_numpy()
                if first:
                    run, coordinate = np.nonzero(chosen(roots, config))
                    row = np.tile(np.arange(len(rep)), len(run))
                    coordinate, path = np.repeat(coordinate, len(rep)), np.repeat(roots[run], len(rep))
                else:
                    parent = part.column(2).to_numpy().view(np.uint64)
                    row, coordinate = np.nonzero(chosen(parent, config))
                    path = parent[row]
                out = child(path, coordinate, token[row, coordinate]).view(np.int64)
                yield pa.record_batch([pa.array(rep[row]), pa.array(out)], names=["rep", "path"])

    columns = ["rep", "minhash"] if first else ["rep", "minhash", "path"]
    return sets.select(*columns).mapInArrow(go, "rep bigint, path bigint")


def sized(records: DataFrame, name: str) -> DataFrame:
    """Records of buckets that hold at least two sets, with the bucket's size."""
    sizes = records.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(records.join(sizes, "path"), name)


def buckets(sets: DataFrame, config: JoinConfig) -> DataFrame:
    """(path, rep) of every bucket to compare; each holds about ``config.bucket`` sets or fewer."""
    level, out = sized(descend(sets, config, True), "level"), None
    for depth in range(1, config.depth + 1):
        small = level.filter(F.col("n") <= config.bucket).select("path", "rep")
        out = small if out is None else out.union(small)
        large = level.filter(F.col("n") > config.bucket)
        if large.isEmpty():
            return out
        if depth < config.depth:
            level = sized(descend(large.join(sets, "rep").select("rep", "minhash", "path"), config, False).distinct(), "level")
    return out.union(in_blocks(large, F.col("path"), F.ceil(F.col("n") * 2 / config.bucket)).select("path", "rep"))


def in_blocks(rows: DataFrame, group: Column, count: Column) -> DataFrame:
    """Deals the rows of a group into ``count`` blocks and sends each to every pair of blocks that holds its own.

    Adds ``path`` (the pair's key), ``own`` (the row's block) and ``low``, ``high`` (the pair).
    """
    dealt = rows.withColumn("_g", group).withColumn("_c", count.cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "_g"), F.col("_c")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "_other")).withColumn("high", F.greatest("own", "_other"))
    return dealt.withColumn("path", F.xxhash64("_g", "low", "high")).drop("_g", "_c", "_other")


def stars(links: np.ndarray) -> np.ndarray:
    """Smallest member index of each member's component, from a symmetric boolean matrix."""
    n = len(links)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        reached = np.zeros(n, bool)
        reached[i] = True
        edge = reached.copy()
        while edge.any():
            edge = links[edge].any(axis=0) & ~reached
            reached |= edge
        root[reached] = i
    return root


def sketch_stars(sketch: np.ndarray, least: int) -> np.ndarray:
    """As ``stars``, on sketches: a member joins who agrees in ``least`` bytes with any member reached so far."""
    n = len(sketch)
    root = np.full(n, -1)
    todo = np.arange(n)
    while len(todo):
        first, todo = todo[0], todo[1:]
        root[first] = first
        queue = [first]
        while queue and len(todo):
            near = (sketch[todo] == sketch[queue.pop()]).sum(axis=1) >= least
            found, todo = todo[near], todo[~near]
            root[found] = first
            queue += found.tolist()
    return root


def suggested(compare: DataFrame, config: JoinConfig) -> DataFrame:
    """Star edges (u, v) between sets of one bucket whose sketches agree."""
    least = config.sketch_matches()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 0):
            path, rep = table.column(0).to_numpy(), table.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(len(rep), -1)
            bounds = runs(path)
            size = np.diff(bounds)
            us, vs = [], []
            small = np.repeat(size <= 16, size)
            for step in range(1, 16):  # small buckets: all pairs at one distance at once
                i = np.flatnonzero(small[:-step] & (path[:-step] == path[step:])) if len(path) > step else np.zeros(0, int)
                if not len(i):
                    break
                i = i[(sketch[i] == sketch[i + step]).sum(axis=1) >= least]
                us.append(rep[i])
                vs.append(rep[i + step])
            for g in np.flatnonzero(size > 16):
                a, b = bounds[g], bounds[g + 1]
                root = sketch_stars(sketch[a:b], least)
                own = root != np.arange(b - a)
                us.append(rep[a:b][own])
                vs.append(rep[a:b][root[own]])
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    by_path = compare.select("path", "rep", "sketch").repartition("path").sortWithinPartitions("path")
    return by_path.mapInArrow(find, "u bigint, v bigint").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by the incidence of elements that at least two sets hold."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[element] > 1
    row, element = row[shared], element[shared]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    element = np.cumsum(np.concatenate(([0], element[1:] != element[:-1]))) if len(element) else element
    total = np.zeros((n, n))
    width = max(1, 4_000_000 // n)
    for at in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        a, b = np.searchsorted(element, [at, at + width])
        block = np.zeros((n, width), np.float32)
        block[row[a:b], element[a:b] - at] = 1
        total += block @ block.T
    return total


def verified(members: DataFrame, docs: DataFrame, config: JoinConfig) -> DataFrame:
    """Exact check inside suggested components: rows (u, v, links).

    ``v`` is the smallest set linked to u's, directly or by others, within one pair of blocks (u itself if none);
    ``links`` the number of documents whose sets reach the threshold with u's there. ``members``: rep, text_key,
    copies, root, blocks.
    """
    dealt = in_blocks(members, F.col("root"), F.col("blocks"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = dealt.join(texts, "rep").filter(F.md5(F.lower("_text")) == F.col("text_key"))
    rows = rows.select("path", "rep", "copies", "own", "low", "high", word_hashes(F.col("_text")).alias("hashes"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = list_parts(batch.column(6))
            out = []
            for a, b in slices(np.diff(offsets), 200_000):
                value, at = shingles(hashes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], config.shingle)
                out += [np.unique(value[at[i] : at[i + 1]]).tobytes() for i in range(b - a)]
            yield pa.record_batch([*batch.columns[:6], pa.array(out, pa.binary())], names=[*batch.schema.names[:6], "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 0):
            path, rep, copies, own, low, high = (table.column(k).to_numpy() for k in range(6))
            fresh = np.concatenate(([True], (path[1:] != path[:-1]) | (rep[1:] != rep[:-1])))  # a repeated row is one set
            path, rep, copies, own, low, high = (x[fresh] for x in (path, rep, copies, own, low, high))
            values = table.column(6).filter(pa.array(fresh))
            bounds = runs(path)
            u, v, links = rep.copy(), rep.copy(), np.zeros(len(rep), np.int64)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in values.slice(a, b - a)]
                common = common_counts(sets)
                size = np.array([len(x) for x in sets])
                linked = common >= config.threshold * (size[:, None] + size[None, :] - common) - 1e-9
                np.fill_diagonal(linked, False)
                if low[a] != high[a]:  # pairs inside one block are counted where that block meets itself
                    linked &= own[a:b, None] != own[None, a:b]
                links[a:b] = linked @ copies[a:b]
                v[a:b] = rep[a:b][stars(linked)]
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(links)], names=["u", "v", "links"])

    kept = "path bigint, rep bigint, copies bigint, own int, low int, high int, set binary"
    sets = rows.mapInArrow(to_sets, kept).repartition("path").sortWithinPartitions("path", "rep")
    return sets.mapInArrow(check, "u bigint, v bigint, links bigint")


def jaccard_join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """One row per document id: doc_id, class_id (smallest id of its class), links (documents at the threshold or above).

    Classes are the connected groups of links; a document's copies are links too. Null, empty and blank texts link to
    nothing and are classes of their own; texts of fewer than five words are one shingle. Rows without id are left
    out, rows of one id are one document (of differing texts the one with the smallest digest counts). Extra columns
    are ignored; an empty table gives no rows.
    """
    signed = stored(signatures(docs, config), "signatures")
    ids = signed.groupBy("doc_id").agg(F.min(F.struct("text_key", "n_words")).alias("k")).select("doc_id", "k.*")
    sized_ids = ids.filter("n_words > 0").groupBy("text_key")
    reps = sized_ids.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"))
    minhash = signed.groupBy("text_key").agg(F.first("minhash").alias("minhash"))  # equal texts, equal values
    sets = stored(reps.join(minhash, "text_key").withColumn("sketch", low_bytes(F.col("minhash"))), "sets")
    compare = buckets(sets, config).join(sets.select("rep", "sketch"), "rep")
    coarse = components(suggested(compare, config))
    members = coarse.join(sets.select("rep", "text_key", "copies", "n_words"), F.col("id") == F.col("rep"))
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / config.block), F.ceil(F.col("w") / config.block_words))
    members = members.join(sizes.select("root", blocks.alias("blocks")), "root")
    exact = stored(verified(members, docs, config), "links")
    roots = components(exact.filter("u <> v"))
    links = exact.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("_links"))
    classes = (
        sets.select("rep", "text_key", "copies")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "text_key",
            F.coalesce("root", "rep").alias("_class"),
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
        )
    )
    return ids.join(classes, "text_key", "left").select(
        "doc_id", F.coalesce("_class", "doc_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("links")
    )


def keep_first(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """Documents with one left of each class, that with the smallest id (null last, then by digest); columns unchanged.

    Every row is a document: rows of one id stay if their texts differ, rows without id are compared like others, and
    of equal rows one stays. Null, empty and blank texts are in no class: all of them stay.
    """
    rows = numbered_rows(docs, "rows")
    text = F.col("row.text")
    classes = jaccard_join(rows.select(F.col("number").alias("doc_id"), text.alias("text")), config)
    doc_id = F.col("row.doc_id")
    first = F.struct(doc_id.isNull().alias("absent"), doc_id.alias("id"), F.md5(text).alias("digest"), "number")
    ranked = rows.select(F.col("number").alias("doc_id"), first.alias("first")).join(classes, "doc_id")
    kept = ranked.groupBy("class_id").agg(F.min("first").alias("first")).select(F.col("first.number").alias("number"))
    return rows.join(kept, "number").select("row.*")
