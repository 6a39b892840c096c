"""Substring dedup by De Bruijn compaction.

Every window of ``window`` words is an edge of a De Bruijn graph over the corpus. Edges that occur once need no work,
and most do: each window is filed under its minimizer, the ``seed_words``-word sequence in it with the smallest hash,
neighbouring windows mostly share it, and only windows whose minimizer stands at two places or more can be repeated.

1. Edges are dealt by minimizer and sorted by hash: the first place (document, start) of an edge in the corpus is its
   source, all later ones are repeats. Neighbours meet in one task, so stretches leave it as one row. Inside a batch of
   documents only the first place of an edge leaves as an edge; later places leave as stretches that point to it, so
   no task ever holds all occurrences of an edge that stands in a third of all documents.
2. Such stretches meet the repeats of the document they point to (a join by document), and take over its sources.
3. Repeats that follow each other both here and at their source lie on one nonbranching path and compact to one span
   (window functions per document). Each window has one source, so the spans do not depend on partitions or batches.
4. Spans are joined with the words of their source, and with their own: only those whose words are equal count.

Documents with the text of an earlier one consist of repeats and never enter the graph.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.shared import runs, slices, whole_groups, words

U = np.uint64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class DedupConfig:
    window: int = 20
    seed_words: int = 8  # less than 256 below ``window``
    slice_words: int = 1_000_000  # words that one vectorised step holds
    hot: int = 4096  # minimizers whose rows are spread


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of ``width`` consecutive values at every start."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = out * U(base) + hashes[k : k + len(out)]
    return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values at every start, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def minimizers(hashes: np.ndarray, offsets: np.ndarray, config: DedupConfig) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer: row, first window, number of windows, minimizer."""
    span = config.window - config.seed_words + 1
    seeds = rolling(hashes, config.seed_words, 0x9E3779B97F4A7C15)
    least = sliding_least(seeds, span)
    count = np.maximum(np.diff(offsets) - config.window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    before = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(len(row)) - before[row]
    window = offsets[row] + at
    value = least[window]
    place = window.copy()  # leftmost place of the minimizer: one place is one occurrence, also in periodic texts
    for k in range(span - 1, -1, -1):
        place = np.where(seeds[window + k] == value, window + k, place)
    bounds = runs(place)
    first = bounds[:-1]
    return row[first], at[first], np.diff(bounds), value[first]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0]


def filed(base: DataFrame, config: DedupConfig) -> DataFrame:
    """(doc_id, run, m): runs of windows with their minimizers; a run is its start times 256 plus its length."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            hashes, offsets = flat(batch.column(1))
            for a, b in slices(np.diff(offsets), config.slice_words):
                row, start, n, m = minimizers(hashes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], config)
                yield pa.record_batch([pa.array(ids[a:b][row]), pa.array((start << 8) | n), pa.array(m.view(np.int64))], names=["doc_id", "run", "m"])

    hashed = base.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return hashed.mapInArrow(file, "doc_id bigint, run bigint, m bigint")


def edges(candidates: DataFrame, config: DedupConfig) -> DataFrame:
    """Windows of candidate runs: (h, check, doc_id, row, span).

    ``candidates``: doc_id, row, hashes (of all words), runs (as ``filed`` has them, with 23 bits of the minimizer above;
    below 0 for a minimizer whose rows are spread). The upper 24 bits of ``h`` are the minimizer's, the others the
    window's own hash; where rows are spread, all are the window's. ``check`` holds a second hash of 31 bits and, in its low half, the start of the
    window; few bytes matter here. The first place of an edge in its batch leaves without ``span``; later places leave
    as stretches (number of windows, document and place of the first one), under a random h.
    """
    names = ["h", "check", "doc_id", "row", "span"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            hashes, offsets = flat(batch.column(2))
            found = batch.column(3)
            run_at = found.offsets.to_numpy().astype(np.int64)
            run_at = run_at - run_at[0]
            codes = found.flatten().to_numpy(zero_copy_only=False)
            hot = codes < 0
            codes = np.where(hot, -1 - codes, codes)
            lengths, starts, seeds = codes & 0xFF, (codes >> 8) & 0xFFFFFFFF, codes >> 40
            parts = []
            for a, b in slices(np.diff(offsets), config.slice_words):
                lo, hi = run_at[a], run_at[b]
                size = lengths[lo:hi]
                of = np.repeat(np.repeat(np.arange(a, b), np.diff(run_at[a : b + 1])), size)
                start = np.repeat(starts[lo:hi], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                seed, spread = np.repeat(seeds[lo:hi], size).view(np.uint64), np.repeat(hot[lo:hi], size)
                fits = np.flatnonzero(start + config.window <= (offsets[1:] - offsets[:-1])[of])
                # rows of one id share their runs, which may overlap
                once, at = np.unique((of[fits] << 32) | start[fits], return_index=True)
                of, start, seed, spread = once >> 32, once & 0xFFFFFFFF, seed[fits][at], spread[fits][at]
                part = hashes[offsets[a] : offsets[b]]
                at = offsets[of] - offsets[a] + start
                h = rolling(part, config.window, 0xD6E8FEB86659FD93)[at]
                h = np.where(spread, h, (seed << U(40)) | (h >> U(24)))
                h2 = rolling(mix(part + U(77)), config.window, 0xA0761D6478BD642F)[at]
                h2 = (h2 >> U(33)).astype(np.int64)
                parts.append((h.view(np.int64), h2, ids[of], (rows[of] << 32) | start))
            if not parts or not sum(len(x[0]) for x in parts):
                continue
            h, h2, doc, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, doc, h2, h))
            h, h2, doc, place = h[order], h2[order], doc[order], place[order]
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])))
            cols = [pa.array(x[fresh]) for x in (h, (h2 << 32) | (place & 0xFFFFFFFF), doc, place >> 32)]
            yield pa.record_batch([*cols, pa.nulls(int(fresh.sum()), pa.binary())], names=names)
            first, later = np.flatnonzero(fresh)[np.cumsum(fresh) - 1], ~fresh
            doc, place, n, src_doc, src_place = paths(doc[later], place[later], doc[first[later]], place[first[later]])
            if len(doc):
                packed = np.column_stack([n, src_doc, src_place]).astype("<i8")
                spread = mix(doc.view(np.uint64) * U(31) + place.view(np.uint64)).view(np.int64)
                cols = [pa.array(x) for x in (spread, place & 0xFFFFFFFF, doc, place >> 32)]
                yield pa.record_batch([*cols, pa.array([x.tobytes() for x in packed], pa.binary())], names=names)

    schema = "h bigint, check bigint, doc_id bigint, row bigint, span binary"
    return candidates.select("doc_id", "row", "hashes", "runs").mapInArrow(cut, schema)


def paths(doc, place, src_doc, src_place) -> tuple[np.ndarray, ...]:
    """Repeats that follow each other here and at their source become one stretch.

    Returns document, place, number of windows, source document and source place of each stretch.
    """
    order = np.lexsort((place, doc))
    doc, place, src_doc, src_place = doc[order], place[order], src_doc[order], src_place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (src_doc[1:] != src_doc[:-1]) | (src_place[1:] != src_place[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(doc)])))
    return doc[first], place[first], n, src_doc[first], src_place[first]


SPAN = ["doc_id", "place", "n", "src_doc", "src_place"]
MET = ["at_doc", "kind", "at_place", "n", "other_doc", "other_place"]


def repeats(edge_rows: DataFrame) -> DataFrame:
    """(at_doc, kind, at_place, n, other_doc, other_place).

    ``kind`` 0: the windows at ``at`` have their first place in the corpus at ``other``; 1: those at ``other`` are
    equal to the ones at ``at``, whose first place is not known here.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            done = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            finished = batch.filter(pa.array(done))
            packed = np.frombuffer(b"".join(finished.column(4).to_pylist()), "<i8").reshape(-1, 3)
            h, check, doc, row = (c.to_numpy() for c in batch.columns[:4])
            place = (row << 32) | (check & 0xFFFFFFFF)
            cols = [packed[:, 1].copy(), np.ones(len(packed), np.int64), packed[:, 2].copy(), packed[:, 0].copy(), doc[done], place[done]]
            yield pa.record_batch([pa.array(x) for x in cols], names=MET)
            h, h2, doc, place = h[~done], check[~done] >> 32, doc[~done], place[~done]
            if not len(h):
                continue
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            src_doc, src_place = doc[first], place[first]
            if last is not None and last[:2] == (h[0], h2[0]):  # goes on from the batch before
                lead = first == 0
                src_doc[lead], src_place[lead] = last[2:]
                same[0] = True
            last = (h[-1], h2[-1], src_doc[-1], src_place[-1])
            doc, place, n, src_doc, src_place = paths(doc[same], place[same], src_doc[same], src_place[same])
            cols = [doc, np.zeros(len(doc), np.int64), place, n, src_doc, src_place]
            yield pa.record_batch([pa.array(x) for x in cols], names=MET)

    met = edge_rows.repartition(F.shiftright("h", 40)).sortWithinPartitions("h", F.shiftright("check", 32), "doc_id", "row", "check")
    return met.mapInArrow(find, ", ".join(f"{c} bigint" for c in MET))


def resolved(met: DataFrame) -> DataFrame:
    """(doc_id, place, n, src_doc, src_place): every repeated window with its first place in the corpus.

    Stretches that point to a place of ``at_doc`` take over what the document has there: the source where it is a
    repeat itself, the place where it is none. One task sees one document's rows at a time.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 0):
            at_doc, kind, place, n, other_doc, other_place = (table.column(k).to_numpy() for k in range(6))
            known = kind == 0
            yield pa.record_batch([pa.array(x[known]) for x in (at_doc, place, n, other_doc, other_place)], names=SPAN)
            bounds = runs(at_doc)
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = a + np.flatnonzero(known[a:b])
                asked = a + np.flatnonzero(~known[a:b])
                if not len(asked):
                    continue
                # The document's windows in order: gap, repeat, gap, repeat, …, gap
                ends = np.column_stack([place[own], place[own] + n[own]]).ravel()
                first = np.searchsorted(ends, place[asked], side="right")
                count = np.searchsorted(ends, place[asked] + n[asked], side="left") - first + 1
                of = np.repeat(asked, count)
                part = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                begin = np.maximum(place[of], np.concatenate(([np.iinfo(np.int64).min], ends))[part])
                end = np.minimum(place[of] + n[of], np.concatenate((ends, [np.iinfo(np.int64).max]))[part])
                src_doc, src_place = np.full(len(of), at_doc[a]), begin.copy()
                repeat = part % 2 == 1
                holder = own[part[repeat] // 2]
                src_doc[repeat] = other_doc[holder]
                src_place[repeat] = other_place[holder] + begin[repeat] - place[holder]
                some = end > begin
                cols = [other_doc[of], other_place[of] + begin - place[of], end - begin, src_doc, src_place]
                yield pa.record_batch([pa.array(x[some]) for x in cols], names=SPAN)

    dealt = met.repartition("at_doc").sortWithinPartitions("at_doc", "at_place")
    return dealt.mapInArrow(resolve, ", ".join(f"{c} bigint" for c in SPAN))


def compacted(spans: DataFrame) -> DataFrame:
    """Joins spans that follow each other here and at their source; any cut of them gives the same result."""
    by = Window.partitionBy("doc_id").orderBy("place")

    def before(c: str) -> Column:
        return F.lag(c).over(by)

    follows = (
        (before("place") + before("n") == F.col("place"))
        & (before("src_doc") == F.col("src_doc"))
        & (before("src_place") + before("n") == F.col("src_place"))
    )
    path = F.sum(F.when(follows, 0).otherwise(1)).over(by)
    joined = spans.withColumn("path", path).groupBy("doc_id", "path")
    found = joined.agg(F.min("place").alias("place"), F.sum("n").alias("n"), F.min("src_doc").alias("src_doc"), F.min("src_place").alias("src_place"))
    return found.select(SPAN)


def excerpt(words: list[bytes], start: int, n: int, window: int) -> bytes:
    """Digest of the words under ``n`` windows."""
    return hashlib.blake2b(b"\x00".join(words[start : start + n + window - 1]), digest_size=16).digest()


def with_source_words(spans: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """Adds ``words``: the digest of the source's words under the span, read off the source's text.

    Equal requests are asked once, so a passage of which half the corpus holds copies is read once a length.
    """
    asked = spans.select("src_doc", "src_place", "n").distinct()
    per_source = asked.groupBy(F.col("src_doc").alias("doc_id")).agg(F.collect_list(F.struct("src_place", "n")).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                inner = asked.values
                place, n = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                mine = np.flatnonzero(place >> 32 == row)
                if len(mine):
                    found = WORD.findall(text.as_buffer().to_pybytes())
                    out += [(doc, p, k, excerpt(found, p & 0xFFFFFFFF, k, window)) for p, k in zip(place[mine].tolist(), n[mine].tolist())]
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["src_doc", "src_place", "n", "words"])

    source = texts.join(per_source, "doc_id").select("doc_id", "row", "text", "asked")
    digests = source.mapInArrow(read, "src_doc bigint, src_place bigint, n bigint, words binary")
    return spans.join(digests, ["src_doc", "src_place", "n"])


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, row and copy: ``row`` tells repeated rows of one id apart (in order of the texts' digests),
    ``copy`` says that an earlier document has the same text. All uses share one exchange of the texts by doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.md5(text).alias("key"))
    ids = base.select("doc_id", "key")
    first = ids.groupBy("key").agg(F.min("doc_id").alias("first"))
    copies = ids.join(first, "key").filter("doc_id <> first").groupBy("doc_id").agg(F.collect_set("key").alias("copied"))
    in_order = Window.partitionBy("doc_id").orderBy("key")
    again = F.row_number().over(in_order) > F.rank().over(in_order)
    rows = base.join(copies, "doc_id", "left").select(
        "doc_id", "text", F.row_number().over(in_order).alias("row"), again.alias("_again"),
        F.coalesce(F.array_contains("copied", F.col("key")), F.lit(False)).alias("_copied"),
    )
    return rows.select("doc_id", "text", "row", (F.col("_again") | F.col("_copied")).alias("copy"))


def compared_spans(docs: DataFrame, config: DedupConfig) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, place, n, src_doc, src_place, words), and the numbered texts that they refer to."""
    texts = numbered(docs)
    fresh = texts.filter(~F.col("copy"))
    found = filed(fresh, config).filter("m is not null")  # said here, so that both uses of the counts share an exchange
    twice = found.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1")
    # The most frequent minimizers are known by a list of fixed length, their rows are spread; every other key holds
    # less than one part in ``hot`` of the rows.
    hot = twice.orderBy(F.desc("c"), "m").limit(config.hot).select("m", F.lit(True).alias("hot"))
    spread = found.join(F.broadcast(hot), "m", "left").select(
        "doc_id",
        F.when(F.col("hot"), -1 - F.col("run")).otherwise(F.col("run")).alias("run"),
        F.when(F.col("hot"), F.xxhash64("doc_id")).otherwise(F.col("m")).alias("k"),
    )
    again = twice.select(F.col("m").alias("k"), F.lit(True).alias("again"))
    repeated = spread.join(again, "k", "left").filter("run < 0 or again")
    with_seed = F.shiftleft(F.col("k").bitwiseAND(0x7FFFFF), 40).bitwiseOR(F.col("run"))
    code = F.when(F.col("run") < 0, F.col("run")).otherwise(with_seed)
    runs_of = repeated.groupBy("doc_id").agg(F.collect_list(code).alias("runs"))
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")
    candidates = fresh.join(runs_of, "doc_id").select("doc_id", "row", hashes, "runs")
    spans = compacted(resolved(repeats(edges(candidates, config))))
    return with_source_words(spans, texts, config.window), texts


def repeated_spans(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """doc_id, row, start, n (windows), src_doc, src_row, src_start of all repeats of windows (first places are none).

    Every span's words have been compared with its source's. Documents that are copies as a whole are left out, see
    ``numbered``.
    """
    spans, texts = compared_spans(docs, config)
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "src_doc", "src_place", "words")).alias("spans"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                own = [s for s in spans if s["place"] >> 32 == row]
                found = WORD.findall(text.as_buffer().to_pybytes()) if own else []
                for s in own:
                    start = s["place"] & 0xFFFFFFFF
                    if excerpt(found, start, s["n"], config.window) == s["words"]:
                        out.append((doc, row, start, s["n"], s["src_doc"], s["src_place"] >> 32, s["src_place"] & 0xFFFFFFFF))
            cols = list(zip(*out)) if out else [[]] * 7
            names = ["doc_id", "row", "start", "n", "src_doc", "src_row", "src_start"]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)

    schema = "doc_id bigint, row bigint, start bigint, n bigint, src_doc bigint, src_row bigint, src_start bigint"
    return texts.join(listed, "doc_id").select("doc_id", F.col("row").cast("bigint"), "text", "spans").mapInArrow(compare, schema)


def deduplicate(docs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256 for every row.

    A word goes if a window that covers it starts earlier too (smaller id, or same document and earlier start). Null
    texts have no words; rows without id are left out; of repeated ids, rows in order of their digests count as
    documents one after the other. Extra columns are ignored; an empty table gives no rows.
    """
    spans, texts = compared_spans(docs, config)
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "words")).alias("spans"))
    rows = texts.join(listed, "doc_id", "left").select("doc_id", "row", "text", "spans", "copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept, sha = [], [], [], []
            copies = batch.column(4).to_pylist()
            for row, text, spans, copy in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), copies):
                found = WORD.findall(text.as_buffer().to_pybytes())
                keep = np.full(len(found), not copy or len(found) < config.window)
                if spans.is_valid and not copy:
                    inner = spans.values
                    place, n = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                    source = inner.field(2)
                    for k in np.flatnonzero(place >> 32 == row).tolist():
                        start, count = int(place[k]) & 0xFFFFFFFF, int(n[k])
                        if excerpt(found, start, count, config.window) == source[k].as_py():
                            keep[start : start + count + config.window - 1] = False
                left = found if keep.all() else [w for w, k in zip(found, keep) if k]
                joined = b" ".join(left)
                n_words.append(len(found))
                n_removed.append(len(found) - len(left))
                kept.append(joined)
                sha.append(hashlib.sha256(joined).hexdigest())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.record_batch([*cols, texts, pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return rows.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
