"""Cross-tokenizer alignment: which ids of tokenizer B stand for the same bytes as an id of tokenizer A.

A text and the space before it are encoded by both tokenizers. Byte offsets where tokens of both end cut the tokens
into groups; every A token of a group is linked with every B token of it. A link's count is the number of documents
that hold its id pair linked.

Identity map: for every A id the B id of the same bytes is computed once. A group of one A and one B token is nearly
always such a pair, so these pairs are counted in vectors as long as A's vocabulary, one a task, whose sum has at most
that many rows. Only the other pairs, which irregular groups make, are shuffled: distinct per chunk of documents, joined
with their counts, and brought back to the chunk.

Neither tokenizer joins bytes across the start of white space (``Tokenizers`` derives the exceptions from B's
vocabulary), so both end a token there and texts fall apart into units, white space and the word after it. Units repeat; their
tokens and groups are kept in each Python worker.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.llm.shared import runs, slices, stored
from doorlens.llm.tokens import tokenizer_file

# fixed values: the characters that A's splitting takes for white space
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNIT = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
LEAD = re.compile(f"[{BLANKS}]*")
BOUNDARY = re.compile(f"(?<=[^{BLANKS}])(?=[{BLANKS}])")
BLANK = re.compile(f"[{BLANKS}]")
CODE_BITS = 40  # of a pair's code


@dataclass(frozen=True)
class AlignConfig:
    a_file: str | None = None  # a file of the tokenizers library (byte-level)
    b_file: str | None = None  # a sentencepiece model that puts a space before the text
    chunk_bytes: int = 4_000_000  # text bytes whose pairs meet their counts together
    segment: int = 1_000_000  # characters of a text that are split into units at once
    cache: int = 600_000  # units kept per Python worker

    def files(self) -> tuple[str, str]:
        return self.a_file or tokenizer_file("byte_bpe_50k.json"), self.b_file or tokenizer_file("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this worker one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        # Each character up to U+07FF is one letter per byte in byte-level text; these cover all bytes
        # but the 13 that no UTF-8 text holds.
        level, letters = ByteLevel(add_prefix_space=False, use_regex=False), {}
        for c in [*range(0x800), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)]:
            if not 0xD800 <= c < 0xE000:
                shown = level.pre_tokenize_str(chr(c))[0][0]
                letters.update(zip(shown, chr(c).encode()))
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(ch in letters for ch in token):
                self.a_bytes[i] = bytes(letters[ch] for ch in token)
        self.b_bytes: list[bytes | None] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(None)
            elif self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
        same: dict[bytes, int] = {}
        for i, raw in enumerate(self.b_bytes):  # a piece goes before a byte of the same value
            if raw is not None and (raw not in same or self.b.is_byte(same[raw])):
                same[raw] = i
        self.identity = np.array([same.get(raw, -1) if raw is not None else -1 for raw in self.a_bytes], np.int64)
        self.a_length, self.b_length = (np.array([len(x or b"") for x in raw]) for raw in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        # White space that B may join to what stands before it: no unit may begin there.
        pieces = [x.decode("utf-8", "replace") for x in self.b_bytes if x]
        self.joins = {y for p in pieces for x, y in zip(p, p[1:]) if BLANK.match(y) and (not BLANK.match(x) or (x == " " and y != " "))}

    def units(self, text: str) -> list[str]:
        """The text in units, between which neither tokenizer joins anything."""
        found = UNIT.findall(text)
        if not any(c in text for c in self.joins):
            return found
        out: list[str] = []
        for u in found:
            if out and any(c in self.joins for c in LEAD.match(u)[0]):
                out[-1] += u
            else:
                out.append(u)
        return out

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers of units as they stand inside a text."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u.removeprefix(" ") for u in units], num_threads=1)
        for k, u in enumerate(units):
            if u == " ":
                b[k] = [self.space]
            elif not u.startswith(" "):  # the library's own space is no part of the unit
                b[k] = b[k][1:] if b[k][:1] == [self.space] else [-1]
        return a, b


@dataclass
class Groups:
    """Groups of units: per unit the numbers n_a, n_b, n_groups, n_links and the digest's part; whether both
    tokenizers spell it; its distinct pairs (codes a * size of B + b, from ``at[k]`` to ``at[k + 1]``) with their links."""

    numbers: np.ndarray
    shown: list[bytes]
    whole: np.ndarray
    at: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their amounts."""
    order = np.argsort(keys, kind="stable")
    keys, amounts = keys[order], amounts[order]
    first = runs(keys)[:-1]
    return keys[first], np.add.reduceat(amounts, first) if len(first) else amounts


def flat(values: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, values), np.int64, len(values))
    return np.fromiter(chain.from_iterable(values), np.int64, int(count.sum())), count


def grouped(units: list[bytes], a: list[list[int]], b: list[list[int]], tokens: Tokenizers) -> Groups:
    """Groups of all units at once. Their bytes are laid end to end; both tokenizers end a token at each unit's end."""
    a_raw, b_raw, n = tokens.a_bytes, tokens.b_bytes, len(units)
    whole = np.ones(n, bool)
    for ids, raw in ((a, a_raw), (b, b_raw)):
        spelled = [raw[i] if i >= 0 else None for i in chain.from_iterable(ids)]
        if None in spelled or b"".join(spelled) != b"".join(units):
            for k, x in enumerate(ids):
                parts = [raw[i] if i >= 0 else None for i in x]
                whole[k] &= None not in parts and b"".join(parts) == units[k]
    a, b = ([x if w else [] for x, w in zip(ids, whole)] for ids in (a, b))
    (a, a_count), (b, b_count) = flat(a), flat(b)
    size = len(b_raw)
    a_ends, b_ends = np.cumsum(tokens.a_length[a]), np.cumsum(tokens.b_length[b])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    unit = np.repeat(np.arange(n), a_count)[first_a] if len(cuts) else np.zeros(0, np.int64)
    numbers = np.column_stack([a_count, b_count, np.bincount(unit, minlength=n), np.bincount(unit, n_a * n_b, n).astype(np.int64)])
    # Links: single pairs as they are; small groups in full; large ones by distinct ids, whose occurrences multiply.
    links = n_a * n_b
    small = links <= 4096
    of = np.repeat(np.flatnonzero(small), links[small])
    k = np.arange(len(of)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    codes = [a[first_a[of] + k // n_b[of]] * size + b[first_b[of] + k % n_b[of]]]
    owner, times = [unit[of]], [np.ones(len(of), np.int64)]
    for g in np.flatnonzero(~small):
        ka, ta = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        kb, tb = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        codes.append((ka[:, None] * size + kb[None, :]).ravel())
        times.append((ta[:, None] * tb[None, :]).ravel())
        owner.append(np.full(len(codes[-1]), unit[g]))
    keys, times = summed((np.concatenate(owner) << CODE_BITS) | np.concatenate(codes), np.concatenate(times))
    at = np.searchsorted(keys >> CODE_BITS, np.arange(n + 1))
    # The digest's parts: A's ids, then B's, group by group; what follows each id depends on where it stands.
    side = np.concatenate((2 * a_group, 2 * b_group + 1))
    order = np.argsort(side, kind="stable")
    side = side[order]
    last = np.concatenate((side[1:] != side[:-1], [True])) if len(side) else np.zeros(0, bool)
    ends = np.concatenate((unit[1:] != unit[:-1], [True])) if len(unit) else np.zeros(0, bool)
    mark = np.where(last, np.where(side % 2 == 0, 1, np.where(ends[side // 2], 3, 2)), 0)
    written = "".join(chain.from_iterable(zip(map(str, np.concatenate((a, b))[order].tolist()), map(",|;\n".__getitem__, mark.tolist()))))
    lines = iter(written.encode().split(b"\n"))
    shown = [next(lines) if c else b"" for c in a_count.tolist()]
    return Groups(numbers, shown, whole, at, keys & ((1 << CODE_BITS) - 1), times)


class Aligner:
    """Aligns texts unit by unit; one per Python worker."""

    def __init__(self, config: AlignConfig):
        self.config, self.tokens = config, Tokenizers(*config.files())
        self.size = len(self.tokens.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.weight = 0
        none = np.zeros(0, np.int64)
        self.seen = Groups(np.zeros((0, 4), np.int64), [], np.zeros(0, bool), np.zeros(1, np.int64), none, none)

    def learn(self, units: set[str]) -> None:
        """Adds the groups of units that are not known."""
        if len(self.known) > self.config.cache or self.weight > 64 * self.config.cache:
            self.forget()
        fresh = [u for u in units if u not in self.known]
        if not fresh:
            return
        got, old = grouped([u.encode() for u in fresh], *self.tokens.encode(fresh), self.tokens), self.seen
        self.known.update(zip(fresh, range(len(old.shown), len(old.shown) + len(fresh))))
        self.weight += sum(map(len, fresh))
        old.shown.extend(got.shown)
        both = [np.concatenate(x) for x in ((old.numbers, got.numbers), (old.whole, got.whole), (old.at, got.at[1:] + old.at[-1]), (old.pairs, got.pairs), (old.times, got.times))]
        self.seen = Groups(both[0], old.shown, *both[1:])

    def segments(self, text: str) -> Iterator[str]:
        """A text in consecutive parts that begin at units."""
        at = 0
        while len(text) - at > self.config.segment:
            cut = BOUNDARY.search(text, at + self.config.segment)
            # a part must not begin with what may belong to the unit before
            while cut and any(c in self.tokens.joins for c in LEAD.match(text, cut.end())[0]):
                cut = BOUNDARY.search(text, cut.end() + 1)
            if not cut:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, ...]]]:
        """Per text its numbers, its digest ('' without tokens) and (identity ids, links, other codes, links)."""
        n = len(texts)
        numbers, whole, digests = np.zeros((n, 4), np.int64), np.array([bool(t) for t in texts], bool), [hashlib.sha256() for _ in texts]
        keys, times, begun = np.zeros(0, np.int64), np.zeros(0, np.int64), [False] * n
        waiting: list[tuple[int, str]] = []
        size = 0

        def settle() -> None:
            nonlocal keys, times
            cut = [self.tokens.units(s) for _, s in waiting]
            self.learn(set(chain.from_iterable(cut)))
            index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
            doc = np.repeat([k for k, _ in waiting], list(map(len, cut)))
            seen, at = self.seen, 0
            for (k, _), units in zip(waiting, cut):
                digests[k].update(b";" * begun[k] + b";".join([seen.shown[i] for i in index[at : at + len(units)].tolist()]))
                begun[k], at = True, at + len(units)
            both, count = np.unique((doc << 32) | index, return_counts=True)
            doc, index = both >> 32, both & 0xFFFFFFFF
            np.add.at(numbers, doc, seen.numbers[index] * count[:, None])
            np.logical_and.at(whole, doc, seen.whole[index])
            width = seen.at[index + 1] - seen.at[index]
            place = np.repeat(seen.at[index] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            key = (np.repeat(doc, width) << CODE_BITS) | seen.pairs[place]
            key, time = summed(key, seen.times[place] * np.repeat(count, width))
            keys, times = summed(np.concatenate((keys, key)), np.concatenate((times, time)))
            waiting.clear()

        for k, text in enumerate(texts):
            for segment in self.segments(" " + text) if text else ():
                waiting.append((k, segment))
                size += len(segment)
                if size >= self.config.segment:
                    settle()
                    size = 0
        if waiting:
            settle()
        numbers[~whole] = 0
        codes = keys & ((1 << CODE_BITS) - 1)
        same = self.tokens.identity[codes // self.size] == codes % self.size
        bounds = np.searchsorted(keys >> CODE_BITS, np.arange(n + 1))
        out, none = [], np.zeros(0, np.int64)
        for k in range(n):
            c, t, m = (x[bounds[k] : bounds[k + 1]] for x in (codes, times, same))
            out.append((c[m] // self.size, t[m], c[~m], t[~m]) if whole[k] else (none,) * 4)
        return numbers, [d.hexdigest() if w else "" for d, w in zip(digests, whole)], out


@lru_cache(maxsize=1)
def aligner(config: AlignConfig) -> Aligner:
    return Aligner(config)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
LISTS = ("ids", "id_links", "pairs", "pair_links")
ALIGNED = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, ids array<int>, id_links array<bigint>, pairs array<bigint>, pair_links array<bigint>"


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), pa.int64()).cast(kind))


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def aligned(docs: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """One row per document: sums, digest of its groups, identity ids and other pairs (codes) with their links."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number = aligner(config), 0
        for batch in batches:
            text = batch.column(2)
            sizes = np.diff(pc.fill_null(pc.binary_length(text), 0).to_numpy().cumsum(), prepend=0)
            for a, b in slices(sizes, config.chunk_bytes):
                numbers, digests, found = of.align(text.slice(a, b - a).to_pylist())
                cols = list(zip(*found))
                chunk = (batch.column(0)[a].as_py() << 32) + number
                number += 1
                yield pa.record_batch(
                    [
                        pa.array(np.full(b - a, chunk)), batch.column(1).slice(a, b - a),
                        *[pa.array(numbers[:, k]) for k in range(4)], pa.array(digests, pa.string()),
                        lists(cols[0], pa.int32()), *[lists(c, pa.int64()) for c in cols[1:]],
                    ],
                    names=["chunk", "doc_id", *NUMBERS, "groups_sha256", *LISTS],
                )

    source = docs.select(F.spark_partition_id().cast("bigint"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(rows, ALIGNED)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per key of a list column of distinct keys: one addition per batch, so a hot key leaves a batch once."""
    for batch in batches:
        keys, n = np.unique(parts(batch.column(0))[0].astype(np.int64), return_counts=True)
        yield pa.record_batch([pa.array(keys), pa.array(n.astype(np.int64))], names=["k", "n"])


def identity_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents per A id whose identity pair is linked: a vector of A's vocabulary a task, added up."""

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(parts(batch.column(0))[0], minlength=size)
        ids = np.flatnonzero(total)
        yield pa.record_batch([pa.array(ids), pa.array(total[ids])], names=["k", "n"])

    got = rows.select("ids").mapInArrow(vector, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)  # at most one row per A id came back
    out[got["k"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): documents per pair code that is no identity pair."""
    return rows.select("pairs").mapInArrow(counted, "k bigint, n bigint").groupBy(F.col("k").alias("pair")).agg(F.sum("n").alias("n"))


def table(docs: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """The alignment itself: a_id, b_id, documents (that hold the pair linked), best (highest of its a_id, ties too)."""
    of, spark = aligner(config), docs.sparkSession
    rows = stored(aligned(docs, config), "aligned")
    same = identity_counts(rows, len(of.tokens.identity))
    ids = np.flatnonzero(same)
    known = spark.createDataFrame(list(zip(ids.tolist(), of.tokens.identity[ids].tolist(), same[ids].tolist())), "a_id int, b_id int, documents bigint")
    other = pair_counts(rows).select(
        F.floor(F.col("pair") / of.size).cast("int").alias("a_id"), (F.col("pair") % of.size).cast("int").alias("b_id"), F.col("n").alias("documents")
    )
    every = stored(other.unionByName(known), "pairs")
    most = every.groupBy("a_id").agg(F.max("documents").alias("most"))  # at most A's vocabulary
    return every.join(F.broadcast(most), "a_id").select("a_id", "b_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def report(docs: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Null and empty texts, and texts that one tokenizer cannot spell, have no tokens: zeros and an empty digest.
    Repeated rows and rows without id are documents of their own. Extra columns are ignored; an empty table gives no
    rows. A group without inner boundaries may be of any length; its distinct id pairs are what is kept of it.
    """
    of, spark = aligner(config), docs.sparkSession
    rows = stored(aligned(docs, config), "aligned")
    same = identity_counts(rows, len(of.tokens.identity))
    counts = stored(pair_counts(rows), "pairs")
    best, size = same.copy(), of.size
    got = counts.groupBy(F.floor(F.col("pair") / size).alias("a")).agg(F.max("n").alias("n")).toPandas()  # at most A's vocabulary
    at = got["a"].to_numpy(np.int64)
    best[at] = np.maximum(best[at], got["n"].to_numpy(np.int64))
    vectors = spark.sparkContext.broadcast((same, best))  # two numbers per A id

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            pairs, offsets = parts(batch.column(1))
            bounds = runs(chunks)
            for a, b in zip(bounds[:-1], bounds[1:]):
                keys = np.unique(pairs[offsets[a] : offsets[b]])
                yield pa.record_batch([pa.array(np.full(len(keys), chunks[a])), pa.array(keys.astype(np.int64))], names=["chunk", "pair"])

    wanted = rows.select("chunk", "pairs").mapInArrow(distinct, "chunk bigint, pair bigint").join(counts, "pair")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        same, best = vectors.value
        keys, n = right.column("pair").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        ids, at = parts(left.column("ids"))
        pairs, pair_at = parts(left.column("pairs"))
        id_links, pair_links = parts(left.column("id_links"))[0], parts(left.column("pair_links"))[0]
        count = n[np.searchsorted(keys, pairs)] if len(pairs) else np.zeros(0, np.int64)

        def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(values)))
            return total[offsets[1:]] - total[offsets[:-1]]

        n_best = per_row(id_links * (same[ids] == best[ids]), at) + per_row(pair_links * (count == best[pairs // size]), pair_at)
        total = per_row(id_links * same[ids], at) + per_row(pair_links * count, pair_at)
        out = left.select(["doc_id", *NUMBERS, "groups_sha256"])
        return out.append_column("n_best", pa.array(n_best.astype(np.int64))).append_column("count_sum", pa.array(total.astype(np.int64)))

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    per_chunk = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk"))
    done = per_chunk.applyInArrow(finish, schema)
    return done.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
