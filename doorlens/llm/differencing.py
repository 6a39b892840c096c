"""Packing by Karmarkar-Karp multiway differencing.

Documents become token pieces of at most a window. A full piece is a window of its own; all others are dealt into
``k`` windows of near-equal sums: every piece begins as a partition of its own with one filled window, and the two partitions
with the greatest spreads are merged, the fullest window of one with the emptiest of the other, so that opposing
imbalances cancel, until one partition is left. ``k`` is the least number that could hold the pieces and rises
while the fullest window exceeds the capacity. Where that costs more than ``slack`` of the windows (and more than one),
the items are too coarse to balance: every eighth is cut into a half, a quarter, an eighth … and the group is dealt
again, then every fourth, and so on.

Groups are consecutive documents of one Spark task, closed by their number of tokens. They need no shuffle and no key, so
neither a hot source nor repeated rows gather anywhere, and a task holds one group's ids at a time.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from dataclasses import dataclass
from operator import itemgetter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.llm.tokens import END_ID, encoder, packed, tokenizer_file


@dataclass(frozen=True)
class DifferencingConfig:
    size: int = 2048
    windows: int = 512  # of one group, about
    slack: float = 0.005  # share of windows beyond the least number that is borne without cutting
    cut_every: tuple[int, ...] = (0, 8, 4, 2, 1)  # first no item is cut, then every eighth, …
    least_piece: int = 8  # pieces are not halved below


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` lists of item numbers whose sums of ``sizes`` are near-equal.

    A partition is the ascending list of its filled windows (sum, serial number, items as nested pairs); windows that
    are still empty are not written down. Merging two partitions pairs the fullest windows of one with the emptiest
    of the other: empty ones first, so short partitions just come together.
    """
    serial = len(sizes)
    heap = [(-n, i, [(n, i, i)]) for i, n in enumerate(sizes)]
    if k == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        if len(one) < len(two):
            one, two = two, one
        over = len(one) + len(two) - k  # so many filled windows meet filled ones: the fullest of two, the emptiest of one
        if over > 0:
            merged = []
            for a, b in zip(one[:over], reversed(two[len(two) - over :])):
                merged.append((a[0] + b[0], serial, (a[2], b[2])))
                serial += 1
            one, two = one[over:], two[: len(two) - over] + merged
        if len(two) > 16:
            one = sorted(one + two)
        else:
            for window in two:
                insort(one, window)
        spread = one[-1][0] - (one[0][0] if len(one) == k else 0)
        heapq.heappush(heap, (-spread, serial, one))
        serial += 1
    windows = [flattened(items) for _, _, items in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def flattened(items) -> list[int]:
    out, todo = [], [items]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        else:
            out.append(x)
    return out


def dealt(sizes: list[int], config: DifferencingConfig, most: int) -> list[list[int]] | None:
    """Windows within the capacity; the number rises from the least possible. None beyond ``most`` windows."""
    total = sum(sizes)
    k = -(-total // config.size)
    while k <= most:
        windows = differenced(sizes, k)
        fullest = max(sum(sizes[i] for i in w) for w in windows)
        if fullest <= config.size:
            return [w for w in windows if w]
        k += max(1, (fullest - config.size) * k // (4 * config.size))
    return None


def balanced(lengths: list[int], config: DifferencingConfig = DifferencingConfig()) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length) for items of at most one window each."""
    least = -(-sum(lengths) // config.size)
    most = least + max(1, int(config.slack * least))
    for every in config.cut_every:  # 0: nothing is cut
        pieces = [p for i, n in enumerate(lengths) for p in (halved(i, n, config.least_piece) if every and i % every == 0 else [(i, 0, n)])]
        windows = dealt([p[2] for p in pieces], config, most if every != 1 else len(pieces) + least)
        if windows is not None:
            break
    return [[pieces[i] for i in w] for w in windows]


def halved(item: int, length: int, least: int) -> list[tuple[int, int, int]]:
    """A half, a quarter, an eighth … of an item; the last two are below ``2 * least``."""
    out, start = [], 0
    while length - start >= 2 * least:
        half = (length - start) // 2
        out.append((item, start, half))
        start += half
    return [*out, (item, start, length - start)]


class Packer:
    """Collects the documents of a task into groups and gives the places of their pieces."""

    def __init__(self, config: DifferencingConfig, first_sequence: int):
        self.config, self.sequence = config, first_sequence
        self.rest: list[tuple[int | None, int, int, bytes]] = []  # doc_id, doc_tokens, start, ids below a window
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n, size = len(ids) // 4, self.config.size
        for start in range(0, n - n % size, size):
            yield from self.placed([(doc_id, n, start, ids[4 * start : 4 * (start + size)])])
        if n % size:
            self.rest.append((doc_id, n, n - n % size, ids[4 * (n - n % size) :]))
            self.tokens += n % size
        if self.tokens >= self.config.windows * size:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.rest:
            for window in balanced([len(r[3]) // 4 for r in self.rest], self.config):
                parts = []
                for i, start, length in sorted(window, key=itemgetter(0, 1)):
                    doc_id, n, before, ids = self.rest[i]
                    parts.append((doc_id, n, before + start, ids[4 * start : 4 * (start + length)]))
                yield from self.placed(parts)
        self.rest, self.tokens = [], 0

    def placed(self, parts: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, n, start, ids in parts:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.sequence, offset, ids
            offset += len(ids) // 4
        self.sequence += 1


def pack(docs: DataFrame, config: DifferencingConfig = DifferencingConfig(), file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts are one piece of one id. Repeated rows and null ids are packed as rows of their own. An empty
    table gives no rows. Extra columns are ignored. Each task leaves at most one group that is not full.
    """
    end, name = packed([END_ID]), file or tokenizer_file()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.binary()]
    width = 8 if with_ids else 7
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names[:width])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 8
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols[:width], kinds)], names=names[:width])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, packer, rows = encoder(name), None, []
        for batch in batches:
            for doc, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                if packer is None:
                    packer = Packer(config, batch.column(0)[0].as_py() << 36)
                rows += packer.add(doc, of.encode(text.as_py()) + end)
                if len(rows) >= 5000:
                    yield as_batch(rows)
                    rows = []
        if packer is not None:
            rows += packer.close()
        yield as_batch(rows)

    source = docs.select(F.spark_partition_id().cast("bigint"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(deal, schema)
