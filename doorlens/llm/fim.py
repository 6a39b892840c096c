"""Fill-in-middle transformation with a boundary set that answers "the k-th boundary" from compressed containers.

The byte offsets at which a text may be cut (before every code point, or before every word, and at the end) form a
sorted set. It is stored in containers of 65,536 offsets each, in the smallest of three forms: the offsets themselves
(array), one bit per offset (bitmap), or first offset and length of unbroken stretches (run). Cumulative cardinalities
over the containers tell by one binary search which container holds the k-th offset; a local select inside it gives the
offset. Both cuts of a document are such selects, and the parts are slices of its bytes: texts of one byte a letter are
one run a container, however long, and nothing of the size of the text is built besides one container's offsets.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 16  # offsets of one container
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class FimConfig:
    """``unit``: "point" cuts between code points, "word" before words. Shares are per hundred documents."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    suffix_first: int = 20
    unit: str = "point"
    salt: str = "1:"


class Array(NamedTuple):
    offsets: np.ndarray

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class Bitmap(NamedTuple):
    bits: np.ndarray  # bytes, lowest bit first
    before: np.ndarray  # set bits before each 64-byte block

    def select(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        part = self.bits[64 * block : 64 * block + 64]
        inside = np.flatnonzero(np.unpackbits(part, bitorder="little"))
        return 512 * block + int(inside[k - int(self.before[block])])


class Run(NamedTuple):
    first: np.ndarray
    before: np.ndarray  # offsets before each stretch

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(mask: np.ndarray) -> tuple[Array | Bitmap | Run, int]:
    """The smallest form of a set given by one boolean per offset, and its cardinality."""
    n = int(np.count_nonzero(mask))
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    if 4 * len(first) <= min(2 * n, SPAN // 8):
        return Run(first, np.cumsum(last - first) - (last - first)), n
    if 2 * n <= SPAN // 8:
        return Array(np.flatnonzero(mask).astype(np.uint16)), n
    bits = np.packbits(mask, bitorder="little")
    bits = np.pad(bits, (0, -len(bits) % 64))
    counts = BITS[bits].reshape(-1, 64).sum(axis=1, dtype=np.int64)
    return Bitmap(bits, np.cumsum(counts) - counts), n


def boundaries(part: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Which of some bytes begin a unit; ``before`` is the byte in front of them (a blank at a text's start)."""
    if unit == "point":
        return (part & 0xC0) != 0x80
    blank = BLANK[part]
    return ~blank & np.concatenate(([BLANK[before]], blank[:-1]))


class BoundarySet:
    """Offsets at which a text may be cut: the starts of its units and its end."""

    def __init__(self, text: bytes, unit: str = "point"):
        raw = np.frombuffer(text, np.uint8)
        self.containers: list[Array | Bitmap | Run] = []
        counts = []
        for at in range(0, len(raw) + 1, SPAN):
            part = raw[at : at + SPAN]
            mask = boundaries(part, int(raw[at - 1]) if at else 0x20, unit) if len(part) else np.zeros(0, bool)
            if unit == "word" and at == 0 and len(mask):
                mask[0] = True  # white space before the first word is a part of the first unit
                first = int(np.argmax(~BLANK[part])) if not BLANK[part].all() else 0
                mask[first] = first == 0
            if at + SPAN > len(raw):
                mask = np.concatenate((mask, [True]))
            form, n = container(mask)
            self.containers.append(form)
            counts.append(n)
        self.total = np.concatenate(([0], np.cumsum(counts)))

    def __len__(self) -> int:
        return int(self.total[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.total, k, side="right")) - 1
        return c * SPAN + self.containers[c].select(k - int(self.total[c]))


def cut(text: bytes, doc_id: int | None, config: FimConfig) -> tuple:
    """n, form, prefix length, middle length (units; None if plain), output and the text rebuilt from it."""
    h = hashlib.sha256(f"{config.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    marks = [m.encode() for m in (config.prefix, config.suffix, config.middle)]
    units = BoundarySet(text, config.unit)
    n = len(units) - 1
    if not text or h3 % 100 >= config.transformed or any(m in text for m in marks):
        return n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = units.select(a), units.select(b)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    p, s, m = marks
    if h4 % 100 < config.suffix_first:
        form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
    else:
        form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
    return n, form, a, b - a, out, restored(out, form, config)


def restored(out: bytes, form: str, config: FimConfig) -> bytes:
    """The text of an output. The parts hold no marks, so each mark stands once."""
    if form == "plain":
        return out
    p, s, m = (x.encode() for x in (config.prefix, config.suffix, config.middle))
    first, second = (p, s) if form == "psm" else (s, p)
    head, middle = re.fullmatch(re.escape(first) + b"(.*)" + re.escape(m) + b"(.*)", out, re.DOTALL).groups()
    one, two = head.split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, config: FimConfig = FimConfig()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 for every row.

    Null texts count as empty; empty texts are plain. The cuts depend on doc_id and the text alone, so repeated rows
    give equal rows; a null id is drawn from the salt. Extra columns are ignored, an empty table gives no rows. With
    ``unit`` "word" the lengths are words, a unit being a word and the white space after it.
    """
    schema = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, form, a, b, out, back = cut(text.as_buffer().to_pybytes() if text.is_valid else b"", doc, config)
                found = (doc, n, form, a, b, out, hashlib.sha256(out).hexdigest(), hashlib.sha256(back).hexdigest())
                for col, value in zip(cols, found):
                    col.append(value)
                size += len(out)
                if size > 32_000_000:  # outputs of long texts leave before more are held
                    yield as_batch(cols, kinds, names)
                    cols, size = [[] for _ in names], 0
            yield as_batch(cols, kinds, names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(rows, schema)


def as_batch(cols: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    made = [pa.array(c, pa.binary()).cast(t) if n == "output" else pa.array(c, t) for c, t, n in zip(cols, kinds, names)]
    return pa.record_batch(made, names=names)
