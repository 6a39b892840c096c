"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

One file (shard) holds documents in ascending id order:

    frame 0 … frame n-1   one zstandard frame each: the ids of consecutive documents, little-endian unsigned 32 bit,
                          with the frame's own content checksum
    index                 a skippable frame: per document its id, its frame and the number of its ids
    seek table            a skippable frame: per frame compressed size, decompressed size and a checksum of the
                          decompressed bytes (low 32 bits of xxh64), then the number of frames, a descriptor byte and
                          the magic number of the seekable format

A reader takes the footer, the seek table and the index from the end of the file, then only the frames it needs; any
zstandard tool can decompress the file as a whole. Every task writes its shard under a name of its own, and only the
shards of the stored manifest count, so a repeated task leaves no half-written data behind.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from dataclasses import dataclass
from typing import BinaryIO, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorlens.llm.shared import new_path, stored
from doorlens.llm.tokens import END_ID, encoder, packed, tokenizer_file

# fixed values of the zstandard seekable format
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUMS = 0x80
FRAME_BYTES = 256 * 1024


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class ShardWriter:
    """Writes one shard to a binary stream."""

    def __init__(self, out: BinaryIO, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.ids = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, len(self.frames), len(ids) // 4))
        self.waiting.append(ids)
        self.size += len(ids)
        self.ids += len(ids) // 4
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            raw = b"".join(self.waiting)
            frame = self.compressor.compress(raw)
            self.out.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        index = struct.pack("<Q", len(docs)) + docs[:, 0].astype("<i8").tobytes() + docs[:, 1:].astype("<u4").tobytes()
        self.out.write(skippable(INDEX_MAGIC, index))
        table = np.array(self.frames, np.int64).reshape(-1, 3).astype("<u4").tobytes()
        self.out.write(skippable(SEEK_MAGIC, table + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)))


class ShardReader:
    """Reads single documents or all of a shard from a seekable stream; damaged frames raise ``ValueError``."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END) if not hasattr(file, "size") else file.size()
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        at = size - 9 - 12 * count - 8
        file.seek(at)
        head, length = struct.unpack("<II", file.read(8))
        if head != SEEK_MAGIC or length != 12 * count + 9:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(file.read(12 * count), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        file.seek(int(self.starts[-1]))
        head, length = struct.unpack("<II", file.read(8))
        index = file.read(length)
        if head != INDEX_MAGIC or len(index) != length:
            raise ValueError("the document index is damaged")
        (n,) = struct.unpack_from("<Q", index)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        places = np.frombuffer(index, "<u4", 2 * n, 8 + 8 * n).reshape(-1, 2)
        self.frame_of, self.counts = places[:, 0], places[:, 1].astype(np.int64)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        data = self.file.read(int(self.frames[k, 0]))
        try:
            raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.frames[k, 1]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k}: {e}") from e
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k}: the checksum differs")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(doc_id, ids) in file order; with ``wanted`` only those ids, and only their frames are decompressed."""
        chosen = np.ones(len(self.doc_ids), bool) if wanted is None else np.isin(self.doc_ids, list(wanted))
        for k in np.unique(self.frame_of[chosen]):
            a, b = np.searchsorted(self.frame_of, [k, k + 1])
            raw, at = self.frame(int(k)), 0
            for i in range(a, b):
                end = at + 4 * int(self.counts[i])
                if chosen[i]:
                    yield int(self.doc_ids[i]), raw[at:end]
                at = end


def store_of(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path in it, for plain paths and URIs."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, folder: str, file: str | None = None, shard_rows: int | None = None) -> DataFrame:
    """Writes the ids of all documents (end id appended) to shards in ``folder``, ids ascending within and across them.

    Returns the stored manifest: shard, path, n_docs, n_ids. Null texts count as empty; rows without id are left out,
    repeated ids are documents of their own. The number of shards follows the session's shuffle partitions.
    """
    name = file or tokenizer_file()
    end = packed([END_ID])
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(shard_rows, "doc_id") if shard_rows else rows.repartitionByRange("doc_id")
    ordered = dealt.sortWithinPartitions("doc_id").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        of, writer, out, path, shard = encoder(name), None, None, "", -1
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    shard = batch.column(2)[0].as_py()
                    path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.ids.zst"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                    writer = ShardWriter(out)
                writer.add(doc, of.encode(text.as_py()) + end)
        if writer is not None:
            writer.close()
            out.close()
            row = [[shard], [path.rsplit("/", 1)[1]], [len(writer.docs)], [writer.ids]]
            yield pa.record_batch([pa.array(c) for c in row], names=["shard", "path", "n_docs", "n_ids"])

    return stored(ordered.mapInArrow(write, "shard bigint, path string, n_docs bigint, n_ids bigint"), "manifest")


def read_shards(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document from the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32 (and ids)."""
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row per shard
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_of(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                with store.open_input_file(f"{base}/{row.path}") as f:
                    reader, start, out = ShardReader(f), int(row.start), []
                    for doc, ids in reader.documents():
                        out.append((doc, start, len(ids) // 4, zlib.crc32(ids), ids)[: 5 if with_ids else 4])
                        start += len(ids) // 4
                        if len(out) >= 5000:
                            yield pd.DataFrame(out, columns=schema_names(schema))
                            out = []
                    yield pd.DataFrame(out, columns=schema_names(schema))

    shards = placed.select("path", F.col("_start").alias("start"), "shard")
    # A task a shard: a number that is asked for is not put together again at run time, however short the manifest.
    shards = shards.repartitionByRange(max(1, manifest.count()), "shard").select("path", "start")
    return shards.mapInPandas(read, schema)


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes all documents to shards in the shared folder and reads them back."""
    folder = new_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, folder), folder)
