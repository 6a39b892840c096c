"""File listings as a data source, empty files included, and picture sizes from the heads of files.

Spark's own file sources pass over zero-byte files and decode pictures whole. Here the folders below the paths are the
partitions: the driver lists only as many levels as give enough folders, tasks list the rest. Any file system that
Arrow can open serves (local, HDFS, object stores); for others an inventory table takes the listing's place.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass
from typing import BinaryIO, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, length bigint, modified timestamp"


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """File system, path in it, and what stands before such paths in Spark's spelling."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    store, path = arrow_fs.FileSystem.from_uri(uri)
    before = "file:" if uri.startswith("file:") else uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"
    return store, path, before


@dataclass
class Folders(InputPartition):
    """Folders that one task lists to the bottom, and files found on the way to them."""

    root: str
    folders: list[str]
    files: list[tuple]


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.paths:
            store, path, before = open_store(root)
            folders, files = [path], []
            while folders and len(folders) < self.wanted:
                below = [i for f in folders for i in store.get_file_info(arrow_fs.FileSelector(f))]
                files += [row_of(i, before) for i in below if i.type == arrow_fs.FileType.File]
                folders = [i.path for i in below if i.type == arrow_fs.FileType.Directory]
            out += [Folders(root, [f], []) for f in folders]
            out += [Folders(root, [], files[k : k + 10_000]) for k in range(0, len(files), 10_000)]
        return out or [Folders("", [], [])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        yield from partition.files
        if partition.folders:
            store, _, before = open_store(partition.root)
            todo = list(partition.folders)
            while todo:
                for info in store.get_file_info(arrow_fs.FileSelector(todo.pop())):
                    if info.type == arrow_fs.FileType.Directory:
                        todo.append(info.path)
                    elif info.type == arrow_fs.FileType.File:
                        yield row_of(info, before)


def row_of(info: arrow_fs.FileInfo, before: str) -> tuple:
    return before + info.path, info.size, info.mtime


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(dict(self.options))


def list_files(spark: SparkSession, paths: str | list[str], partitions: int = 64) -> DataFrame:
    """path, length and modification time of every file below the paths, empty ones too. Contents are never read."""
    spark.dataSource.register(FileListing)
    wanted = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("file_listing").option("paths", json.dumps(wanted)).option("partitions", str(partitions)).load()


def picture_size(f: BinaryIO) -> tuple[int, int]:
    """Width and height from the head of a JPEG, PNG, BMP, WebP or TIFF file; ``ValueError`` says what is wrong."""
    head = f.read(32)
    if not head:
        raise ValueError("empty file")
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        if head[12:16] != b"IHDR" or len(head) < 24:
            raise ValueError("PNG without a header chunk")
        size = struct.unpack(">II", head[16:24])
    elif head.startswith(b"\xff\xd8"):
        size = jpeg_size(f)
    elif head.startswith(b"BM") and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        size = width, abs(height)
    elif head.startswith(b"RIFF") and head[8:12] == b"WEBP":
        size = webp_size(head)
    elif head[:4] in (b"II*\0", b"MM\0*"):
        size = tiff_size(f, "<" if head[:2] == b"II" else ">")
    else:
        raise ValueError("unknown format")
    if min(size) <= 0:
        raise ValueError("a side of 0 pixels")
    return size


def exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ValueError("the file ends early")
    return data


def jpeg_size(f: BinaryIO) -> tuple[int, int]:
    """Goes from segment to segment up to the frame header; segments between are passed over, not read."""
    at = 2
    while True:
        f.seek(at)
        mark = exactly(f, 2)
        if mark[0] != 0xFF:
            raise ValueError("JPEG segments are damaged")
        if mark[1] == 0xFF:  # padding
            at += 1
        elif mark[1] in (0xD9, 0xDA):
            raise ValueError("JPEG without a frame header")
        elif 0xD0 <= mark[1] <= 0xD8 or mark[1] == 0x01:  # without content
            at += 2
        elif 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", exactly(f, 7)[3:])
            return width, height
        else:
            at += 2 + struct.unpack(">H", exactly(f, 2))[0]


def webp_size(head: bytes) -> tuple[int, int]:
    if len(head) < 30:
        raise ValueError("the file ends early")
    kind = head[12:16]
    if kind == b"VP8X":
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", head[26:30])
        return width & 0x3FFF, height & 0x3FFF
    raise ValueError("unknown WebP chunk")


def tiff_size(f: BinaryIO, order: str) -> tuple[int, int]:
    f.seek(4)
    f.seek(struct.unpack(order + "I", exactly(f, 4))[0])
    found = {}
    for _ in range(struct.unpack(order + "H", exactly(f, 2))[0]):
        tag, kind, _, value = struct.unpack(order + "HHI4s", exactly(f, 12))
        if tag in (256, 257):  # width, length
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    if len(found) < 2:
        raise ValueError("TIFF without a size")
    return found[256], found[257]


def picture_sizes(files: DataFrame) -> DataFrame:
    """path, width, height and reason for each ``path``: a broken file is a row with a reason and no size.

    Tasks read a few bytes of each file by position; pixels are never decoded.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    store, inner, _ = open_store(path)
                    with store.open_input_file(inner) as f:
                        out.append((path, *picture_size(f), None))
                except (ValueError, OSError) as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "reason"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path").mapInPandas(measure, "path string, width int, height int, reason string")
