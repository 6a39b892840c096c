"""Label files in containers: the text of every image's label file, in few files, each readable on its own.

A container holds label texts one after the other, then an index (image id, start and length of each, ids ascending),
then a footer with the number of images and a mark. Each task writes containers of bounded size under names of their
own and reports them; when all tasks are done, the driver writes the list of containers (the manifest) and moves it
into place. Readers go by the manifest alone, so failed tasks and repeated ones leave nothing that counts.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass
from typing import BinaryIO, Iterator

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from doorlens.functions.geometry import c
from doorlens.sources.files import open_store

MARK = b"LBLPACK1"
MANIFEST = "manifest.json"
TEXTS = "image_id bigint, labels string"


class ContainerWriter:
    """Writes label texts of ascending image ids to one container."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.index = out, 0, []

    def add(self, image_id: int, text: bytes) -> None:
        self.out.write(text)
        self.index.append((image_id, self.at, len(text)))
        self.at += len(text)

    def close(self) -> None:
        self.out.write(np.array(self.index, "<i8").reshape(-1, 3).tobytes())
        self.out.write(struct.pack("<Q", len(self.index)) + MARK)


class Container:
    """Reads a container from a seekable file: the index first, texts by position."""

    def __init__(self, file: arrow_fs.FileSystem | BinaryIO):
        self.file = file
        size = file.size()
        file.seek(size - 16)
        n, mark = struct.unpack("<Q8s", file.read(16))
        if mark != MARK:
            raise ValueError("not a label container")
        file.seek(size - 16 - 24 * n)
        self.index = np.frombuffer(file.read(24 * n), "<i8").reshape(-1, 3)

    def text(self, k: int) -> str:
        _, start, length = self.index[k].tolist()
        self.file.seek(start)
        return self.file.read(length).decode()

    def find(self, image_id: int) -> str | None:
        k = int(np.searchsorted(self.index[:, 0], image_id))
        return self.text(k) if k < len(self.index) and self.index[k, 0] == image_id else None


@dataclass
class Written(WriterCommitMessage):
    containers: list[tuple[str, int, int, int]]  # name, images, least and greatest id


class PackWriter(DataSourceWriter):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def write(self, iterator: Iterator) -> Written:
        """Rows (image_id, labels) in ascending order of ids, to as many containers as the size limit asks for."""
        store, base, _ = open_store(self.path)
        store.create_dir(base, recursive=True)
        done, writer, out, name = [], None, None, ""

        def finish() -> None:
            writer.close()
            out.close()
            done.append((name, len(writer.index), writer.index[0][0], writer.index[-1][0]))

        for row in iterator:
            if writer is None:
                name = f"{uuid.uuid4().hex}.labels"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
                writer = ContainerWriter(out)
            writer.add(row[0], (row[1] or "").encode())
            if writer.at >= self.limit:
                finish()
                writer = None
        if writer is not None:
            finish()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest takes its place in one move; containers of the state before it are removed after that."""
        store, base, _ = open_store(self.path)
        store.create_dir(base, recursive=True)
        before = manifest(self.path)
        containers = sorted((x for m in messages if m is not None for x in m.containers), key=lambda x: x[2])
        fresh = f"{base}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh, compression=None) as out:
            out.write(json.dumps(containers).encode())
        store.move(fresh, f"{base}/{MANIFEST}")
        for name, *_ in before:
            store.delete_file(f"{base}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, base, _ = open_store(self.path)
        for name, *_ in (x for m in messages if m is not None for x in m.containers):
            store.delete_file(f"{base}/{name}")


@dataclass
class OneContainer(InputPartition):
    name: str


class PackReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [OneContainer(name) for name, *_ in manifest(self.path)] or [OneContainer("")]

    def read(self, partition: OneContainer) -> Iterator[tuple]:
        if partition.name:
            store, base, _ = open_store(self.path)
            with store.open_input_file(f"{base}/{partition.name}") as f:
                held = Container(f)
                for k, image_id in enumerate(held.index[:, 0].tolist()):
                    yield image_id, held.text(k)


class LabelPack(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_pack"

    def schema(self) -> str:
        return TEXTS

    def reader(self, schema) -> DataSourceReader:
        return PackReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a label pack is replaced as a whole: use mode overwrite")
        return PackWriter(self.options["path"], int(self.options.get("container_bytes", str(128 << 20))))


def manifest(path: str) -> list[tuple[str, int, int, int]]:
    """name, images, least and greatest id of every container; none if nothing was written."""
    store, base, _ = open_store(path)
    try:
        with store.open_input_file(f"{base}/{MANIFEST}") as f:
            return [tuple(x) for x in json.loads(f.read())]
    except FileNotFoundError:
        return []


def write_label_pack(lines: DataFrame, path: str, container_bytes: int = 128 << 20) -> None:
    """Label lines (image_id, line_no, line) as one text per image; an image with null lines only has an empty text.

    Images are dealt by ranges of ids, so their number does not bound the number of files; lines of one image meet
    in one row.
    """
    lines.sparkSession.dataSource.register(LabelPack)
    listed = F.sort_array(F.collect_list(F.when(c("line").isNotNull(), F.struct("line_no", "line"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    texts = lines.filter("image_id is not null").groupBy(c("image_id").cast("bigint").alias("image_id")).agg(text.alias("labels"))
    ordered = texts.repartitionByRange("image_id").sortWithinPartitions("image_id")
    ordered.write.format("label_pack").mode("overwrite").option("path", path).option("container_bytes", str(container_bytes)).save()


def read_label_pack(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, labels) of every image, one task a container."""
    spark.dataSource.register(LabelPack)
    return spark.read.format("label_pack").option("path", path).load()


def read_label_file(path: str, image_id: int) -> str | None:
    """One image's label text: the containers that can hold the id are looked up by their indexes."""
    store, base, _ = open_store(path)
    for name, _, least, greatest in manifest(path):
        if least <= image_id <= greatest:
            with store.open_input_file(f"{base}/{name}") as f:
                found = Container(f).find(image_id)
            if found is not None:
                return found
    return None
