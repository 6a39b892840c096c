import io
import zlib

import pytest
import zstandard

from doorlens.llm import seekable
from tests.llm.helpers import docs, empty, rows
from tests.llm.test_packing import whole


def shard(pieces, frame_bytes=64):
    out = io.BytesIO()
    writer = seekable.ShardWriter(out, frame_bytes=frame_bytes)
    for doc_id, ids in pieces:
        writer.add(doc_id, ids)
    writer.close()
    return out.getvalue()


PIECES = [(i * 2, bytes([i % 256, 0, 0, 0]) * (1 + i % 9)) for i in range(100)]


def test_reads_back_all_and_single_documents():
    data = shard(PIECES)
    assert list(seekable.ShardReader(io.BytesIO(data)).documents()) == PIECES
    reader = seekable.ShardReader(io.BytesIO(data))
    read = []
    reader.frame, frame = lambda k: read.append(k) or frame(k), reader.frame
    assert list(reader.documents([84])) == [PIECES[42]] and len(read) == 1
    assert list(reader.documents([1, 3])) == []
    assert list(seekable.ShardReader(io.BytesIO(shard([]))).documents()) == []


def test_other_tools_read_the_file():
    got = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(shard(PIECES)), read_across_frames=True).read()
    assert got == b"".join(ids for _, ids in PIECES)


def test_damage_is_noticed():
    data = bytearray(shard(PIECES))
    data[30] ^= 0xFF
    with pytest.raises(ValueError):
        list(seekable.ShardReader(io.BytesIO(bytes(data))).documents())
    with pytest.raises(ValueError):
        seekable.ShardReader(io.BytesIO(bytes(data[:-1])))


def test_a_read_task_a_shard(spark):
    folder = seekable.new_path(spark, "shards")
    manifest = seekable.write_shards(docs(spark), folder, shard_rows=9)
    shards = manifest.filter("n_docs > 0").count()
    from pyspark.sql import functions as F

    tasks = seekable.read_shards(manifest, folder).select(F.spark_partition_id().alias("p")).distinct().count()
    assert shards > 4 and tasks == shards


@pytest.mark.parametrize("partitions", [1, 5])
def test_round_trip(spark, partitions):
    data = rows()
    folder = seekable.new_path(spark, "shards")
    got = seekable.read_shards(seekable.write_shards(docs(spark, data), folder, shard_rows=partitions), folder).collect()
    start, by_id = 0, {}
    for doc_id, text, *_ in data:
        if doc_id is not None:
            by_id.setdefault(doc_id, []).append(whole(text))
    assert len(got) == sum(map(len, by_id.values()))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and (r.n_tokens, r.ids_crc32) in [(len(x) // 4, zlib.crc32(x)) for x in by_id[r.doc_id]]
        start += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
    assert seekable.round_trip(empty(spark)).count() == 0
