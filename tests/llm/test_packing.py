import random
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from doorlens.llm import packing
from doorlens.llm.packing import PackingConfig
from doorlens.llm.tokens import Encoder, packed, tokenizer_file
from tests.llm.helpers import docs, empty, rows


def whole(text):
    t = Tokenizer.from_file(tokenizer_file())
    return packed([*t.encode(text or "", add_special_tokens=False).ids, 1])


def test_encoder_equals_the_library():
    e, rng = Encoder(tokenizer_file()), random.Random(1)
    t = e.tokenizer
    bits = ["a", "Zß", "É", " ", "\n", "\t", "\x1c", "\x85", " ", "İ", "ΣΑΣ", "é", "́", "ﬁ", "😀", "日本", "'s", "'LL", "12", "½",
            "<|endoftext|>", "<|start", "...", "×", "ª", "​", "don't"]
    texts = ["", *["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(800)], "x" * 5000]
    for text in texts:
        assert e.encode(text) == packed(t.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("config", [PackingConfig(), PackingConfig(size=64, ranked_rows=10)])
def test_every_piece_has_its_place(spark, config):
    data = rows()
    got = packing.pack(docs(spark, data), config).collect()
    want = Counter()
    for doc_id, text, *_ in data:
        ids = whole(text)
        for k, at in enumerate(range(0, len(ids), 4 * config.size)):
            part = ids[at : at + 4 * config.size]
            want[(doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= config.size
    least = -(-sum(r.length for r in got) // config.size)
    assert len(sequences) <= least * 1.1 + 1


def held(solution):
    used = Counter()
    for items, count in solution.configurations:
        assert count > 0
        for i in items:
            used[i] += count
    return used


def test_solution_holds_the_histogram():
    rng = random.Random(4)
    for size in (1, 10, 50):
        histogram = {k: rng.randrange(1, 60) for k in range(1, size + 1)}
        got = packing.solve(histogram, PackingConfig(size=size))
        assert all(sum(items) <= size for items, _ in got.configurations)
        assert held(got) == histogram and got.sequences == sum(c for _, c in got.configurations)
    assert packing.solve({}).configurations == []


@pytest.mark.parametrize("kind", ["usual", "many", "over half", "one length"])
def test_program_decides(kind):
    rng = random.Random(6)
    usual = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000))
    histogram = {
        "usual": dict(usual),
        "many": {k: 1000 * n for k, n in usual.items()},
        "over half": {3000: 500, 2500: 300, 700: 100},
        "one length": {1000: 100_000},
    }[kind]
    got = packing.solve(histogram)
    assert held(got) == histogram
    assert got.from_program >= 0.9 * got.sequences
    assert got.bound <= got.sequences <= 1.005 * got.bound + 1


def test_program_decides_on_the_test_table(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by_length = packing.pieces_of(docs_, tokenizer_file(), PackingConfig()).groupBy("length").count().collect()
    got = packing.solve({r["length"]: r["count"] for r in by_length})
    assert got.from_program >= 0.9 * got.sequences and got.sequences <= 1.002 * got.bound + 1


def test_bound_holds():
    """Against the best packing of small cases, by search."""
    rng = random.Random(8)
    for _ in range(20):
        items = sorted((rng.randrange(2, 11) for _ in range(8)), reverse=True)

        def fewest(k, rooms):
            if k == len(items):
                return len(rooms)
            best = fewest(k + 1, [*rooms, 10 - items[k]])
            for i, room in enumerate(rooms):
                if room >= items[k] and room not in rooms[:i]:
                    best = min(best, fewest(k + 1, [*rooms[:i], room - items[k], *rooms[i + 1 :]]))
            return best

        got = packing.solve(dict(Counter(items)), PackingConfig(size=10))
        assert got.bound <= fewest(0, []) + 1e-9 and got.sequences >= fewest(0, [])


def test_best_values():
    rng = random.Random(3)
    import numpy as np

    lengths = np.array([2, 3, 7, 11])
    values = np.array([rng.random() for _ in lengths])
    best = packing.best_values(lengths, values, 30)
    want = [0.0] * 31
    for room in range(1, 31):
        want[room] = max([want[room - 1], *[want[room - n] + v for n, v in zip(lengths, values) if n <= room]])
    assert np.allclose(best, want)


def test_repeated_rows_spread(spark):
    """Equal rows have row numbers of their own, so no ranking window holds them all."""
    pieces = packing.pieces_of(docs(spark, [(1, "a b", "en", "a", 0, 0.0, "")] * 5000), tokenizer_file(), PackingConfig())
    got = packing.ranked(pieces, 100)
    assert [r.rank for r in got.orderBy("rank").collect()] == list(range(5000))
    from pyspark.sql import functions as F

    sizes = pieces.groupBy(F.pmod(F.xxhash64("row"), F.lit(50))).count().collect()
    assert len(sizes) == 50 and max(r["count"] for r in sizes) < 200


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0
