import hashlib
import random

import pytest

from doorlens.llm import debruijn
from doorlens.llm.debruijn import DedupConfig
from tests.llm.helpers import docs, empty, rows, sentence, words


def brute(data, k):
    texts = [(d, t or "") for d, t, *_ in data if d is not None]
    texts.sort(key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()))
    seen, out = set(), []
    for doc_id, text in texts:
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            edge = tuple(w[i : i + k])
            if edge in seen:
                keep[i : i + k] = [False] * k
            seen.add(edge)
        left = " ".join(x for x, y in zip(w, keep) if y)
        out.append((doc_id, len(w), len(w) - sum(keep), left, hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("config", [DedupConfig(), DedupConfig(window=6, seed_words=3, slice_words=50, hot=5)])
def test_equals_brute_force(spark, config):
    rng = random.Random(9)
    data = rows()
    passage = sentence(rng, 70)
    for i in range(60):
        parts = [sentence(rng, rng.randrange(0, 40)), passage if i % 2 else passage[40:300], "p q r " * rng.randrange(0, 20)]
        rng.shuffle(parts)
        data.append((3000 + i, " ".join(parts), "en", "a", 0, 0.0, ""))
    got = debruijn.deduplicate(docs(spark, data).repartition(4), config).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(data, config.window))


def test_spans_name_their_source(spark):
    rng = random.Random(3)
    passage = sentence(rng, 50)
    data = [(i, f"{sentence(rng, 25)} {passage} {sentence(rng, 25)}", "en", "a", 0, 0.0, "") for i in range(3)]
    spans = debruijn.repeated_spans(docs(spark, data)).collect()
    place = {(r.doc_id, r.start + k): (r.src_doc, r.src_start + k) for r in spans for k in range(r.n)}
    w = {i: words(t) for i, t, *_ in data}
    assert {d for d, _ in place} == {1, 2} and len(place) >= 2 * 31
    for (d, p), (sd, sp) in place.items():
        assert w[d][p : p + 20] == w[sd][sp : sp + 20] and (sd, sp) < (d, p)
    assert len(spans) <= 8  # compacted, not one row per window


def graph_spans(data, k):
    """Spans of the whole graph, by dictionaries."""
    seen, out = {}, []
    for doc_id, text, *_ in sorted(data, key=lambda r: r[0]):
        w, last = words(text), None
        for i in range(len(w) - k + 1):
            edge = tuple(w[i : i + k])
            source = seen.setdefault(edge, (doc_id, i))
            if source == (doc_id, i):
                last = None
            elif last is not None and out[-1][3] == source[0] and out[-1][4] + out[-1][2] == source[1]:
                out[-1][2] += 1
            else:
                out.append([doc_id, i, 1, *source])
                last = i
    return sorted(map(tuple, out))


@pytest.mark.parametrize("partitions", [1, 16, 200])
def test_spans_do_not_depend_on_partitions_or_batches(spark, partitions):
    rng = random.Random(11)
    passage, other = sentence(rng, 300).split(), sentence(rng, 60).split()
    data = []
    for i in range(40):
        part = passage[rng.randrange(0, 100) : 300 - rng.randrange(0, 100)] if i else passage
        text = " ".join([sentence(rng, rng.randrange(0, 30)), *part, *(other if i % 3 else []), sentence(rng, 9), *other])
        data.append((i * 7, text, "en", "a", 0, 0.0, ""))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = debruijn.repeated_spans(docs(spark, data).repartition(partitions)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = graph_spans(data, 20)
    assert sorted((r.doc_id, r.start, r.n, r.src_doc, r.src_start) for r in got) == want
    assert len(want) < 200 and sum(n for _, _, n, *_ in want) > 5000


def test_unequal_words_do_not_count(spark):
    """A span whose hash lies is found out by its words."""
    rng = random.Random(2)
    a, b = sentence(rng, 40), sentence(rng, 40)
    texts = debruijn.numbered(docs(spark, [(1, a, "en", "a", 0, 0.0, ""), (2, b, "en", "a", 0, 0.0, ""), (3, a + " x", "en", "a", 0, 0.0, "")]))
    place = 1 << 32
    spans = spark.createDataFrame([(2, place, 21, 1, place), (3, place, 21, 1, place)], "doc_id bigint, place bigint, n bigint, src_doc bigint, src_place bigint")
    got = {r.doc_id: bytes(r.words) for r in debruijn.with_source_words(spans, texts, 20).collect()}
    own = {i: debruijn.excerpt([w.encode() for w in t.split()], 0, 21, 20) for i, t in ((2, b), (3, a))}
    assert got[3] == own[3] and got[2] != own[2]


def test_empty_table(spark):
    assert debruijn.deduplicate(empty(spark)).count() == 0
