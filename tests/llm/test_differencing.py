import random
import zlib
from collections import Counter, defaultdict

import pytest

from doorlens.llm import differencing
from doorlens.llm.differencing import DifferencingConfig
from tests.llm.helpers import docs, empty, rows
from tests.llm.test_packing import whole


def naive(sizes, k):
    """Multiway differencing on full k-tuples, step by step."""
    parts = [([0] * (k - 1) + [n], [[] for _ in range(k - 1)] + [[i]]) for i, n in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][-1] - p[0][0])
        (s, a), (t, b) = parts.pop(), parts.pop()
        both = sorted(zip([x + y for x, y in zip(s, reversed(t))], [x + y for x, y in zip(a, reversed(b))]), key=lambda w: w[0])
        parts.append(([x for x, _ in both], [y for _, y in both]))
    return parts[0]


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_differencing(k):
    rng = random.Random(k)
    sizes = rng.sample(range(1, 10**9), 60)  # no ties: every step is determined
    got = differencing.differenced(sizes, k)
    assert sorted(i for w in got for i in w) == list(range(60)) and len(got) == k
    assert sorted(sum(sizes[i] for i in w) for w in got) == sorted(naive(sizes, k)[0])
    assert differencing.differenced([], k) == [[]] * k
    assert sorted(map(sorted, differencing.differenced([5], k))) == [[]] * (k - 1) + [[0]]


@pytest.mark.parametrize("kind", ["usual", "over half", "one length", "tiny", "few", "full"])
def test_windows_are_nearly_full(kind):
    rng = random.Random(7)
    lengths = {
        "usual": [min(2047, int(rng.lognormvariate(5, 1.3)) + 1) for _ in range(3000)],
        "over half": [1100] * 400,  # two never fit a window: cut
        "one length": [700] * 900,
        "tiny": [1 + i % 3 for i in range(20_000)],
        "few": [2000, 90],
        "full": [2047] * 300,
    }[kind]
    config = DifferencingConfig()
    windows = differencing.balanced(lengths, config)
    total, filled = sum(lengths), [sum(n for _, _, n in w) for w in windows]
    assert max(filled) <= config.size and len(windows) <= max(-(-total // config.size) * 1.005, -(-total // config.size) + 1)
    spans = defaultdict(list)
    for i, start, n in (p for w in windows for p in w):
        spans[i].append((start, n))
    for i, length in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == length
    if kind == "usual":
        assert max(filled) - min(filled) <= 16 and len(spans) == len(lengths) == sum(map(len, windows))  # near-equal, nothing cut


@pytest.mark.parametrize("config", [DifferencingConfig(), DifferencingConfig(size=64, windows=5)])
def test_every_id_has_one_place(spark, config):
    data = rows()
    got = differencing.pack(docs(spark, data).repartition(3), config, with_ids=True).collect()
    want = Counter((doc_id, whole(text)) for doc_id, text, *_ in data)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens, r.start].append(bytes(r.ids))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= config.size
    for (doc_id, ids), n in want.items():
        at = 0
        while at < len(ids) // 4:  # some piece of each copy begins here
            found = [p for p in pieces[doc_id, len(ids) // 4, at] if ids[4 * at :].startswith(p)]
            assert found
            at += len(found[0]) // 4
    assert sum(r.length for r in got) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    tokens = sum(r.length for r in got)
    assert len(sequences) <= tokens / config.size * 1.02 + 3 * 2


def test_same_result_without_ids(spark):
    d = docs(spark).coalesce(1)
    with_ids = differencing.pack(d, with_ids=True).drop("ids").collect()
    assert differencing.pack(d).collect() == with_ids


def test_empty_table(spark):
    assert differencing.pack(empty(spark)).count() == 0
