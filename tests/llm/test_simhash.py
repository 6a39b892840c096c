import hashlib

import pytest

from doorlens.llm import simhash
from tests.llm.helpers import docs, empty, rows


def test_edits_and_neighbours(spark):
    data = rows()
    got = simhash.compare_edits(docs(spark, data)).collect()
    texts = {}
    for doc_id, text, *_ in data:
        if doc_id is not None:
            texts.setdefault(doc_id, []).append(text or "")
    for own in texts.values():
        own.sort(key=lambda t: hashlib.md5(t.encode()).hexdigest())
    ids = sorted(texts)
    want = {}
    for i, doc_id in enumerate(ids):
        following = texts[ids[(i + 1) % len(ids)]][0]
        for t in texts[doc_id]:
            k = len(t) // 4
            edited = t[: len(t) - k] + following[:k]
            want.setdefault(doc_id, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id]
        apart = bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1")
        assert r.near_edited == 1 - apart / 64 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 16
    by_text = {}
    for r in got:
        if len(texts[r.doc_id]) == 1:
            by_text.setdefault(texts[r.doc_id][0], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        near = sum(bin(int(r.fingerprint, 16) ^ p).count("1") <= 3 for p in prints) - 1
        assert r.near_count == (near if r.doc_id % 20 == 0 else None)
    assert simhash.compare_edits(empty(spark)).count() == 0


def test_a_fingerprint_is_the_weighted_vote(spark):
    text = "alpha beta gamma alpha beta"
    d = spark.createDataFrame([(1, text), (2, "one"), (3, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(d, ["doc_id"]).collect()}
    w = text.split()
    pairs = list(zip(w, w[1:]))
    hashes = spark.createDataFrame(pairs, "a string, b string").selectExpr("xxhash64(a, b) h", "length(a) + length(b) w").collect()
    want = 0
    for b in range(64):
        if sum(r.w if (r.h >> b) & 1 else -r.w for r in hashes) > 0:
            want |= 1 << b
    assert got[1] & (2**64 - 1) == want
    assert got[2] == spark.sql("select xxhash64('one') h").first().h and got[3] == 0


@pytest.mark.parametrize("radius,blocks", [(3, 6), (2, 4), (0, 1)])
def test_block_tables_find_every_pair(spark, radius, blocks):
    import random

    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for p in prints]
    signed = [p - 2**64 if p >= 2**63 else p for p in set(prints)]
    d = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    got = [(r[0], r[1]) for r in simhash.within(d, d, radius, blocks).collect()]
    want = {(a, b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_sparse_ids_are_few_blocks(spark, monkeypatch):
    """Blocks follow the number of rows, not the range of the ids; the circle is the same."""
    import random

    monkeypatch.setattr(simhash, "ID_BLOCK", 100)
    rng = random.Random(5)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(1000)}, key=lambda _: rng.random())
    blocked = simhash.in_blocks(spark.createDataFrame([(i, i % 7) for i in ids], "doc_id bigint, n bigint"), len(ids))
    assert blocked.select("_b").distinct().count() <= 10
    got = {r.doc_id: (r.next_id, r.prev_id, r.prev_n) for r in simhash.neighbours(blocked).collect()}
    order = sorted(ids)
    assert got == {x: (order[(k + 1) % 1000], order[k - 1], order[k - 1] % 7) for k, x in enumerate(order)}
    one = simhash.neighbours(simhash.in_blocks(spark.createDataFrame([(5, 3)], "doc_id bigint, n bigint"), 1)).first()
    assert (one.next_id, one.prev_id, one.prev_n) == (5, 5, 3)
