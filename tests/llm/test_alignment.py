import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from doorlens.llm import alignment
from doorlens.llm.alignment import AlignConfig, Aligner
from doorlens.llm.tokens import tokenizer_file
from tests.llm.helpers import docs, empty, rows


@pytest.fixture(scope="module")
def brute():
    """Groups of a whole text by the libraries alone."""
    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    # the byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    letter = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}
    names = {i: t for t, i in a.get_vocab().items()}

    def a_raw(i):
        return bytes(letter[c] for c in names[i])

    def b_raw(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        xs, ys = [a_raw(i) for i in x], [b_raw(i) for i in y]
        if b"".join(xs) != whole or b"".join(ys) != whole:
            return []
        ends = set(np.cumsum([len(r) for r in xs]).tolist()) & set(np.cumsum([len(r) for r in ys]).tolist())
        out, at = [], 0
        sides = [[], []]
        for side, ids, raws in ((0, x, xs), (1, y, ys)):
            group, at = [], 0
            for i, r in zip(ids, raws):
                group.append(i)
                at += len(r)
                if at in ends:
                    sides[side].append(group)
                    group = []
        out = list(zip(*sides))
        assert len(sides[0]) == len(sides[1])
        return out

    return groups


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def digest(groups):
    return hashlib.sha256(shown(groups).encode()).hexdigest() if groups else ""


BITS = ["a", "Zß", "É", " ", " ", "  ", "\n", "\t", "\r", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "ΣΑΣ", "é", "́", "ﬁ", "😀", "日本",
        "'s", "12", "½", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "...", ";\r", "▁", "\0", "the", "token", "{\r\n", "don't", "�"]


def test_units_equal_whole_texts(brute):
    rng = random.Random(2)
    of = Aligner(AlignConfig(segment=60, cache=300))
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    texts += ["x" * 3000, "ab" * 2000, " " * 700, "a" + " " * 300 + "b", "\n" * 50 + "x", "\r" * 9, "日本語" * 100, "word \r word\r\n" * 20]
    for text in texts:
        want = brute(text)
        [(n_a, n_b, n_groups, n_links)], [sha], _ = of.align([text])
        assert (n_groups, sha) == (len(want), digest(want)), repr(text)
        assert n_a == sum(len(x) for x, _ in want) and n_b == sum(len(y) for _, y in want)
        assert n_links == sum(len(x) * len(y) for x, y in want)


def expected(data, brute):
    per = [(doc_id, brute(text)) for doc_id, text, *_ in data]
    linked = [Counter(p for x, y in g for a in x for p in ((a, b) for b in y)) for _, g in per]
    count = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, g), c in zip(per, linked):
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), digest(g)))
    return out, count, most


@pytest.mark.parametrize("config", [AlignConfig(), AlignConfig(chunk_bytes=500, segment=200, cache=50)])
def test_equals_brute_force(spark, brute, config):
    data = rows() + [(7000 + i, "".join(random.Random(i).choice(BITS) for _ in range(30)), "en", "a", 0, 0.0, "") for i in range(60)]
    want, count, most = expected(data, brute)
    got = alignment.report(docs(spark, data).repartition(3), config)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    pairs = alignment.table(docs(spark, data), config).collect()
    assert {(r.a_id, r.b_id): r.documents for r in pairs} == dict(count)
    assert all(r.best == (r.documents == most[r.a_id]) for r in pairs)


def test_long_text(spark, brute):
    rng = random.Random(5)
    text = " ".join(rng.choice(BITS[:4] + ["the", "token", "alignment", "\r\n x"]) for _ in range(300_000))
    want, *_ = expected([(1, text)], brute)
    assert [tuple(r) for r in alignment.report(docs(spark, [(1, text, "en", "a", 0, 0.0, "")])).collect()] == want


def test_empty_table(spark):
    assert alignment.report(empty(spark)).count() == 0
    assert alignment.table(empty(spark)).count() == 0


def test_identity_map_has_the_same_bytes():
    t = Aligner(AlignConfig()).tokens
    known = np.flatnonzero(t.identity >= 0)
    assert len(known) > 10_000 and all(t.a_bytes[i] == t.b_bytes[t.identity[i]] for i in known)
    assert sum(x is None for x in t.a_bytes) <= 13  # the bytes that no UTF-8 text holds
