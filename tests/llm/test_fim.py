import hashlib
import random

import numpy as np
import pytest

from doorlens.llm import fim
from doorlens.llm.fim import SPAN, Array, Bitmap, BoundarySet, FimConfig, Run
from tests.llm.helpers import docs, empty, rows, words


def brute(doc_id, text):
    """The contract, code point by code point."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, lengths = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, lengths = "spm", f"<S>{s}<P>{p}<M>{m}", (a, b - a)
    else:
        form, out, lengths = "psm", f"<P>{p}<S>{s}<M>{m}", (a, b - a)
    return doc_id, n, form, *lengths, out, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_equals_brute_force(spark):
    rng = random.Random(4)
    data = rows()
    bits = ["a", "é", "日", "😀", "<", ">", "P", "S", "M", "\n", "\0", "<P"]
    data += [(2000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))), "en", "a", 0, 0.0, "") for i in range(400)]
    data += [(1, f"with {m} inside", "en", "a", 0, 0.0, "") for m in ("<P>", "<S>", "<M>")]
    data += [(3000 + i, s * 90_000, "en", "a", 0, 0.0, "") for i, s in enumerate(["ab", "é", "aé", "日本 ", "a" * 50 + "é" * 9])]
    got = [tuple(r) for r in fim.transform(docs(spark, data).repartition(3)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted((brute(d, t) for d, t, *_ in data), key=key)


@pytest.mark.parametrize("text", ["", "a", "é", "x" * 200_000, "é" * 100_000, "aé" * 70_000, "日" + "a" * 65_535 + "é" * 300, "日本語a" * 50_000])
def test_select_gives_every_boundary(text):
    units = BoundarySet(text.encode())
    starts = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))).astype(int)
    assert len(units) == len(text) + 1
    for k in {*range(0, len(starts), 997), len(starts) - 1, *range(min(len(starts), 50))}:
        assert units.select(k) == starts[k]
    with pytest.raises(IndexError):
        units.select(len(units))


def test_all_three_containers_are_used():
    kinds = {type(c) for t in ("x" * 200_000, "aé" * 70_000, "日" * 3000) for c in BoundarySet(t.encode()).containers}
    assert {Run, Bitmap, Array} == kinds
    long = BoundarySet(b"x" * 5_000_000)  # a run a container, whatever the length
    assert all(isinstance(c, Run) and len(c.first) == 1 for c in long.containers) and long.select(4_999_999) == 4_999_999
    sparse = np.zeros(SPAN, bool)
    sparse[::100] = True
    assert isinstance(fim.container(sparse)[0], Array)


def test_words():
    text = "  one two\n three " + "w " * 60_000
    units = BoundarySet(text.encode(), "word")
    assert len(units) - 1 == len(words(text))
    assert [units.select(k) for k in (0, 1, 2, 3)] == [0, 6, 11, 17]
    assert len(BoundarySet(b"", "word")) == 1 and len(BoundarySet(b"  ", "word")) == 2
    out = fim.cut(text.encode(), 5, FimConfig(unit="word", transformed=100))
    assert out[5] == text.encode() and out[4] != text.encode()


def test_empty_table(spark):
    assert fim.transform(empty(spark)).count() == 0
