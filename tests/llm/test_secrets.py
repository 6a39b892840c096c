import hashlib
import random
import re

from doorlens.llm import secrets
from doorlens.llm.secrets import KINDS
from tests.llm.helpers import docs, empty, rows

WORDS = "password passwd secret token apikey api_key".split()
EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in WORDS)
ASSIGN = re.compile(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    c = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(a + c + h), (len(a), len(c), len(h))


def cases():
    rng = random.Random(2)
    bits = ["Token", "API_KEY", "passwd", "token=token: ", "AKIA", "AKIAABCDEFGH1234567", "0" * 31, "deadbeef" * 4, "deadbeef" * 9,
            '"', "'", " : ", "=", "==", "a/b+c_d.e-f", "longvalue123", "é", "😀", "\n", " ", "x", "secret = 'abcdefgh'", "ſecret=12345678"]
    data = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))), "en", "a", 0, 0.0, "") for i in range(300)]
    return data + rows(2)


def test_base_spans_equal_brute_force(spark):
    data = cases()
    got = secrets.report(docs(spark, data)).collect()
    assert len(got) == len(data)
    want = {}
    for doc_id, text, *_ in data:
        spans, counts = base(text)
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.setdefault(doc_id, []).append((*counts, hashlib.sha256(listed.encode()).hexdigest()))
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want[r.doc_id]
        listed = [s for s in r.spans.split(",") if s.split(":")[0] in KINDS[:3]]
        assert hashlib.sha256(",".join(listed).encode()).hexdigest() == r.base_sha256


def test_weak_parts_need_their_complements(spark):
    opaque, access, far = "Zx9Kq2Lm8Vb4Nt6Rw1Ys7", "AKIAABCDEFGH1234567", "filler words " * 60
    texts = {
        1: f"key {opaque} alone",
        2: f"id {access} then {opaque} here",
        3: f"id {access} {far} {opaque}",
        4: "user: alice and password: hunter2hunter2",
        5: "user: alice only, see https://db.example.com/path",
        6: "login = bob password = abcdefgh12 at https://db.example.com/path",
        7: "see https://db.example.com/path",
    }
    data = [(i, t, "en", "a", 0, 0.0, "") for i, t in texts.items()]
    got = {r.doc_id: sorted({s.split(":")[0] for s in r.spans.split(",") if s}) for r in secrets.report(docs(spark, data)).collect()}
    assert got == {
        1: [], 2: ["access", "opaque"], 3: ["access"], 4: ["assign", "identifier"], 5: [],
        6: ["assign", "endpoint", "identifier"], 7: [],
    }


def test_redaction_removes_what_is_reported(spark):
    data = cases()
    got = secrets.redact(docs(spark, data))
    assert got.columns == docs(spark, data).columns and got.count() == len(data)
    texts = {}
    for doc_id, text, *_ in data:
        out, at = "", 0
        for s, _, e in base(text)[0]:
            if s >= at:
                out += (text or "")[at:s] + "[SECRET]"
            at = max(at, e)
        texts.setdefault(doc_id, []).append(None if text is None else out + text[at:])
    linked = {r.doc_id for r in secrets.report(docs(spark, data)).collect() if r.n_linked}
    for r in got.collect():
        if r.doc_id not in linked:
            assert r.text in texts[r.doc_id]
    assert secrets.redact(empty(spark)).count() == 0 and secrets.report(empty(spark)).count() == 0
