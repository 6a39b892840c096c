"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _text string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), None, "", " \n\t ", "one", "one two three", "one two three",
        sentence(rng, 4000), "é ß 😀 " + sentence(rng, 30), "a b c " * 40, "A B C " * 40, sentence(rng, 20),
        "x\x0bx\x1fy z " + base[:200],
    ]
    langs = ["en", "de", None]
    out = [(i * 3 % 41, t, langs[i % 3], [None, "b", "a"][i % 3], len(t or ""), 0.5, "clash") for i, t in enumerate(texts)]
    out.append(out[2])  # a repeated row
    out.append((out[2][0], "another text of the same id", "en", "a", 5, 0.5, "clash"))
    out.append((None, base, "en", "a", 5, None, None))
    out += [(1000 + i, sentence(rng, rng.randrange(0, 200)), "en", f"s{i % 4}", 0, 0.0, "") for i in range(40)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
