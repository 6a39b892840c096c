import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from doorlens.llm import ppm
from doorlens.llm.ppm import PpmConfig, PpmModel, grams_of
from tests.llm.helpers import docs, empty, rows


def encoded(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)


def plain_bits(train, text, order):
    """Code length by dictionaries of contexts, byte after byte."""
    seen = [Counter() for _ in range(order + 1)]
    for t in train:
        padded = b"\0" * order + t.encode()
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[k][padded[i - k : i], padded[i]] += 1
    total = [Counter() for _ in seen]
    kinds = [Counter() for _ in seen]
    for k, counts in enumerate(seen):
        for (context, _), n in counts.items():
            total[k][context] += n
            kinds[k][context] += 1
    bits, padded = 0.0, b"\0" * order + text.encode()
    for i in range(order, len(padded)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            context = padded[i - k : i]
            if not total[k][context]:
                continue
            n = seen[k][context, padded[i]]
            bits -= math.log2((n or kinds[k][context]) / (total[k][context] + kinds[k][context]))
            if n:
                break
    return bits


def test_code_lengths_are_exact():
    train = [("en", "the cat sat on the mat"), ("de", "der Hund lag auf der Straße"), ("en", "that is that"), ("de", "ö")]
    languages = ["de", "en"]
    data, offsets = encoded([t for _, t in train])
    lang = np.repeat([languages.index(x) for x, _ in train], np.diff(offsets))
    for order in (0, 2, 4):
        model = PpmModel(languages, lang, grams_of(data, offsets, order), np.ones(len(data)), order)
        texts = ["the mat", "", "der", "unrelated Ж text", "ö", "a", "that Straße is 123"]
        got = model.code_lengths(*encoded(texts))
        want = [[plain_bits([t for x, t in train if x == k], text, order) for k in languages] for text in texts]
        assert np.allclose(got, want)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = ppm.fit(d.filter("doc_id % 4 <> 2"), PpmConfig(sample=60))
    got = ppm.identify(d.filter("doc_id % 4 = 2"), model).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_rare_language_beside_large_ones(spark):
    """The large languages have more distinct grams than any table of fixed size, each twice; the rare one's stand once or twice."""
    rng = random.Random(4)

    def letters(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    large = [(k, letters(2500)) for k in ("l1", "l2", "l3") for _ in range(100)]
    vocabulary = [letters(8).replace(" ", "x") for _ in range(60)]
    rare = [("rare", " ".join(rng.sample(vocabulary, 30))) for _ in range(4)]
    data = [(i, t, k, "a", 0, 0.0, "") for i, (k, t) in enumerate(large + large + rare)]
    model = ppm.fit(docs(spark, data))
    held = [(i, " ".join(rng.sample(vocabulary, 12)), None, "a", 0, 0.0, "") for i in range(20)]
    assert {r.lang_pred for r in ppm.identify(docs(spark, held), model).collect()} == {"rare"}


def test_awkward_rows(spark):
    model = ppm.fit(docs(spark))
    got = ppm.identify(docs(spark), model).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert ppm.identify(empty(spark), model).count() == 0
    none = ppm.fit(empty(spark))
    assert {r.lang_pred for r in ppm.identify(docs(spark), none).collect()} == {"und"}


def test_blocks_equal_the_whole():
    texts = ["the cat sat", "", "der Hund é", "x", "", "on the mat " * 30]
    data, offsets = encoded(texts)
    model = PpmModel(["a", "b"], np.arange(len(data)) % 2, grams_of(data, offsets, 4), np.ones(len(data)), 4)
    whole = model.code_lengths(data, offsets, len(data))
    for block in (1, 3, 7, 64):
        assert np.allclose(model.code_lengths(data, offsets, block), whole)


def test_long_text_needs_little_memory():
    import tracemalloc

    data, offsets = encoded(["the cat sat on the mat, " * 830_000])  # 20 MB
    model = PpmModel([f"l{i}" for i in range(8)], np.arange(4000) % 8, grams_of(data[:4000], np.array([0, 4000]), 4), np.ones(4000), 4)
    tracemalloc.start()
    model.code_lengths(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000_000


def test_input_columns_of_the_same_names(spark):
    model = ppm.fit(docs(spark))
    got = ppm.identify(docs(spark).withColumn("lang_pred", F.col("lang")), model)
    assert got.columns.count("score") == got.columns.count("lang_pred") == 1 and got.count() == docs(spark).count()
