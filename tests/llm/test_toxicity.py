import random

import numpy as np

from doorlens.llm import toxicity
from doorlens.llm.toxicity import FactorizationMachine, ToxicityConfig
from tests.llm.helpers import docs, empty, rows, sentence


def labelled(spark, n=600):
    """Label 1 needs an insult, or both a group word and an attack word, which alone are harmless."""
    rng, data, labels = random.Random(3), [], []
    for i in range(n):
        w = sentence(rng, 30).split()
        kind = i % 6
        w[5] = "insultword" if kind == 0 else w[5]
        w[6] = "groupword" if kind in (1, 2) else w[6]
        w[9] = "attackword" if kind in (1, 3) else w[9]
        data.append((i, " ".join(w), "en", "a", 0, 0.0, ""))
        labels.append((i, int(kind in (0, 1))))
    return docs(spark, data), spark.createDataFrame(labels, "doc_id bigint, toxic int"), data, dict(labels)


def test_learns_words_and_pairs(spark):
    d, labels, _, truth = labelled(spark)
    model = toxicity.fit(d, labels.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(d.select("doc_id", "text"), model).collect()}
    held = [i for i in got if i % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == truth[i] for i in held])
    assert right > 0.95
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def pair_rows(n, seed):
    """Of 20 rows five are toxic, two by a pair; each word of the pair stands in eight rows, two of them toxic."""
    rng, rows, labels = np.random.default_rng(seed), [], []
    for i in range(n):
        k = i % 20
        own = [11, 12] if k < 2 else [11] if k < 8 else [12] if k < 14 else [13] if k < 17 else []
        rows.append(np.unique(np.concatenate([rng.integers(1000, 1040, 8), np.array(own, np.int64)])))
        labels.append(int(k < 2 or 14 <= k < 17))
    return rows, np.array(labels, float)


def test_learns_a_pair_of_words_at_the_base_rate():
    rows, labels = pair_rows(8000, 5)
    for word in (11, 12):
        assert np.mean(labels[[word in r for r in rows]]) == labels.mean()
    model = toxicity.train(rows, labels, ToxicityConfig())
    held, truth = pair_rows(1000, 6)
    offsets = np.cumsum([0] + [len(r) for r in held])
    toxic = model.logits(np.concatenate(held), offsets) >= 0
    pair = np.arange(len(held)) % 20 < 2
    assert toxic[pair].mean() > 0.9 and toxic[truth == 0].mean() < 0.02


def test_logits_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    fm = FactorizationMachine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [[1, 5, 7], [], [3], [0, 19, 4, 2]]
    offsets = np.cumsum([0] + [len(s) for s in sets])
    want = [
        0.3 + sum(fm.weights[i] for i in s) + sum(fm.vectors[a] @ fm.vectors[b] for k, a in enumerate(s) for b in s[:k]) for s in sets
    ]
    assert np.allclose(fm.logits(np.array(sum(sets, []), np.int64), offsets), want)


def test_awkward_rows(spark):
    config = ToxicityConfig(epochs=1)
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (None, 1), (6, None), (999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs(spark), labels, config)
    scored = toxicity.score(docs(spark), model, config).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 for r in scored)
    none = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id bigint, toxic int"), config)
    assert toxicity.score(docs(spark), none, config).filter("score >= 0.5").count() == 0
    assert toxicity.score(empty(spark), none, config).count() == 0
