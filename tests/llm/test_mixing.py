from collections import Counter, defaultdict

from doorlens.llm import mixing
from doorlens.llm.mixing import MixConfig
from tests.llm.helpers import docs, empty, rows, sentence, words


def water_level(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3.0 * sizes[s] for s in over}


def check(got, data, config):
    sizes = defaultdict(int)
    for _, text, _, source, *_ in data:
        sizes[source] += len(words(text))
    want = water_level(sizes)
    by_size = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by_size[(r.source_size, round(r.target, 6))].append(r)
    assert sorted(round(t, 6) for t in want.values()) == sorted(k[1] for k in by_size) or len(set(want.values())) < len(want)
    for (_, target), group in by_size.items():
        assert abs(sum(r.taken for r in group) - target) <= max(r.size for r in group)


def test_targets_and_rounding(spark):
    import random

    rng = random.Random(8)
    data = rows() + [(5000 + i, sentence(rng, rng.randrange(1, 90)), "en", "big", 0, 0.0, "") for i in range(700)]
    for config in (MixConfig(), MixConfig(fan_in=4)):
        got = mixing.mix(docs(spark, data), config).collect()
        assert len(got) == len(data)
        check(got, data, config)
        again = mixing.mix(docs(spark, data[::-1]).repartition(7), config).collect()
        key = lambda r: (str(r.doc_id), r.size, r.taken)
        assert sorted(map(key, got)) == sorted(map(key, again))


def test_probabilities_hold_on_average(spark):
    data = [(i, "w " * (1 + i % 5), "en", "ab"[i % 2], 0, 0.0, "") for i in range(60)]
    taken = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(docs(spark, data), MixConfig(seed=seed, fan_in=8)).collect():
            taken[r.source_size, r.target] += r.taken
    for (_, target), total in taken.items():
        assert abs(total / 12 - target) < 5


def test_rows_are_repeated(spark):
    """Each row as often as the mix takes it, rows without id and different texts of one id too."""
    data = rows() + [(None, "words without an id " * 9, "en", "a", 0, 0.0, ""), (None, "more of these " * 9, "en", None, 0, 0.0, "")]
    got = mixing.repeat_rows(docs(spark, data).repartition(3))
    want = Counter()
    for r in mixing.mix(docs(spark, data)).collect():
        want[r.doc_id, r.size] += r.copies
    assert got.columns == docs(spark).columns
    assert Counter((r.doc_id, len(words(r.text))) for r in got.collect()) == +want
    allowed = {tuple(r) for r in docs(spark, data).collect()}
    assert all(tuple(r) in allowed for r in got.collect())
    assert any(r.doc_id is None for r in got.collect())
    assert mixing.repeat_rows(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_equal_rows_are_drawn_apart(spark):
    """A hundred thousand equal rows have keys of their own and do not fall into one group."""
    from pyspark.sql import functions as F

    same = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    other = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("y").alias("source"))
    docs_ = same.unionByName(other)
    config = MixConfig()
    sizes = mixing.stored(mixing.sized(docs_, F.monotonically_increasing_id()), "sizes")
    keys = mixing.keyed(sizes, config)
    assert keys.count() == keys.select("key").distinct().count() == 120_000
    groups = keys.filter("source = 'x'").groupBy(F.pmod("key", F.lit(100_000 // 64))).count()
    assert groups.agg(F.max("count")).first()[0] < 150
    got = mixing.mix(docs_, config).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert len(got) == 2 and all(abs(r.t - r.target) <= 4 for r in got)


def test_all_texts_empty(spark):
    data = [(1, None, None, None, 0, 0.0, ""), (2, "", "en", "a", 0, 0.0, "")]
    assert [(r.size, r.taken) for r in mixing.mix(docs(spark, data)).collect()] == [(0, 0), (0, 0)]
