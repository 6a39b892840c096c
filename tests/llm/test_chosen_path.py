from collections import defaultdict
from itertools import combinations

import pytest

from doorlens.llm import chosen_path, components
from tests.llm.helpers import docs, empty, rows, words


def sets_of(data):
    """One text per id (smallest digest), as its shingle set."""
    from hashlib import md5

    best = {}
    for doc_id, text, *_ in data:
        if doc_id is not None:
            key = md5((text or "").lower().encode()).hexdigest()
            best[doc_id] = min(best.get(doc_id, (key, text or "")), (key, text or ""))
    out = {}
    for doc_id, (_, text) in best.items():
        w = words(text.lower())
        out[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(data):
    sets, links, root = sets_of(data), defaultdict(int), {}
    for i in sets:
        root[i] = i

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("config", [chosen_path.JoinConfig(), chosen_path.JoinConfig(bucket=6, block=5)])
def test_equals_brute_force(spark, config):
    import random

    rng = random.Random(5)
    data = rows()
    base = words(data[0][1])
    for k in range(40):  # a chain of near copies, in buckets and blocks that are far too small for it
        copy = list(base)
        for at in rng.sample(range(len(copy)), 2):
            copy[at] = f"new{rng.randrange(9)}"
        data.append((2000 + k, " ".join(copy), "en", "a", 0, 0.0, ""))
    got = chosen_path.jaccard_join(docs(spark, data), config).collect()
    assert {r.doc_id: (r.class_id, r.links) for r in got} == brute(data)
    assert len(got) == len({r.doc_id for r in got})


def test_keep_first(spark):
    """Every row is a document, whatever its id; of each class the smallest id stays (null last, then the digest)."""
    from hashlib import md5

    data = rows()
    data += [(None, data[9][1], "en", "a", 0, 0.0, ""), (None, "text without an id", "en", "a", 0, 0.0, ""), data[9]]
    classes = defaultdict(list)
    for number, (c, _) in brute([(k, *r[1:]) for k, r in enumerate(data)]).items():
        classes[c].append(data[number])
    first = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, md5((r[1] or "").encode()).hexdigest())
    want = [min(members, key=first) for members in classes.values()]
    kept = chosen_path.keep_first(docs(spark, data).repartition(3))
    assert kept.columns == docs(spark).columns
    key = lambda r: (str(r[0]), r[1] or "", str(r[3]))
    assert sorted(map(key, kept.collect())) == sorted(map(key, want))
    assert chosen_path.keep_first(empty(spark)).count() == 0


def test_empty_table(spark):
    assert chosen_path.jaccard_join(empty(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 130)} | {200: 200, 300: 200}
    assert {r.id: r.root for r in got} == want and len(got) == len(want)


def test_runs_reach_the_recall():
    met = 1.0
    config = chosen_path.JoinConfig()
    for _ in range(config.depth):
        met = 1 - 2.718281828459045 ** -met
    assert 1 - (1 - met) ** config.runs() >= config.recall
