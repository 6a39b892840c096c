import numpy as np

from doorlens.llm import multi_index
from doorlens.llm.multi_index import IndexConfig, visit

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(data, k=5):
    rows = {}
    for i, v, _ in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            rows.setdefault(len(v), []).append((i, np.array(v, float)))
    out = {}
    for same in rows.values():
        for i, v in same:
            if i % 50 == 0:
                near = [(-float(v @ w / np.sqrt((v @ v) * (w @ w))), j) for j, w in same if j != i]
                out[i] = sorted((round(s, 9), j) for s, j in near)[:k]
    return out


def table(seed=0, n=700, copies=40):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 16)).astype("float32")
    data = [(i, v[i].tolist(), 0) for i in range(n)]
    data += [(1000 + i, v[3].tolist(), 1) for i in range(copies)]  # ties: smaller ids first
    data += [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [None] * 16, 0), (2200, [float("inf")] + [1.0] * 15, 0)]
    return [*data, (None, v[0].tolist(), 0), (3000, [1.0, 2.0], 0), (3001, [2.0, 1.0], 0), (4000, [1e-30, 3e38], 0)]


def test_exact_when_all_cells_are_visited(spark):
    data = table()
    for config in (IndexConfig(centroids=4, share=1.0), IndexConfig(centroids=3, share=1.0, block=50)):
        got = multi_index.nearest(spark.createDataFrame(data, SCHEMA), "vec_id % 50 = 0", config=config).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
        assert found == {i: x for i, x in brute(data).items() if x}
        assert all([r.rank for r in got if r.query_id == i] != [] for i in found)


def test_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([tuple(r) for r in d.collect()])
    got = {}
    for r in multi_index.nearest(d, "vec_id % 50 = 0", config=IndexConfig(entries=100)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[i] & {j for _, j in x}) for i, x in want.items())
    assert hits / sum(len(x) for x in want.values()) >= 0.9


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(6), rng.random(5)
    cells = visit(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)
    assert len(visit(a, b, np.full(30, 10), 25)) == 3


def test_empty_table(spark):
    assert multi_index.nearest(spark.createDataFrame([], SCHEMA), "vec_id % 50 = 0").count() == 0
