import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import ann as A
from leadspark.llm.common import table


def brute(rows, asked, k=5):
    rows = {(i, tuple(v)) for i, v in rows}
    out = {}
    for q, v in rows:
        if asked(q):
            a = np.array(v, float)
            for i, w in rows:
                if i != q:
                    b = np.array(w, float)
                    m = max(len(a), len(b))
                    x, y = np.pad(a, (0, m - len(a))), np.pad(b, (0, m - len(b)))
                    s = float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))
                    out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, -2))
    return {q: sorted(d.items(), key=lambda x: (-x[1], x[0]))[:k] for q, d in out.items()}


def test_recall_and_scores(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()], lambda q: q % 50 == 0)
    got = {}
    for r in A.report(e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want))
    assert hits >= 0.95
    exact = {(q, i): s for q, found in brute([(r.vec_id, r.embedding) for r in e.collect()], lambda q: q % 50 == 0, 10_000).items() for i, s in found}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, found in got.items() for i, s in found)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(0, 120, 3)]  # one very common vector
    good += [(i, rng.normal(size=4).tolist()) for i in range(1, 60, 3)] + [(200, [1.0, 2.0]), (200, [1.0, 2.0]), (250, [2e200, 4e200, 0.0, -2e200])]
    bad = [(2, None), (5, []), (8, [0.0] * 4), (11, [1.0, None]), (14, [nan, 1.0]), (17, [inf, 1.0]), (None, [1.0, 1.0]), (350, [0.0])]
    rows = [(i, v, "x", 1) for i, v in good + bad]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, bucket int")
    with np.errstate(over="ignore", invalid="ignore"):
        want = brute([g for g in good if g[0] != 250], lambda q: q % 50 == 0)
    got = {}
    for r in A.report(e.where("vec_id is null or vec_id <> 250")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert 250 in {r.query_id for r in A.report(e).collect()}


def test_small_and_empty(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in A.report(e).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert A.report(e.where("vec_id = 0")).count() == 0 and A.report(e.where("false")).count() == 0


def test_buckets_grow_with_the_vectors():
    assert A.Index.of(50_000, 64).axes == 1 and A.Index.of(10**8, 64).axes == 2
    x = np.random.default_rng(0).normal(size=(50, 64))
    index = A.Index(64, 2, 30, 2)
    found = index.buckets(x / np.linalg.norm(x, axis=1, keepdims=True), 30)
    assert found.shape == (50, 2, 30) and all(len(set(r.tolist())) == 30 for t in found for r in t)


def test_rotation_keeps_angles():
    x = np.random.default_rng(0).normal(size=(20, 16))
    y = A.Index(16, 1, 1).turned(x, 0, 0)
    assert np.allclose(x @ x.T, y @ y.T)


def test_query_column(spark):
    e = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(12)], "vec_id long, embedding array<float>")
    assert A.nearest(e, F.col("id") == 7, k=2).count() == 2
