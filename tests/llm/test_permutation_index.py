import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import permutation_index as pi

ROOT = "/root/testdata"


def brute(ids, vectors, k=20, every=20):
    v, out = np.asarray(vectors, np.float64), {}
    ids = np.asarray(ids)
    for i in np.flatnonzero(ids % every == 0):
        score = np.einsum("ij,j->i", v, v[i])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        near = out.setdefault(r.query_id, [])
        assert r.rank == len(near) + 1
        near.append((r.vec_id, r.score))
    return out


def frame(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, schema)


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no sample tables")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_on_the_sample(spark, size):
    table = spark.read.parquet(f"{ROOT}/{size}/embeddings.parquet")
    rows = table.collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = found(pi.op11_nearest_vectors(spark, table))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    score = {(q, i): s for q, near in want.items() for i, s in near}
    for q, near in got.items():
        assert len(near) == 20 and all(i != q for i, _ in near) and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, score.get((q, i), s), abs_tol=1e-12) for i, s in near)


def test_a_third_are_copies_or_near_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 32)).astype(np.float32)
    v[:250] = v[0]
    v[250:500] = v[0] + rng.normal(size=(250, 32)).astype(np.float32) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(1500)
    want = brute(ids, v)
    got = found(pi.op11_nearest_vectors(spark, frame(spark, [(int(i), x.tolist(), 0) for i, x in zip(ids, v, strict=True)])))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q in (int(i) for i in ids[:250] if i % 20 == 0):
        assert got[q] == want[q]  # ties all the way, to the smaller ids


def test_products_of_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(6000, 16)) * rng.lognormal(0, 1, size=(6000, 1))).astype(np.float32)
    want = brute(range(6000), v)
    got = found(pi.op11_nearest_vectors(spark, frame(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)])))
    assert recall(got, want) >= 0.9


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    assert pi.op11_nearest_vectors(spark, frame(spark, [])).count() == 0
    broken = [(20, None, 1), (40, [0.0, 0.0], 1), (60, [1.0, None], 1), (80, [1.0, nan], 1), (100, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (120, [], 1)]
    assert pi.op11_nearest_vectors(spark, frame(spark, broken)).count() == 0
    some = [*broken, (0, [1.0, 0.0], 1), (1, [2.0], 2), (2, [0.5, 3.0], 3), (3, [2.0, 0.0], 3), (3, [2.0, 0.0], 3), (140, [-1.0, 0.0], None), (-20, [0.0, 1.0], 5)]
    got = found(pi.op11_nearest_vectors(spark, frame(spark, some)))
    assert got[0] == [(1, 2.0), (3, 2.0), (2, 0.5), (-20, 0.0), (140, -1.0)]
    assert set(got) == {0, 140, -20}
    # One vector alone has no neighbour; equal ids count once; columns of any name may be there.
    assert pi.op11_nearest_vectors(spark, frame(spark, [(20, [1.0], 1)])).count() == 0
    clash = frame(spark, some).withColumns({"block": F.lit(1), "ids": F.lit("x"), "score": F.lit(2)})
    assert found(pi.op11_nearest_vectors(spark, clash)) == got
    doubles = frame(spark, [(0, [1.0, 1e-3], 0), (1, [0.1, 0.2], 0)], "vec_id long, embedding array<double>, label int")
    assert found(pi.op11_nearest_vectors(spark, doubles))[0] == [(1, 0.1 + 0.2 * 1e-3)]


def test_pivots_are_spread_and_places_are_footrule():
    rng = np.random.default_rng(5)
    sample = np.concatenate([np.ones((50, 8)), rng.normal(size=(100, 8))])
    pivots = pi.farthest(sample, 60)
    assert len(pivots) == 60 and len(np.unique(pivots, axis=0)) == 60
    assert len(pi.farthest(np.ones((9, 4)), 5)) == 1
    one = pi.places(sample, pivots)
    posted = min(pi.POSTED, len(pivots))
    distance = np.abs(one[:5, None].astype(int) - one[None].astype(int)).sum(axis=2)
    assert (distance == posted * (posted + 1) - 2 * pi.in_common(np.ascontiguousarray(one.T), one[:5]).astype(int)).all()
