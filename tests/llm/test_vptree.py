import numpy as np
import pytest

from rankloom.llm import vptree


def brute(rows, k):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
    out = {}
    for q, x in good:
        scores = sorted((-float(sum(np.asarray(v) * x)), i) for i, v in good if i != q)
        out[q] = scores[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score double, shard int, v string").repartition(3)


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(size=6)], 0.0, 0, "x") for i in range(900)]
    vectors = make(spark, rows)
    out = vptree.nearest(vectors, vectors, k=5, factor=1.0, shard=300, block=200)
    same(found(out), brute([(r[0], r[1]) for r in rows], 5))


@pytest.mark.parametrize("factor", [vptree.FACTOR])
def test_recall(spark, sf_dir, factor):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = found(vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), factor=factor))
    want = brute([(r["vec_id"], r["embedding"]) for r in vectors.collect()], 20)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in got])
    assert len(got) == len([q for q in want if q % 20 == 0]) and recall >= 0.9


def test_pruning_skips_leaves_of_clustered_vectors():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.normal(size=(40, 8)) * 30, 100, 0) + rng.normal(size=(4000, 8))
    tree = vptree.Tree(points, 100)
    seen = [len(x) for x in tree.search(points[:50], 10, 1.0)]
    assert max(seen) < 400  # candidates kept are few
    for q in range(50):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        assert set(np.argsort(d, kind="stable")[:10]) <= set(tree.search(points[q : q + 1], 10, 1.0)[0])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same_v = [0.5, 0.25, -0.75]
    rows = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 0.0, 1.0]), (5, [None, 1.0, 2.0]), (None, same_v)]
    rows += [(i, same_v) for i in range(10, 60)] + [(70, [1.0, 2.0, 3.0]), (71, [-1.0, 0.0, 0.5])]
    vectors = make(spark, [(i, v, 1.0, 2, "x") for i, v in rows])
    out = vptree.nearest(vectors, vectors, k=4, factor=1.0, shard=20, block=7)
    same(found(out), brute(rows, 4))
    assert vptree.nearest(vectors.limit(0), vectors, k=4).count() == 0
    assert vptree.nearest(vectors, vectors.limit(0), k=4).count() == 0
    two = make(spark, [(1, [1.0, 0.0], 1.0, 2, "x"), (2, [0.0, 1.0], 1.0, 2, "x")])
    assert {q: [i for _, i in v] for q, v in found(vptree.nearest(two, two)).items()} == {1: [2], 2: [1]}


def lengths_of(shape, rng, n):
    if shape == "one doubled":
        return np.where(np.arange(n) == 17, 2.0, 1.0)
    return np.exp(rng.normal(size=n) * 0.5) if shape == "lognormal" else np.where(np.arange(n) == 17, 20.0, 1.0)


@pytest.mark.parametrize("shape", ["one doubled", "lognormal", "clustered, one of 20"])
def test_nothing_is_missed_where_lengths_differ(spark, shape):
    rng = np.random.default_rng(5)
    n = 10_000
    x = rng.normal(size=(n, 16))
    if shape.startswith("clustered"):
        x = 4 * rng.normal(size=(40, 16))[np.arange(n) % 40] + x
    x = x / np.linalg.norm(x, axis=1)[:, None] * lengths_of(shape, rng, n)[:, None]
    x = x.astype(np.float32).astype(float)
    vectors = make(spark, [(i, v, 0.0, 0, "x") for i, v in enumerate(x.tolist())])
    got = found(vptree.nearest(vectors, vectors.filter("vec_id % 100 = 0"), shard=3300))
    want = {}
    for q in range(0, n, 100):
        score = -(x @ x[q])
        score[q] = np.inf
        want[q] = [(score[i], int(i)) for i in np.lexsort((np.arange(n), score))[:20]]
    same(got, want)
