import numpy as np
import pytest

from tidewatch.llm import whitening
from tidewatch.llm.queries import op11_embedding_whitening

NAN, INF = float("nan"), float("inf")


def frame(spark, vectors, extra=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return df.withColumns({c: df["vec_id"] for c in ("component_", "deviation_", "whitened_", "x_", "found_")}) if extra else df


def brute(vectors):
    """n, S, V, eigenvalues and vectors over the distinct integer vectors, plainly."""
    whole = sorted({tuple(int(np.floor(float(np.float32(c)) * 256)) for c in v) for v in vectors})
    x = np.array(whole, dtype=np.longdouble)
    z = x - x.mean(0)
    v = (z.T @ z / len(x)).astype(float)
    values, found = np.linalg.eigh(v)
    return len(whole), [sum(c) for c in zip(*whole)], v, values[::-1], found[:, ::-1]


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_query_equals_plain_arithmetic(spark, table):
    sf_dir = f"/root/testdata/{table}"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, sums, v, values, found = brute([r.embedding for r in rows])
    got = {}
    for r in op11_embedding_whitening(spark, sf_dir).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows)
    signs = {}
    for row in rows:
        x = np.floor(np.array(row.embedding, dtype=float) * 256)
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(x, sums))
        for k in range(1, 5):
            r = got[row.vec_id][k]
            want = (x - np.array(sums) / n) @ found[:, k - 1] / np.sqrt(values[k - 1])
            sign = signs.setdefault(k, np.sign(want * r.whitened))
            assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened - sign * want) < 1e-7
            assert abs(r.explained - values[k - 1] / np.trace(v)) < 1e-10 and r.identity_error < 1e-9


def rotated(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [np.linspace(1, 9, 48), np.r_[np.linspace(3, 9, 20), 1 + 1e-9 * np.arange(12)], np.ones(24), np.r_[np.zeros(9), np.linspace(1, 2, 9)], np.r_[5 + 1e-12 * np.arange(6), np.ones(6)], np.zeros(5)])
def test_eigenvectors_are_right_to_double_precision_in_clusters_too(values):
    a = rotated(values)
    got, x = whitening.refined_eigenvectors(a)
    a, wide = a.astype(np.longdouble), x.astype(np.longdouble)
    size = max(np.abs(a).max(), 1e-300)
    assert np.all(np.diff(got) <= 0)
    assert np.abs(a @ wide - wide * got).max() < 2e-15 * size and np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15


def test_refinement_beats_float32():
    a = rotated(np.linspace(1, 9, 48))
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    _, fine = whitening.refined_eigenvectors(a)
    defect = lambda x: np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max()
    assert defect(fine) < 1e-13 < 1e-8 < defect(rough)


def test_defined_cases(spark):
    vectors = [[1.0, 2.0, 0.5], [1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 0.0, 1.0], None, [], [1.0, None, 2.0], [NAN, 1.0, 1.0], [INF, 1.0, 1.0], [1.0, 2.0]]
    df = frame(spark, vectors, extra=True)
    model = whitening.fit(df)
    assert model.n == 3 and len(model.values) == 3
    out = whitening.whiten(df, model)
    assert out.columns == [*df.columns, "_component_", "_deviation_", "_whitened_"]
    rows = out.collect()
    assert sorted({r.vec_id for r in rows}) == [0, 1, 2, 3] and len(rows) == 12
    assert all(r.found_ == r.vec_id for r in rows)
    # three points span two dimensions: the last component has no variance
    assert all((r["_whitened_"] is None) == (r["_component_"] == 3) for r in rows)
    first = {r.vec_id: (r["_deviation_"], r["_whitened_"]) for r in rows if r["_component_"] == 1}
    assert first[0] == first[1] and model.identity_error < 1e-9


def test_no_vectors_one_vector_and_huge_entries(spark):
    empty = frame(spark, []).limit(0)
    assert whitening.fit(empty) is None and whitening.whiten(frame(spark, [[1.0]]), None).count() == 0
    assert whitening.whiten(empty, None).columns == ["vec_id", "embedding", "component_", "deviation_", "whitened_"]
    one = frame(spark, [[1.0, 2.0]] * 3)
    model = whitening.fit(one)
    rows = whitening.whiten(one, model).collect()
    assert model.n == 1 and model.trace == 0 and model.identity_error is None
    assert len(rows) == 6 and all(r.deviation_ == 0 and r.whitened_ is None for r in rows)
    vectors = [[3e9, 1.0], [-5e9, 2.0], [1e9, -3e9]]
    big = frame(spark, vectors)
    n, sums, *_ = brute(vectors)
    got = {r.vec_id: r.deviation_ for r in whitening.whiten(big, whitening.fit(big)).collect()}
    for i, v in enumerate(vectors):
        assert int(got[i]) == sum((n * int(np.floor(float(np.float32(c)) * 256)) - s) ** 2 for c, s in zip(v, sums))
