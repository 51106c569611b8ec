from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from casewright.llm import queries
from casewright.llm import whitening as W


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 20):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T + (rng.random() < 0.5) * np.eye(n)
            values = np.linalg.eigvalsh(a)
            for shift in (-2.1234, -0.3217, 0.1237, 1.4711):
                assert W.negative_pivots(a - shift * np.eye(n)) == (values < shift).sum()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [7, 7, 7, 2, 2, 1e-3], [1e6, 1, 1 - 1e-9, 1 - 2e-9, 1e-4], [3.0], [2, 0, 0], [1.0] * 40, list(np.geomspace(1, 1e-9, 50)), [0.0, 0.0]])
def test_spectrum_with_ties_and_near_ties(values):
    rng = np.random.default_rng(2)
    d = len(values)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    matrix = (q * np.array(values, float)) @ q.T
    matrix = (matrix + matrix.T) / 2
    found = W.leading_spectrum(matrix, 32)
    expected = [v for v in sorted(values, reverse=True) if v > 1e-12 * max(values)][:32]
    assert len(found.values) == len(expected)
    if expected:
        assert np.allclose(found.values, expected, rtol=1e-6, atol=1e-13 * max(values))
        assert np.abs(found.vectors.T @ found.vectors - np.eye(len(expected))).max() < 1e-12
        assert np.abs(matrix @ found.vectors - found.vectors * found.values).max() < 1e-13 * max(values) * d


def test_whole_products_are_exact():
    rng = np.random.default_rng(3)
    for most in (5, 1 << 20, (1 << 32) + 1):
        z = rng.integers(-most, most + 1, (300, 4))
        assert (W.whole_products(z.astype(float)) == z.astype(object).T @ z.astype(object)).all()


def brute(vectors: list[np.ndarray], components: int = 32) -> tuple[np.ndarray, list[int], np.ndarray]:
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    deviation = [sum(int(v) ** 2 for v in row) for row in away]
    centred = away / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return centred @ u / np.sqrt(e), deviation, e / np.trace(centred.T @ centred / n)


def test_query_against_brute_force(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    kept = [r for r in table if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    white, deviation, explained = brute([r["embedding"] for r in kept])
    rows = queries.op13_embedding_whitening(spark, sf_dir).toPandas()
    assert len(rows) == white.size and set(rows.n) == {len(kept)} and rows.identity_error.nunique() == 1 and rows.identity_error[0] < 1e-9
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in kept]].to_numpy()
    signs = np.sign((wide * white).sum(axis=0))
    assert np.abs(wide * signs - white).max() < 1e-7
    assert dict(zip(rows.vec_id, rows.deviation)) == dict(zip([r["vec_id"] for r in kept], deviation))
    assert np.allclose(rows.groupby("component").explained.first().to_numpy(), explained, rtol=1e-9)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    sound = [[float(x) for x in rng.standard_normal(3)] + [2.5] for _ in range(40)]
    rows = [(i, v, "x", 1.0) for i, v in enumerate(sound)] + [(0, sound[0], "x", 1.0), (None, sound[1], None, None)]
    odd = [(90, None, "a", 1.0), (91, [], "a", 1.0), (92, [1.0, None, 2.0, 3.0], "a", 1.0), (93, [1.0, float("nan"), 0.0, 0.0], "a", 1.0), (94, [1.0, float("inf"), 0.0, 0.0], "a", 1.0), (95, [1.0, 2.0], "a", 1.0), (96, [1e30, 0.0, 0.0, 0.0], "a", 1.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, w string, n double").repartition(3)
    got = W.whiten(df).toPandas()
    white, deviation, _ = brute([r[1] for r in rows], 3)
    assert len(got) == 42 * 3 and set(got.component) == {1, 2, 3} and got.identity_error[0] < 1e-9
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert np.allclose(sorted(np.abs(got[got.component == 1].whitened)), sorted(np.abs(white[:, 0])), atol=1e-9)
    assert got.vec_id.isna().sum() == 3


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert W.whiten(df).count() == 0


def test_large_entries_keep_exact_sums(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-(1 << 24), 1 << 24, 3)] for _ in range(50)]
    got = W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    white, deviation, _ = brute(vectors, 3)
    rows = got.toPandas()
    assert rows.identity_error[0] < 1e-9
    told = {r.vec_id: None if np.isnan(r.deviation) else True for r in rows.itertuples()}
    assert all((told[i] is None) == (v >= 1 << 63) for i, v in enumerate(deviation))


def test_partitioning_does_not_show(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one, many = (W.whiten(df.repartition(n)).orderBy("vec_id", "component").select("vec_id", F.round("whitened", 9).alias("w"), "explained").collect() for n in (1, 7))
    assert one == many
