from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from llm_samples import SF

from docsieve.llm.queries import QUERIES
from docsieve.llm.whitening import Spectrum, Whitening, component_rows, rank_one_update, usable_vectors, whiten_embeddings


def spectrum_error(values, vectors, wanted):
    made = vectors @ np.diag(values) @ vectors.T
    scale = max(np.abs(wanted).max(), 1e-300)
    return max(np.abs(made - wanted).max() / scale, np.abs(vectors.T @ vectors - np.eye(len(values))).max())


def test_rank_one_updates():
    """Of all sizes, with close and equal eigenvalues and with parts that vanish."""
    rng = np.random.default_rng(1)
    for t in range(300):
        k = int(rng.integers(1, 40))
        values = np.sort(rng.normal(size=k) * 10.0 ** rng.integers(-3, 6))
        if t % 3 == 0 and k > 3:
            values[2] = values[1] + 1e-9
        if t % 7 == 0 and k > 2:
            values[1] = values[0]
        values.sort()
        vectors = np.linalg.qr(rng.normal(size=(k, k)))[0]
        u = vectors[:, 0].copy() if t % 5 == 0 else rng.normal(size=k) * 10.0 ** rng.integers(-6, 3)
        rho = 10.0 ** rng.integers(-3, 3)
        wanted = vectors @ np.diag(values) @ vectors.T + rho * np.outer(u, u)
        found = rank_one_update(values.copy(), vectors.copy(), u, rho)
        assert (np.diff(found[0]) >= 0).all()
        assert spectrum_error(*found, wanted) < 1e-13


def test_spectra():
    """Rows taken up one by one, and spectra combined, against the scatter of all rows; a third of them are equal."""
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (900, 12))
    x[::3] = x[0]
    x[:, 5] = x[:, 4]
    x[:, 6] = 7
    whole = Spectrum.empty(12)
    whole.add(x)
    parts = Spectrum.empty(12)
    for start in range(0, 900, 250):
        one = Spectrum.empty(12)
        one.add(x[start : start + 250])
        parts.merge(Spectrum.of(*one.row().values()))
    wanted = np.cov(x.T.astype(float), bias=True) * len(x)
    for found in (whole, parts):
        assert spectrum_error(found.values, found.vectors, wanted) < 1e-11
        assert found.n == 900 and found.sums == x.sum(axis=0).tolist()


def plain_whitening(vectors, components):
    """Exact sums, covariance of the centred rows, and a dense solver."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums.tolist())] for row in x.tolist()])
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    return n, deviation, centred @ found / np.sqrt(values), values / (centred * centred).mean(axis=0).sum()


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, whitened, explained = plain_whitening([r["embedding"] for r in table], 32)
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(rows) == 32 * n
    by_vector = {}
    for r in rows:
        by_vector.setdefault(r["vec_id"], {})[r["component"]] = r
    found = np.array([[by_vector[t["vec_id"]][c]["whitened"] for c in range(1, 33)] for t in table])
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found - whitened * signs).max() < 1e-8
    for t, wanted in zip(table, deviation):
        assert all(r["n"] == n and r["deviation"] == wanted for r in by_vector[t["vec_id"]].values())
    shares = [by_vector[table[0]["vec_id"]][c]["explained"] for c in range(1, 33)]
    assert np.allclose(shares, explained, rtol=1e-10)
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and 0 < errors.pop() < 1e-10


def test_many_tasks(spark, monkeypatch):
    """More partial results than are combined at once."""
    monkeypatch.setattr("docsieve.llm.whitening.FAN", 3)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 5)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>").repartition(11)
    n, deviation, whitened, _ = plain_whitening(vectors, 5)
    rows = {r["vec_id"]: r for r in whiten_embeddings(df).collect()}
    found = np.array([rows[i]["whitened"] for i in range(60)])
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.abs(found - whitened * signs).max() < 1e-9
    assert [rows[i]["deviation"] for i in range(60)] == deviation and rows[0]["n"] == n == 60


def test_odd(spark):
    """Nulls, numbers that are none, huge ones, other lengths, repeated rows, equal rows, columns with clashing names."""
    fine = [[1.0, 2.0, 3.0], [1.0, 2.5, -3.0], [0.0, 2.0, 1.0], [0.0, 2.0, 1.0], [4.0, -2.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(fine)] + [(None, fine[0], "x", 1), (0, fine[0], "x", 1)]
    rows += [(50 + i, v, "x", 1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, part string, n int")
    for name in ("vector", "sums", "values", "whitened", "d"):
        df = df.withColumn(name, df["part"])
    found = whiten_embeddings(df).collect()
    assert sorted(str(r["vec_id"]) for r in found) == sorted(["0", "0", "1", "2", "3", "4", "None"])
    n, deviation, whitened, _ = plain_whitening([*fine, fine[0], fine[0]], 3)
    by_id = {r["vec_id"]: r for r in found}
    assert n == 7 and [by_id[i]["deviation"] for i in range(5)] == deviation[:5]
    made = np.array([by_id[i]["whitened"] for i in range(5)])
    assert np.abs(np.abs(made) - np.abs(whitened[:5])).max() < 1e-9
    for none in (df.limit(0), df.where("vec_id >= 50 and vec_id < 56")):
        empty = whiten_embeddings(none)
        assert empty.count() == 0 and empty.columns == whiten_embeddings(df).columns
    assert usable_vectors(df, "vec_id", "embedding").count() == 9


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_variance(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, embedding array<float>")
    for r in component_rows(whiten_embeddings(df)).collect():
        assert (r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, None, None, 0)


def test_less_variance_than_dimensions(spark):
    vectors = [[float(i), float(2 * i), 1.0] for i in range(9)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<float>")
    rows = whiten_embeddings(df).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in rows)
    assert rows[0]["explained"][0] == pytest.approx(1) and rows[0]["identity_error"] < 1e-12


def test_deviations_beyond_64_bits():
    model = Whitening(3_000_000_000, [0, 3], np.ones(2), np.eye(2), 2.0)
    x = np.array([[0, 0], [1, 1], [1000, 0], [1 << 40, 0]])
    n, wanted = 3_000_000_000, []
    for a, b in x.tolist():
        exact = (n * a) ** 2 + (n * b - 3) ** 2
        wanted.append(exact if exact < 1 << 63 else None)
    assert model.deviations(x) == wanted and wanted[-1] is None and wanted[0] == 9
