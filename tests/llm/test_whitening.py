import math

import numpy as np
import pytest

from lodestone.llm.queries import QUERIES
from lodestone.llm.whitening import Spectrum, rank_one, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def direct(rows, most=16):
    """The contract, by one dense eigendecomposition: key -> (deviation, whitened values), and the shares."""
    good = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(-values) if values[i] > 1e-12 * values.max()][:most]
    white = ((x * n - sums) / n) @ vectors[:, order] / np.sqrt(values[order])
    return n, [k for k, _ in good], ((x * n - sums) ** 2).sum(axis=1), white, values[order] / values.sum()


def check(out, rows, most=16):
    n, keys, deviation, white, explained = direct(rows, most)
    assert out.columns == COLUMNS
    got = out.collect()
    assert len(got) == len(keys) * len(explained) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    values = {}
    for r in got:
        values.setdefault((r["component"], r["vec_id"], r["deviation"]), []).append(r["whitened"])
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
    for c in range(len(explained)):
        mine, theirs = [], []
        for i, k in enumerate(keys):
            mine.append(values[(c + 1, k, int(deviation[i]))][0])
            theirs.append(white[i, c])
        sign = np.sign(np.dot(mine, theirs))
        assert np.allclose(mine, sign * np.array(theirs), atol=1e-7)


def _table(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, x string, k int")


def test_query_equals_a_dense_eigendecomposition(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, sf_dir), rows)


def test_broken_repeated_and_flat_vectors(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))).astype(np.float32)
    base[:, 3] = base[:, 1]                                   # a direction without variance
    base[:, 4] = 0.25
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]        # a hot vector
    broken = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0, 0.0]),
              (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (205, [])]
    out = whiten(_table(spark, rows + broken).repartition(11))
    check(out, rows)
    assert {r["component"] for r in out.collect()} == {1, 2, 3}
    check(whiten(_table(spark, rows + broken), most=2), rows, most=2)


def test_null_keys_keep_their_rows(spark):
    rows = [(None, [0.0, 1.0]), (None, [1.0, 0.0]), (3, [2.0, 2.5])]
    assert whiten(_table(spark, rows)).filter("vec_id is null").count() == 4


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])] * 3, [(1, None)], [(1, []), (2, [])]])
def test_nothing_to_fit(spark, rows):
    out = whiten(_table(spark, rows))
    assert out.columns == COLUMNS and out.count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(_table(spark, rows)).filter("component = 1").collect()}
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    exact = [int(v) for v in ((x * 3 - x.sum(axis=0)) ** 2).sum(axis=1)]
    assert got == {k: v if v < 1 << 63 else None for (k, _), v in zip(rows, exact, strict=True)} and None in got.values()


@pytest.mark.parametrize("dim,n,step", [(1, 20, 1), (6, 200, 3), (24, 120, 1), (24, 10, 2)])
def test_spectra_of_parts_meet(dim, n, step):
    rng = np.random.default_rng(dim + n)
    x = np.round(rng.normal(size=(n, dim)) * 3) / step       # whole numbers: many ties and deflations
    whole, parts = Spectrum.empty(dim), [Spectrum.empty(dim) for _ in range(4)]
    for i, v in enumerate(x):
        whole.add(v)
        parts[min(i % 5, 3)].add(v)
    joined = Spectrum.empty(dim)
    for p in parts:
        joined.merge(p)
    want = np.cov(x.T, bias=True).reshape(dim, dim)
    for s in (whole, joined):
        assert s.n == n and np.allclose(s.mean, x.mean(axis=0))
        assert np.allclose(s.basis @ np.diag(s.values) @ s.basis.T, want, atol=1e-10)
        assert np.allclose(s.basis.T @ s.basis, np.eye(s.basis.shape[1]), atol=1e-11)


def test_rank_one_with_equal_and_untouched_eigenvalues():
    values, basis = np.array([0.0, 1.0, 1.0, 1.0, 2.0]), np.eye(5)
    u = np.array([0.0, 3.0, 4.0, 0.0, 1.0])
    new, turned = rank_one(values, basis, u)
    assert np.allclose(turned @ np.diag(new) @ turned.T, np.diag(values) + np.outer(u, u), atol=1e-13)
    same, _ = rank_one(values, basis, np.zeros(5))
    assert np.array_equal(same, values)
