"""Whitening of vectors by an eigendecomposition that is carried along, vector by vector.

Every partition starts from nothing and takes in its vectors one at a time: the covariance changes by a rank-one term along
the centred vector, the new eigenvalues are the roots of a secular equation between the old ones, and the eigenvectors
follow from the roots. Components that the vector does not touch, and equal eigenvalues, are deflated first. A spectrum is
added to another one by as many rank-one updates as it has components, and one for the difference of the means; spectra
meet a few at a time in rounds of tasks. The resulting basis is refined by one Rayleigh-Ritz step over all vectors.

Vectors are taken in as integers, ``floor(64 c) + 1,000,000``, so that counts, sums and deviations are exact; everything
else works on their differences from the mean, which are small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.plans.scratch import Scratch

SCALE = 64
OFFSET = 1_000_000
MOST = 16             # components returned
LARGEST = 2.0 ** 40   # scaled entries beyond it, in either direction, count as this
FAN_IN = 8            # spectra that one task adds up
_EPS = np.finfo(float).eps
_STEPS = 80


# --- rank-one updates -------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The eigenvalues of ``diag(d) + z z'`` for rising ``d`` and squares ``z2`` > 0: for each the pole it is measured from,
    the distance to it, and the differences of all poles and that eigenvalue (a column each)."""
    k = len(d)
    far = np.append(d[1:], d[-1] + z2.sum())
    half = (far - d) / 2
    at_half = 1 + (z2[:, None] / ((d[:, None] - d) - half)).sum(axis=0)
    right = at_half < 0                                    # the root lies in the right half of its interval
    right[-1] = False
    origin = np.where(right, np.append(np.arange(1, k), k - 1), np.arange(k))
    poles = d[:, None] - d[origin]                         # measured from the origin of each root
    lo, hi = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    if at_half[-1] < 0:
        lo[-1], hi[-1] = half[-1], 2 * half[-1]
    left_of = np.arange(k)[:, None] <= np.arange(k)        # poles up to the root's own
    own, nxt = np.diagonal(poles), np.append(np.diagonal(poles, -1), np.inf)
    t = (lo + hi) / 2
    todo = np.arange(k)
    for _ in range(_STEPS):
        gap = poles[:, todo] - t[todo]
        terms = z2[:, None] / gap
        slopes = terms / gap
        f = 1 + terms.sum(axis=0)
        lo[todo], hi[todo] = np.where(f < 0, t[todo], lo[todo]), np.where(f < 0, hi[todo], t[todo])
        open_ = (np.abs(f) > 4 * _EPS * (1 + np.abs(terms).sum(axis=0))) & (hi[todo] - lo[todo] > 2 * _EPS * np.abs(t[todo]))
        if not open_.any():
            break
        todo, f, terms, slopes = todo[open_], f[open_], terms[:, open_], slopes[:, open_]
        mine = left_of[:, todo]
        da, db = own[todo] - t[todo], nxt[todo] - t[todo]
        sa, sb = (slopes * mine).sum(axis=0), (slopes * ~mine).sum(axis=0)
        a = sa * da * da                                   # f = c + a / (own - t) + b / (next - t), slopes matched side by side
        last = np.isinf(db)
        with np.errstate(all="ignore"):
            b = np.where(last, 0.0, sb * db * db)
            c = f - sa * da - np.where(last, 0.0, sb * db)
            q, p, r = c, -(c * (da + db) + a + b), c * da * db + a * db + b * da
            root = np.sqrt(np.maximum(p * p - 4 * q * r, 0))
            step = np.where(p < 0, 2 * r / (-p + root), np.where(q != 0, (-p - root) / (2 * q), -r / p))
            step = np.where(last, da + a / c, step)
        new = t[todo] + step
        good = np.isfinite(new) & (new > lo[todo]) & (new < hi[todo])
        t[todo] = np.where(good, new, (lo[todo] + hi[todo]) / 2)
    return d[origin], t, poles - t


def rank_one(values: np.ndarray, basis: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) of ``basis diag(values) basis' + u u'``."""
    z = basis.T @ u
    rest = u - basis @ z
    again = basis.T @ rest
    z, rest = z + again, rest - basis @ again
    size = np.linalg.norm(rest)
    if basis.shape[1] < len(u) and size > 16 * _EPS * np.linalg.norm(u):
        values, basis, z = np.append(0.0, values), np.column_stack([rest / size, basis]), np.append(size, z)
    if not len(values):
        return values, basis
    norm = np.linalg.norm(z)
    small = 8 * _EPS * max(values[-1], norm * norm)
    active = np.abs(z) * norm > small
    at = np.flatnonzero(active)
    zs, ds = z[at], values[at]
    if len(at) > 1:
        reach = np.hypot(zs[1:], zs[:-1])
        if ((np.diff(ds) * np.abs(zs[1:] * zs[:-1]) <= small * reach * reach)).any():  # equal eigenvalues: rotate one out
            values, basis, z = values.copy(), basis.copy(), z.copy()
            i = at[0]
            for j in at[1:]:
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if (values[j] - values[i]) * abs(c * s) <= small:
                    basis[:, [i, j]] = np.column_stack([c * basis[:, i] - s * basis[:, j], s * basis[:, i] + c * basis[:, j]])
                    values[i], values[j] = values[i] * c * c + values[j] * s * s, values[i] * s * s + values[j] * c * c
                    z[i], z[j], active[i] = 0.0, r, False
                i = j
            at = np.flatnonzero(active)
            at = at[np.argsort(values[at], kind="stable")]
            zs, ds = z[at], values[at]
    if not len(at):
        return values, basis
    origin, t, gaps = secular_roots(ds, zs * zs)
    apart = ds - ds[:, None]
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(-gaps / apart, axis=1)))  # the vector for which these roots are exact
    turned = np.copysign(exact, zs)[:, None] / gaps
    turned /= np.linalg.norm(turned, axis=0)
    values, basis = values.copy(), basis.copy()
    values[at], basis[:, at] = origin + t, basis[:, at] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Mean and covariance (divisor ``n``) of the vectors so far, the covariance as rising eigenvalues and eigenvectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(0), np.zeros((dim, 0)))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update along its difference from the mean."""
        n, off = self.n, x - self.mean
        self.n, self.mean = n + 1, self.mean + off / (n + 1)
        self.values, self.basis = rank_one(self.values * (n / (n + 1)), self.basis, off * (np.sqrt(n) / (n + 1)))

    def merge(self, other: Spectrum) -> None:
        """Another spectrum, one rank-one update for each of its components and one for the means."""
        n = self.n + other.n
        if not other.n:
            return
        share, off = other.n / n, other.mean - self.mean
        values, basis = self.values * (self.n / n), self.basis
        for value, vector in zip(other.values, other.basis.T, strict=True):
            values, basis = rank_one(values, basis, vector * np.sqrt(max(value, 0) * share))
        self.values, self.basis = rank_one(values, basis, off * np.sqrt(share * (self.n / n)))
        self.n, self.mean = n, self.mean + off * share


# --- tables -----------------------------------------------------------------

def integers(vector: str) -> Column:
    """The vector as integers, null if it is null or holds nulls or entries that aren't finite."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    scaled = lambda c: F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(~bad, F.transform(entries, lambda c: F.floor(scaled(c)) + OFFSET))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(table: DataFrame, names: list[str]) -> dict[int, list]:
    """Sums of a table ``at, names...`` by place; there are as many places as a matrix of the components has entries."""
    rows = table.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {r["at"]: [r[c] for c in names] for r in rows}


@dataclass
class Whitening:
    """What was fitted: ``n`` vectors, exact ``sums``, components (columns, falling variance), their variances and the total."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        """The whole part of the mean; what is left, ``rest / n``, lies between 0 and 1."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of ``n x - sums``, exact; None beyond 64 bits."""
        near = x - self.middle
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * max(x.shape[1], 1) < 1 << 63:
            return ((near * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((near.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _spectra(fit: DataFrame, middle: np.ndarray, dim: int, scratch: Scratch) -> Spectrum:
    """One spectrum of all vectors (less ``middle``): of each partition first, then ``FAN_IN`` at a time."""
    schema = "part long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"

    def row(part, s):
        lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (s.mean, s.values, s.basis)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *lists],
                                          ["part", "n", "mean", "eigenvalues", "eigenvectors"])

    def grow(batches):
        held = Spectrum.empty(dim)
        for batch in batches:
            for x in _matrix(batch.column(0), dim) - middle:
                held.add(x.astype(float))
        if held.n:
            yield row(TaskContext.get().partitionId(), held)

    def read(r):
        return Spectrum(r["n"], np.array(r["mean"]), np.array(r["eigenvalues"]), np.array(r["eigenvectors"]).reshape(dim, -1))

    def meet(batches):
        part, held = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] // FAN_IN != part:
                    if held:
                        yield row(part, held)
                    part, held = r["part"] // FAN_IN, Spectrum.empty(dim)
                held.merge(read(r))
        if held:
            yield row(part, held)

    spectra, turn = scratch.write(fit.mapInArrow(grow, schema), "spectra-0"), 0
    while (most := spectra.agg(F.max("part")).first()[0]) > 0:
        turn += 1
        dealt = spectra.repartition(most // FAN_IN + 1, F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("part")
        spectra = scratch.write(dealt.mapInArrow(meet, schema), f"spectra-{turn}")
    return read(spectra.first())


def _products(fit: DataFrame, of) -> DataFrame:
    """Sums over all vectors of the products of every two entries of ``of(vectors)``, and last the sum of the entries'
    squares: ``at, s``, summed within partitions."""

    def add(batches):
        total, squares = None, 0.0
        for batch in batches:
            y, all_ = of(batch.column(0))
            total = y.T @ y if total is None else total + y.T @ y
            squares += float((all_ * all_).sum())
        if total is not None:
            flat = np.append(total.ravel(), squares)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "s"])

    return fit.mapInArrow(add, "at long, s double")


def _gathered(table: DataFrame, k: int) -> tuple[np.ndarray, float]:
    sums = _summed(table, ["s"])
    flat = np.array([sums[i][0] for i in range(k * k + 1)])
    whole = flat[:-1].reshape(k, k)
    return (whole + whole.T) / 2, flat[-1]


def fit_whitening(vectors: DataFrame, scratch: Scratch, most: int = MOST) -> Whitening | None:
    """The whitening of the distinct rows of ``x`` (integer vectors of one length); None if there are none."""
    fit = scratch.write(vectors.select("x").distinct(), "fit")
    first = fit.first()
    if first is None or not len(first["x"]):
        return None
    dim = len(first["x"])

    def sums(batches):
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(x.sum(axis=0)), pa.array(np.full(dim, len(x)))],
                                             ["at", "s", "n"])

    parts = fit.mapInArrow(sums, "at long, s long, n long")
    found = _summed(parts.withColumn("s", F.col("s").cast("decimal(20,0)")), ["s", "n"])
    out = Whitening(found[0][1], [int(found[i][0]) for i in range(dim)], np.zeros((dim, 0)), np.zeros(0), 0.0)
    spectrum = _spectra(fit, out.middle, dim, scratch)
    basis = np.linalg.qr(spectrum.basis)[0]
    if basis.shape[1]:
        def along(column):
            y = out.centred(_matrix(column, dim))
            return y @ basis, y

        products, squares = _gathered(_products(fit, along), basis.shape[1])
        values, turned = np.linalg.eigh(products / out.n)
        order = [i for i in np.argsort(-values, kind="stable") if values[i] > dim * _EPS * values.max()][:most]
        components = basis @ turned[:, order]
        components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(order))])
        out.components, out.variances, out.total = components, values[order], squares / out.n

        def white(column):
            w = out.whitened(_matrix(column, dim))
            return w, w

        products, _ = _gathered(_products(fit, white), len(order))
        out.identity_error = float(np.abs(products / out.n - np.eye(len(order))).max())
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each component of each vector.

    Rows whose vector is null, or holds nulls or entries that aren't finite, give none. Vectors are expected to have one
    length; rows of another than the commonest (the greatest of equally common ones) give none. Repeated vectors are fitted
    once and returned for each of their rows, whatever their keys, nulls among them. Directions without variance are no
    components, so a single distinct vector, empty vectors and an empty table give no rows. ``deviation`` is null beyond 64
    bits. Only ``key`` and ``vector`` are read. Of a component's two signs, its largest entry is positive.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    vectors = rows.select(F.col(key).alias("k"), integers(vector).alias("x")).filter("x is not null")
    length = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    vectors = vectors.filter(F.size("x") == (length["d"] if length else 0))
    model = fit_whitening(vectors, scratch, most)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [rows.schema[key].dataType.simpleString(), "int", "long", "long", "double", "double", "double"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema)
    k, dim = len(model.variances), len(model.sums)
    explained = model.variances / model.total

    def of(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                 pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(each), model.identity_error))], names)

    return vectors.mapInArrow(of, schema)
