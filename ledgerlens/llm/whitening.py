"""Embedding whitening by the leading eigenvectors of a covariance that is never built.

Jacobi-Davidson: a subspace is projected (Rayleigh-Ritz), the Ritz vectors not yet converged each
get a correction from the projected equation (I - UU')(V - theta I)(I - UU') t = -r, solved roughly
by MINRES, and the corrections extend the subspace; converged vectors are locked. The driver holds
vectors of one embedding's length only. Each product of V with some of them is one Spark job: tasks
centre their rows and sum (x - mean)((x - mean)'u), and the sums are added by Spark. The MINRES
iterations of all open vectors go in step, so that one job serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.arrow import add_struct, others, row_type
from ledgerlens.session import pin

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# A vector with an entry beyond this counts as one that is not finite.
LARGEST = 2.0 ** 40
ROWS = 4_096
INNER_STEPS, INNER_TOLERANCE, OUTER_STEPS = 12, 0.01, 60
EPS = float(np.finfo(np.float64).eps)
Product = Callable[[np.ndarray], np.ndarray]

RESULT = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.DecimalType(38, 0)),
    T.StructField("whitened", T.ArrayType(T.DoubleType())),
    T.StructField("explained", T.ArrayType(T.DoubleType())),
    T.StructField("identity_error", T.DoubleType()),
])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=0))


def minres(product: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of A x = b for each column of b, with symmetric A, in step."""
    beta = first = _norms(b)
    x, w, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    before, now = b, b
    old = dbar = epsilon = sine = np.zeros_like(beta)
    cosine, phi_bar = -np.ones_like(beta), beta
    for step in range(steps):
        live = (beta > EPS * first) & (phi_bar > tolerance * first)
        if not live.any():
            break
        v = np.where(live, now / np.where(live, beta, 1), 0)
        y = product(v)
        if step:
            y = y - before * np.where(live, beta / np.where(old > 0, old, 1), 0)
        alpha = (v * y).sum(axis=0)
        y = y - now * np.where(live, alpha / np.where(live, beta, 1), 0)
        before, now, old, beta = now, y, beta, _norms(y)
        last_epsilon = epsilon
        delta, gamma_bar = cosine * dbar + sine * alpha, sine * dbar - cosine * alpha
        epsilon, dbar = sine * beta, -cosine * beta
        gamma = np.maximum(np.hypot(gamma_bar, beta), np.finfo(float).tiny)
        cosine, sine = gamma_bar / gamma, beta / gamma
        phi, phi_bar = cosine * phi_bar, np.where(live, sine * phi_bar, phi_bar)
        w, w2 = (v - last_epsilon * w2 - delta * w) / gamma, w
        x = x + np.where(live, phi * w, 0)
    return x


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of `new` outside the basis, orthonormal; those that vanish are left out."""
    kept = basis
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - kept @ (kept.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-8 * size:
            kept = np.column_stack([kept, column / left])
    return kept[:, basis.shape[1]:]


def leading_eigenpairs(
    product: Product, dimension: int, wanted: int, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, their unit vectors (columns), and the residuals' norms.

    product(U) is A U for a symmetric A with no negative eigenvalue. Vectors are locked when
    their residual is as small as double precision lets it be, and tried again together at the end.
    """
    wanted = min(wanted, dimension)
    most = min(dimension, 4 * wanted + 8)
    tolerance = EPS * max(64, dimension)
    start = np.random.default_rng(seed).standard_normal((dimension, min(dimension, wanted + 4)))
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    basis = _orthonormal(start, locked)
    image, best = product(basis), None
    for _ in range(OUTER_STEPS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        open_ = min(wanted - len(values), basis.shape[1])
        u, au = basis[:, :open_], image[:, :open_]
        residual = au - u * theta[:open_]
        residual -= locked @ (locked.T @ residual)
        scale = max([*values[:1], theta[0], np.finfo(float).tiny])
        done = _norms(residual) <= tolerance * scale
        full = basis.shape[1] + locked.shape[1] == dimension
        count = open_ if full or done.all() else int(np.argmin(done))
        locked = np.column_stack([locked, u[:, :count]])
        values = np.append(values, theta[:count])
        basis, image = basis[:, count:], image[:, count:]
        if len(values) == wanted:
            # One more projection, on the locked vectors alone, with true products.
            locked, _ = np.linalg.qr(locked)
            image = product(locked)
            small = locked.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, locked, image = values[::-1], (locked @ turn)[:, ::-1], (image @ turn)[:, ::-1]
            norms = _norms(image - locked * values)
            if best is None or norms.max() < best[2].max() / 2:
                best = values, locked, norms
                if norms.max() > tolerance * max(values[0], np.finfo(float).tiny) and not full:
                    basis, locked, values = locked, locked[:, :0], np.zeros(0)
                    continue
            return best
        u, theta, residual = u[:, count:], theta[count:open_], residual[:, count:]
        near = np.column_stack([locked, u])

        def outside(x: np.ndarray) -> np.ndarray:
            return x - near @ (near.T @ x)

        def corrected(x: np.ndarray) -> np.ndarray:
            x = outside(x)
            return outside(product(x) - x * theta)

        more = minres(corrected, -outside(residual), INNER_STEPS, INNER_TOLERANCE)
        if basis.shape[1] + more.shape[1] + locked.shape[1] > most:
            stay = min(basis.shape[1], max(2 * wanted - locked.shape[1], u.shape[1]))
            basis, image = basis[:, :stay], image[:, :stay]
        extra = _orthonormal(outside(more), np.column_stack([locked, basis]))
        if not extra.shape[1]:  # nothing new in the corrections: look elsewhere
            extra = _orthonormal(start[::-1], np.column_stack([locked, basis]))
        basis, image = np.column_stack([basis, extra]), np.column_stack([image, product(extra)])
    if best is None:
        raise ArithmeticError("the eigenvectors have not converged")
    return best


@dataclass
class Fit:
    """What the fit list gives: its size, sums, and the components with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float | None = None

    def split_mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest, so that centring is exact but for the rest."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array(
            [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])


def _valid(vector: Column) -> Column:
    inside = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & inside


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _stored(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors, many to a row, on reliable storage, so that each product reads them quickly."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), dimension).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])

    return pin(vectors.mapInArrow(pack, row_type(x="binary")))


def _summed(
    stored: DataFrame, dimension: int, size: int, add: Callable[[np.ndarray], np.ndarray],
    kind: str = "double",
) -> np.ndarray:
    """The sum over all stored rows of add(x), an array of `size` numbers for each block x."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = add(np.frombuffer(data, "<i8").reshape(-1, dimension)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(total)], ["slot", "value"])

    parts = stored.mapInArrow(work, row_type(slot="long", value=kind))
    rows = parts.groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["slot"]] = r["value"]
    return out


def fit(stored: DataFrame, dimension: int, components: int) -> Fit | None:
    """Sums and components of the stored vectors; None without any."""
    sums = _summed(
        stored, dimension, dimension + 1, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n = int(sums[-1])
    if not n:
        return None
    none = np.zeros(0)
    model = Fit(n, [int(s) for s in sums[:-1]], np.zeros((dimension, 0)), none, none, 0.0)
    whole, rest = model.split_mean()

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest

    def product(u: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            d = centred(x)
            return d.T @ (d @ u)

        return _summed(stored, dimension, u.size, add).reshape(u.shape) / n

    model.trace = float(_summed(
        stored, dimension, 1, lambda x: (centred(x) ** 2).sum(keepdims=True))[0]) / n
    model.values, model.vectors, model.residuals = leading_eigenpairs(product, dimension, components)
    used = model.values > dimension * EPS * max(model.values[0], np.finfo(float).tiny)
    k = int(used.sum())
    if k:
        scaled = model.vectors[:, used] / np.sqrt(model.values[used])

        def moments(x: np.ndarray) -> np.ndarray:
            y = centred(x) @ scaled
            return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

        found = _summed(stored, dimension, k * k + k, moments) / n
        mean = found[k * k:]
        covariance = found[:k * k].reshape(k, k) - np.outer(mean, mean)
        model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(
    rows: DataFrame,
    into: str = "white",
    vector_column: str = "embedding",
    keep: Sequence[str] | None = None,
    components: int = COMPONENTS,
) -> DataFrame:
    """Keep the rows with a vector, and add a struct: n, deviation, whitened, explained, identity_error.

    Each entry c becomes the whole number floor(1024 c) + 100000. Components are unit eigenvectors of
    the covariance of these vectors (divisor n), by falling eigenvalue, to double precision, with
    either sign. whitened holds the centred vector's projections over the root of the eigenvalue, explained
    the eigenvalue over the trace, deviation the exact sum over dimensions of (n x - sum)^2, and
    identity_error the largest departure of whitened's covariance from the identity.

    Dropped are rows whose vector is null or empty, holds a null or an entry that is not finite or
    beyond 2^40, or has not the most frequent length (of equally frequent ones the greatest). Fewer
    dimensions than components give so many; a component without variance is null in whitened, and
    explained is null where there is no variance at all. Repeated rows count each; equal
    eigenvalues give some basis of their space, the same for all rows; an empty table stays
    empty. An input column named as `into` is replaced, others pass unchanged.
    """
    vector = F.col(f"`{vector_column}`")
    valid = rows.filter(_valid(vector))
    sizes = valid.groupBy(F.size(vector).alias("size")).count()
    size = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    dimension = size["size"] if size else 1
    # An array of another length has no value at the last place, and the filters stay apart.
    valid = valid.filter(F.size(vector) == dimension)
    model = fit(_stored(valid.select(_whole(vector).alias("x")), dimension), dimension, components)
    kept = others(rows.columns if keep is None else keep, into)
    named = valid.select(_whole(vector).alias("__x"), *[F.col(f"`{c}`").alias(f"__c{i}")
                                                      for i, c in enumerate(kept)])

    def make():
        from decimal import Decimal

        if model is None:
            return lambda batch: []
        whole, rest = model.split_mean()
        sums = np.array(model.sums, object)
        used = model.values > dimension * EPS * max(model.values[0], np.finfo(float).tiny)
        scaled = model.vectors[:, used] / np.sqrt(model.values[used])
        explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

        def step(batch: pa.RecordBatch) -> list[tuple]:
            x = _matrix(batch.column(0), dimension)
            y = ((x - whole) - rest) @ scaled
            # n x - sum = n (x - whole) - (sum - n whole); whole numbers beyond 64 bits when large.
            far = int(np.abs(x - whole).max()) + 1
            if dimension * (far * model.n) ** 2 < 1 << 62:
                left = np.array(model.sums, np.int64) - model.n * whole
                squares = ((model.n * (x - whole) - left) ** 2).sum(axis=1).tolist()
            else:
                squares = ((model.n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
            none = [None] * int((~used).sum())
            return [(model.n, Decimal(s), [*w, *none], explained, model.identity_error)
                    for s, w in zip(squares, y.tolist())]

        return step

    done = add_struct(named, "__r", RESULT, make, ["__x"], [f"__c{i}" for i in range(len(kept))])
    return done.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)],
                       F.col("__r").alias(into))
