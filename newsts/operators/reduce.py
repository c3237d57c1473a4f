"""Reducers of dense columns that return transformed rows (X15): principal
components, factor analysis and non-negative factors.

The fits read sums only: PCA and factor analysis one covariance Gram, NMF the
products of each pass; what reaches the driver has the size of the columns.
Rows are transformed where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import gram as G
from .lagged import q


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, population covariance, rows) of the rows without nulls."""
    row = G.gram(df.withColumn("_one", F.lit(1.0)), cols, "_one").first()
    if row is None or not row["n"]:
        raise ValueError("no rows without nulls")
    g = G.to_numpy(row.asDict())
    mean = g["sx"] / g["n"]
    return mean, g["xx"] / g["n"] - np.outer(mean, mean), g["n"]


def _signed(loadings: np.ndarray) -> np.ndarray:
    """Columns turned so that the largest entry of each is positive."""
    return loadings * np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def linear_rows(df: DataFrame, cols: Sequence[str], mean: np.ndarray, weights: np.ndarray, prefix: str) -> DataFrame:
    """``df`` with (x - mean)·weights as columns prefix1, prefix2, ...; null
    where a column is null."""
    out = {}
    for j in range(weights.shape[1]):
        total = F.lit(0.0)
        for c, m, w in zip(cols, mean, weights[:, j], strict=True):
            total = total + (q(c).cast("double") - F.lit(float(m))) * F.lit(float(w))
        out[f"{prefix}{j + 1}"] = total
    return df.withColumns(out)


def pca_rows(df: DataFrame, cols: Sequence[str], k: int) -> tuple[DataFrame, np.ndarray]:
    """(rows with pc1..pck, variances of the components)."""
    mean, cov, _ = covariance(df, cols)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    return linear_rows(df, cols, mean, _signed(vectors[:, order]), "pc"), values[order]


def factor_fit(cov: np.ndarray, k: int, steps: int = 200) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(loadings, noise variances, log likelihood a row without constants) by
    expectation-maximisation on the covariance alone."""
    p = len(cov)
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-12)) / 2
    noise, history = np.maximum(np.diag(cov) / 2, 1e-12), []
    for _ in range(steps):
        full = load @ load.T + np.diag(noise)
        history.append(-0.5 * float(np.linalg.slogdet(full)[1] + np.trace(np.linalg.solve(full, cov))))
        beta = np.linalg.solve(full, load).T  # k x p: mean of the factors given x
        second = np.eye(k) - beta @ load + beta @ cov @ beta.T
        load = np.linalg.solve(second, beta @ cov).T
        noise = np.maximum(np.diag(cov - load @ (beta @ cov)), 1e-12)
    assert load.shape == (p, k)
    return load, noise, history


def factor_rows(df: DataFrame, cols: Sequence[str], k: int, steps: int = 200) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with factor1..factork, the means of the factors given the row;
    loadings; noise variances).  Columns are standardised first, so the
    loadings are correlations."""
    mean, cov, _ = covariance(df, cols)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    load, noise, _ = factor_fit(cov / np.outer(scale, scale), k, steps)
    load = _signed(load)
    weights = np.linalg.solve(load @ load.T + np.diag(noise), load) / scale[:, None]
    return linear_rows(df, cols, mean, weights, "factor"), load, noise


BLOCK_ROWS = 128  # documented parameter: rows of a stored block


def stored_blocks(rows: DataFrame) -> DataFrame:
    """The rows of double columns without nulls, stored as blocks of a few rows
    each, so that a fit of many passes reads them as whole arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + BLOCK_ROWS].tobytes() for i in range(0, len(x), BLOCK_ROWS)], pa.binary())], names=["block"])

    return cut_lineage(rows.mapInArrow(run, "block binary"))


def block_rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The rows of a batch of :func:`stored_blocks`."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, width)


def nonnegative_weights(x: np.ndarray, h: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Rows w >= 0 that make w·h nearest to the rows of x."""
    return nonnegative_solve(x @ h.T, h @ h.T, sweeps)


EXACT = 4  # documented parameter: weights of a row up to which all supports are tried


def nonnegative_solve(a: np.ndarray, b: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Rows w >= 0 that minimise w·b·w' - 2·a·w': of the supports of a few
    weights the one that meets the optimum's conditions; by coordinate sweeps
    for the rows without one."""
    k = len(b)
    w, left = np.zeros(a.shape), np.arange(len(a))
    if k <= EXACT and np.isfinite(b).all():
        scale = np.maximum(np.abs(a).max(axis=1, initial=0.0), 1e-300) * 1e-12
        for support in sorted(range(1 << k), key=lambda s: -s.bit_count()):
            on = [j for j in range(k) if support >> j & 1]
            part = b[np.ix_(on, on)]
            if not len(left) or (on and np.linalg.cond(part) > 1e12):
                continue
            mine = a[left]
            found = np.zeros(mine.shape)
            if on:
                found[:, on] = mine[:, on] @ np.linalg.inv(part)
            good = (found >= 0.0).all(axis=1)
            off = [j for j in range(k) if j not in on]
            if off:
                good &= (mine[:, off] - found @ b[:, off] <= scale[left][:, None]).all(axis=1)
            w[left[good]] = found[good]
            left = left[~good]
    if len(left):
        w[left] = _nonnegative_sweeps(a[left], b, sweeps)
    return w


def _nonnegative_sweeps(a: np.ndarray, b: np.ndarray, sweeps: int) -> np.ndarray:
    w = np.maximum(a / np.maximum(b.sum(axis=0), 1e-300), 0.0)
    for _ in range(sweeps):
        change = 0.0
        for j in range(len(b)):
            new = np.maximum(0.0, w[:, j] + (a[:, j] - w @ b[:, j]) / max(b[j, j], 1e-300))
            change = max(change, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if change <= 1e-12 * max(1.0, float(np.abs(w).max(initial=0.0))):
            break
    return w


def nmf_rows(df: DataFrame, cols: Sequence[str], k: int, iters: int = 50, tol: float = 1e-6, seed: int = 0) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(rows with w1..wk, factors k x columns, loss of each pass): X ≈ W·H of
    non-negative columns.  Rows with a null or a negative value do not take
    part and have null weights.

    A pass solves the weights of every row anew from the factors, so no table
    of weights is kept, and returns W'X and W'W, sums of k x (columns + k)
    numbers; the factors are updated from these by coordinate sweeps.
    """
    p = len(cols)
    rows = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    usable = [F.col(c).isNotNull() & (F.col(c) >= 0) for c in rows.columns]
    for u in usable:
        rows = rows.filter(u)
    high = rows.agg(*[F.max(c) for c in rows.columns]).first()
    h = np.random.default_rng(seed).random((k, p)) * np.array([v or 1.0 for v in high]) + 1e-9
    names = [f"s{i}" for i in range(k * (p + k) + 1)]
    blocks = stored_blocks(rows)

    def sums(h: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * (p + k) + 1)
            for batch in batches:
                x = block_rows(batch, p)
                w = nonnegative_weights(x, h)
                total += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [float((x * x).sum())]])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names=names)

        part = blocks.mapInArrow(run, ", ".join(f"{n} double" for n in names))
        return np.array([v or 0.0 for v in part.agg(*[F.sum(n) for n in names]).first()])

    losses: list[float] = []
    for _ in range(iters):
        s = sums(h)
        wx, ww, xx = s[: k * p].reshape(k, p), s[k * p: k * (p + k)].reshape(k, k), s[-1]
        losses.append(float(xx - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tol * max(losses[-2], 1e-300):
            break
        for _ in range(20):
            for j in range(k):
                h[j] = np.maximum(1e-12, h[j] + (wx[j] - ww[j] @ h) / max(ww[j, j], 1e-300))
    out = [f"w{j + 1}" for j in range(k)]
    ready = F.array(*[q(c).cast("double") for c in cols])
    good = F.forall(ready, lambda x: x.isNotNull() & (x >= 0))
    source = df.withColumn("_x", F.when(good, ready))
    kept = df.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x")
            mask = x.is_valid().to_numpy(zero_copy_only=False)
            w = np.full((batch.num_rows, k), np.nan)
            if mask.any():
                w[mask] = nonnegative_weights(x.drop_null().flatten().to_numpy().reshape(-1, p), h)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *[pa.array(w[:, j], mask=~mask) for j in range(k)]],
                                             names=[*kept, *out])

    from pyspark.sql import types as T
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in out]])
    return source.mapInArrow(apply, schema), h, losses
