"""Feature selection from Grams (X7-X10) and reducers.

Selection loops (recursive elimination, forward search) run on the p×p
Gram of a group inside ``mapInPandas``: the rows are scanned once, every
candidate subset is a sub-matrix solve, and nothing row-level is
revisited or sent to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gram as G
from .models import solve


def _sub(g: dict, idx: list[int]) -> dict:
    return {"n": g["n"], "sx": g["sx"][idx], "sy": g["sy"], "xx": g["xx"][np.ix_(idx, idx)],
            "xy": g["xy"][idx], "yy": g["yy"]}


def scale_gram(g: dict, lo: np.ndarray, hi: np.ndarray) -> dict:
    """Gram of min-max scaled columns x' = (x−lo)/(hi−lo) (range 1 when
    constant), derived from the raw Gram without another pass."""
    rng = np.where(hi - lo == 0, 1.0, hi - lo)
    n = g["n"]
    sx = (g["sx"] - n * lo) / rng
    xx = (g["xx"] - np.outer(g["sx"], lo) - np.outer(lo, g["sx"]) + n * np.outer(lo, lo)) / np.outer(rng, rng)
    xy = (g["xy"] - lo * g["sy"]) / rng
    return {"n": n, "sx": sx, "sy": g["sy"], "xx": xx, "xy": xy, "yy": g["yy"]}


def rfe_order(g: dict, n_keep: int = 1, kind: str = "lasso", alpha: float = 1.0, **search) -> list[int]:
    """Elimination order: repeatedly fit on the remaining columns and drop
    the one with the smallest |coef| (ties: lowest column index first).
    Returns ranks (1 = kept).  A column with a zero coefficient leaves a fit
    with an L1 penalty as it is, so the next ones go without another fit;
    other fits begin from the last one.  ``search``: max_iter and tol."""
    p = len(g["sx"])
    remaining = list(range(p))
    ranks = [1] * p
    r, b, fitted = p - n_keep + 1, None, False
    while len(remaining) > n_keep:
        if not fitted:
            _, b = solve(_sub(g, remaining), kind, alpha, start=b if kind == "lasso" else None, **search)
        j = int(np.argmin(np.abs(b)))  # first minimum = lowest index on ties
        fitted = kind == "lasso" and b[j] == 0.0
        ranks[remaining[j]] = r
        r -= 1
        remaining.pop(j)
        b = np.delete(b, j)
    return ranks


def rfe(grams: DataFrame, names: Sequence[str], n: int, kind: str = "lasso", alpha: float = 1.0,
        by: Sequence[str] = ()) -> DataFrame:
    """(by…, feature, rank, selected) per group."""
    by = list(by)
    schema = T.StructType([*[grams.schema[b] for b in by], T.StructField("feature", T.StringType()),
                           T.StructField("rank", T.IntegerType()), T.StructField("selected", T.BooleanType())])

    def run(it):
        for pdf in it:
            out = []
            for rec in pdf.to_dict("records"):
                ranks = rfe_order(G.to_numpy(rec), n, kind, alpha)
                out += [[*[rec[b] for b in by], names[i], int(rk), rk == 1] for i, rk in enumerate(ranks)]
            if out:
                yield pd.DataFrame(out, columns=[*by, "feature", "rank", "selected"])
    return grams.mapInPandas(run, schema)


def _cv_r2(blocks: dict, folds: list[int], idx: list[int]) -> float:
    """Mean test R² over time folds from block Grams (fold f trains on the
    blocks before it and tests on block f)."""
    scores = []
    for f in folds:
        train = None
        for b, g in blocks.items():
            if b < f:
                train = g if train is None else {k: train[k] + g[k] for k in g}
        test = blocks[f]
        tr, te = _sub(train, idx), _sub(test, idx)
        c, b = solve(tr, "ols")
        n = te["n"]
        sse = (te["yy"] - 2 * c * te["sy"] - 2 * b @ te["xy"] + n * c * c + 2 * c * b @ te["sx"] + b @ te["xx"] @ b)
        sst = te["yy"] - te["sy"] ** 2 / n
        scores.append(1.0 - sse / sst if sst > 0 else 0.0)
    return float(np.mean(scores))


def forward_select(block_grams: DataFrame, names: Sequence[str], n: int, by: Sequence[str] = (),
                   block: str = "_blk") -> DataFrame:
    """Greedy forward selection scored by mean time-fold R²; every
    candidate is a sub-matrix solve on the block Grams (data scanned once).
    Output: (by…, step, feature, score)."""
    by = list(by)
    rows = block_grams.groupBy(*by).agg(F.collect_list(F.struct(F.col(block).alias("b"), "n", "sx", "sy", "xx", "xy", "yy")).alias("blocks"))
    schema = T.StructType([*[block_grams.schema[b] for b in by], T.StructField("step", T.IntegerType()),
                           T.StructField("feature", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(it):
        for pdf in it:
            out = []
            for rec in pdf.to_dict("records"):
                blocks = {int(b["b"]): G.to_numpy(b) for b in rec["blocks"]}
                folds = sorted(k for k in blocks if k >= 0)
                chosen: list[int] = []
                for step in range(1, n + 1):
                    best, best_j = None, None
                    for j in range(len(names)):
                        if j in chosen:
                            continue
                        s = _cv_r2(blocks, folds, chosen + [j])
                        if best is None or s > best:
                            best, best_j = s, j
                    chosen.append(best_j)
                    out.append([*[rec[b] for b in by], step, names[best_j], best])
            if out:
                yield pd.DataFrame(out, columns=[*by, "step", "feature", "score"])
    return rows.mapInPandas(run, schema)


def select_by_coef(grams: DataFrame, names: Sequence[str], kind: str = "lasso", alpha: float = 1.0,
                   max_features: int | None = None, threshold: float = 1e-5) -> DataFrame:
    """Keep features with |coef| ≥ threshold, the largest first, at
    most ``max_features``."""
    schema = "feature string, coef double, selected boolean"

    def run(it):
        for pdf in it:
            out = []
            for rec in pdf.to_dict("records"):
                _, b = solve(G.to_numpy(rec), kind, alpha)
                order = np.argsort(-np.abs(b), kind="stable")
                keep = set([i for i in order if abs(b[i]) >= threshold][: max_features or len(b)])
                out += [[names[i], float(b[i]), i in keep] for i in range(len(b))]
            if out:
                yield pd.DataFrame(out, columns=["feature", "coef", "selected"])
    return grams.mapInPandas(run, schema)


def pca_fit(df: DataFrame, cols: Sequence[str], k: int):
    """Spark ML PCA on the assembled columns (distributed covariance)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    va = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip")
    return PCA(k=k, inputCol="_v", outputCol="pca").fit(va.transform(df)), va


def rfe_cv(block_grams: DataFrame, names: Sequence[str], kind: str = "lasso", alpha: float = 1.0,
           min_n: int = 1, block: str = "_blk") -> DataFrame:
    """For every time fold, RFE on the fold's train Gram and the test
    R² of each subset size on the fold's test block; the size with the best
    mean score is chosen and RFE on all blocks picks the features.
    Output: (n_features, mean_r2, chosen, features)."""
    rows = block_grams.groupBy().agg(F.collect_list(F.struct(F.col(block).alias("b"), "n", "sx", "sy", "xx", "xy", "yy")).alias("blocks"))
    schema = "n_features int, mean_r2 double, chosen boolean, features array<string>"

    def run(it):
        for pdf in it:
            for rec in pdf.to_dict("records"):
                blocks = {int(b["b"]): G.to_numpy(b) for b in rec["blocks"]}
                folds = sorted(k for k in blocks if k >= 0)
                p = len(names)
                scores = {n: [] for n in range(min_n, p + 1)}
                for f in folds:
                    train = None
                    for b, g in blocks.items():
                        if b < f:
                            train = g if train is None else {k: train[k] + g[k] for k in g}
                    ranks = rfe_order(train, 1, kind, alpha)
                    order = sorted(range(p), key=lambda i: ranks[i])
                    for n in scores:
                        idx = sorted(order[:n])
                        scores[n].append(_cv_r2({**{b: g for b, g in blocks.items() if b < f}, f: blocks[f]}, [f], idx))
                means = {n: float(np.mean(v)) for n, v in scores.items()}
                best = max(means, key=lambda n: (means[n], -n))
                total = None
                for g in blocks.values():
                    total = g if total is None else {k: total[k] + g[k] for k in g}
                ranks = rfe_order(total, best, kind, alpha)
                chosen = [names[i] for i in range(p) if ranks[i] == 1]
                yield pd.DataFrame([[n, means[n], n == best, chosen if n == best else []] for n in sorted(means)],
                                   columns=["n_features", "mean_r2", "chosen", "features"])
    return rows.mapInPandas(run, schema)
