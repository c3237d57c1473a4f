"""G: the shared sufficient-statistics pass for every least-squares operator.

One scan of the rows produces, per group, n, Σx, Σy, ΣxxT, Σxy, Σy².
Each task first folds its rows into one partial row per group with numpy
inside ``mapInPandas`` (map-side combine: what crosses the shuffle is
p² numbers per group per task, not rows), then a small grouped step sums
the partials.  A hot group therefore never lands in one task as rows.
Grams are additive: a window / fold / refit Gram is a sum or difference
of block Grams (M12, V8).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lagged import complete, q

GRAM_FIELDS = [("n", T.LongType()), ("sx", T.ArrayType(T.DoubleType())), ("sy", T.DoubleType()),
               ("xx", T.ArrayType(T.DoubleType())), ("xy", T.ArrayType(T.DoubleType())), ("yy", T.DoubleType())]


def _schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    fields = [df.schema[b] for b in by]
    return T.StructType([*fields, *[T.StructField(n, t) for n, t in GRAM_FIELDS]])


def gram(df: DataFrame, x_cols: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per-group sufficient statistics of (X, y); rows with a null in X or y dropped."""
    by = list(by)
    p = len(x_cols)
    src = df.select(*by, *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(x_cols)],
                    q(y).cast("double").alias("y"))
    src = complete(src, [c for c in src.columns if c not in by])
    schema = _schema(df, by)
    xs = [f"x{i}" for i in range(p)]
    if p <= SQL_MAX_P:
        return _gram_sql(src, xs, by)

    def partial(it):
        acc: dict = {}
        for pdf in it:
            if pdf.empty:
                continue
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                X = g[xs].to_numpy(dtype=np.float64)
                Y = g["y"].to_numpy(dtype=np.float64)
                s = acc.get(key)
                part = [len(Y), X.sum(0), Y.sum(), X.T @ X, X.T @ Y, float(Y @ Y)]
                if s is None:
                    acc[key] = part
                else:
                    for i in range(6):
                        s[i] = s[i] + part[i]
        rows = []
        for key, s in acc.items():
            rows.append([*key, int(s[0]), s[1].tolist(), float(s[2]), s[3].reshape(-1).tolist(),
                         s[4].tolist(), float(s[5])])
        if rows:
            yield pd.DataFrame(rows, columns=[*by, "n", "sx", "sy", "xx", "xy", "yy"])

    parts = src.mapInPandas(partial, schema=schema)
    return combine(parts, by)


# narrow designs: the p(p+1)/2 product sums as built-in aggregates (JVM,
# whole-stage codegen, partial aggregation); wider ones fold in numpy
SQL_MAX_P = 16


def _gram_sql(src: DataFrame, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    p = len(xs)
    prods = {}
    for i in range(p):
        for j in range(i, p):
            prods[(i, j)] = F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"_p{i}_{j}")
    aggs = [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(xs)], F.sum("y").alias("sy"),
            *prods.values(), *[F.sum(F.col(x) * F.col("y")).alias(f"_y{i}") for i, x in enumerate(xs)],
            F.sum(F.col("y") * F.col("y")).alias("yy")]
    g = src.groupBy(*by).agg(*aggs)
    xx = [F.col(f"_p{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]
    return g.select(*by, F.col("n").cast("long").alias("n"), F.array(*[F.col(f"_s{i}") for i in range(p)]).alias("sx"),
                    "sy", F.array(*xx).alias("xx"), F.array(*[F.col(f"_y{i}") for i in range(p)]).alias("xy"), "yy")


def combine(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum partial Gram rows per group.  ``Summarizer.sum`` is a mergeable
    aggregate: a task holds one running sum per group, not a list of parts."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def total(c):
        return vector_to_array(Summarizer.sum(array_to_vector(F.col(c)))).alias(c)
    g = parts.groupBy(*by).agg(F.sum("n").alias("n"), total("sx"), F.sum("sy").alias("sy"), total("xx"), total("xy"),
                               F.sum("yy").alias("yy"))
    return g.filter(F.col("n").isNotNull())


def to_numpy(row) -> dict:
    """Gram row → numpy pieces (driver-side k×k maths on the small result)."""
    p = len(row["sx"])
    return {"n": row["n"], "sx": np.array(row["sx"]), "sy": row["sy"],
            "xx": np.array(row["xx"]).reshape(p, p), "xy": np.array(row["xy"]), "yy": row["yy"]}


def centered(g: dict) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
    n = g["n"]
    mx = g["sx"] / n
    my = g["sy"] / n
    sxx = g["xx"] - n * np.outer(mx, mx)
    sxy = g["xy"] - n * mx * my
    syy = g["yy"] - n * my * my
    return sxx, sxy, syy, mx, my
