"""AdaBoost.R2 of stumps (M5).

A member is a stump: a split of one feature with a mean on each side, fitted
to the rows with their present weights.  A row's weight follows from the
members so far, so tasks compute it where the row is and no weights are
stored.  A round is one pass that sums (weight, weight·y, weight·y²) by
feature and split point, from which the best split follows, and one that
measures the member's errors.  The candidate split points of a feature are at
most ``bins`` quantiles of it, or its values if they are fewer.  Weights take
the place of the usual resampling (declared).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lagged import q
from .reduce import block_rows, stored_blocks


@dataclass
class Stump:
    feature: int
    split: float
    left: float  # where x <= split
    right: float
    worst: float = 0.0  # largest error on the train rows
    beta: float = 1.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, self.feature] <= self.split, self.left, self.right)


def weights(members: Sequence[Stump], x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Row weights after the members, not divided by their sum."""
    log, columns = np.zeros(len(y)), np.asfortranarray(x)
    for m in members:
        power = rate * np.log(max(m.beta, 1e-300))
        log += power
        if m.worst:
            log -= np.abs(m.predict(columns) - y) * (power / m.worst)
    return np.exp(log)


def best_split(sums: np.ndarray, points: list[np.ndarray]) -> Stump:
    """The split that lessens the weighted square error most, from the sums
    (feature, bin, 3); ties go to the first feature and point."""
    total = sums[0].sum(axis=0)
    best, gain = Stump(0, float("inf"), total[1] / total[0], total[1] / total[0]), 0.0
    for f, at in enumerate(points):
        upto = np.cumsum(sums[f], axis=0)
        for i, split in enumerate(at[:-1]):
            w, wy, _ = upto[i]
            rest = total[0] - w
            if w <= 0 or rest <= 0:
                continue
            g = wy * wy / w + (total[1] - wy) ** 2 / rest - total[1] ** 2 / total[0]
            if g > gain * (1 + 1e-12) + 1e-12:
                best, gain = Stump(f, float(split), wy / w, (total[1] - wy) / rest), g
    return best


def weighted_median(values: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Of each row of ``values``: the least value that half of the mass does not exceed."""
    order = np.argsort(values, axis=1, kind="stable")
    upto = np.cumsum(mass[order], axis=1)
    at = (upto >= 0.5 * upto[:, -1:]).argmax(axis=1)
    return np.take_along_axis(values, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]


def adaboost_fit(df: DataFrame, x_cols: Sequence[str], y: str, rounds: int = 30, rate: float = 0.01, bins: int = 64) -> list[Stump]:
    """The members, at most ``rounds``; fewer where one has a mean loss of a
    half or none at all.  Rows with a null are left out; no rows, no members."""
    rows = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(x_cols)], q(y).cast("double").alias("y")).dropna()
    p = len(x_cols)
    if rows.isEmpty():
        return []
    ends = rows.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(f"x{i}", [k / bins for k in range(1, bins + 1)], 100_000))) for i in range(p)]).first()
    points = [np.array(e, float) for e in ends]
    width = max(map(len, points))
    blocks = stored_blocks(rows)

    def split_block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        block = block_rows(batch, p + 1)
        return block[:, :p], block[:, p]

    def histogram(members: list[Stump]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((p, width, 3))
            for batch in batches:
                x, target = split_block(batch)
                w = weights(members, x, target, rate)
                wy = w * target
                for f in range(p):
                    at = np.minimum(np.searchsorted(points[f], x[:, f]), len(points[f]) - 1)
                    for k, each in enumerate((w, wy, wy * target)):
                        total[f, :, k] += np.bincount(at, each, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

        out = np.zeros(p * width * 3)
        for cell, s in blocks.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s")).collect():  # features x bins x 3
            out[cell] = s
        return out.reshape(p, width, 3)

    def measured(members: list[Stump], new: Stump) -> tuple[float, float, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worst, mass, loss = 0.0, 0.0, 0.0
            for batch in batches:
                x, target = split_block(batch)
                w, e = weights(members, x, target, rate), np.abs(new.predict(x) - target)
                worst, mass, loss = max(worst, float(e.max(initial=0.0))), mass + float(w.sum()), loss + float(w @ e)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (worst, mass, loss)], names=["worst", "mass", "loss"])

        r = blocks.mapInArrow(run, "worst double, mass double, loss double").agg(F.max("worst"), F.sum("mass"), F.sum("loss")).first()
        return r[0], r[1], r[2]

    members: list[Stump] = []
    for _ in range(rounds):
        new = best_split(histogram(members), points)
        new.worst, mass, loss = measured(members, new)
        if new.worst == 0.0:
            new.beta = 1e-300
            return [*members, new]
        share = loss / new.worst / mass
        if share >= 0.5:
            return members or [new]
        new.beta = share / (1.0 - share)
        members.append(new)
    return members


def adaboost_apply(df: DataFrame, members: Sequence[Stump], x_cols: Sequence[str], rate: float = 0.01, out: str = "yhat") -> DataFrame:
    """Rows with the weighted median of the members; null where a feature is
    null or there is no member."""
    p, members = len(x_cols), list(members)
    mass = np.array([rate * np.log(1.0 / max(m.beta, 1e-300)) if m.beta < 1.0 else 1.0 for m in members])
    ready = F.array(*[q(c).cast("double") for c in x_cols])
    source = df.withColumn("_x", F.when(F.forall(ready, lambda x: x.isNotNull()), ready))
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x")
            mask = x.is_valid().to_numpy(zero_copy_only=False) & bool(members)
            yhat = np.zeros(batch.num_rows)
            if mask.any():
                rows = x.drop_null().flatten().to_numpy().reshape(-1, p)
                yhat[mask] = weighted_median(np.stack([m.predict(rows) for m in members], axis=1), mass)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(yhat, mask=~mask)], names=[*kept, out])

    return source.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
