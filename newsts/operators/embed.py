"""Word vectors as tables split by word.

Skip-gram with negative samples.  Words are dealt into blocks by a hash; a
block's word vectors and context vectors are rows of two tables.  A turn of
training pairs block i of the words with block (i + turn) mod n of the
contexts: no two tasks of a turn touch the same vector, as in block-cyclic
matrix factorisation, so a turn is one Spark job whose tasks each hold two
blocks and stream the counted pairs between them.  Negative samples come from
the task's contexts by an alias table over their counts to the power 0.75.
After n turns every pair has been seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# documented parameters: words in a block, about, while there are no more than
# MANY_BLOCKS; then words in a block.  Every turn stores all vectors and there are as many turns as blocks
BLOCK_WORDS, MANY_BLOCKS, LARGE_BLOCK = 100_000, 16, 500_000


def n_blocks(words: int) -> int:
    return max(4, min(-(-words // BLOCK_WORDS), MANY_BLOCKS), -(-words // LARGE_BLOCK))


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance, other): sample i uniformly, keep it by ``chance[i]``, else take ``other[i]``."""
    n = len(weights)
    chance, other = weights * (n / weights.sum()), np.arange(n)
    small, large = [i for i in range(n) if chance[i] < 1.0], [i for i in range(n) if chance[i] >= 1.0]
    while small and large:
        s, g = small.pop(), large[-1]
        other[s] = g
        chance[g] -= 1.0 - chance[s]
        if chance[g] < 1.0:
            small.append(large.pop())
    chance[small + large] = 1.0
    return chance, other


class Block:
    """The two blocks of a task and one step of training."""

    def __init__(self, words: np.ndarray, w: np.ndarray, wg: np.ndarray, contexts: np.ndarray, c: np.ndarray, cg: np.ndarray,
                 freq: np.ndarray, negatives: int, rate: float, seed: int):
        self.words, self.w, self.wg = words, w, wg
        self.contexts, self.c, self.cg = contexts, c, cg
        self.chance, self.other = alias_table(freq ** 0.75)
        self.negatives, self.rate, self.rng = negatives, rate, np.random.default_rng(seed)

    def learn(self, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> None:
        """Pairs (places in the blocks) with their counts; gradients of a
        vector are averaged over the step and scaled by AdaGrad."""
        drawn = self.rng.integers(0, len(self.chance), size=(len(word), self.negatives))
        drawn = np.where(self.rng.random(drawn.shape) < self.chance[drawn], drawn, self.other[drawn])
        at = np.concatenate([context[:, None], drawn], axis=1)
        target = np.zeros(at.shape)
        target[:, 0] = 1.0
        x, y = self.w[word], self.c[at]
        error = (1.0 / (1.0 + np.exp(-np.einsum("ij,ikj->ik", x, y)))) - target
        error[:, 1:][drawn == context[:, None]] = 0.0
        error *= n[:, None]
        self._step(self.w, self.wg, word, np.einsum("ik,ikj->ij", error, y), n)
        self._step(self.c, self.cg, at.ravel(), (error[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1]), np.repeat(n, at.shape[1]))

    def _step(self, v: np.ndarray, g: np.ndarray, at: np.ndarray, gradient: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        some, total, mass = at[starts], np.add.reduceat(gradient[order], starts, axis=0), np.add.reduceat(n[order], starts)
        total /= mass[:, None]
        g[some] += (total * total).mean(axis=1)
        v[some] -= self.rate * total / np.sqrt(g[some] + 1e-8)[:, None]


def word_pairs(lists: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """word, context, n: how often two tokens of one list stand together."""
    k = lists.select(F.col(tokens_col).alias("t")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("t") - 1)))
    k = k.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("t") - 1))).filter("i <> j")
    return k.select(F.get("t", F.col("i")).alias("word"), F.get("t", F.col("j")).alias("context")).dropna() \
            .groupBy("word", "context").agg(F.count(F.lit(1)).cast("double").alias("n"))


def word2vec(lists: DataFrame, size: int = 16, rounds: int = 2, steps: int = 5, negatives: int = 5, rate: float = 0.3,
             seed: int = 42, blocks: int | None = None, tokens_col: str = "tokens") -> DataFrame:
    """Word, v (array of ``size``) for every word that stands in a list
    with another one.  ``rounds`` over all pairs, each pair ``steps`` times in
    a turn; no vector passes through the driver.  No pairs, no words."""
    pairs = cut_lineage(word_pairs(lists, tokens_col))
    freq = cut_lineage(pairs.groupBy("word").agg(F.sum("n").alias("n")))
    m = blocks or n_blocks(freq.count())

    def block(c: str):
        return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")

    def start(kind: int):
        return F.array(*[(F.pmod(F.xxhash64("word", F.lit(seed), F.lit(kind), F.lit(j)), F.lit(1 << 20)) / float(1 << 20) - 0.5) / size
                         for j in range(size)])

    dealt = cut_lineage(pairs.select("word", "context", "n", block("word").alias("i"), block("context").alias("j")))
    vectors = cut_lineage(freq.select(block("word").alias("block"), F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"), "word", "n")
                          .withColumn("v", F.when(F.col("kind") == 0, start(0)).otherwise(start(1))).withColumn("g", F.lit(0.0)))
    schema = "block int, kind int, word string, n double, v array<double>, g double"

    def turn(shift: int, number: int) -> DataFrame:
        # the cell of a task: its words' block, and the contexts' turned to it
        cell = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(m)))
        rows = vectors.withColumn("cell", cell).unionByName(
            dealt.filter(F.pmod(F.col("j") - F.col("i"), F.lit(m)) == shift)
            .select(F.col("i").alias("cell"), F.lit(2).alias("kind"), "word", "context", "n"), allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held, job = None, {0: [], 1: []}, None

            def out() -> Iterator[pa.RecordBatch]:
                if current is None:
                    return
                made = job or begin()
                for kind, v, g in ((0, made.w, made.wg), (1, made.c, made.cg)):
                    if held[kind]:
                        table = pa.Table.from_batches(held[kind]).combine_chunks()
                        yield from pa.table([table["block"], table["kind"], table["word"], table["n"], pa.array(list(v), pa.list_(pa.float64())), pa.array(g)],
                                            names=["block", "kind", "word", "n", "v", "g"]).to_batches()

            def begin() -> Block:
                parts = []
                for kind in (0, 1):
                    table = pa.Table.from_batches(held[kind]) if held[kind] else None
                    v = np.array(table["v"].to_pylist(), float).reshape(-1, size) if table else np.zeros((0, size))
                    parts.append((np.array(table["word"].to_pylist() if table else [], object), v, table["g"].to_numpy().copy() if table else np.zeros(0)))
                freq = pa.Table.from_batches(held[1])["n"].to_numpy() if held[1] else np.ones(1)
                return Block(*parts[0], *parts[1], freq, negatives, rate, hash((seed, number, int(current))) & 0x7FFFFFFF)

            for batch in batches:
                cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
                cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else ():
                    part = batch.slice(a, b - a)
                    if cells[a] != current:
                        yield from out()
                        current, held, job, place = cells[a], {0: [], 1: []}, None, None
                    if kinds[a] < 2:
                        held[int(kinds[a])].append(part)
                        continue
                    if job is None:
                        job = begin()
                        place = [{w: k for k, w in enumerate(x)} for x in (job.words, job.contexts)]
                    word = np.array([place[0][w] for w in part.column("word").to_pylist()])
                    context = np.array([place[1][w] for w in part.column("context").to_pylist()])
                    n = part.column("n").to_numpy()
                    for _ in range(steps):
                        order = job.rng.permutation(len(n))
                        for lo in range(0, len(n), 1024):
                            some = order[lo:lo + 1024]
                            job.learn(word[some], context[some], n[some])
            yield from out()

        return (rows.repartition(m, "cell").sortWithinPartitions("cell", "kind", "word", "context")
                .select("cell", "kind", "block", "word", "context", "n", "v", "g").mapInArrow(run, schema))

    for r in range(rounds):
        for shift in range(m):
            vectors = cut_lineage(turn(shift, r * m + shift))
    return vectors.filter("kind = 0").select("word", "v")
