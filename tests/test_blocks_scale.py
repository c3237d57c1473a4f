"""Fits of many passes read stored blocks of rows."""
import numpy as np


def test_stored_blocks_keep_every_row(spark):
    from newsts.operators.reduce import BLOCK_ROWS, stored_blocks
    n = 3 * BLOCK_ROWS + 5
    blocks = stored_blocks(spark.range(n).repartition(2).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(2 * id AS DOUBLE) AS b"))
    kept = [np.frombuffer(r[0]).reshape(-1, 2) for r in blocks.collect()]
    assert len(kept) <= n // BLOCK_ROWS + 2
    got = np.concatenate(kept)
    assert sorted(got[:, 0]) == list(range(n)) and (got[:, 1] == 2 * got[:, 0]).all()


def test_nonnegative_solve_is_exact_where_sweeps_are_slow():
    from newsts.operators.reduce import nonnegative_solve
    b = np.array([[1.0, 0.9999], [0.9999, 1.0]])  # sweeps gain little here
    w = np.array([[2.0, 3.0], [0.0, 1.0], [0.0, 0.0]])
    got = nonnegative_solve(w @ b, b)
    assert np.abs(got - w).max() < 1e-8
    negative = nonnegative_solve(np.array([[-1.0, 1.0], [-1.0, -2.0]]), np.eye(2))
    assert negative.tolist() == [[0.0, 1.0], [0.0, 0.0]]
