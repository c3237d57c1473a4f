"""M4 with a log link: few passes of sums."""
import numpy as np
import pytest


@pytest.mark.parametrize("power", [1.0, 1.5, 2.0])
def test_log_link_fit_meets_the_score_equations(spark, power):
    from newsts.operators.models import log_link_fit
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = np.exp(0.5 + x @ [0.3, -0.2]) * rng.uniform(0.5, 1.5, 300)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 2.0), (1.0, 1.0, None)]
    m = log_link_fit(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y", power, 50, 1e-12)
    mu = np.exp(m.intercept + x @ m.coefficients)
    score = np.column_stack([np.ones(300), x]).T @ ((y - mu) * mu ** (1.0 - power))
    assert np.abs(score).max() < 1e-8


def test_glm_with_a_log_link_takes_few_jobs(spark):
    """Rounding once kept the steps above the tolerance until the last pass."""
    from newsts.operators.models import ml_fit
    df = spark.createDataFrame([(float(i % 2), float(1 + i % 50)) for i in range(500)], "x double, y double")
    spark.sparkContext.setJobGroup("glm_scale", "passes")
    model, _ = ml_fit(df, ["x"], "y", "glm", family="gamma", link="log", maxIter=50, tol=1e-12)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("glm_scale"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 30
    assert model.intercept == pytest.approx(np.log(25.0), abs=1e-9)


def test_glm_constant_column_and_bad_labels(spark):
    from newsts.operators.models import log_link_fit
    df = spark.createDataFrame([(1.0, float(i)) for i in range(1, 5)], "x double, y double")
    m = log_link_fit(df, ["x"], "y", 1.0)
    assert m.intercept == pytest.approx(np.log(2.5)) and m.coefficients[0] == 0.0
    with pytest.raises(ValueError):
        log_link_fit(df.selectExpr("x", "y - 1 AS y"), ["x"], "y", 2.0)
