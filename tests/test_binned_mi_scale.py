"""Rows are not shuffled by column."""


def test_binned_mi_sends_no_rows_by_column(spark):
    from newsts.operators.stats import binned_mi
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i)) for i in range(60)], "a double, b double, y double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long_plan = binned_mi(df, ["a", "b"], "y")._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in long_plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["col"] for r in binned_mi(df, ["a", "b"], "y").collect()} == {"a", "b"}
