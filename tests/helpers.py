"""Small helpers shared by the tests."""

from pyspark.sql import functions as F


def column(spark, values, kind="string"):
    """Values in row order as a one-column frame."""
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def evaluate(spark, values, expression, kind="string"):
    """The expression on each value, in the given order."""
    rows = column(spark, values, kind).select("i", expression(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def executed_plan(df):
    """Physical plan after the query has run, with everything the adaptive planner did."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
