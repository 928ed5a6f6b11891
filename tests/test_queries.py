"""Every registered query against its SQL in DuckDB, on whole tables."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection

# Spark types and what DuckDB calls them.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "decimal(38,0)": "DECIMAL(38,0)",
}


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    result = registry.queries()[name](spark, SF_DIR)
    cursor = duck.execute(registry.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES.get(t, t) for c, t in result.dtypes} == types
    columns, wanted = by_name([d[0] for d in cursor.description], cursor.fetchall())
    got_columns, got = by_name(result.columns, [tuple(r) for r in result.collect()])
    assert got_columns == columns
    assert sum(wanted.values()) > 0
    only_spark, only_sql = got - wanted, wanted - got
    assert not only_spark and not only_sql, (
        f"{sum(only_spark.values())} rows only in Spark, e.g. {str(list(only_spark)[:2])[:600]}; "
        f"{sum(only_sql.values())} only in SQL, e.g. {str(list(only_sql)[:2])[:600]}"
    )


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_return_rows(spark, name):
    assert registry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = {r.kind: r.n for r in registry.entry(spark).collect()}
    assert rows["maps"] == 0 and rows["layers"] > 0 and rows["documents"] > 0
