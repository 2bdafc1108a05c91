"""SQL functions and views mean what the expressions and operators mean."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tramline.plans import surface

VALUES = {
    "string": [None, "", "08:05:30", "25:00:00", "7:x:1", "20240229", "2024-03-01", "loc:44.4,26.1", "loc:1,2", "  Piața  Unirii "],
    "double": [None, 0.0, -12.5, 44.43, 26.1, 75.0, 130.0, 301.0, 9000.0], "int": [None, 0, 1, 3, 11, 99], "bigint": [None, 0, 59, 3600, 86400], "timestamp": [None, 0, 1704067199, 1717372800],
}


@pytest.mark.parametrize("name", sorted(surface.functions()))
def test_function_equals_its_expression(spark, name):
    surface.register_functions(spark, "t_")
    parameters, result, make = surface.functions()[name]
    columns = [p.split() for p in parameters.split(", ")]
    rows = max(len(VALUES[k]) for _, k in columns)
    data = [tuple(VALUES[k][(i * (2 * j + 1) + j) % len(VALUES[k])] for j, (_, k) in enumerate(columns)) for i in range(3 * rows)]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'bigint' if k == 'timestamp' else k}" for c, k in columns))
    df = df.select(*[F.timestamp_seconds(c).alias(c) if k == "timestamp" else F.col(c) for c, k in columns])
    if any(c == "seconds" and k == "bigint" for c, k in columns):
        df = df.filter("seconds > 0")
    df.createOrReplaceTempView("t_rows")
    want = df.select(make(*[c for c, _ in columns]).cast(result).alias("v")).collect()
    sql = spark.sql(f"select t_{name}({', '.join(c for c, _ in columns)}) as v from t_rows")
    assert list(map(str, sql.collect())) == list(map(str, want)) and len({str(r) for r in want}) > 1
    assert "Python" not in sql._jdf.queryExecution().executedPlan().toString()
