import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert {"vid", "es", "se", "lp", "i2", "cq"} == set(df.columns) and df.count() > 0


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
