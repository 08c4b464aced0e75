import __spark_entry__ as e


def test_entry_and_names(spark):
    df = e.entry(spark)
    assert df.count() == 200 and "hiding" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
