import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 45
