"""SimHash of odd documents, against the query's own SQL."""

import pytest

from motley.plans import registry

duckdb = pytest.importorskip("duckdb")


def test_simhash_of_odd_texts_is_that_of_its_sql(spark, tmp_path):
    texts = ["a b", "", None, " \n ", "a b c", "a\x0bb c", "a\x85b c", "a　b", "a b c", "İstanbul", "ΑΣ ΟΔΟΣ", "a\x1cb \tc", "\U0001f600 q", "a\x00b c"]
    rows = [*enumerate(texts), (99, "one part"), (99, "and another part"), (None, "without a number")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, simhash FROM ({registry.ORACLES['simhash']})").fetchall()
    got = registry.QUERIES["simhash"](spark, str(tmp_path)).select("doc_id", "simhash").collect()
    assert len(want) == 13 and sorted(map(tuple, got), key=str) == sorted(want, key=str)
