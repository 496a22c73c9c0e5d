"""Request grammar at any key."""

from pyspark.sql import functions as F

from lexmill.operators import correspondence
from lexmill.plans import catalog


def test_requests_of_high_keys_stay_in_the_grammar(spark, tmp_path):
    rows = spark.createDataFrame([(5, 899_999), (10, 99_998), (6, 899_999)], "o_orderkey long, o_custkey long")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.valid for r in catalog.QUERIES["request_grammar"](spark, str(tmp_path)).collect()}
    assert got == {5: True, 10: True, 6: False}


def test_a_request_line_ends_where_its_page_ends(spark):
    x = spark.createDataFrame([("1 F.3d 2",), ("1 F.3d 2\r",), ("1 F.3d 2 ",)], "p string")
    assert [r[0] for r in x.select(correspondence.valid_request(F.col("p"))).collect()] == [True, False, False]
