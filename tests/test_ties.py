"""Values at which Spark and the oracle's engine part: letters, ties and casts."""

import duckdb
from pyspark.sql import functions as F

from manifestry.operators import evidence
from manifestry.plans import document_queries, rule_queries


def test_letters_that_upper_case_makes_several_of(spark):
    rows = spark.createDataFrame([("Stra\u00dfe \ufb01x 1",)], "c string")
    assert rows.select(evidence.norm(F.col("c")).alias("n")).first().n == "STRAEX1"
    assert rows.select(evidence.upper(F.col("c")).alias("u")).first().u == "STRA\u00dfE \ufb01X 1"
    ends = rows.select(evidence.chain(F.lit("en\u00dfst enge ers"), F.lit("en\u00dfst enge er"), F.lit(True), F.lit("OCR"))["derivation"].alias("d"))
    assert ends.first().d == "CONTENT_MISMATCH"  # similarity 10 / 13; with the sharp s as two letters 12 / 15


def test_last_item_of_a_tie_is_the_first_in_the_file(spark, tmp_path):
    duckdb.sql("SELECT 7 AS l_orderkey, 1 AS l_linenumber, 5 AS l_partkey, unnest([32.0, 37.0]::DOUBLE[]) AS l_quantity").write_parquet(str(tmp_path / "lineitem.parquet"))
    duckdb.sql("SELECT 5 AS p_partkey, 'bolt' AS p_name").write_parquet(str(tmp_path / "part.parquet"))
    assert document_queries.cargo(spark, str(tmp_path)).first().cargo.endswith("320 KG")


def test_amounts_are_rounded_to_whole_ones(spark, tmp_path):
    duckdb.sql("SELECT 1 AS o_orderkey, 1 AS o_custkey, 100.6::DOUBLE AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate").write_parquet(str(tmp_path / "orders.parquet"))
    duckdb.sql("SELECT 1 AS c_custkey, 'A' AS c_name, 3.35::DOUBLE AS c_acctbal, 'M' AS c_mktsegment").write_parquet(str(tmp_path / "customer.parquet"))
    row = rule_queries.view(spark, str(tmp_path)).first()
    assert row.inv_total_amount == "$101.50"
    assert row.cr_currency_amount == "USD 100.00"
