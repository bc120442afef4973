"""Value pools over the orders' regions, and the credit derived from each order's bill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pools
from . import rules_sql as sql
from .document_queries import regions
from .rule_queries import view
from .shipments import with_query


def texts(spark: SparkSession, d: str) -> DataFrame:
    whole = F.array_join(F.transform(F.array(*map(F.lit, ("bl_no", "header", "freight", "cargo"))), lambda n: F.coalesce(F.try_element_at("regions", n), F.lit(""))), " ")
    return regions(spark, d).withColumn("text", whole)


def pooled(spark: SparkSession, d: str) -> DataFrame:
    return pools.pools(texts(spark, d), "o_orderkey").where("kind <> 'reference_code'")


def weighed(spark: SparkSession, d: str) -> DataFrame:
    return pools.numbers(texts(spark, d), "o_orderkey").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def credits(spark: SparkSession, d: str) -> DataFrame:
    return pools.credit(view(spark, d))


def queries() -> dict:
    return {"value_pools": pooled, "number_pools": weighed, "derived_credit": credits}


def oracle_sql() -> dict[str, str]:
    n = sql.nv
    drawn = lambda what, m: f"CAST(('0x' || substr(md5('{what}' || shipment_id), 1, 8)) AS BIGINT) % {m}"
    place = lambda f: f"nullif(coalesce(nullif(trim(regexp_extract({n(f)}, '^([^,/(]*)', 1)), ''), trim({n(f)})), '')"
    weight, freight = sql.quantity(n("gross_weight"), "KG"), sql.amount(n("total_freight"))
    text = f"upper(concat_ws(' ', {n('description_of_goods')}, {n('port_of_loading')}, {n('port_of_discharge')}))"
    either = lambda what, *words: f"CASE WHEN {drawn(what, 2)} = 0 AND NOT ({' OR '.join(f'''contains({text}, '{w}')''' for w in words)}) THEN 'PROHIBITED' ELSE 'ALLOWED' END"
    named = f"upper(regexp_extract(regexp_extract({n('description_of_goods')}, '^([^/\\n]*)', 1), '[A-Za-z]{{2,}}(?:\\s+[A-Za-z]{{2,}})?', 0))"
    from ..functions.scalars import INCOTERMS

    term = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(upper(coalesce({n('incoterms')}, {n('description_of_goods')})), '\\b{t}\\b') THEN '{t}' END" for t in INCOTERMS) + ")"
    latest = f"shipped + CAST(5 + {drawn('ship', 26)} AS INTEGER)"
    return {
        "derived_credit": with_query(f"""SELECT shipment_id, {place('port_of_loading')} AS lc_port_of_loading, {place('port_of_discharge')} AS lc_port_of_discharge, {n('consignee')} AS lc_consignee, CASE WHEN {drawn('notify', 10)} < 6 THEN {n('notify_party')} END AS lc_notify_party,
 nullif({named}, '') AS lc_description_of_goods, strftime({latest}, '%Y-%m-%d') AS lc_latest_shipment_date, strftime({latest} + CAST(10 + {drawn('show', 31)} AS INTEGER), '%Y-%m-%d') AS lc_expiry_date,
 CASE WHEN w > 0 THEN round(w * (1.1::DOUBLE + ({drawn('weight', 1001)}) / 1000::DOUBLE * (1.5::DOUBLE - 1.1::DOUBLE)), 2) END AS lc_max_gross_weight_kg, NULL::DOUBLE AS lc_max_measurement_cbm, CASE WHEN f > 0 THEN f END AS lc_freight_amount, {term} AS lc_incoterms,
 {either('partial', 'PARTIAL', 'PART SHIPMENT', '1ST SHIPMENT')} AS lc_partial_shipment, {either('transit', 'TRANSHIP', 'TRANSSHIP', 'TRANSIT')} AS lc_transhipment, 10.0::DOUBLE AS lc_tolerance_pct, 21 AS lc_presentation_days, NULL::VARCHAR AS lc_bl_consignment, 'COMMERCIAL INVOICE;PACKING LIST;BILL OF LADING' AS lc_documents FROM x""",
            f"x AS (SELECT *, {weight} AS w, {freight} AS f, CASE WHEN {n('on_board_date')} IS NOT NULL THEN {sql.day(n('on_board_date'))} ELSE {sql.day(n('date_of_issue'))} END AS shipped FROM s)"),
        "value_pools": """WITH o AS (SELECT o_orderkey AS file, o_orderkey % 5 AS k, upper(c_name) AS name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 g AS (SELECT l_orderkey AS file, arg_min(p_name, (l_linenumber, l_partkey)) AS goods FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
 v AS (SELECT 'company' AS kind, CASE k WHEN 0 THEN name || ' CO., LTD.' WHEN 2 THEN name || ' INC.' END AS value, file FROM o UNION ALL SELECT 'port', CASE k WHEN 0 THEN n_name || ' , KOREA' WHEN 1 THEN n_name END, file FROM o
   UNION ALL SELECT 'vessel', CASE k WHEN 0 THEN 'MSC BIANCA' WHEN 1 THEN 'HMM ALGECIRAS' WHEN 2 THEN 'EVER GIVEN THE LONG' END, file FROM o UNION ALL SELECT 'goods', goods, file FROM o JOIN g USING (file)),
 p AS (SELECT kind, arg_min(value, file) AS value, min(file) AS file, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY kind, upper(value))
 SELECT kind, value, file, n, row_number() OVER (PARTITION BY kind ORDER BY file) - 1 AS place FROM p""",
        "number_pools": """WITH i AS (SELECT l_orderkey AS k, CAST(l_quantity AS INTEGER) * 10 AS w FROM lineitem), t AS (SELECT DISTINCT k FROM i JOIN orders ON o_orderkey = k),
 v AS (SELECT 'weight_kg' AS kind, w::DOUBLE AS value FROM i JOIN orders ON o_orderkey = k UNION ALL SELECT 'weight_kg', 1234.5 FROM t WHERE k % 2 = 0 UNION ALL SELECT 'weight_kg', 9 FROM t WHERE k % 2 = 0
   UNION ALL SELECT 'measurement_cbm', k + 0.5 FROM t WHERE k % 2 = 0 UNION ALL SELECT 'amount_usd', CASE o_orderkey % 5 WHEN 0 THEN 1741.56 WHEN 3 THEN 5 END FROM orders WHERE o_orderkey % 5 IN (0, 3))
 SELECT kind, count(*) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM v GROUP BY kind""",
    }
