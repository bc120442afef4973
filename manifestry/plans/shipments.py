"""Shipments as the library sees them, made from the driver's order tables.

An order is a shipment: its documents' fields are texts (or missing), its credit's terms are typed.  The view is
written once, in SQL that Spark and DuckDB both read, so that query and oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns: shipment_id, the bill of lading's fields, lc_* (credit terms), inv_* and pack_* (other documents), held.
VIEW = """
SELECT o_orderkey AS shipment_id,
 CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'BL' || CAST(o_orderkey AS STRING) END AS bl_no,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE c_name || ' EXPORT CO., LTD.' END AS shipper,
 CASE o_orderkey % 6 WHEN 0 THEN 'DHHJ FRANCHISING CO., LTD.' WHEN 1 THEN 'DHHJ FRANCHISING' WHEN 2 THEN 'TO THE ORDER OF DHHJ BANK' WHEN 3 THEN NULL WHEN 4 THEN 'HANWOO TRADING INC.' ELSE 'TO ORDER' END AS consignee,
 CASE o_orderkey % 5 WHEN 0 THEN 'TRY ENERGY CO., LTD.' WHEN 1 THEN 'WRONG COMPANY INC.' WHEN 2 THEN ' ' ELSE c_mktsegment || ' ENERGY' END AS notify_party,
 CASE o_orderkey % 7 WHEN 0 THEN 'MSC BIANCA' WHEN 1 THEN 'INTENDED MSC BIANCA' WHEN 2 THEN NULL ELSE 'HMM UNINTENDED' END AS vessel,
 CASE o_orderkey % 8 WHEN 0 THEN 'BUSAN, KOREA' WHEN 1 THEN 'PUSAN' WHEN 2 THEN 'ANY PORT IN EUROPE' WHEN 3 THEN NULL WHEN 4 THEN 'INCHON, KOREA' WHEN 5 THEN 'CANTON TRANSIT' ELSE 'SHANGHAI, CHINA' END AS port_of_loading,
 CASE o_orderkey % 9 WHEN 0 THEN 'TOKYO, JAPAN' WHEN 1 THEN 'EUROPEAN MAIN PORTS' WHEN 2 THEN '' WHEN 3 THEN 'BOMBAY, INDIA' ELSE 'HAMBURG, GERMANY' END AS port_of_discharge,
 CASE o_orderkey % 10 WHEN 0 THEN 'SAW MACHINE FOB' WHEN 1 THEN 'SAW MACHINE, SPARE PARTS PARTIAL SHIPMENT' WHEN 2 THEN '27 PKG RUSTY STEEL COIL CIF' WHEN 3 THEN 'WETSUIT STC 10 CTNS' WHEN 4 THEN NULL WHEN 5 THEN 'MACHINERY PARTS FREIGHT COLLECT' WHEN 6 THEN 'RAW COTTON YARN TRANSHIPMENT' WHEN 7 THEN '27 PKG CELL ASSEMBLY' WHEN 8 THEN 'TORN BAGS SHORT SHIPPED' ELSE 'GENERAL MERCHANDISE' END AS description_of_goods,
 CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 1700 AS STRING) || ' KG' WHEN 1 THEN '0.884 MT' WHEN 2 THEN '1,240 KGS' WHEN 3 THEN 'HEAVY' WHEN 4 THEN NULL ELSE '884 KG' END AS gross_weight,
 CASE o_orderkey % 5 WHEN 0 THEN '349.64 CBM' WHEN 1 THEN CAST(o_orderkey % 600 AS STRING) || ' M3' WHEN 2 THEN NULL ELSE '12 PALLETS' END AS measurement,
 CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) WHEN 2 THEN '60-55-2708' WHEN 3 THEN NULL ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '-' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '-' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) END AS date_of_issue,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '  JUN ' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) WHEN 2 THEN 'June 7, ' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS on_board_date,
 CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'PUSAN' END AS place_of_issue,
 CASE o_orderkey % 6 WHEN 0 THEN '$1,741.56' WHEN 1 THEN 'USD 1900' WHEN 2 THEN 'FREIGHT COLLECT' WHEN 3 THEN NULL WHEN 4 THEN '$5,000.00' ELSE 'COLLECTED 1,600.00' END AS total_freight,
 CASE o_orderkey % 4 WHEN 0 THEN 'FOB' WHEN 1 THEN NULL WHEN 2 THEN 'CIF BUSAN' ELSE '' END AS incoterms,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'THREE (3)' END AS no_of_original_bl,
 CASE o_orderkey % 8 WHEN 0 THEN 'RECEIVED FOR SHIPMENT' WHEN 1 THEN 'RECEIVED IN APPARENT GOOD ORDER FOR SHIPMENT' WHEN 2 THEN 'SHIPPED ON DECK' WHEN 3 THEN 'CARGO MAY BE CARRIED ON DECK' WHEN 4 THEN 'CORRECTION AUTHENTICATED' WHEN 5 THEN 'AMENDED, SUBJECT TO CHARTER PARTY' WHEN 6 THEN NULL ELSE 'CLEAN' END AS bl_clauses,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'BUSAN' WHEN 2 THEN 'PUSAN, KOREA' ELSE 'INCHEON' END AS lc_port_of_loading,
 CASE o_orderkey % 4 WHEN 0 THEN 'TOKYO' WHEN 1 THEN 'MUMBAI, INDIA' WHEN 2 THEN '' ELSE 'HAMBURG' END AS lc_port_of_discharge,
 CASE o_orderkey % 3 WHEN 0 THEN 'DHHJ FRANCHISING CO., LTD.' WHEN 1 THEN 'HANWOO TRADING CO., LTD.' ELSE NULL END AS lc_consignee,
 CASE o_orderkey % 3 WHEN 0 THEN 'TRY ENERGY CO., LTD.' WHEN 1 THEN NULL ELSE 'MACHINERY ENERGY CORP' END AS lc_notify_party,
 CASE o_orderkey % 4 WHEN 0 THEN 'SAW MACHINE' WHEN 1 THEN 'saw machine, spare parts' WHEN 2 THEN NULL ELSE 'STEEL, COIL,' END AS lc_description_of_goods,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SOON' ELSE CAST(year(o_orderdate) AS STRING) || '-06-30' END AS lc_latest_shipment_date,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '31/12/' || CAST(year(o_orderdate) AS STRING) ELSE CAST(year(o_orderdate) AS STRING) || '-07-15' END AS lc_expiry_date,
 CASE o_orderkey % 5 WHEN 0 THEN 'FOB' WHEN 1 THEN 'CIF HAMBURG' WHEN 2 THEN NULL WHEN 3 THEN 'DDP' ELSE 'CFR' END AS lc_incoterms,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1000.0E0 END AS lc_max_gross_weight_kg,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 350.0E0 END AS lc_max_measurement_cbm,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1741.56E0 END AS lc_freight_amount,
 CAST(5 + o_orderkey % 3 * 5 AS DOUBLE) AS lc_tolerance_pct,
 CAST(CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 21 END AS INT) AS lc_presentation_days,
 CASE WHEN o_orderkey % 2 = 0 THEN 'PROHIBITED' ELSE 'ALLOWED' END AS lc_partial_shipment,
 CASE WHEN o_orderkey % 3 = 0 THEN 'prohibited' ELSE 'ALLOWED' END AS lc_transhipment,
 CASE WHEN o_orderkey % 2 = 0 THEN 'TO_ORDER' ELSE NULL END AS lc_bl_consignment,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'COMMERCIAL INVOICE;FULL SET OF B/L' WHEN 2 THEN 'PACKING LIST' ELSE 'BILL OF LADING;INVOICE' END AS lc_documents,
 CASE o_orderkey % 5 WHEN 0 THEN 'gross_weight' WHEN 1 THEN 'consignee,port_of_loading' WHEN 2 THEN 'vessel,bl_no,shipper,consignee,measurement' ELSE '' END AS held,
 CAST(CAST(o_orderdate AS DATE) AS DATE) AS order_date,
 CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 'INV-' || CAST(o_orderkey AS STRING) END AS inv_invoice_no,
 CASE o_orderkey % 5 WHEN 0 THEN 'DHHJ FRANCHISING CO LTD' WHEN 1 THEN 'SHANGHAI EAST TRADING' WHEN 2 THEN 'CO., LTD.' WHEN 3 THEN NULL ELSE 'HANWOO TRADING' END AS inv_buyer,
 CASE WHEN o_orderkey % 4 = 0 THEN 'OTHER SELLER' ELSE c_name || ' EXPORT' END AS inv_seller,
 CASE o_orderkey % 7 WHEN 0 THEN '27 PKG CELL ASSEMBLY MACHINE' WHEN 1 THEN '27 PKG STEEL COIL' WHEN 2 THEN 'MACHINERY PARTS' WHEN 3 THEN 'RAW COTTON' WHEN 4 THEN NULL ELSE 'SAW MACHINE' END AS inv_description_of_goods,
 '$' || CAST(CAST({total} AS BIGINT) AS STRING) || '.50' AS inv_total_amount,
 CASE o_orderkey % 3 WHEN 0 THEN 'FOB' WHEN 1 THEN 'C.I.F.' ELSE NULL END AS inv_incoterms,
 'LC-2026-' || CAST(o_orderkey % 50 AS STRING) AS inv_lc_no,
 CASE o_orderkey % 3 WHEN 0 THEN 'INV' || CAST(o_orderkey AS STRING) WHEN 1 THEN 'inv-' || CAST(o_orderkey AS STRING) ELSE 'INV-1' END AS pack_invoice_no,
 CASE o_orderkey % 4 WHEN 0 THEN '27 PKG CELL ASSEMBLY' WHEN 1 THEN 'COTTON YARN 27 PKG' ELSE 'SAW BLADE' END AS pack_description_of_goods,
 CASE o_orderkey % 4 WHEN 0 THEN '884 KG' WHEN 1 THEN '0.886 MT' WHEN 2 THEN '1,240 KG' ELSE NULL END AS pack_gross_weight,
 CASE o_orderkey % 3 WHEN 0 THEN '349.64 CBM' WHEN 1 THEN '350 CBM' ELSE '12 M3' END AS pack_measurement,
 'LC2026' || CAST(o_orderkey % 49 AS STRING) AS cr_lc_no,
 CASE WHEN o_orderkey % 5 = 0 THEN 'OPEN' ELSE 'USD ' || CAST(CAST({balance} AS BIGINT) AS STRING) || '.00' END AS cr_currency_amount,
 CASE o_orderkey % 2 WHEN 0 THEN 'FOB' ELSE 'CIF' END AS cr_incoterms
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions than there are (one small file); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the tables of ``sf_dir``: one equi-join, everything else is projection.

    Projections this wide make methods that the JVM refuses to compile (above 8,000 bytes of code); with the limit set,
    Spark evaluates them in small methods instead of running one large method in the interpreter.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # DuckDB's cast to whole numbers rounds, Spark's cuts off
    amounts = VIEW.replace("{total}", "rint(o_totalprice)").replace("{balance}", "rint(c_acctbal * 30)")
    return spark.sql(amounts, orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet")), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def oracle_view() -> str:
    return VIEW.format(orders="orders", customer="customer", total="o_totalprice", balance="c_acctbal * 30")


def with_as_of(view: DataFrame) -> DataFrame:
    """Each shipment's day of presentation; never the wall clock."""
    from pyspark.sql import functions as F

    return view.withColumn("as_of", F.expr("date_add(order_date, CAST(shipment_id % 60 AS INT))"))


def with_query(select: str, more: str = "") -> str:
    """The oracle's SQL: ``select`` over the shipments (table s), further CTEs in between."""
    return f"WITH s0 AS ({oracle_view()}), s AS (SELECT *, CAST(order_date + CAST(shipment_id % 60 AS INTEGER) AS DATE) AS as_of FROM s0){', ' + more if more else ''} {select}"
