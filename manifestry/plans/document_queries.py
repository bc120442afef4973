"""Queries on the texts of documents: fields cleaned out of their regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaners
from ..operators import papers
from .term_queries import table

#: Regions of an order's bill by its key modulo 5, and what is to come out of them ({name}, {nation}, {key}: of the order).
CASES = [
    ({"bl_no": "DLSU123456 HLCU{key}", "shipper": "OCEAN CARRIER\nTEL 02-123\nAB123456 {name} CO., LTD.\nSEOUL", "vessel_info": "M/V MSC  BIANCA V.112", "port_left": "CY/CY\nTOTAL 5\nONE (1)\nSOMEWHERE\n{nation} , KOREA 5 CBM", "footer": "PUSAN, KOREA 2026-06-01\nthree  (3)\nTEL 1", "freight": "$ 1,741.56 FOB  BUSAN"},
     {"bl_no": "HLCU{key}", "shipper": "{name} CO., LTD.", "vessel": "MSC BIANCA", "voyage_no": "112", "port_of_loading": "{nation} , KOREA", "place_of_issue": "PUSAN, KOREA", "no_of_original_bl": "THREE (3)", "total_freight": "$1,741.56", "incoterms": "FOB BUSAN"}),
    ({"header": "ABCDEFGH123456789 MAEU{key}", "shipper": "SHIPPER\nabc\n{name}\nNEXT", "vessel_info": "HMM ALGECIRAS / 2608E", "port_left": "{nation}\nAB\n", "footer": "seoul 2026-06-01", "freight": "1,741.56 fob"},
     {"bl_no": "MAEU{key}", "shipper": "{name}", "vessel": "HMM ALGECIRAS", "voyage_no": "2608E", "port_of_loading": "{nation}"}),
    ({"shipper": "TO ORDER OF SHIPPER\n{name} INC.", "vessel_info": "EVER GIVEN THE LONG ONE V.12W CFS/CFS", "port_left": "FCL VIA", "footer": "Issued at BUSAN", "freight": "CIFX"},
     {"shipper": "{name} INC.", "vessel": "EVER GIVEN THE LONG", "voyage_no": "V.12W", "place_of_issue": "BUSAN"}),
    ({"shipper": "TO ORDER OF SHIPPER", "vessel_info": "V123", "freight": "FREIGHT $5"}, {"shipper": "TO ORDER OF SHIPPER", "vessel": "V123", "voyage_no": "V123", "total_freight": "$5"}),
    ({}, {}),
]
REGIONS = ("bl_no", "header", "shipper", "vessel_info", "port_left", "footer", "freight")
SHOWN = [f for f in cleaners.FIELDS if f not in ("consignee", "notify_party", "port_of_discharge")]


def _filled(text, key, name, nation):
    return F.replace(F.replace(F.replace(text, F.lit("{key}"), F.lpad(key.cast("string"), 7, "0")), F.lit("{name}"), name), F.lit("{nation}"), nation)


def cargo(spark: SparkSession, d: str) -> DataFrame:
    """An order's cargo: a line for each item with a code, packages and weight; every other order has a total and what follows it.

    Of items with the same number and part the first in the file stands last, as it is the one that the oracle's ``arg_max`` keeps.
    """
    items = table(spark, d, "lineitem").withColumn("before", -F.col("_metadata.row_index")).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    n = F.col("l_quantity").cast("int").cast("string")
    line = F.concat(F.lit("ABC"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(" "), n, F.lit(" PKG "), "p_name", F.lit(", "), n, F.lit("0 KG"))
    rows = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "before", line.alias("line")))).alias("x"))
    total = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("\nTOTAL 5 PKG 1,234.50 kgs "), F.col("o_orderkey").cast("string"), F.lit(".5 CBM\nAFTER 9 KG"))).otherwise(F.lit(""))
    return rows.select("o_orderkey", F.concat(F.array_join(F.transform("x", lambda i: i["line"]), "\n"), total).alias("cargo"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, regions): each order's regions and their texts."""
    who = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), F.upper("c_name").alias("name"), F.col("n_name").alias("nation"))
    literal = spark.createDataFrame([(i, *(c.get(r) for r in REGIONS)) for i, (c, _) in enumerate(CASES)], "k int, " + ", ".join(f"{r} string" for r in REGIONS))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % len(CASES)).cast("int").alias("k")).join(who, "o_custkey").join(F.broadcast(literal), "k").join(cargo(spark, d), "o_orderkey", "left")
    texts = {r: _filled(F.col(r), F.col("o_orderkey"), F.col("name"), F.col("nation")) for r in REGIONS} | {"cargo": F.col("cargo"), "measurement": F.when(F.col("o_orderkey") % 4 == 1, "7 M3")}
    return rows.select("o_orderkey", F.create_map(*(x for r, t in texts.items() for x in (F.lit(r), t))).alias("regions"))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return regions(spark, d).select("o_orderkey", *cleaners.fields(F.col("regions"))).select("o_orderkey", *SHOWN)


#: Two lay-outs of each kind by the order's key: text, x and y of boxes 20 high and 10 a letter wide. {key} and {name} are the order's.
PAPERS = {
    "commercial_invoice": [
        [("COMMERCIAL INVOICE", 300, 0), ("Invoice No.", 0, 50), (": INV-{key}", 150, 48), ("Invoice Date", 400, 50), ("2026-01-02", 560, 50), ("SELLER", 0, 100), ("{name}", 0, 122), ("CO., LTD.", 0, 138), ("BUYER", 400, 160), ("PACIFIC", 400, 190), ("GMBH", 480, 190),
         ("SANTOS EXPRESS", 0, 230), ("Total Amount", 0, 290), ("USD 1,000.00", 200, 290), ("L/C No", 400, 290), ("LC-{key}", 500, 290)],
        # one heading for two columns; a label of two letters; labels that lie apart
        [("INVOICE NO INVOICE DATE", 0, 0), ("INV-{key}", 0, 30), ("TO", 0, 100), ("ACME", 40, 100), ("QTY", 0, 200), ("27", 0, 230), ("PKG", 30, 230), ("AMOUNT", 300, 215), ("$5", 310, 245), ("PRICE TERM", 500, 230), ("FOB", 500, 260), ("BUSAN;", 540, 260)],
    ],
    "packing_list": [
        [("PACKING LIST", 300, 0), ("DATE", 0, 50), ("2026-01-02", 60, 50), ("GROSS WEIGHT", 0, 100), ("884 KG", 130, 100), ("NET WEIGHT", 250, 100), ("800 KG", 370, 100), ("CBM", 480, 100), ("3.5", 540, 100), ("SHIPPING MARKS", 0, 200), ("{name}", 0, 230), ("PUSAN", 0, 245), ("NUMBER OF PACKAGES", 400, 220), ("{key} CTNS", 640, 220)],
        # a short label counts as a word only, one of two letters that are no word not at all, and a label next to another has no value
        [("UPDATED", 0, 0), ("1 MAY", 100, 0), ("G/W", 0, 100), ("884 KG", 60, 100), ("SELLER", 0, 200), ("BUYER", 300, 200), ("ACME", 300, 230)],
    ],
}
PARSED = {
    "commercial_invoice": [
        {"invoice_no": "INV-{key}", "invoice_date": "2026-01-02", "seller": "{name} CO., LTD.", "buyer": "PACIFIC GMBH", "total_amount": "USD 1,000.00", "lc_no": "LC-{key}"},
        {"invoice_no": "INV-{key}", "invoice_date": "INV-{key}", "buyer": "ACME", "quantity": "27 PKG", "total_amount": "$5", "incoterms": "FOB BUSAN"},
    ],
    "packing_list": [{"packing_date": "2026-01-02", "gross_weight": "884 KG", "net_weight": "800 KG", "measurement": "3.5", "marks": "{name} PUSAN", "package_count": "{key} CTNS"}, {"buyer": "ACME"}],
}


def paper_tokens(spark: SparkSession, d: str, kind: str) -> DataFrame:
    box = lambda t, x, y: F.struct(F.lit(t).alias("text"), F.lit(x).alias("x_min"), F.lit(y).alias("y_min"), F.lit(x + 10 * len(t.replace("{key}", "0000000").replace("{name}", "CUSTOMER#000000000"))).alias("x_max"), F.lit(y + 20).alias("y_max"))
    forms = [F.array(*(box(*b) for b in form)) for form in PAPERS[kind]]
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, forms[0]).otherwise(forms[1]).alias("form"))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.upper("c_name").alias("name"))
    each = rows.join(who, "o_custkey").select(F.col("o_orderkey").alias("document_id"), "name", F.posexplode("form").alias("idx", "b")).select("document_id", "name", "idx", "b.*")
    text = _filled(F.col("text"), F.col("document_id"), F.col("name"), F.lit(""))
    return each.withColumn("text", text).withColumn("confidence", F.when(F.col("idx") % 2 == 0, 0.9).otherwise(0.8)).drop("name")


def papered(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        parsed = papers.parse(papers.pages(paper_tokens(spark, d, kind)), kind)
        sure = F.round(F.col("buyer" if kind == "commercial_invoice" else "marks")["confidence"], 6)
        return parsed.select("document_id", *(F.col(f)["value"].alias(f) for f in papers.LABELS[kind]), sure.alias("confidence"))

    return run


def _paper_sql(kind: str, sure: str) -> str:
    fields = list(papers.LABELS[kind])
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'"
    values = ", ".join(f"({i}, {', '.join(text(out.get(f)) for f in fields)})" for i, out in enumerate(PARSED[kind]))
    filled = lambda f: f"replace(replace({f}, '{{key}}', lpad(CAST(o_orderkey AS VARCHAR), 7, '0')), '{{name}}', upper(c_name)) AS {f}"
    return f"SELECT o_orderkey AS document_id, {', '.join(map(filled, fields))}, CAST({sure} AS DOUBLE) AS confidence FROM orders JOIN customer ON c_custkey = o_custkey JOIN (VALUES {values}) AS c(k, {', '.join(fields)}) ON k = o_orderkey % 2"


def queries() -> dict:
    return {"cleaned_fields": cleaned, "invoice_fields": papered("commercial_invoice"), "packing_fields": papered("packing_list")}


def oracle_sql() -> dict[str, str]:
    stated = [f for f in SHOWN if f not in ("description_of_goods", "gross_weight", "measurement")]
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'"
    values = ", ".join(f"({i}, {', '.join(text(out.get(f)) for f in stated)})" for i, (_, out) in enumerate(CASES))
    filled = lambda f: f"replace(replace(replace({f}, '{{key}}', lpad(CAST(o_orderkey AS VARCHAR), 7, '0')), '{{name}}', upper(c_name)), '{{nation}}', n_name) AS {f}"
    return {
        "invoice_fields": _paper_sql("commercial_invoice", "CASE o_orderkey % 2 WHEN 0 THEN round((0.8 + 0.9) / 2 * 0.85, 6) ELSE 0.68 END"),
        "packing_fields": _paper_sql("packing_list", "CASE o_orderkey % 2 WHEN 0 THEN round((0.9 + 0.8) / 2 * 0.85, 6) END"),
        "cleaned_fields": f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name, CAST(l_quantity AS INTEGER) AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
 u AS (SELECT l_orderkey, p_name, min((l_linenumber, l_partkey)) AS place FROM i GROUP BY ALL), g AS (SELECT l_orderkey, substr(string_agg(p_name, ' / ' ORDER BY place), 1, 200) AS goods FROM u GROUP BY 1),
 w AS (SELECT l_orderkey, arg_max(n || '0 KG', (l_linenumber, l_partkey)) AS weight FROM i GROUP BY 1)
 SELECT o_orderkey, {', '.join(map(filled, stated))}, goods AS description_of_goods, CASE WHEN goods IS NULL THEN NULL WHEN o_orderkey % 2 = 0 THEN '1,234.50 KGS' ELSE weight END AS gross_weight,
   CASE WHEN o_orderkey % 2 = 0 AND goods IS NOT NULL THEN o_orderkey || '.5 CBM' WHEN o_orderkey % 4 = 1 THEN '7 CBM' END AS measurement
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN (VALUES {values}) AS c(k, {', '.join(stated)}) ON k = o_orderkey % {len(CASES)} LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN w ON w.l_orderkey = o_orderkey""",
    }
