"""Glossaries by version over the tables: which version held on an order's day, and what it says of the order's nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import glossaries
from .term_queries import table

#: Versions, the day they took effect, and the rule by which a nation's terms are in them.
VERSIONS = [("2026.1", "1994-01-01", "true"), ("2026.2", "1996-07-01", "n_nationkey % 3 <> 0"), ("2026.10", "1999-01-01", "n_nationkey % 2 = 0")]


def terms(spark: SparkSession, d: str) -> DataFrame:
    """Each nation as a port in each version that has it, with its region and a misspelt name as other names; in the second
    version an organisation has terms of its own for some."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = F.array(F.concat(F.lit("Port of "), "n_name"), F.concat("r_name", F.lit("/"), "n_nationkey"))

    def of(version: str, day: str, keep: str, tier: str) -> DataFrame:
        some = nations.where(keep)
        form = F.concat("n_name", F.lit(f", {version}" if tier == "standard" else ", own"))
        return some.select(
            F.lit(version).alias("version"), F.lit(day).cast("date").alias("effective_date"), F.lit(tier).alias("tier"), F.lit("port").alias("class"), F.concat(F.lit(tier[:1]), "n_nationkey").alias("term_id"), F.concat(F.lit("XX"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("canonical"),
            F.when(F.col("n_nationkey") % 7 != 5, form).alias("form"), F.lit("code").alias("lang"), F.lit("a").alias("authority"), F.lit("b").alias("source"), aliases.alias("aliases"), F.col("r_name").alias("country"), F.lit(None).cast("string").alias("deprecated_by"),
        )

    out = of(*VERSIONS[1][:2], "n_nationkey % 4 = 1", "organisation")
    for v in VERSIONS:
        out = out.unionByName(of(*v, "standard"))
    return out


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each order's nation, written in one of three ways, by the version that held on the order's day."""
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_nationkey", "n_name")
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.concat(F.lit("xx"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))).when(k == 1, F.concat(F.lit(" PORT  of "), "n_name")).otherwise(F.concat(F.lit("no "), "n_name"))
    rows = table(spark, d, "orders").join(who, "o_custkey").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.lit("port").alias("class"), written.alias("value"))
    found = glossaries.looked_up(rows, "day", terms(spark, d))
    return found.select("o_orderkey", "version", F.size(F.coalesce("hits", F.array().cast("array<struct<term_id: string, form: string>>"))).cast("long").alias("n"), F.get("hits", F.lit(0))["term_id"].alias("term_id"), F.get("hits", F.lit(0))["form"].alias("form"))


def wrong(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a glossary of which, by rule, some entries lack something, repeat or hide others."""
    n = F.col("n_nationkey")
    bad = terms(spark, d).where("version = '2026.1'").withColumn("n_nationkey", F.substring("canonical", 3, 3).cast("int"))
    bad = bad.withColumns({
        "country": F.when(n % 5 != 1, F.col("country")), "lang": F.when(n % 5 == 2, "xx").otherwise(F.col("lang")), "authority": F.when(n % 5 != 3, F.col("authority")), "class": F.when(n % 10 == 4, "no class").when(n % 10 == 9, "goods").otherwise(F.col("class")),
        "deprecated_by": F.when(n % 10 == 0, "nobody"), "aliases": F.when(n % 10 == 5, F.array("canonical", F.lit("A b"), F.lit("a  B"))).otherwise(F.array("country")),
    }).drop("n_nationkey")
    return glossaries.problems(bad).select("term_id", "problem", "detail")


def queries() -> dict:
    return {"glossary_as_of": as_of, "glossary_problems": wrong}


def oracle_sql() -> dict[str, str]:
    held = "CASE WHEN day >= DATE '1999-01-01' THEN '2026.10' WHEN day >= DATE '1996-07-01' THEN '2026.2' WHEN day >= DATE '1994-01-01' THEN '2026.1' END"
    there = "CASE v WHEN '2026.1' THEN true WHEN '2026.2' THEN n % 3 <> 0 WHEN '2026.10' THEN n % 2 = 0 ELSE false END"
    return {
        "glossary_as_of": f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, n_nationkey AS n, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 h AS (SELECT *, {held} AS v FROM o), f AS (SELECT *, o_orderkey % 3 <> 2 AND {there} AS std, o_orderkey % 3 <> 2 AND coalesce(v = '2026.2', false) AND n % 4 = 1 AS own FROM h)
 SELECT o_orderkey, v AS version, CAST(CASE WHEN std OR own THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN own THEN 'o' || n WHEN std THEN 's' || n END AS term_id,
   CASE WHEN n % 7 = 5 THEN NULL WHEN own THEN n_name || ', own' WHEN std THEN n_name || ', ' || v END AS form FROM f""",
        "glossary_problems": """WITH t AS (SELECT n_nationkey AS n, 's' || n_nationkey AS id, r_name, 'XX' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code FROM nation JOIN region ON n_regionkey = r_regionkey),
 u AS (SELECT *, n % 5 <> 1 AS has_country, CASE WHEN n % 10 = 4 THEN 'no class' WHEN n % 10 = 9 THEN 'goods' ELSE 'port' END AS class FROM t),
 k AS (SELECT class, id, r_name AS key, has_country FROM u WHERE class <> 'no class' AND n % 10 <> 5
   UNION ALL SELECT class, id, 'A B', has_country FROM u WHERE n % 10 = 5)
 SELECT id AS term_id, 'missing' AS problem, 'authority' AS detail FROM u WHERE n % 5 = 3
 UNION ALL SELECT id, 'language', 'xx' FROM u WHERE n % 5 = 2 UNION ALL SELECT id, 'no_country', NULL FROM u WHERE n % 5 = 1 AND class = 'port' UNION ALL SELECT id, 'unknown_class', 'no class' FROM u WHERE n % 10 = 4
 UNION ALL SELECT id, 'unknown_successor', 'nobody' FROM u WHERE n % 10 = 0 UNION ALL SELECT id, 'alias_is_the_name', code FROM u WHERE n % 10 = 5 UNION ALL SELECT id, 'repeated_alias', 'A B' FROM u WHERE n % 10 = 5
 UNION ALL SELECT min(id), 'shared_name', key FROM k WHERE class = 'goods' GROUP BY key HAVING count(*) > 1
 UNION ALL SELECT min(id), 'shared_name_without_country', key FROM k WHERE class = 'port' GROUP BY key HAVING count(DISTINCT id) > 1 AND count(*) FILTER (NOT has_country) > 0
 UNION ALL SELECT NULL, 'no_terms', c FROM (SELECT unnest(['transport_doc', 'delivery', 'practice_phrase', 'price_term', 'party_suffix', 'qty_unit', 'volume_unit', 'container_no', 'hs_code']) AS c)""",
    }
