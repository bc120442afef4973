"""Queries on terms, texts and dates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import terms
from ..sources import mt700
from . import rules_sql as sql
from .shipments import spread

#: Texts that name quantities, tariff codes, price terms and parties, by the row's key.
QUANTITIES = ["1,234.50 KGS", "5 M3", "7 L.", "12ctns", "9 FOO", "no number", "40 Tonnes", "3 P.C.S"]
HS_CODES = ["847130", "8471.30", "HS 8471.30", "8471.30-1000", "84713", "hs 847130 1234", "X", " 123456 "]
PRICES = ["FOB Busan", "F.O.B. PUSAN, KOREA", "CIF Hamburg (Incoterms 2020)", "cfr", "ABC Busan", "DDP ,  Lagos ,", "E X W Seoul", "FOBBING"]
PARTIES = ["GAE WOON CO.,LTD", "PACIFIC IMPORT GMBH", "HANWOO TRADING", "ACME Pte. Ltd.", "CO", "ALPHA CORPORATION LIMITED ", "BETAINC", "Delta, Inc"]
DATE_SHAPES = ["yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd MMM yyyy", "dd MMMM yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "MMM dd yyyy", "MMMM dd yyyy", "dd-MMM-yyyy", "dd-MMMM-yyyy"]
STRFTIME = ["%Y-%m-%d", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%d-%b-%Y", "%d-%B-%Y"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(key: str, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


MESSAGE = "'{{1:F01BANK}}{{4:' || chr(10) || ':20:LC' || CAST(o_orderkey AS STRING) || chr(10) || ':31D:' || substr(replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ''), 3, 6) || 'SEOUL' || chr(10) || ':32B:' || CASE o_orderkey % 4 WHEN 0 THEN 'USD123456,78' WHEN 1 THEN 'USD 123,456.78' WHEN 2 THEN 'EUR1,000' ELSE 'n/a' END || chr(10) || ':39A:' || CASE o_orderkey % 3 WHEN 0 THEN '10/05' WHEN 1 THEN '5,5' ELSE 'none' END || chr(10) || ':43P:' || CASE o_orderkey % 3 WHEN 0 THEN 'NOT ALLOWED' WHEN 1 THEN 'ALLOWED' ELSE 'CONDITIONAL' END || chr(10) || ':43T:PROHIBITED' || chr(10) || ':44E:BUSAN' || chr(10) || ':44E:INCHEON' || chr(10) || ':44C:' || CASE o_orderkey % 2 WHEN 0 THEN '260631' ELSE '260630' END || chr(10) || ':50:/123456' || chr(10) || 'HANWOO TRADING' || chr(10) || 'SEOUL' || chr(10) || ':59:GAE WOON CO., LTD.' || chr(10) || ':45A:+SAW MACHINE' || chr(10) || '+SPARE PARTS' || CASE o_orderkey % 3 WHEN 0 THEN ' CIF' ELSE '' END || chr(10) || ':46A:+SIGNED INVOICE' || chr(10) || '1) ' || CASE o_orderkey % 4 WHEN 0 THEN 'FULL SET B/L MADE OUT TO ORDER NOTIFY APPLICANT' WHEN 1 THEN 'BILL OF LADING CONSIGNED TO DHHJ BANK.' WHEN 2 THEN 'BILL OF LADING, NOTIFY PARTY: TRY ENERGY.' ELSE 'PACKING LIST' END || chr(10) || ':47A:' || CASE o_orderkey % 4 WHEN 0 THEN '+MAX. GROSS WEIGHT 1,000 KGS' || chr(10) || '+MEASUREMENT NOT EXCEEDING 350 CBM' WHEN 1 THEN '- GROSS WEIGHT MAXIMUM 2 M.TONS FOB' WHEN 2 THEN 'GROSS WEIGHT 900 KG FOB OR CFR' ELSE 'NONE' END || chr(10) || ':48:WITHIN 21 DAYS' || chr(10) || '-}}'".replace("{{", "{").replace("}}", "}")


def mt700_fields(spark: SparkSession, d: str) -> DataFrame:
    message = F.when(F.col("o_orderkey") % 50 == 49, "no credit at all").otherwise(F.expr(MESSAGE))
    parsed = mt700.parse(spread(table(spark, d, "orders")).select("o_orderkey", message.alias("message")))
    return parsed.drop("message").withColumn("documents", F.array_join("documents", "|"))


def gram_dice(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("text")).distinct()
    return terms.dice_top_k(names, names)


def glossary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    row = lambda tier, cond, term: n.where(cond).select(F.lit(tier).alias("tier"), F.upper("n_name").alias("key"), F.expr(term).alias("term"))
    return row("standard", "true", "'std:' || n_name").unionByName(row("standard", "n_nationkey % 4 = 1", "'std2:' || n_name")).unionByName(row("organisation", "n_nationkey % 3 = 0", "'org:' || n_name")).unionByName(row("shipment", "n_nationkey % 5 = 0", "'own:' || n_name"))


GLOSSARY = """g AS (SELECT 3 AS r, 'standard' AS tier, upper(n_name) AS key, 'std:' || n_name AS term FROM nation UNION ALL SELECT 3, 'standard', upper(n_name), 'std2:' || n_name FROM nation WHERE n_nationkey % 4 = 1
 UNION ALL SELECT 2, 'organisation', upper(n_name), 'org:' || n_name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 1, 'shipment', upper(n_name), 'own:' || n_name FROM nation WHERE n_nationkey % 5 = 0),
 w AS (SELECT s_suppkey, upper(n_name) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 h AS (SELECT s_suppkey, w.key, tier, term FROM w JOIN (SELECT *, rank() OVER (PARTITION BY key ORDER BY r) AS k FROM g) g ON g.key = w.key AND k = 1)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.upper("n_name").alias("key"))
    return terms.tier_lookup(wanted, glossary(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("group"), (F.col("event_id") * 7 % 400).alias("start"), (F.col("event_id") * 7 % 400 + F.col("event_id") * 3 % 23).alias("end"))


def apply_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name with its first word and its last letter replaced."""
    p = table(spark, d, "part")
    cut = F.instr("p_name", " ") - 1
    own = F.array(F.struct(F.lit(0).alias("start"), cut.alias("end"), F.lit("<X>").alias("new")), F.struct((F.length("p_name") - 1).alias("start"), F.length("p_name").alias("end"), F.lit("!").alias("new")))
    return p.select("p_partkey", terms.apply_spans(F.col("p_name"), own).alias("text"))


def queries() -> dict:
    def part_pairs(spark, d):
        p = table(spark, d, "part")
        return p.select("p_partkey", F.upper("p_name").alias("a"), F.upper(F.concat_ws(" ", F.lower("p_type"), F.reverse(F.split("p_name", " ")).getItem(0))).alias("b"))

    def with_case(key, values, tbl):
        return lambda spark, d: table(spark, d, tbl).select(key, _pick(key, values).alias("text"))

    quantities, hs, prices, parties = with_case("l_orderkey", QUANTITIES, "lineitem"), with_case("p_partkey", HS_CODES, "part"), with_case("o_orderkey", PRICES, "orders"), with_case("c_custkey", PARTIES, "customer")
    dates = lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.coalesce(*(F.when(F.col("o_orderkey") % 14 == i, F.upper(F.date_format(F.col("o_orderdate").cast("date"), f))) for i, f in enumerate(DATE_SHAPES))).alias("text"))
    return {
        "norm_keys": lambda spark, d: table(spark, d, "part").select("p_partkey", s.normalize_key(F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" (x)  é"))).alias("key"), s.loose_key(F.concat("p_brand", F.lit("-"), "p_name")).alias("loose")),
        "unit_codes": lambda spark, d: quantities(spark, d).select("l_orderkey", terms.split_quantity(F.col("text"))[0].alias("number"), terms.split_quantity(F.col("text"))[1].alias("unit"), terms.unit_code(terms.split_quantity(F.col("text"))[1]).alias("code")),
        "hs_codes": lambda spark, d: hs(spark, d).select("p_partkey", terms.normalize_hs(F.col("text")).alias("hs")),
        "price_terms": lambda spark, d: prices(spark, d).select("o_orderkey", terms.price_term(F.col("text"))[0].alias("code"), terms.price_term(F.col("text"))[1].alias("place")),
        "party_suffix": lambda spark, d: parties(spark, d).select("c_custkey", terms.party_suffix(F.col("text"))[0].alias("as_is"), terms.party_suffix(F.col("text"))[1].alias("to_be")),
        "container_check": lambda spark, d: table(spark, d, "part").select("p_partkey", F.concat(F.lit("MSKU"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("code")).select("p_partkey", s.container_check_digit(F.col("code")).cast("int").alias("digit"), (s.container_check_digit(F.col("code")) == F.col("p_partkey") % 10).alias("valid")),
        "tier_lookup": lambda spark, d: _hits(spark, d).select("s_suppkey", "key", "tier", "term"),
        "tier_decision": lambda spark, d: terms.resolve(_hits(spark, d), ["s_suppkey", "key"]),
        "gram_dice_topk": gram_dice,
        "phrase_scan": lambda spark, d: table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"(?i)\b(idiot|clown|pathetic|worthless)\b")).cast("long").alias("n_whole"), F.regexp_count(F.lower("text"), F.lit("the")).cast("long").alias("n_part")),
        "span_overlap": lambda spark, d: terms.resolve_overlaps(spans(spark, d)),
        "apply_spans": apply_spans,
        "token_jaccard": lambda spark, d: part_pairs(spark, d).select("p_partkey", F.round(s.jaccard(F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))), 6).alias("jaccard"), F.round(s.overlap_share(F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))), 6).alias("overlap")),
        "levenshtein_ratio": lambda spark, d: part_pairs(spark, d).select("p_partkey", F.round(s.levenshtein_ratio(F.col("a"), F.col("b")), 6).alias("ratio")),
        "trigram_sim": lambda spark, d: part_pairs(spark, d).select("p_partkey", F.round(s.trigram_similarity(F.lower("a"), F.lower("b")), 6).alias("similarity")),
        "parse_dates": lambda spark, d: dates(spark, d).select("o_orderkey", "text", s.parse_date(F.col("text")).alias("day")),
        "parse_quantities": lambda spark, d: quantities(spark, d).select("l_orderkey", F.round(s.parse_quantity(F.col("text"), "KG"), 4).alias("kg"), F.round(s.parse_quantity(F.col("text"), "CBM"), 4).alias("cbm"), F.round(s.parse_amount(F.col("text")), 4).alias("amount")),
        "mt700_fields": mt700_fields,
        "text_numbers": lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)).cast("long").alias("n_numbers")),
    }


def oracle_sql() -> dict[str, str]:
    pairs = "(SELECT p_partkey, upper(p_name) AS a, upper(lower(p_type) || ' ' || split_part(p_name, ' ', -1)) AS b FROM part)"
    x, y = "list_distinct(string_split(a, ' '))", "list_distinct(string_split(b, ' '))"
    both = f"list_distinct(list_concat({x}, {y}))"
    case = lambda key, values, tbl: f"(SELECT {key}, {_pick_sql(key, values)} AS text FROM {tbl})"
    number, unit = (f"nullif(regexp_extract(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*([A-Za-z0-9가-힣./³]+)', {i}), '')" for i in (1, 2))
    names = terms.unit_names()
    unit_map = "CASE regexp_replace(upper(unit), '[.\\s]+', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    hs = "'^(?:HS\\s*)?([0-9]{4})\\.?([0-9]{2})(?:[-\\s]?([0-9]{4}))?$'"
    price = "'^\\s*([A-Z])[.\\s]?([A-Z])[.\\s]?([A-Z])\\b(.*)$'"
    code = " || ".join(f"regexp_extract(upper(text), {price}, {i})" for i in (1, 2, 3))
    suffix = f"regexp_extract(upper(text), '(?:^|\\s)({terms.SUFFIX}(?:[.,]*\\s*{terms.SUFFIX})*[.,]*)\\s*$', 1)"
    forms = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in terms.SUFFIX_FORMS.items()) + " END"
    skip = [n for n in range(10, 39) if n % 11][:26]
    value = "CASE WHEN i <= 4 THEN " + f"[{', '.join(map(str, skip))}][ascii(substr(code, i, 1)) - 64]" + " ELSE CAST(substr(code, i, 1) AS INTEGER) END"
    grams3 = "list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3))"
    tri = lambda c: f"list_distinct(list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substr('  ' || {c} || ' ', i, 3)))"
    key = "trim(regexp_replace(regexp_replace(upper(text), '[^A-Z0-9가-힣.]', ' ', 'g'), ' +', ' ', 'g'))"
    tag = lambda t, pat="([^\\n]*)": f"regexp_extract(m, '\\n:{t}:{pat}', 1)"
    amount = tag("32B")
    digits = f"regexp_extract({amount}, '^[A-Z]{{3}}\\s*([0-9.,]+)', 1)"
    return {
        "norm_keys": "SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_brand || ' - ' || p_name || ' (x)  é'), '[^A-Z0-9가-힣.]', ' ', 'g'), ' +', ' ', 'g')) AS key, regexp_replace(upper(p_brand || '-' || p_name), '[^A-Z0-9가-힣]', '', 'g') AS loose FROM part",
        "unit_codes": f"SELECT l_orderkey, number, unit, {unit_map} AS code FROM (SELECT l_orderkey, {number} AS number, {unit} AS unit FROM {case('l_orderkey', QUANTITIES, 'lineitem')})",
        "hs_codes": f"SELECT p_partkey, CASE WHEN regexp_matches(t, {hs}) THEN regexp_extract(t, {hs}, 1) || '.' || regexp_extract(t, {hs}, 2) || CASE WHEN regexp_extract(t, {hs}, 3) <> '' THEN '-' || regexp_extract(t, {hs}, 3) ELSE '' END END AS hs FROM (SELECT p_partkey, upper(trim(text)) AS t FROM {case('p_partkey', HS_CODES, 'part')})",
        "price_terms": f"SELECT o_orderkey, CASE WHEN list_contains({sql.lst(s.INCOTERMS)}, c) THEN c END AS code, CASE WHEN list_contains({sql.lst(s.INCOTERMS)}, c) THEN nullif(regexp_replace(regexp_replace(rest, '\\s*\\(\\s*INCOTERMS\\s*[0-9]{{4}}\\s*\\)\\s*$', ''), '^[ ,]+|[ ,]+$', '', 'g'), '') END AS place FROM (SELECT o_orderkey, {code} AS c, regexp_extract(upper(text), {price}, 4) AS rest FROM {case('o_orderkey', PRICES, 'orders')})",
        "party_suffix": f"SELECT c_custkey, nullif(raw, '') AS as_is, CASE WHEN raw <> '' THEN array_to_string(list_transform(regexp_extract_all(raw, '{terms.SUFFIX}'), lambda t: {forms}), ', ') END AS to_be FROM (SELECT c_custkey, {suffix} AS raw FROM {case('c_custkey', PARTIES, 'customer')})",
        "container_check": f"SELECT p_partkey, digit, digit = p_partkey % 10 AS valid FROM (SELECT p_partkey, CAST(list_sum(list_transform(range(1, 11), lambda i: ({value}) * CAST(pow(2, i - 1) AS BIGINT))) % 11 % 10 AS INTEGER) AS digit FROM (SELECT p_partkey, 'MSKU' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part))",
        "tier_lookup": f"WITH {GLOSSARY} SELECT * FROM h",
        "tier_decision": f"WITH {GLOSSARY} SELECT s_suppkey, key, count(*) AS n, CASE WHEN count(*) = 1 THEN 'apply' ELSE 'choice' END AS outcome, CASE WHEN count(*) = 1 THEN min(term) END AS term FROM h GROUP BY s_suppkey, key",
        "gram_dice_topk": f"""WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_brand) AS text FROM part), k AS (SELECT text, ' ' || {key} || ' ' AS p FROM n), g AS (SELECT text, unnest({grams3}) AS gram FROM k),
 c AS (SELECT text, gram, count(*) AS c FROM g GROUP BY ALL), t AS (SELECT text, sum(c) AS n FROM c GROUP BY text),
 j AS (SELECT a.text AS query, b.text AS term, sum(least(a.c, b.c)) AS common FROM c a JOIN c b ON a.gram = b.gram GROUP BY ALL),
 z AS (SELECT query, term, round(2.0 * CAST(common AS DOUBLE) / CAST(x.n + y.n AS DOUBLE), 6) AS score FROM j JOIN t x ON x.text = query JOIN t y ON y.text = term)
 SELECT * FROM (SELECT query, term, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, term) AS place FROM z WHERE score >= 0.55) WHERE place <= 5""",
        "phrase_scan": "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\b(idiot|clown|pathetic|worthless)\\b')) AS BIGINT) AS n_whole, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS n_part FROM documents",
        "span_overlap": """WITH s AS (SELECT DISTINCT user_id AS g, CAST(event_id * 7 % 400 AS BIGINT) AS a, CAST(event_id * 7 % 400 + event_id * 3 % 23 AS BIGINT) AS b FROM events), l AS (SELECT g, list({'a': a, 'b': b} ORDER BY a - b, a, b) AS f FROM s WHERE a < b GROUP BY g),
 k AS (SELECT g, unnest(list_reduce(f, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t.a < x.b AND x.a < t.b)) = 0 THEN list_append(acc, x) ELSE acc END, f[1:0])) AS x FROM l) SELECT g AS "group", x.a AS "start", x.b AS "end" FROM k""",
        "apply_spans": "SELECT p_partkey, '<X>' || substr(p_name, instr(p_name, ' '), length(p_name) - instr(p_name, ' ')) || '!' AS text FROM part",
        "token_jaccard": f"SELECT p_partkey, round(len(list_intersect({x}, {y}))::DOUBLE / len({both}), 6) AS jaccard, round(len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})), 6) AS overlap FROM {pairs}",
        "levenshtein_ratio": f"SELECT p_partkey, round(CASE WHEN a = b THEN 0.0 ELSE levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS ratio FROM {pairs}",
        "trigram_sim": f"SELECT p_partkey, round(len(list_intersect({tri('lower(a)')}, {tri('lower(b)')}))::DOUBLE / len(list_distinct(list_concat({tri('lower(a)')}, {tri('lower(b)')}))), 6) AS similarity FROM {pairs}",
        "parse_dates": "SELECT o_orderkey, text, " + sql.day("text") + " AS day FROM (SELECT o_orderkey, upper(CASE o_orderkey % 14 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(STRFTIME)) + " END) AS text FROM orders)",
        "parse_quantities": f"SELECT l_orderkey, round({sql.quantity('text', 'KG')}, 4) AS kg, round({sql.quantity('text', 'CBM')}, 4) AS cbm, round({sql.amount('text')}, 4) AS amount FROM {case('l_orderkey', QUANTITIES, 'lineitem')}",
        "mt700_fields": f"""SELECT o_orderkey, """ + ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in ("lc_no", "expiry_date", "latest_shipment_date", "currency", "amount", "tolerance_pct", "partial_shipment", "transhipment", "port_of_loading", "port_of_discharge", "description_of_goods", "applicant", "beneficiary", "documents", "presentation_days", "max_gross_weight_kg", "max_measurement_cbm", "incoterms", "bl_consignment", "consignee", "notify_party")) + f""", error FROM (SELECT o_orderkey, {tag('20')} AS lc_no, CAST(try_strptime('20' || {tag('31D', '([0-9]{6})')}, '%Y%m%d') AS DATE) AS expiry_date, CAST(try_strptime('20' || {tag('44C', '([0-9]{6})')}, '%Y%m%d') AS DATE) AS latest_shipment_date,
 nullif(regexp_extract({amount}, '^([A-Z]{{3}})\\s*[0-9.,]+', 1), '') AS currency,
 TRY_CAST(CASE WHEN {digits} LIKE '%.%' THEN replace({digits}, ',', '') WHEN regexp_matches({digits}, ',[0-9]{{0,2}}$') THEN replace({digits}, ',', '.') ELSE replace({digits}, ',', '') END AS DOUBLE) AS amount,
 CASE {tag('39A')} WHEN '10/05' THEN 5.0 WHEN '5,5' THEN 5.5 END::DOUBLE AS tolerance_pct, CASE {tag('43P')} WHEN 'NOT ALLOWED' THEN 'PROHIBITED' WHEN 'ALLOWED' THEN 'ALLOWED' END AS partial_shipment, 'PROHIBITED' AS transhipment,
 'BUSAN' AS port_of_loading, CAST(NULL AS VARCHAR) AS port_of_discharge, 'SAW MACHINE SPARE PARTS' || CASE WHEN o_orderkey % 3 = 0 THEN ' CIF' ELSE '' END AS description_of_goods,
 'HANWOO TRADING' AS applicant, 'GAE WOON CO., LTD.' AS beneficiary, 'SIGNED INVOICE|' || CASE k WHEN 0 THEN 'FULL SET B/L MADE OUT TO ORDER NOTIFY APPLICANT' WHEN 1 THEN 'BILL OF LADING CONSIGNED TO DHHJ BANK.' WHEN 2 THEN 'BILL OF LADING, NOTIFY PARTY: TRY ENERGY.' ELSE 'PACKING LIST' END AS documents,
 21 AS presentation_days, CASE k WHEN 0 THEN 1000.0 WHEN 1 THEN 2000.0 END::DOUBLE AS max_gross_weight_kg, CASE k WHEN 0 THEN 350.0 END::DOUBLE AS max_measurement_cbm,
 CASE WHEN k = 1 THEN 'FOB' WHEN k = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'CIF' END AS incoterms, CASE k WHEN 0 THEN 'TO_ORDER' END AS bl_consignment, CASE k WHEN 1 THEN 'DHHJ BANK' END AS consignee, CASE k WHEN 0 THEN 'HANWOO TRADING' WHEN 2 THEN 'TRY ENERGY' END AS notify_party,
 CASE WHEN o_orderkey % 50 = 49 THEN 'no tags' END AS error FROM (SELECT o_orderkey, o_orderkey % 4 AS k, {MESSAGE} AS m FROM orders))""",
        "text_numbers": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS BIGINT) AS n_numbers FROM documents",
    }
