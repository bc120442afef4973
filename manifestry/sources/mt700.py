"""Documentary-credit messages (MT700): tags to typed credit terms, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s


def tags(message: Column) -> Column:
    """Map from tag to value; of a repeated tag the first counts. Only block 4 is read where there are blocks."""
    body = F.regexp_replace(message, "\r\n?", "\n")
    inner = s.bound(body, lambda b: s.bound(F.regexp_extract(b, r"(?s)\{4:(.*?)-\}", 1), lambda block: F.when(block != "", block).otherwise(F.regexp_replace(b, r"\{[0-9]:[^{}]*\}", ""))))

    def paired(text: Column) -> Column:
        # the text between two tags is cut once; each piece begins with its own tag
        return F.transform(F.split(text, r"(?m)^\s*(?=:[0-9]{2}[A-Z]?:)"), lambda p: F.struct(F.regexp_extract(p, "^:([0-9]{2}[A-Z]?):", 1).alias("tag"), F.regexp_replace(p, r"^:[0-9]{2}[A-Z]?:\s*|\s+$", "").alias("value")))

    def first(pairs: Column) -> Column:
        return s.bound(F.transform(pairs, lambda p: p["tag"]), lambda heads: F.filter(pairs, lambda p, i: (p["tag"] != "") & (F.array_position(heads, p["tag"]) == i + 1)))

    return F.map_from_entries(s.bound(s.bound(inner, paired), first))


def first_line(value: Column) -> Column:
    return F.trim(F.regexp_extract(value, r"^\s*([^\n]*)", 1))


def joined(value: Column) -> Column:
    """Lines, without the plus sign or dash that may lead them, as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"(?m)^\s*[+\-]\s*", ""), r"\s*\n\s*", " "))


def swift_date(value: Column) -> Column:
    """YYMMDD of this century, else any readable date; null if it isn't in the calendar."""
    head = first_line(value)
    six = F.regexp_extract(head, "^([0-9]{6})", 1)
    return F.when(six != "", F.to_date(F.try_to_timestamp(F.concat(F.lit("20"), six), F.lit("yyyyMMdd")))).otherwise(s.parse_date(head))


def swift_number(digits: Column) -> Column:
    """A comma with at most two digits behind it is a decimal point, else it parts thousands."""
    return (
        F.when(digits.endswith(","), F.regexp_replace(digits, ",$", "")).when(F.contains(digits, F.lit(".")) & F.contains(digits, F.lit(",")), F.replace(digits, F.lit(","), F.lit("")))
        .when(digits.rlike(",[0-9]{0,2}$"), F.regexp_replace(digits, ",([0-9]{0,2})$", ".$1")).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    ).try_cast("double")


def items(value: Column) -> Column:
    """Lines without their bullets; blank ones dropped."""
    return F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[+\-*]|[0-9]+[.)])\s*", ""))), lambda x: x != "")


def party(value: Column) -> Column:
    """The first line that is no account."""
    lines = F.filter(F.transform(F.split(value, "\n"), F.trim), lambda x: (x != "") & ~x.startswith("/"))
    return F.when(value.isNotNull(), F.coalesce(F.get(lines, F.lit(0)), F.lit("")))


def named(item: Column, pattern: str) -> Column:
    """What the pattern names in the item, without the dots behind it; null if nothing is left."""
    return F.nullif(F.rtrim(F.regexp_replace(F.trim(F.regexp_extract(item, pattern, 1)), r"\.+$", "")), F.lit(""))


def consignment(documents: Column, applicant: Column) -> Column:
    """Struct (bl_consignment, consignee, notify_party), from the first document asked for that is a bill of lading.

    To order or to a named consignee; "notify applicant" means the applicant's name.
    """
    item = F.get(F.filter(documents, lambda x: x.rlike(r"(?i)BILL OF LADING|\bB/?L\b")), F.lit(0))
    to_order = F.coalesce(item.rlike(r"(?i)\bTO\s+(?:THE\s+)?ORDER\b"), F.lit(False))
    to = F.coalesce(named(item, r"(?i)\bCONSIGNED\s+TO\s+(.+)"), named(item, r"(?i)\bMADE\s+OUT\s+TO\s+(.+)"))
    notify = named(item, r"(?i)\bNOTIFY\b\s*(?:PARTY|ADDRESS)?\s*[:\-]?\s*(.+)")
    return F.struct(
        F.when(to_order, "TO_ORDER").alias("bl_consignment"), F.when(~to_order, to).alias("consignee"),
        F.when(F.upper(notify) == "APPLICANT", F.coalesce(F.nullif(applicant, F.lit("")), notify)).otherwise(notify).alias("notify_party"),
    )


def limit(conditions: Column, word: str, unit: str) -> Column:
    """The last limit in the unit that a condition with the word states; metric tons count as tonnes."""
    stated = F.filter(conditions, lambda x: F.contains(F.upper(x), F.lit(word)) & x.rlike(r"(?i)\bMAX(?:IMUM)?\.?\b|\bNOT\s+(?:TO\s+)?EXCEED(?:ING)?\b"))
    if word == "MEASUREMENT":  # a line on the weight is read as that alone
        stated = F.filter(stated, lambda x: ~F.contains(F.upper(x), F.lit("GROSS WEIGHT")))
    read = F.filter(F.transform(stated, lambda x: s.parse_quantity(F.regexp_replace(x, r"(?i)\bM\.?\s?TONS?\b|\bMETRIC\s+TONS?\b", "MT"), unit)), lambda v: v.isNotNull())
    return F.when(F.size(read) > 0, F.element_at(read, -1))


def price_code(conditions: Column, goods: Column) -> Column:
    """The one trade term named in the further conditions, or else in the goods; none where several are."""
    codes = lambda text: F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\b(" + "|".join(s.INCOTERMS) + r")\b"), 1))
    one = lambda text: s.bound(codes(text), lambda c: F.struct((F.size(c) > 0).alias("any"), F.when(F.size(c) == 1, F.get(c, F.lit(0))).alias("code")))
    return s.bound(F.struct(one(conditions).alias("a"), one(goods).alias("b")), lambda x: F.when(x["a"]["any"], x["a"]["code"]).otherwise(x["b"]["code"]))


def permission(value: Column) -> Column:
    """The negative form is looked for first, as it holds the positive one."""
    v = F.upper(joined(value))
    return F.when(v.rlike(r"\bNOT\s+ALLOWED\b|\bNOT\s+PERMITTED\b|PROHIBIT"), "PROHIBITED").when(v.rlike(r"\bALLOWED\b|\bPERMITTED\b"), "ALLOWED")


def parse(messages: DataFrame, message: str = "message") -> DataFrame:
    """``messages`` with the credit's terms, and ``error``: a message without tags is no credit, and has none of them."""
    t = messages.withColumn("tags", tags(F.col(message)))
    of = lambda tag: F.try_element_at(F.col("tags"), F.lit(tag))
    amount = F.upper(first_line(of("32B")))
    tolerances = F.transform(F.regexp_extract_all(joined(of("39A")), F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), 1), lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))
    return t.select(
        *messages.columns, first_line(of("20")).alias("lc_no"), swift_date(of("31D")).alias("expiry_date"), swift_date(of("44C")).alias("latest_shipment_date"),
        F.nullif(F.regexp_extract(amount, r"^([A-Z]{3})\s*[0-9.,]+", 1), F.lit("")).alias("currency"), swift_number(F.regexp_extract(amount, r"^[A-Z]{3}\s*([0-9.,]+)", 1)).alias("amount"),
        F.array_min(tolerances).alias("tolerance_pct"), permission(of("43P")).alias("partial_shipment"), permission(of("43T")).alias("transhipment"),
        joined(of("44E")).alias("port_of_loading"), joined(of("44F")).alias("port_of_discharge"), joined(of("45A")).alias("description_of_goods"),
        party(of("50")).alias("applicant"), party(of("59")).alias("beneficiary"), items(of("46A")).alias("documents"), F.regexp_extract(joined(of("48")), "([0-9]+)", 1).try_cast("int").alias("presentation_days"),
        limit(items(of("47A")), "GROSS WEIGHT", "KG").alias("max_gross_weight_kg"), limit(items(of("47A")), "MEASUREMENT", "CBM").alias("max_measurement_cbm"),
        price_code(of("47A"), of("45A")).alias("incoterms"), F.when(F.coalesce(F.size("tags"), F.lit(0)) == 0, "no tags").alias("error"),
    ).withColumn("c", consignment(F.col("documents"), F.col("applicant"))).select("*", "c.*").drop("c")
