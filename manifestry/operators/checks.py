"""Checks of one shipment: each a column expression with the outcome pass, violated, format_error or not_evaluated.

The order of the guards is part of the meaning: a missing credit term first, then a missing document value
(which only ``required`` counts against the shipment).  Fields are looked up by name in the wide shipment row that
``prepare`` makes, credit terms with the prefix ``lc_``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .catalog import Rule

PASS, VIOLATED, FORMAT_ERROR, NOT_EVALUATED = "pass", "violated", "format_error", "not_evaluated"
PREPAID_TERMS = ["CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP"]  # fixed value


DATE_FIELDS = ("on_board_date", "date_of_issue", "lc_latest_shipment_date", "lc_expiry_date")


def prepare(shipments: DataFrame) -> DataFrame:
    """Shipments with every text trimmed (blank: null) and the day of each date field in ``day_*``.

    The checks read these columns, so each field is cleaned and parsed once for the whole catalog.
    """
    kinds = dict(shipments.dtypes)
    clean = shipments.select(*(s.present(F.col(c)).alias(c) if kinds[c] == "string" and c != "held" else F.col(c) for c in shipments.columns))
    return clean.withColumns({f"day_{c}": s.parse_date(F.col(c)) for c in DATE_FIELDS})


def _day(rule: Rule) -> Column:
    """Day of the rule's first present field: null if that one can't be read."""
    out = F.lit(None).cast("date")
    for f in reversed(rule.fields):
        out = F.when(F.col(f).isNotNull(), F.col("day_" + f)).otherwise(out)
    return out


def outcome(status: Column, detail: Column | None = None) -> Column:
    detail = F.lit(None).cast("string") if detail is None else F.when(status == VIOLATED, detail.cast("string"))
    return F.struct(status.alias("status"), detail.alias("detail"))


def decide(*guards: tuple[Column, str], otherwise: Column) -> Column:
    """First guard that holds names the status, else ``otherwise`` (true: pass, false: violated)."""
    out = None
    for condition, status in guards:
        out = F.when(condition, status) if out is None else out.when(condition, status)
    last = F.when(otherwise, PASS).otherwise(VIOLATED)
    return last if out is None else out.otherwise(last)


def _value(rule: Rule) -> Column:
    return F.coalesce(*(F.col(f) for f in rule.fields)) if rule.fields else F.lit(None).cast("string")


def _term(rule: Rule) -> Column:
    return F.col("lc_" + rule.credit)


def required(rule: Rule) -> Column:
    if not rule.fields:
        return outcome(F.lit(NOT_EVALUATED))
    return outcome(F.when(_value(rule).isNotNull(), PASS).otherwise(VIOLATED))


def required_if_lc(rule: Rule) -> Column:
    return outcome(decide((_term(rule).isNull(), NOT_EVALUATED), otherwise=_value(rule).isNotNull()))


def _both(rule: Rule) -> tuple:
    return (_term(rule).isNull(), NOT_EVALUATED), (_value(rule).isNull(), NOT_EVALUATED)


def match_place(rule: Rule) -> Column:
    return outcome(decide(*_both(rule), otherwise=s.places_match(_value(rule), _term(rule))))


def contains_keywords(rule: Rule) -> Column:
    wanted = F.filter(F.transform(F.split(F.upper(_term(rule)), ","), lambda k: F.trim(k)), lambda k: k != "")
    missing = F.filter(wanted, lambda k: ~F.contains(F.upper(_value(rule)), k))
    return outcome(decide(*_both(rule), otherwise=F.size(missing) == 0), F.array_join(missing, ", "))


def date_not_after(rule: Rule) -> Column:
    day, limit = _day(rule), F.col("day_lc_" + rule.credit)
    return outcome(decide(*_both(rule), (day.isNull() | limit.isNull(), FORMAT_ERROR), otherwise=day <= limit), F.datediff(day, limit))


def presentation_before_expiry(rule: Rule) -> Column:
    expiry = F.col("day_lc_" + rule.credit)
    return outcome(decide((_term(rule).isNull(), NOT_EVALUATED), (expiry.isNull(), FORMAT_ERROR), otherwise=F.col("as_of") <= expiry), F.datediff("as_of", expiry))


def presentation_period(rule: Rule) -> Column:
    day = _day(rule)
    return outcome(decide((_value(rule).isNull(), NOT_EVALUATED), (day.isNull(), FORMAT_ERROR), otherwise=F.col("as_of") <= F.date_add(day, F.col("lc_presentation_days"))), F.datediff("as_of", day))


def date_not_in_future(rule: Rule) -> Column:
    day = _day(rule)
    return outcome(decide((_value(rule).isNull(), NOT_EVALUATED), (day.isNull(), FORMAT_ERROR), otherwise=day <= F.col("as_of")), F.datediff(day, "as_of"))


def numeric_not_above(rule: Rule) -> Column:
    limit, amount = F.col("lc_" + rule.credit), s.parse_quantity(_value(rule), rule.unit)
    return outcome(decide((limit.isNull(), NOT_EVALUATED), (_value(rule).isNull() | amount.isNull(), NOT_EVALUATED), otherwise=amount <= limit), F.round(amount, 4))


def within_tolerance(rule: Rule) -> Column:
    target, amount, share = F.col("lc_" + rule.credit), s.parse_amount(_value(rule)), F.col("lc_tolerance_pct") / 100
    return outcome(decide((target.isNull(), NOT_EVALUATED), (_value(rule).isNull() | amount.isNull(), NOT_EVALUATED), otherwise=amount.between(target * (1 - share), target * (1 + share))))


def forbidden_when_prohibited(rule: Rule) -> Column:
    text = F.upper(F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in rule.fields)))
    found = F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in rule.keywords))
    return outcome(decide((F.coalesce(F.upper(_term(rule)), F.lit("")) != "PROHIBITED", NOT_EVALUATED), (F.trim(text) == "", NOT_EVALUATED), otherwise=found.isNull()), found)


def contains_forbidden(rule: Rule) -> Column:
    hits = []
    for f in rule.fields:
        value = F.col(f)
        # one pattern asks for all keywords; only a text that holds one is asked for each
        excused = s.has_word(value, "(?:" + "|".join(rule.unless) + ")") if rule.unless else F.lit(False)
        some = s.has_word(value, "(?:" + "|".join(rule.keywords) + ")") & ~excused
        hits.append(F.when(some, F.coalesce(*(F.when(s.has_word(value, k), F.lit(k)) for k in rule.keywords))))
    found = F.coalesce(*hits)
    return outcome(decide((_value(rule).isNull(), NOT_EVALUATED), otherwise=found.isNull()), found)


def on_board_required(rule: Rule) -> Column:
    clauses, day = (F.col(f) for f in rule.fields)
    received = F.coalesce(F.upper(clauses).rlike(r"RECEIVED\s+(?:IN\s+APPARENT\s+GOOD\s+ORDER\s+)?FOR\s+SHIPMENT"), F.lit(False))
    return outcome(decide((~received, NOT_EVALUATED), otherwise=day.isNotNull()))


def freight_prepaid_required(rule: Rule) -> Column:
    prepaid = F.coalesce(F.substring(F.upper(_term(rule)), 1, 3).isin(PREPAID_TERMS), F.lit(False))
    collect = reduce(lambda a, b: a | b, (F.coalesce(s.has_word(F.col(f), "COLLECT"), F.lit(False)) for f in rule.fields))
    return outcome(decide((~prepaid, NOT_EVALUATED), (_value(rule).isNull(), NOT_EVALUATED), otherwise=~collect))


def consignment_required(rule: Rule) -> Column:
    return outcome(decide((F.coalesce(F.upper(_term(rule)), F.lit("")) != "TO_ORDER", NOT_EVALUATED), (_value(rule).isNull(), NOT_EVALUATED), otherwise=F.upper(_value(rule)).rlike(r"\bTO\s+(?:THE\s+)?ORDER\b")))


def contains_incoterms(rule: Rule) -> Column:
    term = F.upper(_term(rule))
    base = F.when(F.substring(term, 1, 3).isin(s.INCOTERMS), F.substring(term, 1, 3)).otherwise(term)
    return outcome(decide(*_both(rule), otherwise=F.contains(F.upper(_value(rule)), base)))


def documents_required(rule: Rule) -> Column:
    """The list is one text, its items separated by semicolons."""
    return outcome(decide((_term(rule).isNull(), NOT_EVALUATED), otherwise=F.contains(F.upper(_term(rule)), F.lit("BILL OF LADING")) | F.upper(_term(rule)).rlike(r"\bB/?L\b")))


REGISTRY: dict[str, Callable[[Rule], Column]] = {
    f.__name__: f
    for f in (
        required, required_if_lc, match_place, contains_keywords, date_not_after, presentation_before_expiry, presentation_period,
        date_not_in_future, numeric_not_above, within_tolerance, forbidden_when_prohibited, contains_forbidden, on_board_required,
        freight_prepaid_required, consignment_required, contains_incoterms, documents_required,
    )
}
