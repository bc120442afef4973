"""The whole feature vector of a shipment, by groups, in one fixed order under a schema version.

Missing is NaN, never 0: a rule that could not be judged, documents that cannot be compared, a date that isn't there. A
group that is left out is all NaN, so a vector always has the same length. All is a projection of the shipment's row.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .catalog import RULES, Rule
from .checks import NOT_EVALUATED, PASS, VIOLATED
from .review import classify_conditions
from .verdict import HELD, is_bad

SCHEMA_VERSION = "fs-2"
# The rules that are features, weights of severities, limits of confidence, party names and deadlines.
RULE_FEATURES: tuple[Rule, ...] = tuple(r for r in RULES if r.id <= "D018")
SEVERITY_WEIGHTS = {"critical": 3, "warning": 2, "info": 1}
REQUIRED_BELOW, RECOMMENDED_BELOW, MISMATCH_ABOVE, LATE_AFTER, CHECKED_FIELDS = 0.70, 0.90, 0.15, 21, 7
CONFLICT_ABOVE, ALIKE_FROM = 0.10, 0.5
SOURCES = {"text_pdf": "pdf", "scan": "scan", "json": "json", "manual": "manual"}
NAN = float("nan")


def _or_nan(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(NAN))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _rules() -> dict[str, Column]:
    """1 violated, 0 passed, NaN skipped or held; then counts, weights and the fields that violations name."""
    at = {r.id: F.get("outcomes", F.lit(i)) for i, r in enumerate(RULE_FEATURES)}
    skipped = lambda r: r["status"].isin(NOT_EVALUATED, HELD)
    bad = F.col("bad")
    of = lambda severity: F.size(F.filter(bad, lambda r: r["severity"] == severity)).cast("double")
    fields = F.array(*(F.when(is_bad(at[r.id]), F.array(*map(F.lit, r.fields)) if r.fields else F.array().cast("array<string>")) for r in RULE_FEATURES))
    total = lambda seq, value: F.aggregate(seq, F.lit(0.0), lambda a, r: a + value(r))
    ranked = lambda r: F.coalesce(*(F.when(r["severity"] == k, float(v)) for k, v in SEVERITY_WEIGHTS.items()))
    return {f"rv_{i}": F.when(r["status"] == VIOLATED, 1.0).when(r["status"] == PASS, 0.0).otherwise(F.lit(NAN)) for i, r in at.items()} | {
        "rv_critical_count": of("critical"), "rv_warning_count": of("warning"), "rv_info_count": of("info"), "rv_severity_weighted_sum": total(bad, ranked), "rv_weight_sum": total(bad, lambda r: r["weight"]),
        "rv_distinct_field_count": F.size(F.array_distinct(F.flatten(F.array_compact(fields)))).cast("double"), "rv_any_critical": _flag(of("critical") > 0),
        "rv_skipped_count": F.size(F.filter("outcomes", skipped)).cast("double"), "rv_skipped_critical_count": F.size(F.filter("outcomes", lambda r: skipped(r) & (r["severity"] == "critical"))).cast("double"),
    }


def _documents() -> dict[str, Column]:
    ratios = F.col("ratios")
    mean = F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x), F.size(ratios))
    apart = lambda a, b: _or_nan(s.deviation_ratio(F.col(a), F.col(b)))
    return {
        "dc_max_edit_distance_ratio": _or_nan(F.array_max(ratios)), "dc_mean_edit_distance_ratio": _or_nan(mean), "dc_qty_deviation_ratio": apart("bl_qty", "packing_qty"), "dc_weight_deviation_ratio": apart("bl_weight", "packing_weight"),
        "dc_amount_deviation_ratio": apart("invoice_amount", "computed_amount"), "dc_conflict_field_count": F.col("conflict_fields").cast("double"), "dc_party_name_mismatch_count": F.size(F.filter(ratios, lambda r: r > MISMATCH_ABOVE)).cast("double"),
    }


def _ratios() -> Column:
    pairs = F.filter("party_pairs", lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    return F.transform(pairs, lambda p: s.levenshtein_ratio(F.upper(F.trim(p["a"])), F.upper(F.trim(p["b"]))))


#: What several features of a group read: worked out once, in columns of their own.
SHARED = {"RULE_VIOLATION": {"bad": lambda: F.filter("outcomes", is_bad)}, "DOC_CONSISTENCY": {"ratios": _ratios}}


def _extraction() -> dict[str, Column]:
    sure = F.coalesce(F.map_values("confidences"), F.array().cast("array<double>"))
    some = lambda c: F.size(F.filter(sure, c)).cast("double")
    checked = F.when(F.coalesce("checked_fields", F.lit(0)) > 0, F.col("checked_fields")).otherwise(CHECKED_FIELDS)
    return {
        "eq_mean_confidence": _or_nan(F.try_divide(F.aggregate(sure, F.lit(0.0), lambda a, x: a + x), F.size(sure))), "eq_min_confidence": _or_nan(F.array_min(sure)),
        "eq_required_check_count": some(lambda c: c < REQUIRED_BELOW), "eq_recommend_check_count": some(lambda c: (c >= REQUIRED_BELOW) & (c < RECOMMENDED_BELOW)), "eq_missing_field_count": F.size("missing_fields").cast("double"),
        "eq_no_evidence_ratio": F.size("no_evidence_fields") / checked,
    } | {f"eq_src_{name}": _flag(F.col("source").eqNullSafe(value)) for name, value in SOURCES.items()}


def _credit() -> dict[str, Column]:
    there = F.col("credit").isNotNull()
    known = lambda c: F.when(there, _or_nan(c)).otherwise(F.lit(NAN))
    of = lambda name: F.col("credit")[name]
    text = F.coalesce(of("conditions_47a"), F.lit(""))
    flag = lambda name: known(_flag(F.coalesce(of(name), F.lit(False))))
    return {
        "lc_required_doc_count": known(of("required_documents")), "lc_47a_char_length": known(F.length(text)), "lc_47a_condition_count": known(F.size(F.filter(F.split(text, ";"), lambda c: F.trim(c) != ""))), "lc_has_special_clause": flag("special_clause"),
        "lc_is_transferable": flag("transferable"), "lc_partial_shipment_allowed": flag("partial_allowed"), "lc_transshipment_allowed": flag("transshipment_allowed"), "lc_amount_tolerance_pct": known(of("tolerance_pct")), "lc_absent": _flag(~there),
    }


def _margins() -> dict[str, Column]:
    """Days from one date to another; all count from the dates of the documents, never from today."""
    shown = F.datediff("presentation_date", "onboard_date")
    return {
        "tm_days_to_expiry": _or_nan(F.datediff("credit_expiry", "onboard_date")), "tm_days_onboard_to_presentation": _or_nan(shown),
        "tm_presentation_period_remaining_ratio": _or_nan(F.when(F.col("presentation_days") != 0, (F.col("presentation_days") - shown) / F.col("presentation_days"))),
        "tm_days_issue_to_onboard": _or_nan(F.datediff("onboard_date", "bl_issue_date")), "tm_is_over_21d": _or_nan(F.when(shown.isNotNull(), _flag(shown > LATE_AFTER))),
    }


def _history() -> dict[str, Column]:
    n = F.coalesce("counterparty_shipments", F.lit(0))
    rate = lambda c: F.when(n == 0, F.lit(NAN)).otherwise(_or_nan(F.col(c)))
    return {
        "hist_counterparty_defect_rate": rate("counterparty_rate"), "hist_bank_defect_rate": rate("bank_rate"), "hist_cargo_type_defect_rate": rate("cargo_rate"),
        "hist_counterparty_shipment_count": n.cast("double"), "hist_is_cold_start": _flag(n == 0),
    }


#: Names of the semantic group and where in the struct ``semantic`` they stand; the last says whether there is one at all.
SEMANTIC = {
    "llm_47a_verifiable_ratio": "verifiable_ratio", "llm_47a_unverifiable_count": "unverifiable_count", "llm_goods_semantic_equiv": "goods", "llm_goods_invoice_semantic_equiv": "goods_invoice",
    "llm_party_semantic_equiv_min": "party_min", "llm_doc_conflict_count": "conflicts", "llm_lc_complexity_score": "complexity",
}


def _semantic() -> dict[str, Column]:
    return {name: _or_nan(F.col("semantic")[at]) for name, at in SEMANTIC.items()} | {"llm_available": _flag(F.col("semantic").isNotNull())}


GROUPS = {
    "RULE_VIOLATION": _rules, "DOC_CONSISTENCY": _documents, "EXTRACTION_QUALITY": _extraction, "LC_COMPLEXITY": _credit, "TIME_MARGIN": _margins, "HISTORY": _history, "LLM_SEMANTIC": _semantic,
}
MODEL_ONLY = tuple(g for g in GROUPS if g != "RULE_VIOLATION")
_NAMES = {
    "RULE_VIOLATION": [f"rv_{r.id}" for r in RULE_FEATURES] + [f"rv_{n}" for n in ("critical_count", "warning_count", "info_count", "severity_weighted_sum", "weight_sum", "distinct_field_count", "any_critical", "skipped_count", "skipped_critical_count")],
    "DOC_CONSISTENCY": [f"dc_{n}" for n in ("max_edit_distance_ratio", "mean_edit_distance_ratio", "qty_deviation_ratio", "weight_deviation_ratio", "amount_deviation_ratio", "conflict_field_count", "party_name_mismatch_count")],
    "EXTRACTION_QUALITY": [f"eq_{n}" for n in ("mean_confidence", "min_confidence", "required_check_count", "recommend_check_count", "missing_field_count", "no_evidence_ratio")] + [f"eq_src_{n}" for n in SOURCES],
    "LC_COMPLEXITY": [f"lc_{n}" for n in ("required_doc_count", "47a_char_length", "47a_condition_count", "has_special_clause", "is_transferable", "partial_shipment_allowed", "transshipment_allowed", "amount_tolerance_pct", "absent")],
    "TIME_MARGIN": [f"tm_{n}" for n in ("days_to_expiry", "days_onboard_to_presentation", "presentation_period_remaining_ratio", "days_issue_to_onboard", "is_over_21d")],
    "HISTORY": [f"hist_{n}" for n in ("counterparty_defect_rate", "bank_defect_rate", "cargo_type_defect_rate", "counterparty_shipment_count", "is_cold_start")],
    "LLM_SEMANTIC": [*SEMANTIC, "llm_available"],
}
NAMES = [n for names in _NAMES.values() for n in names]


def fingerprint(names: list[str] = NAMES, version: str = SCHEMA_VERSION) -> str:
    """What a model and its vectors have to agree on: the version, and the names in their order."""
    return hashlib.sha256(json.dumps([version, names]).encode()).hexdigest()


def features(rows: DataFrame, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """shipment_id and a column for each feature of the groups.

    ``rows``: shipment_id, outcomes (``verdict.judged`` by RULE_FEATURES), party_pairs (array of structs a, b), bl_qty,
    packing_qty, bl_weight, packing_weight, invoice_amount, computed_amount, conflict_fields, confidences (map), missing_fields,
    no_evidence_fields (arrays), checked_fields, source, credit (struct, null without one), credit_expiry, onboard_date,
    bl_issue_date, presentation_date, presentation_days, counterparty_rate, bank_rate, cargo_rate, counterparty_shipments and
    semantic (struct, null without one).
    """
    made = {name: c for g in groups for name, c in GROUPS[g]().items()}
    shared = {name: c() for g in groups for name, c in SHARED.get(g, {}).items()}
    return rows.withColumns(shared).select("shipment_id", *(made[n].alias(n) for n in NAMES if n in made))


def vectorized(rows: DataFrame, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """shipment_id, fingerprint and ``vector``, all features in their order; those of other groups are NaN."""
    some = features(rows, groups)
    vector = F.array(*(F.col(n) if n in some.columns else F.lit(NAN) for n in NAMES))
    return some.select("shipment_id", F.lit(fingerprint()).alias("fingerprint"), vector.alias("vector"))


def semantic(rows: DataFrame) -> DataFrame:
    """rows with the struct ``semantic``, worked out from the texts alone; nothing is asked of a model.

    ``rows``: bl_goods, invoice_goods, bl_consignee, invoice_consignee, bl_qty, packing_qty, bl_weight, packing_weight,
    invoice_amount, computed_amount and credit.  What two blank texts or a missing credit leave open is null.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit("([A-Z0-9]+)"), 1))
    known = lambda a, b, c: F.when((text(a) != "") | (text(b) != ""), c)
    both = lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(s.overlap_share(a, b), F.lit(0.0)))
    apart = lambda a, b: F.coalesce((s.deviation_ratio(F.col(a), F.col(b)) > CONFLICT_ABOVE).cast("int"), F.lit(0))
    low = lambda c: F.coalesce((c < ALIKE_FROM).cast("int"), F.lit(0))
    # the texts' words and what is read more than once stand in columns of their own, each worked out once
    texts = ("bl_goods", "invoice_goods", "bl_consignee", "invoice_consignee")
    w = {c: F.col(f"words_{c}") for c in texts}
    terms = F.coalesce(F.col("credit")["conditions_47a"], F.lit(""))
    told = rows.withColumns({f"words_{c}": words(c) for c in texts} | {"kinds": F.when(F.col("credit").isNotNull(), classify_conditions(terms))})
    told = told.withColumns({
        "alike_goods": known("bl_goods", "invoice_goods", s.jaccard(w["bl_goods"], w["invoice_goods"])), "alike_party": known("bl_consignee", "invoice_consignee", s.jaccard(w["bl_consignee"], w["invoice_consignee"])),
    })
    goods, party, kinds = F.col("alike_goods"), F.col("alike_party"), F.col("kinds")
    share = known("bl_goods", "invoice_goods", both(w["bl_goods"], w["invoice_goods"]))
    conflicts = low(goods) + low(party) + apart("bl_qty", "packing_qty") + apart("bl_weight", "packing_weight") + apart("invoice_amount", "computed_amount")
    n = F.size(F.filter(F.split(terms, ";"), lambda c: F.trim(c) != ""))
    complexity = F.when(F.col("credit").isNotNull(), 0.5 * F.least(n / 6, F.lit(1.0)) + 0.5 * F.least(F.length(terms) / 800, F.lit(1.0)))
    return told.withColumn("semantic", F.struct(
        kinds["verifiable_ratio"].alias("verifiable_ratio"), kinds["n_unverifiable"].alias("unverifiable_count"), goods.alias("goods"), share.alias("goods_invoice"), party.alias("party_min"),
        conflicts.alias("conflicts"), complexity.alias("complexity"),
    )).drop(*(f"words_{c}" for c in texts), "kinds", "alike_goods", "alike_party")
