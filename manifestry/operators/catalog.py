"""The rule catalogs: what is checked, how badly it weighs, and on which fields."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

SEVERITIES = ("critical", "warning", "info")


@dataclass(frozen=True)
class Rule:
    id: str
    check: str
    severity: str
    weight: float
    fields: tuple[str, ...] = ()
    credit: str = ""  # field of the credit, or the flag, that the check compares with
    unit: str = ""
    keywords: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


@dataclass(frozen=True)
class CrossRule:
    id: str
    check: str
    severity: str
    weight: float
    left: tuple[str, str]  # document, field
    right: tuple[str, str]
    unit: str = field(default="")


def _r(id, check, severity, weight, fields="", credit="", unit="", keywords=(), unless=()) -> Rule:
    return Rule(id, check, severity, weight, tuple(fields.split()), credit, unit, tuple(keywords), tuple(unless))


# Ids, checks, severities, weights, fields and keywords define verdicts and scores.
RULES = (
    _r("D001", "required", "critical", 0.30, "bl_no"),
    _r("D002", "date_not_after", "critical", 0.40, "on_board_date date_of_issue", "latest_shipment_date"),
    _r("D003", "match_place", "critical", 0.35, "port_of_loading", "port_of_loading"),
    _r("D004", "match_place", "critical", 0.35, "port_of_discharge", "port_of_discharge"),
    _r("D005", "required", "critical", 0.30, "consignee"),
    _r("D005B", "match_place", "critical", 0.35, "consignee", "consignee"),
    _r("D006", "contains_keywords", "critical", 0.35, "description_of_goods", "description_of_goods"),
    _r("D007", "numeric_not_above", "critical", 0.30, "gross_weight", "max_gross_weight_kg", "KG"),
    _r("D007B", "numeric_not_above", "warning", 0.10, "measurement", "max_measurement_cbm", "CBM"),
    _r("D008", "presentation_before_expiry", "critical", 0.40, "date_of_issue", "expiry_date"),
    _r("D009", "required", "warning", 0.10, "shipper"),
    _r("D010", "required_if_lc", "critical", 0.25, "notify_party", "notify_party"),
    _r("D011", "required", "critical", 0.30, "vessel"),
    _r("D012", "required", "critical", 0.30, "port_of_loading"),
    _r("D012B", "required", "critical", 0.30, "port_of_discharge"),
    _r("D013", "forbidden_when_prohibited", "critical", 0.35, "description_of_goods", "partial_shipment", keywords=("PARTIAL SHIPMENT", "PART SHIPMENT", "1ST SHIPMENT", "2ND SHIPMENT", "FIRST SHIPMENT", "SECOND SHIPMENT")),
    _r("D014", "forbidden_when_prohibited", "warning", 0.15, "description_of_goods port_of_loading port_of_discharge", "transhipment", keywords=("TRANSHIPMENT", "TRANSSHIPMENT", "TRANSIT")),
    _r("D015", "contains_incoterms", "warning", 0.08, "incoterms description_of_goods", "incoterms"),
    _r("D016", "documents_required", "info", 0.02, "", "documents"),
    _r("D017", "within_tolerance", "critical", 0.30, "total_freight", "freight_amount"),
    _r("D018", "presentation_period", "critical", 0.30, "on_board_date date_of_issue", "presentation_days"),
    _r("D019", "date_not_in_future", "critical", 0.35, "date_of_issue"),
    _r("D020", "match_place", "warning", 0.12, "notify_party", "notify_party"),
    _r("D021", "required", "warning", 0.08, "place_of_issue"),
    _r("D022", "required", "critical", 0.30, "date_of_issue"),
    _r("D023", "contains_forbidden", "critical", 0.35, "description_of_goods", keywords=("DAMAGED", "BROKEN", "TORN", "STAINED", "SOILED", "LEAKING", "RUSTY", "SHORT SHIPPED", "INSUFFICIENT PACKING", "INADEQUATE PACKING")),
    _r("D024", "contains_forbidden", "warning", 0.12, "vessel", keywords=("INTENDED",)),
    _r("D025", "contains_forbidden", "critical", 0.30, "port_of_loading port_of_discharge", keywords=("ANY PORT", "ANY PORTS", "MAIN PORT", "MAIN PORTS", "EUROPEAN PORT", "EUROPEAN PORTS", "ASIAN PORT", "ASIAN PORTS", "CONTINENTAL PORT", "CONTINENTAL PORTS")),
    _r("D026", "freight_prepaid_required", "warning", 0.12, "total_freight description_of_goods", "incoterms"),
    _r("D027", "consignment_required", "critical", 0.35, "consignee", "bl_consignment"),
    _r("D028", "contains_forbidden", "critical", 0.35, "bl_clauses", keywords=("CHARTER PARTY", "SUBJECT TO CHARTER")),
    _r("D029", "contains_forbidden", "critical", 0.35, "bl_clauses", keywords=("SHIPPED ON DECK", "LADEN ON DECK", "STOWED ON DECK", "LOADED ON DECK", "CARRIED ON DECK"), unless=("MAY BE CARRIED ON DECK", "MAY BE STOWED ON DECK", "MAY BE LOADED ON DECK")),
    _r("D030", "on_board_required", "critical", 0.35, "bl_clauses on_board_date"),
    _r("D031", "contains_forbidden", "critical", 0.35, "bl_clauses", keywords=("ALTERED", "CORRECTION", "CORRECTED", "AMENDED"), unless=("AUTHENTICATED", "AUTHENTICATION", "INITIALLED")),
    _r("D032", "required", "critical", 0.30, "no_of_original_bl"),
)
CROSS_RULES = (
    CrossRule("X001", "same_party", "critical", 0.35, ("bl", "consignee"), ("invoice", "buyer")),
    CrossRule("X002", "same_party", "warning", 0.12, ("bl", "shipper"), ("invoice", "seller")),
    CrossRule("X003", "goods_compatible", "critical", 0.35, ("bl", "description_of_goods"), ("invoice", "description_of_goods")),
    CrossRule("X004", "goods_compatible", "warning", 0.12, ("invoice", "description_of_goods"), ("packing", "description_of_goods")),
    CrossRule("X005", "same_quantity", "critical", 0.30, ("bl", "gross_weight"), ("packing", "gross_weight"), "KG"),
    CrossRule("X006", "same_quantity", "warning", 0.10, ("bl", "measurement"), ("packing", "measurement"), "CBM"),
    CrossRule("X007", "same_reference", "warning", 0.12, ("invoice", "invoice_no"), ("packing", "invoice_no")),
    CrossRule("X008", "same_reference", "warning", 0.12, ("invoice", "lc_no"), ("credit", "lc_no")),
    CrossRule("X009", "amount_not_above", "critical", 0.40, ("invoice", "total_amount"), ("credit", "currency_amount")),
    CrossRule("X010", "same_reference", "warning", 0.12, ("invoice", "incoterms"), ("credit", "incoterms")),
)
#: A violation for an unreadable value counts as a warning of this weight.
FORMAT_ERROR_WEIGHT = 0.10
#: Checks that compare for equality, and so tie two fields together in the impact graph.
EQUALITY_CHECKS = ("match_place", "within_tolerance", "same_party", "goods_compatible", "same_quantity", "same_reference")


def problems(rules: tuple, known_checks: set[str]) -> list[str]:
    """All that is wrong with a catalog at once: repeated ids, unknown checks or severities, weights off 0..1."""
    out, seen = [], set()
    for r in rules:
        if r.id in seen:
            out.append(f"{r.id}: repeated id")
        seen.add(r.id)
        if r.check not in known_checks:
            out.append(f"{r.id}: unknown check {r.check}")
        if r.severity not in SEVERITIES:
            out.append(f"{r.id}: unknown severity {r.severity}")
        if not 0 <= r.weight <= 1:
            out.append(f"{r.id}: weight {r.weight} is not in 0..1")
    return out


def fingerprint(rules: tuple) -> str:
    """Twelve hex digits that change with any rule, but not with the order in which they are written down."""
    text = json.dumps(sorted((asdict(r) for r in rules), key=lambda r: r["id"]), sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:12]
