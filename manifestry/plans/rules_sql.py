"""The rule catalog in DuckDB's SQL, written apart from the column expressions that it is held against."""

from __future__ import annotations

from ..functions import scalars as s
from ..operators.catalog import RULES, CrossRule, Rule


def lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def nv(c: str) -> str:
    return f"nullif(trim({c}), '')"


def first(fields) -> str:
    return f"coalesce({', '.join(map(nv, fields))})" if fields else "CAST(NULL AS VARCHAR)"


def sig(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(upper({x}), '[A-Z]+')), lambda t: NOT list_contains({lst(s.LEGAL_SUFFIXES)}, t))"


def goods(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(upper({x}), '[A-Z0-9]{{2,}}')), lambda t: NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({lst(s.GOODS_STOPWORDS)}, t))"


def syn(tokens: str) -> str:
    groups = "[" + ", ".join(lst(g) for g in s.PORT_SYNONYMS) + "]"
    return f"list_concat({tokens}, flatten(list_filter({groups}, lambda g: list_has_any(g, {tokens}))))"


STRPTIME = ["%Y-%m-%d", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%d-%b-%Y", "%d-%B-%Y"]


def day(x: str) -> str:
    clean = f"upper(regexp_replace({nv(x)}, '\\s+', ' ', 'g'))"
    return "CAST(coalesce(" + ", ".join(f"try_strptime({clean}, '{f}')" for f in STRPTIME) + ") AS DATE)"


def number(x: str) -> str:
    return f"TRY_CAST(replace(nullif({x}, ''), ',', '') AS DOUBLE)"


def amount(x: str) -> str:
    return number(f"regexp_extract({x}, '([0-9,]+\\.?[0-9]*)', 1)")


def quantity(x: str, unit: str) -> str:
    if unit == "KG":
        a, b = f"regexp_extract(upper({x}), '([0-9,]+\\.?[0-9]*)\\s*KGS?\\b', 1)", f"regexp_extract(upper({x}), '([0-9,]+\\.?[0-9]*)\\s*(?:MT|M\\.T\\.)\\b', 1)"
        return f"(CASE WHEN {a} <> '' THEN {number(a)} ELSE {number(b)} * 1000 END)"
    if unit == "CBM":
        return number(f"regexp_extract(upper({x}), '([0-9,]+\\.?[0-9]*)\\s*(?:CBM|M3)\\b', 1)")
    return amount(x)


def word(x: str, k: str) -> str:
    return f"regexp_matches(upper({x}), '\\b{k}\\b')"


def check(r: Rule) -> tuple[str, str]:
    """(status, detail of a violation) as SQL expressions over table s."""
    v, t = first(r.fields), f"nullif(CAST(lc_{r.credit} AS VARCHAR), '')" if r.credit else "NULL"
    ne_t, ne_v = f"WHEN {t} IS NULL THEN 'not_evaluated'", f"WHEN {v} IS NULL THEN 'not_evaluated'"
    case = lambda guards, ok: f"CASE {guards} WHEN {ok} THEN 'pass' ELSE 'violated' END"
    null = "CAST(NULL AS VARCHAR)"
    if r.check == "required":
        return case("", f"{v} IS NOT NULL"), null
    if r.check == "required_if_lc":
        return case(ne_t, f"{v} IS NOT NULL"), null
    if r.check == "match_place":
        core = sig(f"split_part({t}, ',', 1)")
        wanted = f"(CASE WHEN len({core}) > 0 THEN {core} ELSE {sig(t)} END)"
        return case(f"{ne_t} {ne_v}", f"len({sig(t)}) = 0 OR len(list_intersect({wanted}, {syn(sig(v))})) >= 0.6 * len({wanted})"), null
    if r.check == "contains_keywords":
        missing = f"list_filter(list_transform(string_split(upper({t}), ','), lambda k: trim(k)), lambda k: k <> '' AND NOT contains(upper({v}), k))"
        return case(f"{ne_t} {ne_v}", f"len({missing}) = 0"), f"array_to_string({missing}, ', ')"
    if r.check == "date_not_after":
        return case(f"{ne_t} {ne_v} WHEN {day(v)} IS NULL OR {day(t)} IS NULL THEN 'format_error'", f"{day(v)} <= {day(t)}"), f"CAST({day(v)} - {day(t)} AS VARCHAR)"
    if r.check == "presentation_before_expiry":
        return case(f"{ne_t} WHEN {day(t)} IS NULL THEN 'format_error'", f"as_of <= {day(t)}"), f"CAST(as_of - {day(t)} AS VARCHAR)"
    if r.check == "presentation_period":
        return case(f"{ne_v} WHEN {day(v)} IS NULL THEN 'format_error'", f"as_of <= {day(v)} + lc_presentation_days"), f"CAST(as_of - {day(v)} AS VARCHAR)"
    if r.check == "date_not_in_future":
        return case(f"{ne_v} WHEN {day(v)} IS NULL THEN 'format_error'", f"{day(v)} <= as_of"), f"CAST({day(v)} - as_of AS VARCHAR)"
    if r.check == "numeric_not_above":
        q = quantity(v, r.unit)
        return case(f"{ne_t} WHEN {q} IS NULL THEN 'not_evaluated'", f"{q} <= lc_{r.credit}"), f"CAST(round({q}, 4) AS VARCHAR)"
    if r.check == "within_tolerance":
        return case(f"{ne_t} WHEN {amount(v)} IS NULL THEN 'not_evaluated'", f"{amount(v)} BETWEEN lc_{r.credit} * (1 - lc_tolerance_pct / 100) AND lc_{r.credit} * (1 + lc_tolerance_pct / 100)"), null
    if r.check == "forbidden_when_prohibited":
        text = "upper(" + " || ' ' || ".join(f"coalesce({nv(f)}, '')" for f in r.fields) + ")"
        found = "coalesce(" + ", ".join(f"CASE WHEN contains({text}, '{k}') THEN '{k}' END" for k in r.keywords) + ")"
        return case(f"WHEN coalesce(upper({t}), '') <> 'PROHIBITED' THEN 'not_evaluated' WHEN trim({text}) = '' THEN 'not_evaluated'", f"{found} IS NULL"), found
    if r.check == "contains_forbidden":
        hits = []
        for f in r.fields:
            excuse = " OR ".join(word(nv(f), u) for u in r.unless) or "false"
            hits += [f"CASE WHEN {word(nv(f), k)} AND NOT ({excuse}) THEN '{k}' END" for k in r.keywords]
        found = f"coalesce({', '.join(hits)}, NULL)"
        return case(ne_v, f"{found} IS NULL"), found
    if r.check == "on_board_required":
        return case("WHEN NOT coalesce(regexp_matches(upper(" + nv(r.fields[0]) + "), 'RECEIVED\\s+(?:IN\\s+APPARENT\\s+GOOD\\s+ORDER\\s+)?FOR\\s+SHIPMENT'), false) THEN 'not_evaluated'", f"{nv(r.fields[1])} IS NOT NULL"), null
    if r.check == "freight_prepaid_required":
        collect = " OR ".join(f"coalesce({word(nv(f), 'COLLECT')}, false)" for f in r.fields)
        return case(f"WHEN NOT coalesce(list_contains(['CFR','CIF','CPT','CIP','DAP','DPU','DDP'], substr(upper({t}), 1, 3)), false) THEN 'not_evaluated' {ne_v}", f"NOT ({collect})"), null
    if r.check == "consignment_required":
        return case(f"WHEN coalesce(upper({t}), '') <> 'TO_ORDER' THEN 'not_evaluated' {ne_v}", f"regexp_matches(upper({v}), '\\bTO\\s+(?:THE\\s+)?ORDER\\b')"), null
    if r.check == "contains_incoterms":
        base = f"(CASE WHEN list_contains({lst(s.INCOTERMS)}, substr(upper({t}), 1, 3)) THEN substr(upper({t}), 1, 3) ELSE upper({t}) END)"
        return case(f"{ne_t} {ne_v}", f"contains(upper({v}), {base})"), null
    if r.check == "documents_required":
        return case(ne_t, f"contains(upper({t}), 'BILL OF LADING') OR regexp_matches(upper({t}), '\\bB/?L\\b')"), null
    raise KeyError(r.check)


def one_check(r: Rule) -> str:
    status, detail = check(r)
    return f"SELECT shipment_id, status, CASE WHEN status = 'violated' THEN detail END AS detail FROM (SELECT shipment_id, {status} AS status, {detail} AS detail FROM s)"


def facts_cte() -> str:
    """CTE f: the facts of all rules."""
    parts = []
    for r in RULES:
        status, detail = check(r)
        held = f"list_has_any(string_split(held, ','), {lst(r.fields)})" if r.fields else "false"
        parts.append(f"SELECT shipment_id, '{r.id}' AS rule_id, CASE WHEN {held} THEN 'held' ELSE {status} END AS raw, {detail} AS detail0, '{r.severity}' AS severity0, {r.weight!r}E0 AS weight0 FROM s")
    return (
        "f0 AS (" + " UNION ALL ".join(parts) + "), f AS (SELECT shipment_id, rule_id, CASE WHEN raw = 'format_error' THEN 'violated' ELSE raw END AS status, "
        "CASE WHEN raw = 'format_error' THEN 'warning' ELSE severity0 END AS severity, CASE WHEN raw = 'format_error' THEN 0.1E0 ELSE weight0 END AS weight, "
        "CASE WHEN raw = 'violated' THEN detail0 END AS detail FROM f0)"
    )


PREFIX = {"bl": "", "invoice": "inv_", "packing": "pack_", "credit": "cr_"}


def cross_check(r: CrossRule) -> str:
    a, b = nv(PREFIX[r.left[0]] + r.left[1]), nv(PREFIX[r.right[0]] + r.right[1])
    case = lambda guard, ok: f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {guard} THEN 'not_evaluated' WHEN {ok} THEN 'pass' ELSE 'violated' END"
    if r.check == "same_party":
        x, y = sig(a), sig(b)
        return case(f"len({x}) = 0 OR len({y}) = 0", f"len(list_intersect({x}, {y})) >= 0.6 * least(len({x}), len({y}))")
    if r.check == "goods_compatible":
        x, y = goods(a), goods(b)
        generic = lambda z: f"len(list_filter({z}, lambda t: NOT list_contains({lst(s.GENERIC_GOODS)}, t))) = 0"
        return case(f"len({x}) = 0 OR len({y}) = 0 OR {generic(x)} OR {generic(y)}", f"len(list_intersect({x}, {y})) >= 0.5 * least(len({x}), len({y}))")
    if r.check == "same_quantity":
        x, y = quantity(a, r.unit), quantity(b, r.unit)
        return case(f"{x} IS NULL OR {y} IS NULL", f"abs({x} - {y}) / greatest(abs({x}), abs({y}), 1e-9) <= 0.005")
    if r.check == "same_reference":
        x, y = (f"regexp_replace(upper({z}), '[^\\p{{L}}\\p{{N}}]', '', 'g')" for z in (a, b))
        return case(f"{x} = '' OR {y} = ''", f"{x} = {y}")
    if r.check == "amount_not_above":
        return case(f"{amount(a)} IS NULL OR {amount(b)} IS NULL", f"{amount(a)} <= {amount(b)} * 1.005E0")
    raise KeyError(r.check)
