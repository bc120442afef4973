"""Fields of a bill of lading from the text of their regions: noise taken out, the right line chosen, parts told apart.

Every cleaner is a column expression over one text of several lines, null if it finds nothing; a null or blank text
gives null. Nothing shuffles, so all fields of a page are one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as s

# Words of a form's own headings, patterns of what is looked for and of what gets in between, lengths.
HEADINGS = [
    "BILL OF LADING", "MULTIMODAL", "NEGOTIABLE", "NON-NEGOTIABLE", "FIATA", "WIFFA", "WAYBILL", "COMBINED TRANSPORT", "THROUGH BILL", "STRAIGHT BILL", "OCEAN CARRIER", "SEA WAYBILL", "SURRENDER",
    "ORIGINAL", "COPY", "SEAWAY", "FREIGHT FORWARDER", "CONSIGNOR/SHIPPER", "CONSIGNOR", "SHIPPER",
]
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
DATE = rf"(?i)\b(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{1,2}}\s+(?:{MONTHS})\s+[0-9]{{4}}|(?:{MONTHS})\s+[0-9]{{1,2}}[,.]?\s+[0-9]{{4}}|[0-9]{{2}}-(?:{MONTHS})-[0-9]{{4}})\b"
BL_NO = r"\b([A-Z]{2,8}[0-9]{4,12})\b"
CARGO_CODE, LONGEST_BL_NO = "DLSU", 16
WEIGHT = r"(?i)([0-9,]+\.?[0-9]*)\s*(KGS?|KG|MT|M\.T\.|METRIC\s*TONS?)"
VOLUME = r"(?i)([0-9,]+\.?[0-9]*)\s*(CBM|M3|CU\.?\s*M)"
AMOUNT = r"\$\s*([0-9,]+\.?[0-9]*)"
INCOTERM = r"\b(?:EXW|FCA|FAS|FOB|CFR|CIF|CPT|CIP|DAP|DPU|DDP)\b[^\n]{0,30}"
ORIGINALS = r"(?i)\b(?:ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)\s*\([0-9]+\)"
PORT_NOISE = r"(?i)\b(?:CY|CFS|FCL|LCL|VIA|TRANSIT|THRU)(?:[/\-]\w+)?\b"
VESSEL_NOISE = r"(?i)\b(?:CFS|CY|FCL|LCL)(?:[/\-]\w+)?\b"
CONTACT = r"(?i)(?:TEL|FAX|T\)|F\)|PHONE|MOBILE)[^\n]*"
LEGAL_FORM = r"(?i)CO\.|LTD\.|INC\.|CORP\.|LLC|GMBH|PTE\.|PVT\."
PACKED = r"PKG|PCS|CTNS?|ROLLS?|SETS?|BAGS?|BUNDLES?"
MOST = {"party": 150, "port": 80, "goods": 200, "place": 80, "incoterms": 40, "originals": 20, "vessel_words": 4, "same_goods": 30}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def bare(c: Column) -> Column:
    """Without white space and commas at both ends."""
    return strip(F.regexp_replace(strip(c), "^,+|,+$", ""))


def _lines(text: Column, by: str = "\n") -> Column:
    return F.filter(F.transform(F.split(text, by), strip), lambda x: x != "")


def _one_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def _first(of: Column) -> Column:
    return F.get(of, F.lit(0))


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bl_no(text: Column) -> Column:
    """The first number of a bill that is no code of the cargo and not too long."""
    return _first(F.filter(F.regexp_extract_all(text, F.lit(BL_NO), 1), lambda n: (F.length(n) <= LONGEST_BL_NO) & ~n.startswith(CARGO_CODE)))


def is_heading(line: Column) -> Column:
    """A form's heading, not a value; but a consignment to order is a value, whoever it names."""
    return ~F.contains(F.upper(line), F.lit("TO ORDER")) & F.exists(s.words(HEADINGS), lambda w: F.contains(F.upper(line), w))


def party_name(text: Column) -> Column:
    """The first line that names a legal form, else the first that is longer than three characters; headings, contacts and
    the code of a number in front are left out."""
    lines = F.filter(_lines(F.regexp_replace(text, CONTACT, ""), r"\n|(?<=\.)\s{2,}"), lambda x: ~is_heading(x))
    clean = lambda x: strip(F.regexp_replace(x, r"^[A-Z]{2}[0-9]{6,}\s+", ""))

    def chosen(lines: Column) -> Column:
        legal = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(LEGAL_FORM)), clean), lambda x: x != "")
        other = F.filter(F.transform(lines, clean), lambda x: F.length(x) > 3)
        return F.substring(F.coalesce(_first(legal), _first(other)), 1, MOST["party"])

    return s.bound(lines, chosen)


def port_name(text: Column) -> Column:
    """The first line with a comma, else the first of all, once totals, numbers of originals, quantities and kinds of carriage are out."""
    kept = F.filter(_lines(text), lambda x: ~x.rlike(r"(?i)^(?:TOTAL|SAY|[0-9]+\s*PKG|[0-9]+\s*KG)") & ~x.rlike(r"(?i)^(?:ONE|TWO|THREE|FOUR|FIVE|SIX)\s*\([0-9]+\)"))
    clean = lambda x: bare(_one_space(F.regexp_replace(F.regexp_replace(x, PORT_NOISE, ""), r"(?i)[0-9][0-9,.]*\s*(?:KGS?|KG|CBM|M3)\b", "")))
    names = F.filter(F.transform(kept, clean), lambda x: F.length(x) > 2)
    return s.bound(names, lambda n: F.substring(F.coalesce(_first(F.filter(n, lambda x: F.contains(x, F.lit(",")))), _first(n)), 1, MOST["port"]))


def goods(text: Column) -> Column:
    """The lines before the total, without codes, numbers of packages and quantities; of lines that begin alike the first."""

    def before_total(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)^TOTAL\b")), True)
        return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)

    def item(line: Column) -> Column:
        packed = F.regexp_replace(F.regexp_replace(line, rf"(?i)^[0-9]+\s*(?:{PACKED})\s+", ""), r"(?i),?\s*[0-9][0-9,.]*\s*(?:KGS?|KG|CBM|M3)\b.*$", "")
        packed = F.regexp_replace(strip(packed), ",+$", "")
        return F.when(line.rlike(rf"(?i)^[0-9]+\s*(?:{PACKED})\b"), F.when(F.length(packed) > 2, packed)).otherwise(line)

    def unlike(items: Column) -> Column:
        begins = F.transform(items, lambda x: F.substring(F.upper(x), 1, MOST["same_goods"]))
        return s.bound(begins, lambda b: F.filter(items, lambda x, i: F.array_position(b, F.get(b, i)) == i + 1))

    coded = F.filter(s.bound(_lines(text), before_total), lambda x: ~x.rlike(r"(?i)^[A-Z]{1,4}[0-9]{5,}\s*$"))
    items = F.array_compact(F.transform(coded, lambda x: item(F.regexp_replace(x, r"(?i)^[A-Z]{1,4}[0-9]{5,}\s+", ""))))
    return _found(F.substring(F.array_join(s.bound(items, unlike), " / "), 1, MOST["goods"]))


def _total(text: Column, pattern: str) -> Column:
    """What the pattern finds on the first line of a total that has it, else its last occurrence."""
    on_total = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: strip(x).rlike(r"(?i)^TOTAL\b")), lambda x: F.regexp_extract(x, pattern, 0)), lambda x: x != "")
    return F.coalesce(_first(on_total), F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 0), F.lit(-1)))


def total_weight(text: Column) -> Column:
    return s.bound(_total(text, WEIGHT), lambda m: F.when(m.isNotNull(), F.concat(F.regexp_extract(m, WEIGHT, 1), F.lit(" "), F.upper(F.regexp_extract(m, WEIGHT, 2)))))


def total_volume(text: Column) -> Column:
    return s.bound(_total(text, VOLUME), lambda m: F.when(m.isNotNull(), F.concat(F.regexp_extract(m, VOLUME, 1), F.lit(" CBM"))))


_SHIP = r"(?i)(?:M/?V|S/?S|VESSEL|OCEAN\s+VESSEL)\s+([A-Z][A-Z\s\-.]+?)(?:\s+V\.?\s*(\w+))?$"
_SLASHED = r"(?i)^(.+?)\s*/\s*([A-Z0-9\-]{2,10})$"
_VOYAGE = r"\bV\.?(\w+)\b"


def vessel_voyage(text: Column) -> Column:
    """Struct (vessel, voyage): behind the word for a ship; or parted by a slash; or up to four words before the V."""
    out = lambda vessel, voyage: F.struct(_found(strip(vessel)).alias("vessel"), _found(strip(voyage)).alias("voyage"))

    def of(line: Column) -> Column:
        voyage = F.regexp_extract(line, _VOYAGE, 0)
        head = F.when(voyage != "", F.substr(line, F.lit(1), F.instr(line, voyage) - 1)).otherwise(line)
        words = F.array_join(F.slice(_lines(head, " "), 1, MOST["vessel_words"]), " ")
        return (
            F.when(line.rlike(_SHIP), out(F.regexp_extract(line, _SHIP, 1), F.regexp_extract(line, _SHIP, 2)))
            .when(line.rlike(_SLASHED), out(F.regexp_extract(line, _SLASHED, 1), F.regexp_extract(line, _SLASHED, 2))).otherwise(out(words, voyage))
        )

    return s.bound(_one_space(F.regexp_replace(text, VESSEL_NOISE, "")), of)


def vessel(text: Column) -> Column:
    """The vessel; where only a voyage is read the text itself, so that the voyage isn't lost."""
    return s.bound(vessel_voyage(text), lambda v: F.coalesce(v["vessel"], F.when(v["voyage"].isNotNull(), F.substring(strip(text), 1, 100))))


def voyage(text: Column) -> Column:
    return vessel_voyage(text)["voyage"]


def place_of_issue(text: Column) -> Column:
    """The first run of capitals that is left without dates and contacts."""
    place = F.regexp_extract(_one_space(F.regexp_replace(F.regexp_replace(text, DATE, ""), CONTACT, "")), r"([A-Z][A-Z\s,.]+)", 1)
    return s.bound(F.regexp_replace(strip(place), "^,+|,+$", ""), lambda p: F.when(F.length(p) > 2, F.substring(p, 1, MOST["place"])))


def incoterms(text: Column) -> Column:
    return _found(F.substring(_one_space(F.regexp_extract(text, INCOTERM, 0)), 1, MOST["incoterms"]))


def originals(text: Column) -> Column:
    return _found(F.substring(F.upper(_one_space(F.regexp_extract(text, ORIGINALS, 0))), 1, MOST["originals"]))


def freight(text: Column) -> Column:
    return s.bound(F.regexp_extract(text, AMOUNT, 1), lambda a: F.when(a != "", F.concat(F.lit("$"), a)))


#: Which regions a field is read from, put together by what stands between, and by which cleaner.
FIELDS: dict[str, tuple[tuple[str, ...], str, Callable[[Column], Column]]] = {
    "bl_no": (("bl_no", "header"), " ", bl_no), "shipper": (("shipper",), "", party_name), "consignee": (("consignee",), "", party_name), "notify_party": (("notify",), "", party_name),
    "vessel": (("vessel_info",), "", vessel), "voyage_no": (("vessel_info",), "", voyage), "port_of_loading": (("port_left",), "", port_name), "port_of_discharge": (("port_right",), "", port_name),
    "description_of_goods": (("cargo",), "", goods), "gross_weight": (("cargo", "weight"), "\n", total_weight), "measurement": (("cargo", "measurement"), "\n", total_volume),
    "place_of_issue": (("footer",), "", place_of_issue), "total_freight": (("freight",), "", freight), "incoterms": (("freight",), "", incoterms), "no_of_original_bl": (("footer",), "", originals),
}


def fields(regions: Column) -> list[Column]:
    """A column for each field from a map of region to text; a region that isn't there is empty."""
    text = lambda names, between: F.concat_ws(between, *(F.coalesce(F.try_element_at(regions, F.lit(n)), F.lit("")) for n in names))
    return [clean(text(names, between)).alias(field) for field, (names, between, clean) in FIELDS.items()]
