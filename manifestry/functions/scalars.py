"""Scalar functions on columns: text, tokens, dates, quantities, codes and grades."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They define results and are stated as they are.
PORT_SYNONYMS = [
    ["BUSAN", "PUSAN"], ["INCHEON", "INCHON"], ["GUANGZHOU", "CANTON"], ["MUMBAI", "BOMBAY"], ["CHENNAI", "MADRAS"],
    ["KOLKATA", "CALCUTTA"], ["BEIJING", "PEKING"], ["TROMSOE", "TROMSO"], ["JEDDAH", "JEDDA"],
]
LEGAL_SUFFIXES = ["CO", "LTD", "INC", "CORP", "LLC", "GMBH", "PTE", "PVT", "LIMITED", "COMPANY", "CORPORATION", "AG", "SA", "BV", "NV"]
#: In order: the first pattern that reads a date wins, so month-day-year comes before day-month-year.
DATE_PATTERNS = [
    "yyyy-M-d", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d-MMM-yyyy", "d-MMMM-yyyy",
]
INCOTERMS = ["EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP"]
GOODS_STOPWORDS = [
    "PKG", "PKGS", "PACKAGE", "PACKAGES", "CTN", "CTNS", "CARTON", "CARTONS", "PALLET", "PALLETS", "CASE", "CASES", "BOX", "BOXES",
    "UNIT", "UNITS", "TOTAL", "SAY", "ONLY", "AND", "THE", "OF", "IN", "TO", "ITEM", "ITEMS", "NET", "GROSS", "WEIGHT", "QTY",
    "QUANTITY", "STC", "SHIPPER", "SHIPPERS", "LOAD", "COUNT", "SEAL", "SEALED",
]
GENERIC_GOODS = [
    "MACHINERY", "MACHINE", "MACHINES", "PARTS", "SPARE", "COMPONENTS", "GOODS", "CARGO", "MERCHANDISE", "COMMODITY", "COMMODITIES",
    "EQUIPMENT", "MATERIALS", "MATERIAL", "PRODUCTS", "PRODUCE", "ARTICLES", "SUNDRIES", "GENERAL", "SAID", "CONTAIN", "CONTAINS",
]
MATCH_SHARE, GOODS_SHARE, QUANTITY_TOLERANCE = 0.6, 0.5, 0.005
GRADE_REQUIRED_BELOW, GRADE_RECOMMENDED_BELOW = 0.70, 0.90


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def present(c: Column) -> Column:
    """Trimmed; null if nothing is left.

    A text whose first and last characters are no white space (``!`` is the least that isn't) is taken as it is. Not
    ``nullif``, which Spark plans as a projection of the whole row below the one that asks for it.
    """
    text = c.cast("string")
    bare = F.btrim(text, F.lit(" \t\n\r\f\x0b"))
    return F.when((text >= "!") & (F.substring(text, -1, 1) >= "!"), text).when(bare != "", bare)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*map(present, columns))


def significant_tokens(c: Column) -> Column:
    """Runs of A-Z in the upper-cased text, without company forms; each once."""
    return _tokens(F.upper(c))


def _runs(chars: str, least: str, without: list[str]) -> str:
    """A pattern for whole runs of the characters but those named: no set of words is built for each value."""
    return f"(?<!{chars})(?!(?:{'|'.join(without)})(?!{chars}))({chars}{least})"


def _tokens(upper: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(upper, F.lit(_runs("[A-Z]", "+", LEGAL_SUFFIXES)), 1))


def goods_tokens(c: Column) -> Column:
    """Runs of two or more of A-Z and 0-9 that aren't numbers, without packing words."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(_runs("[A-Z0-9]", "{2,}", ["[0-9]+", *GOODS_STOPWORDS])), 1))


def vague_goods(c: Column) -> Column:
    """Are there no goods tokens but generic ones?"""
    return ~F.upper(c).rlike(_runs("[A-Z0-9]", "{2,}", ["[0-9]+", *GOODS_STOPWORDS, *GENERIC_GOODS]))


def with_synonyms(upper: Column) -> Column:
    """The upper-cased text with all names of the ports in it, side by side."""
    whole = lambda names: f"(?<![A-Z])(?:{'|'.join(names)})(?![A-Z])"
    spelled = reduce(lambda text, group: F.regexp_replace(text, whole(group), " ".join(group)), PORT_SYNONYMS, upper)
    return F.when(upper.rlike(whole([n for group in PORT_SYNONYMS for n in group])), spelled).otherwise(upper)


def places_match(document: Column, credit: Column) -> Column:
    """At least 0.6 of the credit's tokens (before its first comma, if there are any) occur in the document."""
    core, names = significant_tokens(F.substring_index(credit, ",", 1)), _tokens(with_synonyms(F.upper(document)))
    among = lambda w: F.size(F.array_intersect(names, w)) >= MATCH_SHARE * F.size(w)
    return bound(core, lambda w: F.when(F.size(w) > 0, among(w)).otherwise(bound(significant_tokens(credit), among)))


def overlap_share(left: Column, right: Column) -> Column:
    """Common tokens against the smaller set; null if one is empty."""
    return F.try_divide(F.size(F.array_intersect(left, right)).cast("double"), F.least(F.size(left), F.size(right)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two sets: both empty are alike, one empty is nothing alike."""
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Edit distance against the longer text: 0 if equal, 1 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def date_shape(pattern: str) -> str:
    """What a text must look like for a date pattern: the parser is asked only then, as its refusals are dear."""
    if pattern == "yyyyMMdd":
        return "^[0-9]{8}$"
    out, parts = pattern, {"yyyy": "[0-9]{4}", "MMMM": "[A-Z]{3,9}", "MMM": "[A-Z]{3}", "M": "(?:0?[1-9]|1[0-2])", "d": "(?:0?[1-9]|[12][0-9]|3[01])"}
    for i, k in enumerate(parts):
        out = out.replace(k, f"<{i}>")
    for i, v in enumerate(parts.values()):
        out = out.replace(f"<{i}>", v)
    return f"^{out}$"


def parse_date(c: Column) -> Column:
    """The first pattern that reads the cleaned text; null if none does."""
    clean = F.upper(F.regexp_replace(present(c), r"\s+", " "))
    of = lambda x, ps: F.coalesce(*(F.when(x.rlike(date_shape(p)), F.try_to_timestamp(x, F.lit(p))) for p in ps))
    kinds: dict[str, list[str]] = {}
    for p in DATE_PATTERNS:  # by the character behind the leading digits, so that a text is held against few shapes
        kinds.setdefault("^[A-Z]" if p[0] == "M" and " " in p else "^[0-9]{1,4}" + next(ch for ch in p if ch in "-/ "), []).append(p)
    return bound(clean, lambda x: F.to_date(reduce(lambda out, kind: F.when(x.rlike(kind[0]), of(x, kind[1])).otherwise(out), reversed(kinds.items()), F.lit(None).cast("timestamp"))))


def to_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def parse_amount(c: Column) -> Column:
    """The first run of digits and commas with a fraction; null if it holds no digit."""
    return to_number(F.regexp_extract(c, r"([0-9,]+\.?[0-9]*)", 1))


def parse_quantity(c: Column, unit: str) -> Column:
    """Weight in KG (tonnes converted), volume in CBM, else any amount."""
    if unit == "KG":
        kilos = F.regexp_extract(F.upper(c), r"([0-9,]+\.?[0-9]*)\s*KGS?\b", 1)
        tonnes = F.regexp_extract(F.upper(c), r"([0-9,]+\.?[0-9]*)\s*(?:MT|M\.T\.)\b", 1)
        return F.when(kilos != "", to_number(kilos)).otherwise(to_number(tonnes) * 1000)
    if unit == "CBM":
        return to_number(F.regexp_extract(F.upper(c), r"([0-9,]+\.?[0-9]*)\s*(?:CBM|M3)\b", 1))
    return parse_amount(c)


def deviation_ratio(a: Column, b: Column) -> Column:
    """Difference against the larger size; 0 if both are 0, null if one is missing."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(most == 0, F.lit(0.0)).otherwise(F.abs(a - b) / most)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down (not calendar days)."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000)


def grade(value: Column, confidence: Column) -> Column:
    """undetected, required, recommended or confirmed; a value without confidence was confirmed by hand."""
    return (
        F.when(present(value).isNull(), "undetected").when(confidence.isNull(), "confirmed")
        .when(confidence < GRADE_REQUIRED_BELOW, "required").when(confidence < GRADE_RECOMMENDED_BELOW, "recommended").otherwise("confirmed")
    )


@cache
def _compatible() -> tuple[str, dict[str, str]]:
    """Characters whose compatibility form (NFKC) holds some that a key keeps: as a class for patterns, and their forms."""
    forms = {}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if not 0xD800 <= code < 0xE000 and (form := unicodedata.normalize("NFKC", ch)) != ch and re.search("[A-Z0-9가-힣.]", form.upper()):
            forms[ch] = form
    runs = []
    for code in map(ord, forms):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]", forms


def compatible(c: Column) -> Column:
    """Compatibility forms of single characters (full-width letters, units in one character, jamo) written out, as far
    as keys keep them; letters and marks that stand apart are put together to one that keys drop.  Only texts that
    hold such a character are taken apart; a text of ASCII letters alone, which has as many bytes as letters, is taken
    as it is, as the pattern of all such characters is dear."""
    some, forms = _compatible()
    # one literal for the whole table, so that a plan stays small however often a key is made
    table = F.str_to_map(F.lit("\x01".join(f"{ch}\x02{form}" for ch, form in forms.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(some), F.element_at(table, ch)).otherwise(ch)), "")
    whole = F.regexp_replace(F.when(c.rlike(some), spelled).otherwise(c), r"[A-Za-z][\u0300-\u036F]+", "\u00C0")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(whole)


def normalize_key(c: Column) -> Column:
    """Upper case of the compatibility forms, only A-Z, 0-9, Hangul and dots, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(compatible(c)), r"[^A-Z0-9가-힣.]", " "), " +", " "))


def loose_key(c: Column) -> Column:
    """The normalized key without dots and spaces."""
    return F.regexp_replace(F.upper(compatible(c)), r"[^A-Z0-9가-힣]", "")


def grams(key: Column, n: int = 3, left: int = 1, right: int = 1) -> Column:
    """Character n-grams of the padded key, repeats included; none for an empty key."""
    padded = F.concat(F.lit(" " * left), key, F.lit(" " * right))
    cut = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
    return F.when((F.length(key) > 0) & (F.length(padded) >= n), cut).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared against all different trigrams, two spaces before and one behind each text."""
    x, y = F.array_distinct(grams(a, 3, 2, 1)), F.array_distinct(grams(b, 3, 2, 1))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def container_check_digit(code: Column) -> Column:
    """Check digit of a container code's first ten characters; letters' values skip the multiples of eleven."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    powers = F.array(*(F.lit(1 << i) for i in range(10)))
    values = F.array(*(F.lit(v) for v in [n for n in range(10, 39) if n % 11][:26]))

    def add(acc: Column, i: Column) -> Column:
        ch = F.substr(code, i + 1, F.lit(1))
        value = F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.element_at(values, F.instr(F.lit(letters), ch)))
        return acc + value * F.element_at(powers, i + 1)

    return F.when(code.rlike("^[A-Z]{4}[0-9]{6}"), F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), add) % 11 % 10)


def has_word(c: Column, keyword: str) -> Column:
    return F.upper(c).rlike(rf"\b{keyword}\b")
