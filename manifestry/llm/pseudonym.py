"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Values are found by pattern and validated (card numbers by Luhn, IBANs by mod 97, dates by the calendar,
addresses by the range of their octets, social security numbers by the parts never given out); what doesn't hold
is left as it is.  Each value is then permuted within its own format by a keyed Feistel network, so that equal
values get equal pseudonyms in every document and different values of a format different ones.  A date with
slashes that is one both by month and day and by day and month is permuted among such dates, others among those
that can be read in their one way.  In the name of a mail address, letters of the scripts in SCRIPTS are permuted
among those of their range, a letter outside of them stays.

A null text stays null with 0 found; repeated rows are treated alike; an empty table gives an empty result;
other columns of the input, of whatever name, are kept as they are by ``pseudonymize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: The session setting that holds the key where the caller gives none.
KEY_SETTING = "spark.manifestry.pseudonym.key"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: At most 64 characters before the @, 63 in a label and 8 labels, so that no text makes the matcher recurse deeply.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,7}\.\p{L}{2,63}"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
PHONE = r"(?<![\p{L}0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![\p{L}0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![\p{L}0-9])(?:[0-9]{4}(?:([ .-])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![\p{L}0-9])"
SECRET = r"(?<![\p{L}0-9])[0-9A-Fa-f]{32,64}(?![\p{L}0-9])"
IBAN = r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}0-9])"
#: Eight groups, or fewer with one :: after the first, and a digit among them.
_GROUP = r"[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\p{{L}}0-9:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\p{{L}}0-9:])"
SSN = r"(?<![\p{L}0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}0-9-])"
DATE = r"(?<![\p{L}0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?!(?!T[0-9]{2}:)[\p{L}0-9])"
#: Whatever may be one of them; the order decides where two begin at the same place.
ANY = "|".join((EMAIL, IP, IPV6, DATE, SSN, PHONE, SECRET, CARD.replace(r"\1", "[ .-]").replace("([ .-])", "[ .-]"), IBAN))
_LETTERS, _BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: Days of the 400-year cycle of the calendar, as a product of two factors for an uneven Feistel network.
CYCLE, FACTORS = 146_097, (27, 5_411)
#: Days from the first of year 0 to that of 1970, and of year 0.
YEAR_ZERO, LEAP = 719_528, 366
# Fixed value: the codes of countries in the numbering plan, those of one or two digits before those of three.
COUNTRY_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Ranges of letters outside ASCII: the first code point, and two factors of how many follow from it.
SCRIPTS = (
    (0x4E00, 128, 164), (0xAC00, 98, 114),  # Han, Hangul
    (0x430, 4, 8), (0x410, 4, 8), (0x450, 4, 4), (0x400, 4, 4), (0x3B1, 5, 5),  # Cyrillic, Greek
    (0xE0, 1, 23), (0xF8, 2, 4), (0xC0, 1, 23), (0xD8, 2, 4), (0x100, 8, 16), (0x180, 13, 16), (0x1E00, 16, 16),  # Latin
    (0x3041, 2, 43), (0x30A1, 9, 10), (0x620, 1, 43), (0x5D0, 3, 9), (0x904, 6, 9), (0xE01, 6, 8),  # kana, Arabic, Hebrew, Devanagari, Thai
)


def _keyed(key: str, *parts: Column) -> Column:
    """48 bits of a keyed hash, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 12), 16, 10).cast("bigint")


def _network(left: Column, right: Column, m: Column, n: Column, key: str, *tweak: Column) -> Column:
    """Struct (l, r): a permutation of the pairs below (m, n). Rounds add a keyed hash of one side to the other."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["l"] + _keyed(key, *tweak, i, acc["r"])) % m).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + _keyed(key, *tweak, i, acc["l"])) % n).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), turn)


def _permute(x: Column, radix: int, key: str, tweak: Column) -> Column:
    """A string of digits of the radix (at most 2 x 12 of them at a time), permuted among those of its length."""
    width = 24
    powers = F.array(*(F.lit(radix**k) for k in range(width // 2 + 1)))

    def piece(i: Column) -> Column:
        s = F.substr(x, i * width + 1, F.lit(width))
        n = F.length(s)
        a = F.floor(n / 2).cast("int")
        b = n - a
        number = lambda t: F.coalesce(F.conv(t, radix, 10).cast("bigint"), F.lit(0).cast("bigint"))
        out = _network(number(F.substr(s, F.lit(1), a)), number(F.substr(s, a + 1, b)), F.element_at(powers, a + 1).cast("bigint"), F.element_at(powers, b + 1).cast("bigint"), key, tweak, n, i)
        text = lambda v, w: F.lpad(F.lower(F.conv(v.cast("string"), 10, radix)), w, "0")
        # the network runs once: its result is bound by a one-element array
        return F.element_at(F.transform(F.array(out), lambda o: F.concat(text(o["l"], a), text(o["r"], b))), 1)

    return F.when(F.length(x) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / width).cast("int")), piece), ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column, letters: Column) -> Column:
    """The value with its ASCII digits and letters taken in turn from the new ones; case and all else stay."""

    def put(acc: Column, ch: Column) -> Column:
        is_digit, is_letter = ch.rlike("^[0-9]$"), ch.rlike("^[A-Za-z]$")
        new = F.substring(acc["l"], 1, 1)
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(acc["d"], 1, 1)).when(is_letter, F.when(ch.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)).otherwise(ch)).alias("out"),
            F.when(is_digit, F.substr(acc["d"], F.lit(2))).otherwise(acc["d"]).alias("d"),
            F.when(is_letter, F.substr(acc["l"], F.lit(2))).otherwise(acc["l"]).alias("l"),
        )

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), digits.alias("d"), letters.alias("l")), put, lambda acc: acc["out"])


def _letters26(value: Column, key: str, tweak: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(value, "[^A-Za-z]", "")), "[^a-z]", "")
    return F.translate(_permute(F.translate(plain, _LETTERS, _BASE26), 26, key, tweak), _BASE26, _LETTERS)


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits (its last digit counts once): 0 modulo 10 for a valid number."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return acc + F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)).otherwise(F.lit(0))


def mod97(iban: Column) -> Column:
    """Remainder of the number that an IBAN stands for: 1 for a valid one."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def add(acc: Column, ch: Column) -> Column:
        v = F.conv(ch, 36, 10).cast("int")
        return F.when(ch == "", acc).when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    d = _digits(value)
    body = _permute(F.substr(d, F.lit(1), F.length(d) - 1), 10, key, F.lit("card"))
    full = F.element_at(F.transform(F.array(body), lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))), 1)
    return F.when(luhn_sum(d) % 10 == 0, _refill(value, full, F.lit(""))).otherwise(value)


def _iban(value: Column, key: str) -> Column:
    """Written together or in groups of four; one or two groups at the end that don't belong to it stay."""
    heads = F.array(value, *(F.regexp_replace(value, "(?: [A-Z0-9]{1,4}){%d}$" % n, "") for n in (1, 2)))
    valid = F.filter(heads, lambda head: mod97(F.replace(head, F.lit(" "), F.lit(""))) == 1)
    return F.coalesce(F.get(F.transform(valid, lambda head: F.concat(_iban_alone(head, key), F.substr(value, F.length(head) + 1))), F.lit(0)), value)


def _iban_alone(value: Column, key: str) -> Column:
    country, rest = F.substring(value, 1, 2), F.substr(F.replace(value, F.lit(" "), F.lit("")), F.lit(5))
    tweak = F.concat(F.lit("iban"), country)
    inner = _refill(rest, _permute(_digits(rest), 10, key, tweak), _letters26(rest, key, tweak))
    whole = F.transform(F.array(inner), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))
    return F.element_at(F.transform(whole, lambda new: F.when(value.contains(" "), F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)), 1)


def _day(value: Column, form: str) -> Column:
    return F.unix_date(F.to_date(F.try_to_timestamp(value, F.lit(form))))


#: Turns after which a walk has left the days up to the 12th: of all days of the cycle none needs as many but by a chance of 1e-16.
_WALK = 48


#: The same for the days of one year in 400.
_LEAVE = 7


def _cycled(day: Column, key: str, kind: str) -> Column:
    """The day permuted among the 400 years that it lies in; they are counted from year 0, so that years of four digits stay
    years of four digits. A day of year 0, which dates do not have, is permuted on."""

    def moved(day: Column) -> Column:
        at = F.pmod(day + YEAR_ZERO, F.lit(CYCLE))
        new = _network(F.floor(at / FACTORS[1]), at % FACTORS[1], F.lit(FACTORS[0]), F.lit(FACTORS[1]), key, F.lit(kind))
        return F.element_at(F.transform(F.array(new), lambda o: day - at + o["l"] * FACTORS[1] + o["r"]), 1)

    again = lambda d, turn: (turn == 0) | (d < LEAP - YEAR_ZERO)
    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEAVE)), day.cast("bigint"), lambda d, turn: F.when(again(d, turn) & d.isNotNull(), moved(d)).otherwise(d))


def _of_month(day: Column) -> Column:
    return F.dayofmonth(F.date_from_unix_date(day.cast("int")))


def _walked(day: Column, key: str, kind: str) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), day, lambda d, turn: F.when(d.isNull() | (_of_month(d) > 12), d).otherwise(_cycled(d, key, kind)))


def _date(value: Column, key: str) -> Column:
    outs = []
    for f, kind in (("yyyy-MM-dd", value.contains("-")), ("dd.MM.yyyy", value.contains("."))):
        new = _cycled(_day(value, f), key, "date")
        outs.append(F.when(kind, F.date_format(F.date_from_unix_date(new.cast("int")), f)))
    # with slashes: both parts up to 12, so that either may be the month, ...
    part = lambda i: F.split(value, "/").getItem(i).cast("bigint")
    year, pair = part(2), (part(0) - 1) * 12 + part(1) - 1
    moved = _network(year % 400, pair, F.lit(400), F.lit(144), key, F.lit("either"))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    either = F.element_at(F.transform(F.array(moved), lambda o: F.concat(two(F.floor(o["r"] / 12) + 1), F.lit("/"), two(o["r"] % 12 + 1), F.lit("/"), F.lpad((year - year % 400 + o["l"]).cast("string"), 4, "0"))), 1)
    slashes = value.contains("/")
    outs.append(F.when(slashes & part(0).between(1, 12) & part(1).between(1, 12), either))
    # ... or one of them above: permuted until the new day is above as well
    for f in ("MM/dd/yyyy", "dd/MM/yyyy"):
        walked = _walked(_cycled(_day(value, f), key, f), key, f)
        outs.append(F.when(slashes & _day(value, f).isNotNull(), F.date_format(F.date_from_unix_date(walked.cast("int")), f)))
    return F.coalesce(*outs, value)


def _ssn(value: Column, key: str) -> Column:
    """Permuted among those that may be given out: areas 001 to 899 but 666, no part all zeros."""
    part = lambda i: F.split(value, "-").getItem(i).cast("bigint")
    area = part(0) - 1 - (part(0) > 666).cast("bigint")
    moved = _network(area, (part(1) - 1) * 9999 + part(2) - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    digits = lambda v, n: F.lpad(v.cast("string"), n, "0")
    new = F.element_at(F.transform(F.array(moved), lambda o: F.concat_ws("-", digits(o["l"] + 1 + (o["l"] >= 665).cast("bigint"), 3), digits(F.floor(o["r"] / 9999) + 1, 2), digits(o["r"] % 9999 + 1, 4))), 1)
    ok = (part(0) > 0) & (part(0) < 900) & (part(0) != 666) & (part(1) > 0) & (part(2) > 0)
    return F.when(ok, new).otherwise(value)


def _ipv6(value: Column, key: str) -> Column:
    """Its hexadecimal digits are permuted, groups and colons stay; letters are written small."""
    digits = _permute(F.lower(F.replace(value, F.lit(":"), F.lit(""))), 16, key, F.concat(F.lit("ipv6"), F.regexp_replace(value, "[0-9A-Fa-f]", "x")))

    def put(acc: Column, ch: Column) -> Column:
        colon = (ch == ":") | (ch == "")
        return F.struct(F.concat(acc["out"], F.when(colon, ch).otherwise(F.substring(acc["d"], 1, 1))).alias("out"), F.when(colon, acc["d"]).otherwise(F.substr(acc["d"], F.lit(2))).alias("d"))

    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), digits.alias("d")), put, lambda acc: acc["out"])


def _other_letters(value: Column, key: str, tweak: Column) -> Column:
    """Each letter of SCRIPTS permuted within its range, by a permutation of its place in the value."""
    ranges = F.expr("array(" + ", ".join(f"named_struct('first', {f}L, 'm', {m}L, 'n', {n}L)" for f, m, n in SCRIPTS) + ")")

    def moved(ch: Column, i: Column) -> Column:
        def within(c: Column) -> Column:
            return F.transform(F.filter(ranges, lambda r: (c >= r["first"]) & (c < r["first"] + r["m"] * r["n"])), lambda r: put(c, r))

        def put(c: Column, r: Column) -> Column:
            new = _network(F.floor((c - r["first"]) / r["n"]), (c - r["first"]) % r["n"], r["m"], r["n"], key, tweak, r["first"], i)
            return F.element_at(F.transform(F.array(new), lambda o: F.decode(F.unhex(F.lpad(F.hex(o["l"] * r["n"] + o["r"] + r["first"]), 8, "0")), "UTF-32")), 1)

        code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint")
        return F.when(ch.rlike(r"^[\x00-\x7F]?$"), ch).otherwise(F.coalesce(F.get(F.flatten(F.transform(F.array(code), within)), F.lit(0)), ch))

    return F.when(value.rlike(r"^[\x00-\x7F]*$"), value).otherwise(F.array_join(F.transform(F.split(value, ""), moved), ""))


def _ip(value: Column, key: str) -> Column:
    part = lambda i: F.split(value, r"\.").getItem(i).cast("bigint")
    moved = _network(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    octets = lambda o: F.concat_ws(".", *(F.floor(o[s] / 256).cast("int") if high else (o[s] % 256).cast("int") for s in ("l", "r") for high in (True, False)))
    return F.element_at(F.transform(F.array(moved), octets), 1)


def _phone(value: Column, key: str) -> Column:
    """The digits of the country's code after a + stay. Numbers are the same however they are parted, and one without a + is
    taken as one of country 1, whose form it has."""
    digits = _digits(value)
    country = F.when(value.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 1)).otherwise(F.lit(""))
    tweak = F.concat(F.lit("phone"), F.when(country == "", F.lit("1")).otherwise(country))
    return _refill(value, F.concat(country, _permute(F.substr(digits, F.length(country) + 1), 10, key, tweak)), F.lit(""))


def _email(value: Column, key: str) -> Column:
    """The part before the @ is permuted, digits among digits and letters among letters of their script; the domain stays."""
    at = F.instr(value, "@")
    local, domain = F.substr(value, F.lit(1), at - 1), F.substr(value, at)
    tweak = F.concat(F.lit("email"), F.lower(domain))
    return F.concat(_other_letters(_refill(local, _permute(_digits(local), 10, key, tweak), _letters26(local, key, tweak)), key, tweak), domain)


def _secret(value: Column, key: str) -> Column:
    new = _permute(F.lower(value), 16, key, F.lit("secret"))
    return F.when(value.rlike("[A-F]"), F.upper(new)).otherwise(new)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one value found by ANY; the value itself where it isn't valid."""
    whole = lambda p: value.rlike(rf"^(?:{p})$")
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(whole(_OCTET + r"(?:\." + _OCTET + "){3}"), _ip(value, key))
        .when(whole(DATE), _date(value, key))
        .when(value.contains(":"), _ipv6(value, key))
        .when(whole(SSN), _ssn(value, key))
        .when(whole(PHONE), _phone(value, key))
        .when(whole(r"[0-9A-Fa-f]{32,64}"), _secret(value, key))
        .when(value.rlike("^[0-9]"), _card(value, key))
        .otherwise(_iban(value, key))
    )


def pseudonymize(docs: DataFrame, text: str = "text", key: str | None = None, found: str | None = None) -> DataFrame:
    """docs with the personal data of ``text`` replaced; ``found`` names a column for the number of replaced values.

    The key is the caller's, or else that of the session setting KEY_SETTING; without either there is an error.
    The text is split at the values and put together again from what lies between and the pseudonyms.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key, or set {KEY_SETTING}")
    old, new = fresh(docs, "found_values"), fresh(docs, "new_values")
    column = F.col(text)
    may = F.coalesce(column.rlike("[0-9@]"), F.lit(False))
    hits = F.when(may, F.regexp_extract_all(column, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    staged = docs.withColumn(old, hits).withColumn(new, F.transform(old, lambda v: pseudonym(v, key)))
    rebuilt = F.array_join(F.zip_with(F.split(column, ANY, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.when(F.size(old) > 0, rebuilt).otherwise(column)
    if found:
        staged = staged.withColumn(found, F.size(F.filter(F.zip_with(old, new, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: z["a"] != z["b"])).cast("long"))
    return staged.withColumn(text, changed).drop(old, new)
