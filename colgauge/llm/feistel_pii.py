"""Format-preserving pseudonyms of personal data by keyed Feistel networks.

Validated values - card numbers (Luhn), IBANs (mod 97), dates of the calendar, IPv4 addresses,
telephone and social security numbers, e-mail addresses - are replaced by others of the same
format: a number is taken as an index into its domain Z_a x Z_b, and a Feistel network over the
two parts permutes the domain under a key, so different values stay different, equal ones stay
equal in every document, and check digits are made anew. Of an e-mail address every letter and
digit but those of the last label is shifted within its class (``ALPHABETS`` for Latin letters with
marks, Cyrillic and Greek; letters of other scripts stay) by a Feistel network over two halves.
Values that do not validate, and all other text, are left as they are.

Looked for are: IBANs of each country's length; e-mail addresses with letters of any script; dates
year first, day first or, with a day after the twelfth, month first, also before a time of day;
telephone numbers with ``+`` and country code, or of ten digits in groups of 3, 3 and 4. A number with
``+`` ends where its country's numbers do if all of them have one length (``NATIONAL``), else after at most 15 digits.
National numbers in other groups and dates with a month's name are not looked for.

DataFrame functions only; no Python runs on the executors. Matches are found in one pass; only
the parts of a text that match are rewritten.

Defined results: a NULL text stays NULL with 0 values found; an empty one stays empty; separators,
case and length of a value are kept; values written with other separators share a pseudonym;
repeated rows and extra columns pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colgauge.llm.common import query, table

KEY = "example-key"     # a parameter: a real key comes from the caller
ROUNDS = 8

# The forms that are looked for, the first that fits at a place wins.
EMAIL = r"[\p{L}\p{N}_][\p{L}\p{M}\p{N}._%+-]*+@(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]*[\p{L}\p{M}\p{N}])?\.)+(?:[A-Za-z]{2,}|\p{L}{2,})"
# Length of an IBAN -> its countries. A number ends where its country's does, whatever follows it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


# Any other country comes last.
IBAN = r"(?=[A-Z]{2}\d{2})(?:" + "|".join(_iban_form(n, c) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
# Year first, day first, or month first where no day-first reading is: the day is after the twelfth.
MONTH_FIRST = rf"{_MONTH}[./-](?:1[3-9]|2\d|3[01])[./-]{_YEAR}"
DATE = rf"{_YEAR}[/-]{_MONTH}[/-]{_DAY}|{_DAY}[./-]{_MONTH}[./-]{_YEAR}|{MONTH_FIRST}"
# Digits behind a country code, where all numbers of the country have as many; any other number has 8 to 15 digits in all.
NATIONAL = {8: "45 47 65 852", 9: "31 32 33 34 41 48 351 420 421 380 61 56", 10: "1 7 44 52 57 90 91", 11: "86"}
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
E164 = r"\+(?:" + "|".join(
    rf"(?:{c.replace(' ', '|')})(?: ?\(0\))?(?:[ .-]|\) ?| \()?\d(?:(?:[ ./-]|\)[ .-]?| \()?\d){{{n - 1}}}" for n, c in NATIONAL.items()
) + r"|\d(?:(?:[ ./-]|\)[ .-]?| ?\()?\d){7,14})"
PHONE = E164 + r"|(?:\+\d{1,3}[ .-]?|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
CARD = r"\d{4}([ -]?)\d{4}([ -]?)\d{4}([ -]?)\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5}"
KINDS = {"email": EMAIL, "iban": IBAN, "ip": IPV4, "date": DATE, "phone": PHONE, "ssn": SSN, "card": CARD}
_BEFORE, _AFTER = r"(?<![\w@+.-])", r"(?![\w@]|[.-]\d)"
# An address begins at the first letter of its run, whatever mark stands before; a time may follow a date.
_EDGES = {"email": (r"(?<![\p{L}\p{M}\p{N}_@])(?<![\p{L}\p{M}\p{N}_@][.%+-]{1,8})", _AFTER), "date": (_BEFORE, rf"(?:{_AFTER}|(?=[Tt]\d\d:?\d\d))")}
_PLAIN = {k: p.replace("([ -]?)", "[ -]?") for k, p in KINDS.items()}
ANY = "|".join("{}(?:{}){}".format(_EDGES.get(k, (_BEFORE, _AFTER))[0], p, _EDGES.get(k, (_BEFORE, _AFTER))[1]) for k, p in _PLAIN.items())
# Letters beside a to z that are shifted among themselves; each has one capital letter.
ALPHABETS = (
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяёєіїґ", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ",
)
DATE_BASE, DATE_A, DATE_B = "1900-01-01", 270, 271      # 73,170 days: a domain without remainder


def _pad(key: str, what: Column, step: Column, half: Column) -> Column:
    """Keyed pseudo-random hex digits of one round."""
    return F.sha2(F.concat(F.lit(key + "|"), what, F.lit("|"), step.cast("string"), F.lit("|"), half), 512)


def feistel(x: Column, a: int, b: int, key: str, what: Column) -> Column:
    """Permutes 0 <= x < a * b: rounds add a keyed hash of one part to the other, in turn."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        pad = F.conv(F.substring(_pad(key, what, i, F.when(even, s["r"]).otherwise(s["l"]).cast("string")), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(s["l"] + pad % a, F.lit(a))).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + pad % b, F.lit(b))).cast("long").alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    # Long division: x stays below 2^53 in every domain used here.
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _refill(shape: Column, chars: Column, kind: str) -> Column:
    """``shape`` with its characters of ``kind`` (a regex class) replaced in turn by those of ``chars``."""
    each = F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(kind), F.substring(
        chars, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), f"[^{kind[1:-1]}]", "")), F.lit(1))).otherwise(c))
    return F.array_join(each, "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, the last digit counted once."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _mod97(text: Column) -> Column:
    """A string of digits and letters (A is 10) as a number modulo 97."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)


def _card(s: Column, key: str) -> Column:
    """First digit kept, the middle permuted, check digit anew; NULL unless the Luhn sum fits."""
    d = _digits(s)
    middle = F.substring(d, F.lit(2), F.length(d) - 2)
    n = F.length(middle)
    # The middle is cut in two parts of at most nine digits: halves of 11 to 17 digits.
    new = F.lit(None).cast("string")
    for size in range(11, 18):
        a = size // 2
        value = _mixed(middle, a, size - a, key, F.concat(F.lit("card"), F.substring(d, 1, 1), F.lit(str(size))))
        new = F.when(n == size, value).otherwise(new)
    body = F.concat(F.substring(d, 1, 1), new)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), _refill(s, F.concat(body, check), "[0-9]"))


def _mixed(digits: Column, left: int, right: int, key: str, what: Column) -> Column:
    """A digit string of ``left + right`` digits permuted; the two parts are its halves, so no number gets long."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        pad = F.conv(F.substring(_pad(key, what, i, F.when(even, s["r"]).otherwise(s["l"]).cast("string")), 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(s["l"] + pad % 10**left, F.lit(10**left))).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + pad % 10**right, F.lit(10**right))).cast("long").alias("r"))

    start = F.struct(F.substring(digits, 1, left).cast("long").alias("l"), F.substring(digits, left + 1, right).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(
        F.lpad(s["l"].cast("string"), left, "0"), F.lpad(s["r"].cast("string"), right, "0")))


def _phone(s: Column, key: str) -> Column:
    """The number behind the country code permuted; without a ``+`` it is the last ten digits."""
    d = _digits(s)
    behind = F.length(F.regexp_extract(d, "^" + COUNTRY, 0)) + s.rlike(r"^\+\d{1,3} ?\(0\)").cast("int")
    lead = F.when(s.startswith("+"), behind).otherwise(F.length(d) - 10)
    rest = F.substring(d, lead + 1, F.length(d))
    n = F.length(rest)
    new = F.lit(None).cast("string")
    for size in range(4, 15):
        new = F.when(n == size, _mixed(rest, size // 2, size - size // 2, key, F.lit("phone" if size == 10 else f"phone{size}"))).otherwise(new)
    return _refill(s, F.concat(F.substring(d, F.lit(1), lead), new), "[0-9]")


def _ssn(s: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999; NULL outside."""
    d = _digits(s)
    area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    new = feistel(index, 898 * 99, 9999, key, F.lit("ssn"))
    part = F.floor(new / F.lit(9999))
    a = F.floor(part / F.lit(99)) + 1
    text = F.concat(
        F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"),
        F.lpad((part % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((new % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, text)


def _date(s: Column, key: str) -> Column:
    """Days from 1900-01-01 to 2100-05-01, written as they were; NULL for a day that no calendar has.

    A month-first date is permuted until its day is again after the twelfth, so no other date is written like it.
    """
    d = _digits(s)
    iso, month_first = s.rlike(r"^\d{4}"), s.rlike(f"^(?:{MONTH_FIRST})$")
    at = lambda *parts: F.concat_ws("-", *[F.substring(d, a, n) for a, n in parts])
    text = F.when(iso, at((1, 4), (5, 2), (7, 2))).when(month_first, at((5, 4), (1, 2), (3, 2))).otherwise(at((5, 4), (3, 2), (1, 2)))
    day = F.try_to_date(text, "yyyy-MM-dd")
    index = F.datediff(day, F.lit(DATE_BASE).cast("date")).cast("long")
    step = lambda x: feistel(x, DATE_A, DATE_B, key, F.lit("date"))
    date_of = lambda x: F.date_add(F.lit(DATE_BASE).cast("date"), x.cast("int"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), step(index), lambda x, _: F.when(F.dayofmonth(date_of(x)) > 12, x).otherwise(step(x)))
    new = date_of(F.when(month_first, walked).otherwise(step(index)))
    form = lambda f: F.date_format(new, f)
    digits = F.when(iso, form("yyyyMMdd")).when(month_first, form("MMddyyyy")).otherwise(form("ddMMyyyy"))
    return F.when(day.isNotNull(), _refill(s, digits, "[0-9]"))


def _ip(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    number = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    new = feistel(number, 65536, 65536, key, F.lit("ip"))
    return F.concat_ws(".", *[(F.shiftright(new, n).bitwiseAND(F.lit(255))).cast("string") for n in (24, 16, 8, 0)])


def _shifted(s: Column, key: str, what: Column) -> Column:
    """Letters and digits of a string permuted within their classes; case and the rest are kept."""
    low = F.transform(F.split(s, ""), F.lower)      # letter by letter: one may have two small ones
    classes = [("0123456789", "9"), ("abcdefghijklmnopqrstuvwxyz", "a"), *((x, x[0]) for x in ALPHABETS)]

    def by_class(c: Column, of, rest: Column) -> Column:
        out = rest
        for alphabet, name in reversed(classes):
            out = F.when(F.position(c, F.lit(alphabet)) > 0, of(alphabet, name)).otherwise(out)
        return out

    size = lambda c: by_class(c, lambda x, _: F.lit(len(x)), F.lit(1))
    value = lambda c: by_class(c, lambda x, _: F.position(c, F.lit(x)) - 1, F.lit(0))
    half = F.floor(F.size(low) / 2).cast("int")
    left, right = F.slice(low, F.lit(1), half), F.slice(low, half + 1, F.size(low) - half)
    shape = F.concat(F.lit("s"), F.array_join(F.transform(low, lambda c: by_class(c, lambda _, name: F.lit(name), c)), ""))

    def move(part: Column, sizes: Column, pad: Column) -> Column:
        return F.transform(part, lambda v, j: F.pmod(v + F.conv(F.substring(pad, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.get(sizes, j)))

    sizes_l, sizes_r = F.transform(left, size), F.transform(right, size)

    def turn(st: Column, i: Column) -> Column:
        even = i % 2 == 0
        pad = _pad(key, F.concat(what, shape), i, F.array_join(F.transform(F.when(even, st["r"]).otherwise(st["l"]), lambda v: v.cast("string")), ","))
        return F.struct(F.when(even, move(st["l"], sizes_l, pad)).otherwise(st["l"]).alias("l"),
                        F.when(even, st["r"]).otherwise(move(st["r"], sizes_r, pad)).alias("r"))

    start = F.struct(F.transform(left, value).alias("l"), F.transform(right, value).alias("r"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda st: F.concat(st["l"], st["r"]))

    def written(c: Column, v: Column) -> Column:
        new = by_class(F.lower(c), lambda x, _: F.substring(F.lit(x), v + 1, F.lit(1)), c)
        return F.when(c == F.lower(c), new).otherwise(F.upper(new))

    return F.array_join(F.zip_with(F.split(s, ""), done, written), "")


def _email(s: Column, key: str) -> Column:
    """All but the last label."""
    last = F.regexp_extract(s, r"\.\p{L}+$", 0)
    body = F.substring(s, F.lit(1), F.length(s) - F.length(last))
    return F.concat(_shifted(body, key, F.concat(F.lit("email"), F.lower(last))), last)


def _iban(s: Column, key: str) -> Column:
    """Country kept, the rest permuted, check digits anew; NULL unless the number fits modulo 97."""
    plain = F.regexp_replace(s, " ", "")
    country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(bban, F.substring(plain, 1, 4))) == 1)
    new = _shifted(bban, key, F.concat(F.lit("iban"), country))
    check = F.lpad((F.lit(98) - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refill(s, F.concat(country, check, new), "[A-Z0-9]"))


_MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def kind_of(match: Column) -> Column:
    """The first kind whose whole form a match has."""
    kind = F.lit(None).cast("string")
    for name in reversed(_PLAIN):
        kind = F.when(match.rlike(f"^(?:{_PLAIN[name]})$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """What stands for a match; NULL where it does not validate."""
    out = F.lit(None).cast("string")
    for name, make in _MAKERS.items():
        out = F.when(kind == name, make(match, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, found: str | None = None) -> DataFrame:
    """``docs`` with the text rewritten; ``found`` names a column for the array of (kind, value, pseudonym), if wanted.

    All columns are kept; nothing is shuffled.
    """
    keep = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    matched = keep.withColumn("_m", F.when(F.col("_text").rlike("[0-9@]"), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))))
    has = F.coalesce(F.size("_m") > 0, F.lit(False))
    typed = matched.withColumn("_k", F.when(has, F.transform("_m", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))))
    made = typed.withColumn("_p", F.when(has, F.transform("_k", lambda m: F.struct(
        m["kind"].alias("kind"), m["value"].alias("value"), pseudonym(m["value"], m["kind"], key).alias("pseudonym")))))
    gaps = F.split("_text", ANY, -1)
    ends = F.concat(F.transform("_p", lambda p: F.coalesce(p["pseudonym"], p["value"])), F.array(F.lit("")))
    new = F.when(has, F.array_join(F.zip_with(gaps, ends, lambda g, e: F.concat(g, e)), "")).otherwise(F.col("_text"))
    out = made.select("_row", new.alias("_new"), F.filter(
        F.coalesce("_p", F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")),
        lambda p: p["pseudonym"].isNotNull()).alias("_found"))
    columns = [F.col("_new").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col("_found").alias(found)] if found else []))


def _count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda p: p["kind"] == kind))


@query("op4_feistel_pii")
def op4_feistel_pii(spark, folder):
    """Every document with its text pseudonymised, and how many values of each kind were replaced."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = pseudonymise(docs, found="found")
    return done.select("doc_id", "text", *[_count_of("found", kind).alias(f"n_{kind}") for kind in _MAKERS])
