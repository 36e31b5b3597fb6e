"""Format-preserving pseudonyms for personal data, in column expressions alone.

A text is cut at every match of one pattern; each match is validated (check digits, value ranges, calendar) and, if
valid, replaced by a keyed pseudonym of the same format; all else stays as it is. Numbers and dates go through a
Feistel network over their own domain: alternating halves are shifted by a keyed hash of the other half, which is a
permutation whatever the hash. Equal values so get equal pseudonyms in every document, different values of a format
different ones, and the key's owner can invert them. Values without a numeric domain (mail names, secrets) get
a keyed hash of their kind's format, which links equal values too.

* cards: 13 to 19 digits with a valid Luhn check digit; the payload is permuted, the check digit recomputed;
* bank accounts (IBAN) with valid mod-97 check digits: digits permuted, check digits recomputed;
* social security numbers with valid area, group and serial, IPv4 addresses;
* telephone numbers of 8 to 15 digits after a plus sign, and ten digits as ddd ddd dddd;
* calendar dates 1900-2099 (year-month-day, year/month/day, day/month/year, month/day/year): permuted within these years;
* mail addresses; values of fields named token, secret, password or API key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "a key that its owner keeps"
ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
DAY_SIDE = 271  # 271 * 271 is the smallest square domain that holds all days; values outside walk on
DAY_WALKS = 12

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
SECRET_NAME = r"(?i:token|secret|password|passwd|api[_-]?key)"
_MORE = r"(?:\d|[ .-]\d(?=\d))"  # one more digit; after a separator two at least
PLUS_PHONE = (
    r"\+(?:1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\d{10,15}|\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d" + _MORE + r"{3,9}|\d" + _MORE + "{7,14})"
)
COUNTRY_CODE = r"^(\+(?:\d{1,3}(?!\d)|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"
PATTERNS = {
    "secret": SECRET_NAME + r"""["']? {0,3}[:=] {0,3}["']?[A-Za-z0-9_+/=-]{16,}""",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+[\p{L}\p{N}-]*\p{L}{2}",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END,
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "phone": PLUS_PHONE + _END
    + r"|\(\d{3}\) ?\d{3}[ .-]\d{4}" + _END + "|" + _EDGE + r"\d{3}([ .-])\d{3}\1\d{4}" + _END,
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "date": r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\p{L}\p{N}]|[/.-]\d)",
    "card": _EDGE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})" + _END,
}
ANY = "|".join(PATTERNS.values())
MAY_HOLD = "[0-9@:=]"  # a text without any of these holds nothing


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---- keyed permutations --------------------------------------------------------------------------------
def _hash(key: str, tag: Column, *parts: Column) -> Column:
    """60 keyed bits as a long."""
    joined = F.concat_ws("|", F.lit(key), tag, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tag: Column) -> Column:
    """Permute the pair (left < left_size, right < right_size); a struct ``l``, ``r`` of longs."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_left = F.pmod(s["l"] + _hash(key, tag, i, s["r"]) % left_size, left_size)
        moved_right = F.pmod(s["r"] + _hash(key, tag, i, s["l"]) % right_size, right_size)
        return F.struct(F.when(even, moved_left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved_right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power10(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Permutation of the decimal strings of a length (up to 36 digits)."""
    a = F.floor(F.length(digits) / 2).cast("int")
    b = F.length(digits) - a
    left = F.when(a > 0, F.substring(digits, F.lit(1), a).try_cast("long")).otherwise(F.lit(0).cast("long"))
    right = F.substring(digits, a + 1, b).try_cast("long")
    tag = F.concat(F.lit(kind), F.length(digits).cast("string"))

    def written(s: Column) -> Column:
        return F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, "0")).otherwise(F.lit("")), F.lpad(s["r"].cast("string"), b, "0"))

    return _let(feistel(left, right, _power10(a), _power10(b), key, tag), written)


def permute_day(day: Column, key: str) -> Column:
    """Permutation of 0 .. DAYS - 1, by walking on through a slightly larger square until a value is inside."""
    side = F.lit(DAY_SIDE).cast("long")

    def step(x: Column) -> Column:
        return _let(feistel(F.floor(x / DAY_SIDE), x % DAY_SIDE, side, side, key, F.lit("date")), lambda s: s["l"] * DAY_SIDE + s["r"])

    # the first step is always taken, the others only from outside
    walk = F.aggregate(F.sequence(F.lit(0), F.lit(DAY_WALKS)), day.cast("long"), lambda x, i: F.when((i > 0) & (x < DAYS), x).otherwise(step(x)))
    return walk


# ---- formats -------------------------------------------------------------------------------------------
def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"\D", "")


def _refill(match: Column, digits: Column) -> Column:
    """``match`` with its digits taken from ``digits`` in order; separators stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        out = F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (s["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(match, ""), start, put)["out"]


def _luhn(digits: Column, shift: int) -> Column:
    """Luhn sum; ``shift`` 0 counts the last digit once, 1 twice (for a payload without its check digit)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when((i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(match: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        payload = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        checked = _let(payload, lambda p: F.concat(p, F.pmod(-_luhn(p, 1), F.lit(10)).cast("string")))
        return F.when(_luhn(digits, 0) % 10 == 0, _let(checked, lambda c: _refill(match, c))).otherwise(match)

    return _let(_digits(match), made)


def _mod97(account: Column) -> Column:
    """Remainder of an account string (letters as 10 .. 35) by 97."""
    def add(total: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.when(is_digit, (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(account, ""), F.lit(0), add)


def _iban(match: Column, key: str) -> Column:
    plain = F.replace(match, F.lit(" "), F.lit(""))
    country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    digits = _digits(bban)
    own = F.when(F.length(digits) > 0, _let(permute_digits(digits, key, "iban"), lambda d: _refill(bban, d))).otherwise(bban)
    checked = _let(own, lambda o: F.concat(country, F.lpad((98 - _mod97(F.concat(o, country, F.lit("00")))).cast("string"), 2, "0"), o))

    def spaced(made: Column) -> Column:
        def put(s: Column, c: Column) -> Column:
            gap = c == " "
            return F.struct(F.concat(s["out"], F.when(gap, c).otherwise(F.substring(made, s["k"], F.lit(1)))).alias("out"), (s["k"] + (~gap).cast("int")).alias("k"))

        return F.aggregate(F.split(match, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put)["out"]

    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(bban, F.substring(plain, 1, 4))) == 1)
    return F.when(valid, _let(checked, spaced)).otherwise(match)


def _ip(match: Column, key: str) -> Column:
    part = [F.element_at(F.split(match, r"\."), i).cast("int") for i in (1, 2, 3, 4)]
    valid = part[0] < 256
    for p in part[1:]:
        valid = valid & (p < 256)
    side = F.lit(65536).cast("long")

    def written(s: Column) -> Column:
        return F.concat_ws(".", *[x.cast("long").cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)])

    made = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], side, side, key, F.lit("ip"))
    return F.when(valid, _let(made, written)).otherwise(match)


def _ssn(match: Column, key: str) -> Column:
    def valid(x: Column) -> Column:
        area = F.substring(x, 1, 3)
        return ~area.isin("000", "666") & (area < "900") & (F.substring(x, 4, 2) != "00") & (F.substring(x, 6, 4) != "0000")

    # walk on until the permuted number is valid again: about one step in ten is not
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(40)), permute_digits(_digits(match), key, "ssn"), lambda x, _: F.when(valid(x), x).otherwise(permute_digits(x, key, "ssn")))
    return F.when(valid(_digits(match)), _let(walked, lambda d: _refill(match, d))).otherwise(match)


def _phone(match: Column, key: str) -> Column:
    """The country code after a plus sign stays, all further digits are permuted."""
    code = F.regexp_extract(match, COUNTRY_CODE, 1)
    rest = F.substring(match, F.length(code) + 1, F.length(match))
    return F.when(F.length(_digits(match)).between(8, 15), F.concat(code, _let(permute_digits(_digits(rest), key, "phone"), lambda d: _refill(rest, d)))).otherwise(match)


def _date(match: Column, key: str) -> Column:
    sep = F.regexp_extract(match, r"^\d+(\D)", 1)
    part = [F.regexp_extract(match, r"^(\d+)\D(\d+)\D(\d+)$", i).cast("int") for i in (1, 2, 3)]
    year_first = match.rlike(r"^\d{4}")

    def day(y, m, d):
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")

    day_first, month_first = day(part[2], part[1], part[0]), day(part[2], part[0], part[1])
    value = F.when(year_first, day(*part)).otherwise(F.coalesce(day_first, month_first))
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(value, first)
    year_padded = match.rlike(r"\D0|\D\d\d\D\d\d$")
    padded = F.regexp_extract(match, r"^(\d+)", 1).rlike("^(..|0.)$") | F.regexp_extract(match, r"^\d+\D(\d+)", 1).rlike("^(..|0.)$")

    def written(made: Column) -> Column:
        d, m, y = [F.when(padded, F.date_format(made, p + p)).otherwise(F.date_format(made, p)) for p in ("d", "M")] + [F.date_format(made, "yyyy")]
        slashed = F.when(day_first.isNotNull(), F.concat_ws("/", d, m, y)).otherwise(F.concat_ws("/", m, d, y))
        dashed = F.when(year_padded, F.date_format(made, "yyyy-MM-dd")).otherwise(F.date_format(made, "yyyy-M-d"))
        return F.when(year_first, F.replace(dashed, F.lit("-"), sep)).otherwise(F.replace(slashed, F.lit("/"), sep))

    return F.when(number.between(0, DAYS - 1), _let(F.date_add(first, permute_day(number, key).cast("int")), written)).otherwise(match)


def _email(match: Column, key: str) -> Column:
    """A mail address at a domain reserved for examples; equal addresses (in any case) stay equal."""
    return F.concat(F.lit("p"), F.lpad(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(match)).cast("binary"), 256), 1, 15), 16, 10), 19, "0"), F.lit("@person.example"))


def _secret(match: Column, key: str) -> Column:
    name = F.regexp_extract(match, "^(" + SECRET_NAME + r"""["']? {0,3}[:=] {0,3}["']?)""", 1)
    value = F.substring(match, F.length(name) + 1, F.length(match))
    stream = F.concat(*[F.sha2(F.concat(F.lit(f"{key}|secret{i}|"), value).cast("binary"), 256) for i in range(2)])
    blocks = F.ceil(F.length(value) / 128).cast("int")
    return F.concat(name, F.substring(F.repeat(stream, blocks), F.lit(1), F.length(value)))


def _kind(match: Column) -> Column:
    """The first pattern that covers the whole match (patterns are tried in this order everywhere)."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(PATTERNS.items())):
        kind = F.when(match.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(match: Column, kind: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of a kind; an invalid value stays as it is."""
    make = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}
    value = match
    for name, fn in make.items():
        value = F.when(kind == name, fn(match, key)).otherwise(value)
    return value


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, found_as: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``found_as`` adds an array of the kinds replaced, in order.

    Every row and column stays. Null and empty texts, and texts without personal data, are returned unchanged (with an
    empty array). Keep ``key`` the same for texts whose equal values shall stay linked.
    """
    text = F.col(text_col)
    found, kinds, made = "__pii_found", "__pii_kinds", "__pii_made"
    df = docs.withColumn(found, F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    df = df.withColumn(kinds, F.when(F.size(found) > 0, F.transform(found, _kind)))
    df = df.withColumn(made, F.zip_with(found, kinds, lambda m, k: pseudonym(m, k, key)))
    # one piece more than matches: the last has nothing after it
    pieces = F.zip_with(F.split(text, ANY, -1), F.col(made), lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    out = df.withColumn(text_col, F.when(F.col(made).isNotNull(), F.array_join(pieces, "")).otherwise(text))
    if found_as:
        replaced = F.zip_with(F.arrays_zip(F.col(found).alias("m"), F.col(kinds).alias("k")), F.col(made), lambda x, value: F.when(x["m"] != value, x["k"]))
        out = out.withColumn(found_as, F.coalesce(F.filter(replaced, lambda k: k.isNotNull()), F.array().cast("array<string>")))
    return out.drop(found, kinds, made)
