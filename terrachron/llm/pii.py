"""Format-preserving Feistel pseudonyms of personal numbers, dates, addresses and keys.

Matches that validate (Luhn for cards, the remainder modulo 97 for IBANs, area, group and serial for social security
numbers, octets and groups for IP addresses, the calendar for dates, country codes and length for phone numbers) are
replaced by a keyed permutation within their format: the same separators and length, a valid check digit, a valid
date. It is a permutation, so equal values stay equal in every document and different ones stay different, however they
are spaced. Only DataFrame functions are used; a text is split at its matches and put together again within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, read_table, text_or_empty

ROUNDS = 8
#: For tests and as a default; give a secret of your own in production.
KEY = "not-a-secret"
DIGITS = "0123456789"
HEX = "0123456789abcdef"
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most digits of a hex key: the halves of a Feistel network take one byte a character of a round's stream.
HEX_KEY = 256

#: Kinds in order: the place where a match may not begin, its body, and what may not follow. Prefixes of
#: public key formats.
_PATTERNS = {
    "email": (r"(?<![A-Za-z0-9._%+\-])", r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9.\-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}", r"(?![A-Za-z0-9])"),
    "token": (r"(?<![A-Za-z0-9_\-])", r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[-_](?:[a-z]{2,8}[-_])?[A-Za-z0-9]{16,128}|gh[pousr]_[A-Za-z0-9]{30,128}|xox[abprs]-[A-Za-z0-9\-]{10,128}|AIza[A-Za-z0-9_\-]{35})", r"(?![A-Za-z0-9])"),
    "secret": (r"(?<![A-Za-z0-9])", rf"(?:[0-9a-f]{{32,{HEX_KEY}}}|[0-9A-F]{{32,{HEX_KEY}}})", r"(?![A-Za-z0-9])"),
    "iban": (r"(?<![A-Za-z0-9])", r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)", r"(?![A-Za-z0-9])"),
    "ipv6": (r"(?<![A-Za-z0-9:.])", r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)", r"(?![A-Za-z0-9:])"),
    "iso": (r"(?<![\w.\-/])", r"\d{4}-\d{2}-\d{2}", r"(?:(?=T\d{2}:\d{2})|(?![\w\-/]))"),
    "dot": (r"(?<![\w.\-/])", r"\d{2}\.\d{2}\.\d{4}", r"(?![\w\-/])"),
    "slash": (r"(?<![\w.\-/])", r"\d{2}/\d{2}/\d{4}", r"(?![\w\-/])"),
    "ip": (r"(?<![\w.\-])", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?![\w\-]|\.\d)"),
    "phone": (r"(?<![\w+])", r"\+\d{1,3}[ \-.]?(?:\(\d{1,5}\)|\d{1,5})(?:[ \-.]?\d{2,10}){1,4}", r"(?![\w\-])"),
    "us": (r"(?<![\w\-+.])", r"(?:\([2-9]\d{2}\) ?[2-9]\d{2}[\-. ]\d{4}|[2-9]\d{2}([\-.])[2-9]\d{2}\1\d{4})", r"(?![\w\-]|\.\d)"),
    "local": (r"(?<![\w\-+./])", r"0[1-9]\d{1,4}[\-/ ]\d{5,9}", r"(?![\w\-/]|\.\d)"),
    "ssn": (r"(?<![\w\-])", r"\d{3}-\d{2}-\d{4}", r"(?![\w\-])"),
    "card": (r"(?<![\w\-.])", r"\d(?:[ \-]?\d){12,18}", r"(?![\w\-]|\.\d)"),
}
#: A match begins where no letter or digit stands before, and a digit, @ or : comes within the longest name or prefix
#: before one; the rest is passed over at once, in a bounded number of steps a character.
ALL = r"(?<![A-Za-z0-9])(?=\(?[A-Za-z0-9+(][^\s0-9@:]{0,64}[0-9@:]|[0-9])(?:" + "|".join("".join(p).replace("([\\-.])", "(?:[\\-.])").replace("\\1", "[\\-.]") for p in _PATTERNS.values()) + ")"
#: Country calling codes of one and two digits; all others have three. Fixed values (ITU-T E.164).
ONE_DIGIT = "1 7"
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"


def let(x: Column, f) -> Column:
    """f(x) with x worked out once: an expression inside a lambda would be worked out for every element."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def _prf(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _add(left: Column, hexes: Column, alphabet: str) -> Column:
    """Digit by digit, left plus two hex digits of the function each, modulo the alphabet's size."""
    r = len(alphabet)
    at = lambda i: F.instr(F.lit(alphabet), F.substring(left, i, 1)) - 1
    step = lambda i: F.conv(F.substring(hexes, i * 2 - 1, 2), 16, 10).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(left)), lambda i: F.substring(F.lit(alphabet), (at(i) + step(i)) % r + 1, F.lit(1)))
    return F.when(F.length(left) > 0, F.array_join(each, "")).otherwise(F.lit(""))


def feistel(s: Column, alphabet: str, key: str, tweak: str | Column) -> Column:
    """A keyed permutation of the strings of each length over the alphabet: an alternating Feistel network on the two
    halves. The round function gives a byte for each character of a half, from as many SHA-256 blocks as it takes."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def start(x: Column) -> Column:
        half = (F.length(x) / 2).cast("int")
        return F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.length(x)).alias("b"))

    def network(x: Column) -> Column:
        def round_(state: Column, i: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor((F.length(state["a"]) + 31) / 32).cast("int"))
            stream = F.array_join(F.transform(blocks, lambda c: _prf(key, tweak, i, F.length(x), c, state["b"])), "")
            return let(stream, lambda h: F.struct(state["b"].alias("a"), _add(state["a"], h, alphabet).alias("b")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start(x), round_, lambda st: F.concat(st["a"], st["b"]))

    return let(s, network)


def walked(s: Column, valid, step, tries: int = 40) -> Column:
    """step(s) again and again until valid: a permutation of the valid values, if step is one of all values. After all
    tries (a chance under 10 ** -20 where a third of all values is valid) the value stays as it is."""
    out = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), step(s), lambda x, _: F.when(valid(x), x).otherwise(step(x)))
    return let(out, lambda x: F.when(valid(x), x).otherwise(s))


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum of a string of digits; double_last: the last digit is doubled (it stands before a check digit)."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        twice = ((n - i) % 2) == (0 if double_last else 1)
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, v: a + v)


def _refill(form: Column, chars: Column, cls: str) -> Column:
    """The characters in the places of the form that are of the class; others stay."""
    state = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def fill(chars: Column) -> Column:
        return F.aggregate(
            F.split(form, ""),
            state,
            lambda st, c: F.when(c.rlike(cls), F.struct(F.concat(st["o"], F.substring(chars, st["k"], F.lit(1))).alias("o"), (st["k"] + 1).alias("k"))).otherwise(
                F.struct(F.concat(st["o"], c).alias("o"), st["k"].alias("k"))
            ),
            lambda st: st["o"],
        )

    return let(chars, fill)


def _card(m: Column, key: str) -> Column:
    """The longest run of whole groups of digits that validates, the first among equals: an expiry date, a code or a
    count may stand beside a card. The rest of the match stays."""

    def valid(form: Column, d: Column) -> Column:
        body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), DIGITS, key, "card")
        return let(body, lambda b: _refill(form, F.concat(b, ((10 - _luhn_sum(b, True) % 10) % 10).cast("string")), "[0-9]"))

    def runs(g: Column) -> Column:
        run = lambda i, j: let(F.array_join(F.slice(g, i, j - i + 1), ""), lambda d: F.struct((-F.length(d)).alias("n"), i.alias("i"), j.alias("j"), d.alias("d")))
        each = F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: F.transform(F.sequence(i, F.size(g)), lambda j: run(i, j))))
        return F.filter(each, lambda r: F.when(r["n"].between(-19, -13), _luhn_sum(r["d"], False) % 10 == 0).otherwise(False))

    def place(g: Column, r: Column) -> Column:
        before = F.length(F.array_join(F.slice(g, F.lit(1), r["i"] - 1), " ")) + F.when(r["i"] > 1, 1).otherwise(0)
        return F.struct(before.alias("at"), F.length(F.array_join(F.slice(g, r["i"], r["j"] - r["i"] + 1), " ")).alias("n"))

    def put(r: Column, p: Column) -> Column:
        return F.concat(F.substring(m, F.lit(1), p["at"]), valid(F.substring(m, p["at"] + 1, p["n"]), r["d"]), F.substring(m, p["at"] + p["n"] + 1, F.length(m)))

    def best(g: Column) -> Column:
        return let(F.array_min(runs(g)), lambda r: F.when(r.isNull(), m).otherwise(let(place(g, r), lambda p: put(r, p))))

    return let(F.split(m, "[ -]"), best)


def _only(m: Column, cls: str) -> Column:
    return F.regexp_replace(m, f"[^{cls}]", "")


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial are valid before and after."""
    valid = lambda d: d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    return let(_only(m, "0-9"), lambda d: F.when(valid(d), _refill(m, walked(d, valid, lambda x: feistel(x, DIGITS, key, "ssn")), "[0-9]")).otherwise(m))


def country_digits(digits: Column) -> Column:
    """How many of the digits after a plus sign are the country's."""
    return F.when(F.substring(digits, 1, 1).isin(ONE_DIGIT.split()), 1).when(F.substring(digits, 1, 2).isin(TWO_DIGITS.split()), 2).otherwise(3)


def _phone(m: Column, key: str) -> Column:
    """The country's code stays; the rest is permuted as a number of that country and length, however it is spaced."""

    def moved(d: Column) -> Column:
        def with_code(n: Column) -> Column:
            body = feistel(F.substring(d, n + 1, F.length(d)), DIGITS, key, F.concat(F.lit("phone"), F.substring(d, F.lit(1), n)))
            return _refill(m, F.concat(F.substring(d, F.lit(1), n), body), "[0-9]")

        return F.when(F.length(d).between(7, 15), let(country_digits(d), with_code)).otherwise(m)

    return let(_only(m, "0-9"), moved)


def _national(m: Column, key: str, code: str, keep: int) -> Column:
    """A number written without its country: as one of the country (or of none), the first digits kept."""
    return let(_only(m, "0-9"), lambda d: _refill(m, F.concat(F.substring(d, 1, keep), feistel(F.substring(d, F.lit(keep + 1), F.length(d)), DIGITS, key, "phone" + code)), "[0-9]"))


def _mod97(s: Column) -> Column:
    """Remainder of the number that an IBAN's characters spell, letters as 10 to 35."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))


def _iban(m: Column, key: str) -> Column:
    """Country and kinds of character stay: digits are permuted among digits, letters among letters; then the check
    digits are worked out. Groups and spaces stay."""

    def of(c: Column) -> Column:
        body, land = F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 2)

        def filled(b: Column) -> Column:
            digits = feistel(_only(b, "0-9"), DIGITS, key, F.concat(F.lit("iban"), land))
            letters = feistel(_only(b, "A-Z"), UPPER, key, F.concat(F.lit("iban"), land))
            return _refill(_refill(b, digits, "[0-9]"), letters, "[A-Z]")

        check = lambda b: F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0")
        whole = let(filled(body), lambda b: _refill(m, F.concat(land, check(b), b), "[A-Z0-9]"))
        return F.when(F.length(c).between(15, 34) & (_mod97(F.concat(body, F.substring(c, 1, 4))) == 1), whole).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def _ipv6(m: Column, key: str) -> Column:
    """An address is 32 hex digits, whichever way it is shortened; the pseudonym is written without leading zeros and
    not shortened otherwise."""
    sides = F.split(F.lower(m), "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: F.length(g) > 0)

    def whole(a: Column) -> Column:
        left, right = groups(F.get(a, 0)), F.when(F.size(a) > 1, groups(F.get(a, 1))).otherwise(F.array().cast("array<string>"))
        missing = 8 - F.size(left) - F.size(right)
        ok = F.when(F.size(a) == 1, missing == 0).otherwise((F.size(a) == 2) & (missing >= 1))
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
        back = let(feistel(digits, HEX, key, "ipv6"), lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(p, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":"))
        return F.when(ok, back).otherwise(m)

    return let(sides, whole)


def _token(m: Column, key: str) -> Column:
    """The prefix stays, and every character keeps its kind: digits, capitals and small letters are permuted each on
    their own."""
    prefix = F.regexp_extract(m, r"^(AKIA|ASIA|AIza|(?:sk|pk|rk)[-_](?:[a-z]{2,8}[-_])?|gh[pousr]_|xox[abprs]-)", 1)

    def body(x: Column) -> Column:
        out = x
        for name, cls, alphabet in (("d", "0-9", DIGITS), ("u", "A-Z", UPPER), ("l", "a-z", UPPER.lower())):
            out = _refill(out, feistel(_only(x, cls), alphabet, key, "token" + name), f"[{cls}]")
        return out

    return let(prefix, lambda p: F.concat(p, let(F.substring(m, F.length(p) + 1, F.length(m)), body)))


def _ip(m: Column, key: str) -> Column:
    """An address is 8 hex digits; octets are written without leading zeros."""
    o = F.split(m, r"\.")
    valid = F.forall(o, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
    h = F.array_join(F.transform(o, lambda x: F.lower(F.lpad(F.hex(x.cast("int")), 2, "0"))), "")
    back = let(feistel(h, HEX, key, "ip"), lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(p, i * 2 + 1, F.lit(2)), 16, 10)), "."))
    return F.when(valid, back).otherwise(m)


#: 400 Gregorian years have 146097 = 189 * 773 days, so a Feistel network on the two factors stays in range. A date
#: moves within the 400 years that begin with a multiple of 400 and hold it.
DAY0, DAYS_A, DAYS_B = "1600-01-01", 189, 773


def _date(m: Column, key: str, form: str) -> Column:
    day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), F.lit(DAY0).cast("date"))
    number = lambda h: F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    cycle = DAYS_A * DAYS_B

    def round_(s: Column, i: Column) -> Column:
        a = (s["a"] + number(_prf(key, F.lit("date"), i, s["b"]))) % DAYS_A
        return let(a, lambda a: F.struct(a.cast("long").alias("a"), ((s["b"] + number(_prf(key, F.lit("date2"), i, a))) % DAYS_B).cast("long").alias("b")))

    def step(day: Column) -> Column:
        start = F.struct((day % DAYS_A).cast("long").alias("a"), F.floor(day / DAYS_A).cast("long").alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, round_, lambda s: (s["a"] + s["b"] * DAYS_A).cast("int"))

    def moved(day: Column) -> Column:
        # year 0 is no year: of the first 400, the days that fall there are moved once more
        base = (F.floor(day / cycle) * cycle).cast("int")
        real = lambda x: base + x >= F.datediff(F.lit("0001-01-01").cast("date"), F.lit(DAY0).cast("date"))
        new = walked((day - base).cast("int"), real, step, 8)
        return F.when(day.isNotNull(), F.date_format(F.date_add(F.lit(DAY0).cast("date"), (base + new).cast("int")), form)).otherwise(m)

    return let(day, moved)


def _email(m: Column, key: str) -> Column:
    """The part before @ is permuted over letters and digits (case is not kept); its marks and the domain stay."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    chars = F.regexp_replace(F.lower(local), "[^a-z0-9]", "")
    return F.concat(_refill(local, feistel(chars, ALNUM, key, "email"), "[A-Za-z0-9]"), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    p = feistel(F.lower(m), HEX, key, "secret")
    return F.when(m.rlike("[A-F]"), F.upper(p)).otherwise(p)


def _kind(m: Column) -> Column:
    """The first kind whose whole body the match is."""
    out = F.when(m.contains("@"), "email")
    for name, (_, body, _) in _PATTERNS.items():
        out = out.when(m.rlike(f"^(?:{body})$"), name) if name != "email" else out
    return out.otherwise("card")


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match; what does not validate stays as it is."""
    forms = {
        "email": lambda: _email(m, key),
        "token": lambda: _token(m, key),
        "secret": lambda: _secret(m, key),
        "iban": lambda: _iban(m, key),
        "ipv6": lambda: _ipv6(m, key),
        "iso": lambda: _date(m, key, "yyyy-MM-dd"),
        "dot": lambda: _date(m, key, "dd.MM.yyyy"),
        "slash": lambda: _date(m, key, "MM/dd/yyyy"),
        "ip": lambda: _ip(m, key),
        "phone": lambda: _phone(m, key),
        "us": lambda: _national(m, key, "1", 0),
        "local": lambda: _national(m, key, "0", 1),
        "ssn": lambda: _ssn(m, key),
        "card": lambda: _card(m, key),
    }

    def of(k: Column) -> Column:
        out = None
        for name, form in forms.items():
            out = F.when(k == name, form()) if out is None else out.when(k == name, form())
        return out

    return let(_kind(m), of)


#: The expression by application and key: putting it together takes some seconds, and it fits every table.
_BUILT: dict[tuple[str, str], Column] = {}


def _pseudonyms(docs: DataFrame, secret: str) -> Column:
    """The pseudonyms of the matches in the column _m."""
    at = (docs.sparkSession.sparkContext.applicationId, secret)
    if at not in _BUILT:
        _BUILT[at] = F.transform("_m", lambda m: pseudonym(m, secret))
    return _BUILT[at]


def pseudonymise(docs: DataFrame, key: str = "doc_id", text: str = "text", *, secret: str = KEY) -> DataFrame:
    """(key, text, n_replaced): whole texts with their matches replaced, one row each.

    A null text stays null with 0; a text without a match is returned as it is; repeated rows give equal rows; an empty
    table gives no row. A text of any length takes time in proportion to it, white space or not. Passed over: values
    that do not validate, hex keys of more than HEX_KEY digits, names of more than 64 characters before an @ (no address
    may have more).
    """
    t = text_or_empty(text)
    some = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"), F.when(t.rlike("[0-9@:]"), F.regexp_extract_all(t, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_m"))
    new = _pseudonyms(docs, secret)
    mapped = some.select(key, "text", "_m", F.when(F.size("_m") > 0, new).alias("_n"))
    between = F.split("text", ALL, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.col("_n"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    n = F.size(F.filter(F.zip_with("_m", F.col("_n"), lambda a, b: a != b), lambda x: x))
    return mapped.select(key, F.when(F.size("_m") > 0, joined).otherwise(F.col("text")).alias("text"), F.when(F.size("_m") > 0, n).otherwise(0).cast("long").alias("n_replaced"))


def op4_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"))
