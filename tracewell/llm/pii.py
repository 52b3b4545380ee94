"""Format-preserving pseudonyms for personal data, as DataFrame expressions.

Cards, phone, bank account (IBAN) and social security numbers, IP and mail addresses and dates are found by
pattern and, where their format has rules, validated. Each valid value is permuted within its own format by a keyed Feistel
network, so equal values keep equal pseudonyms in all documents, different values different ones, and nothing
has to be looked up or remembered.

Numbers and dates are a pair of digits to a mixed base, (a, b) with a < A and b < B; a round adds a keyed hash
of one half to the other, modulo its base. A mail address is the string before its last dot, in two halves; a
round shifts the letters and digits of one half by a keyed hash of the other. Cards and IBANs keep valid check digits.
A telephone number keeps its country code, an IBAN its country and an IPv6 address its first group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import free_name

ROUNDS = 4  # of two steps each
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:xn--[A-Za-z0-9-]{1,59}|[A-Za-z]{2,24})(?![A-Za-z0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
#: In this order where several begin at the same place. None begins or ends inside a longer run of digits.
PATTERNS = {
    "mail": "(?<![A-Za-z0-9._%+-])" + MAIL,
    "ip": rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z])(?!\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?=[A-Fa-f]{{0,3}}[0-9]){GROUP}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![0-9A-Za-z:])(?!\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z])(?:(?:19|20)[0-9]{2}([/-])[0-9]{2}\3[0-9]{2}|[0-9]{2}[.][0-9]{2}[.](?:19|20)[0-9]{2})(?:(?=T[0-9]{2}:)|(?![0-9A-Za-z]))|(?<![0-9A-Za-z/])[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}(?![0-9A-Za-z/])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+(?:[1-9][0-9]{7,14}|[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,7}|[ .-][0-9]{1,7})(?:[ .-][0-9]{2,7}){0,4}+)(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Country codes of telephone numbers: one digit, two, or else three. Fixed values.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 73,049 days, to the end of 2099


def keyed(key: str, step: int, kind: str, *values: Column) -> Column:
    """A hash of ``values`` under the key, as 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}|{step}"), *(v.cast("string") for v in values)), 256)


def number(hexadecimal: Column) -> Column:
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, a: Column, b: Column, bases: tuple[Column, Column]) -> Column:
    """The struct ``a, b`` after all rounds. Each half is kept below its base, so the whole is a permutation."""
    def half(pair: Column, r: Column) -> Column:
        hashed = number(F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), r.cast("string"), pair["b"].cast("string"),
                                           bases[0].cast("string"), bases[1].cast("string")), 256))
        left = F.pmod(pair["a"] + F.pmod(hashed, bases[0]), bases[0])
        return F.struct(left.alias("a"), pair["b"].alias("b"))

    def other(pair: Column, r: Column) -> Column:
        hashed = number(F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), (-r).cast("string"), pair["a"].cast("string"),
                                           bases[0].cast("string"), bases[1].cast("string")), 256))
        return F.struct(pair["a"].alias("a"), F.pmod(pair["b"] + F.pmod(hashed, bases[1]), bases[1]).alias("b"))

    def one_round(pair: Column, r: Column) -> Column:
        # An array of one element names the half-way pair, so that it is evaluated once.
        return F.element_at(F.transform(F.array(half(pair, r)), lambda p: other(p, r)), 1)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*(F.lit(r) for r in range(1, ROUNDS + 1))), start, one_round)


def named(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """Another string of as many decimal digits, up to 36."""
    size = F.length(digits)
    cut = F.floor(size / 2).cast("int")
    pair = feistel(key, kind, digits.substr(F.lit(1), cut), digits.substr(cut + 1, size - cut),
                   (power_of_ten(cut), power_of_ten(size - cut)))
    return named(pair, lambda p: F.concat(padded(p["a"], cut), padded(p["b"], size - cut)))


def check_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` and it a valid card number."""
    size = F.length(payload)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda s, i: s + named(
        payload.substr(i, F.lit(1)).cast("int") * F.when((size - i) % 2 == 0, 2).otherwise(1),
        lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(-total, F.lit(10)).cast("string")


def card(key: str, digits: Column) -> Column:
    payload = digits.substr(F.lit(1), F.length(digits) - 1)
    valid = check_digit(payload) == digits.substr(F.length(digits), F.lit(1))
    return F.when(valid, named(permuted_digits(key, "card", payload), lambda p: F.concat(p, check_digit(p))))


def permuted_day(key: str, iso: Column) -> Column:
    """Another day from 1900 to 2099 for year, month and day in eight digits; null where there is no such day."""
    day = F.date_diff(F.try_to_timestamp(iso, F.lit("yyyyMMdd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    pair = feistel(key, "date", F.floor(day / DAYS[1]), day % DAYS[1], (F.lit(DAYS[0]), F.lit(DAYS[1])))
    return F.when(day.isNotNull(), named(pair, lambda p: F.date_add(
        F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int"))))


def date(key: str, digits: Column, dotted: Column) -> Column:
    """``digits`` are year, month, day, or the other way round where ``dotted``; null where there is no such day."""
    iso = F.when(dotted, F.concat(F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
                 ).otherwise(digits)
    return named(permuted_day(key, iso), lambda new: F.when(dotted, F.date_format(new, "ddMMyyyy")).otherwise(
        F.date_format(new, "yyyyMMdd")))


def slashed(key: str, match: Column) -> Column:
    """A day as 1/15/1987: the month comes first unless the first number is above 12.

    Zeros before one digit are written if the match has any. Null where there is no such day.
    """
    def fields(p: Column) -> Column:
        month_first = p[0].cast("int") <= 12
        iso = F.concat(p[2], padded(F.when(month_first, p[0]).otherwise(p[1]), 2),
                       padded(F.when(month_first, p[1]).otherwise(p[0]), 2))
        full = match.rlike("^0|/0")
        return named(permuted_day(key, iso), lambda new: F.when(month_first & full, F.date_format(new, "MM/dd/yyyy"))
                     .when(month_first, F.date_format(new, "M/d/yyyy"))
                     .when(full, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "d/M/yyyy")))

    return named(F.split(match, "/"), fields)


def phone(key: str, digits: Column, international: Column) -> Column:
    """The last ten digits permuted; of an international number what follows the country code, 15 digits in all.

    Null for an international number of fewer than eight digits.
    """
    size = F.length(digits)
    code = F.when(international, F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(size - 10)
    rest = F.when(international, F.least(size, F.lit(15)) - code).otherwise(10)
    return F.when(~international | (size >= 8), named(F.struct(code.alias("code"), rest.alias("rest")), lambda n: F.concat(
        digits.substr(F.lit(1), n["code"]), permuted_digits(key, "phone", digits.substr(n["code"] + 1, n["rest"])),
        digits.substr(n["code"] + n["rest"] + 1, size))))


def ssn(key: str, digits: Column) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999; null for anything else."""
    area, group, serial = (F.substring(digits, *x).cast("int") for x in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(key, "ssn", area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1,
                   (F.lit(898), F.lit(99 * 9999)))
    return F.when(valid, named(pair, lambda p: F.concat(
        padded(p["a"] + 1 + (p["a"] >= 665).cast("int"), 3), padded(F.floor(p["b"] / 9999) + 1, 2),
        padded(p["b"] % 9999 + 1, 4))))


def address(key: str, match: Column) -> Column:
    def octets(first: str, second: str) -> Column:
        return named(F.split(match, "[.]"), lambda o: F.element_at(o, int(first)).cast("long") * 256
                     + F.element_at(o, int(second)).cast("long"))

    pair = feistel(key, "ip", octets("1", "2"), octets("3", "4"), (F.lit(65536), F.lit(65536)))
    return named(pair, lambda p: F.concat_ws(".", *(
        x.cast("string") for h in ("a", "b") for x in (F.floor(p[h] / 256), p[h] % 256))))


def address6(key: str, match: Column) -> Column:
    """Eight groups, none left out: the first as it is, the others permuted as two numbers of 56 bits."""
    def groups(sides: Column) -> Column:
        left, right = (F.filter(F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), lambda x: x != "") for i in (0, 1))
        return F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)

    def new(all_groups: Column) -> Column:
        whole = F.array_join(F.transform(all_groups, lambda x: F.lpad(F.lower(x), 4, "0")), "")
        half = [F.conv(F.substring(whole, at, 14), 16, 10).cast("long") for at in (5, 19)]
        pair = feistel(key, "ipv6", *half, (F.lit(1 << 56), F.lit(1 << 56)))
        text = named(pair, lambda p: F.concat(F.substring(whole, 1, 4), *(
            F.lpad(F.lower(F.hex(p[h])), 14, "0") for h in ("a", "b"))))
        return F.when(F.size(all_groups) == 8, named(text, lambda t: F.array_join(F.transform(
            F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.lower(F.conv(t.substr(i, F.lit(4)), 16, 16))), ":")))

    # A double colon stands for one group at least.
    valid = ~match.contains("::") | (F.size(F.array_remove(F.split(match, ":"), "")) < 8)
    return F.when(valid, named(named(F.split(match, "::"), groups), new))


def shifted(text: Column, hashed: Column) -> Column:
    """Letters and digits of ``text`` moved on in the alphabet and in the digits, by the bytes of the hash."""
    def one(c: Column, i: Column) -> Column:
        by = F.conv(hashed.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return reduce(lambda rest, x: F.when(c.between(x[0], x[1]), F.char(
            F.ascii(F.lit(x[0])) + F.pmod(F.ascii(c) - F.ascii(F.lit(x[0])) + by, F.lit(x[2])))).otherwise(rest),
            (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)), c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise("")


def permuted_characters(key: str, kind: str, whole: Column) -> Column:
    """Letters and digits of ``whole`` replaced by others; letter case stays in place and plays no part in the shifts."""
    cut = F.floor(F.length(whole) / 2).cast("int")
    pair = F.struct(whole.substr(F.lit(1), cut).alias("a"), whole.substr(cut + 1, F.length(whole)).alias("b"))

    def one_round(r: int):
        def step(p: Column) -> Column:
            right = F.struct(p["a"].alias("a"), shifted(p["b"], keyed(key, r, kind, F.lower(p["a"]))).alias("b"))
            return named(right, lambda q: F.struct(
                shifted(q["a"], keyed(key, -r, kind, F.lower(q["b"]))).alias("a"), q["b"].alias("b")))

        return step

    for r in range(1, ROUNDS + 1):
        pair = named(pair, one_round(r))
    return named(pair, lambda p: F.concat(p["a"], p["b"]))


def mail(key: str, match: Column) -> Column:
    """The part before the last dot permuted."""
    whole = F.regexp_extract(match, r"^(.*)\.([A-Za-z0-9-]+)$", 1)
    return F.concat(permuted_characters(key, "mail", whole), F.regexp_extract(match, r"(\.[A-Za-z0-9-]+)$", 1))


def remainder97(text: Column) -> Column:
    """Digits and capital letters, these as 10 to 35, read as one number, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.pmod(F.when(
        c.between("0", "9"), s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 55), F.lit(97)))


def iban(key: str, whole: Column) -> Column:
    """``whole`` without spaces: the country, new check digits, the rest permuted; null where its check digits are wrong."""
    country, rest = F.substring(whole, 1, 2), whole.substr(F.lit(5), F.length(whole))
    valid = F.length(whole).between(15, 34) & (
        remainder97(F.concat(rest, F.substring(whole, 1, 4))) == 1)
    return F.when(valid, named(permuted_characters(key, "iban", rest), lambda new: F.concat(
        country, padded(98 - remainder97(F.concat(new, country, F.lit("00"))), 2), new)))


def in_format(match: Column, digits: Column, letters: bool = False) -> Column:
    """``match`` with its digits, and capital letters if ``letters``, replaced by ``digits``, one by one."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))
    return F.aggregate(F.split(match, ""), start, lambda s, c: F.when(
        c.between("0", "9") | (F.lit(letters) & c.between("A", "Z")), F.struct((s["at"] + 1).alias("at"), F.concat(
            s["text"], digits.substr(s["at"], F.lit(1))).alias("text"))).otherwise(
        F.struct(s["at"].alias("at"), F.concat(s["text"], c).alias("text"))), lambda s: s["text"])


def pseudonym(key: str, match: Column) -> Column:
    """The struct ``kind, text`` for a match; a value that isn't valid has no kind and stays as it is."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)

    def found(kind: str, new: Column) -> Column:
        return named(new, lambda x: F.struct(F.when(x.isNotNull(), F.lit(kind)).alias("kind"),
                                             F.coalesce(x, match).alias("text")))

    def of_digits(kind: str, new) -> Column:
        return found(kind, named(named(digits, new), lambda x: F.when(x.isNotNull(), in_format(match, x))))

    return (F.when(match.contains("@"), found("mail", mail(key, match)))
            .when(match.rlike(f"^{OCTET}([.]{OCTET}){{3}}$"), found("ip", address(key, match)))
            .when(match.contains(":"), found("ipv6", address6(key, match)))
            .when(match.rlike("^[A-Z]{2}"), found("iban", named(
                named(F.regexp_replace(match, " ", ""), lambda w: iban(key, w)),
                lambda x: F.when(x.isNotNull(), in_format(match, x, letters=True)))))
            .when(match.startswith("+"), of_digits("phone", lambda d: phone(key, d, F.lit(True))))
            .when(match.rlike("^[0-9]{1,2}/"), found("date", slashed(key, match)))
            .when(size >= 13, of_digits("card", lambda d: card(key, d)))
            .when(size == 8, of_digits("date", lambda d: date(key, d, match.contains("."))))
            .when(size == 9, of_digits("ssn", lambda d: ssn(key, d)))
            .otherwise(of_digits("phone", lambda d: phone(key, d, F.lit(False)))))


def pseudonymised(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced, and ``n_<kind>`` for each kind in PATTERNS.

    A null text stays null and an empty one empty, with counts of 0. Columns named like the counts are
    replaced, all others stay. The same key gives the same pseudonyms everywhere; whoever has it can undo them.
    Repeated rows stay repeated, an empty table gives no rows, and a text of any length is searched as a whole, in one pass.
    """
    source = F.col(f"`{text}`")
    # Nothing of any kind is without a digit or an @; most texts are done with that.
    wanted = F.coalesce(source.rlike("[0-9@]"), F.lit(False))
    found = F.transform(F.regexp_extract_all(source, F.lit(ANY), F.lit(0)), lambda m: pseudonym(key, m))
    nothing = F.array().cast("array<struct<kind:string,text:string>>")
    name = free_name(df, "_found")
    parts = df.withColumn(name, F.when(wanted, found).otherwise(nothing))
    between = F.transform(F.split(source, ANY, -1), lambda p, i: F.concat(
        p, F.coalesce(F.get(name, i)["text"], F.lit(""))))

    def count(kind: str) -> Column:
        return F.size(F.filter(name, lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": count(kind) for kind in PATTERNS}
    return parts.withColumns(counts | {text: F.when(F.size(name) > 0, F.array_join(between, "")).otherwise(
        source)}).drop(name)
