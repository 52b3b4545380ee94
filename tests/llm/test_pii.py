"""Pseudonyms: format, linking and permutation, against a plain Feistel network."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import pii

KEY = "k"


def digest(kind, step, value, bases):
    text = "|".join([f"{KEY}|{kind}", str(step), str(value), *map(str, bases)])
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)


def feistel(kind, a, b, bases):
    for r in range(1, pii.ROUNDS + 1):
        a = (a + digest(kind, r, b, bases) % bases[0]) % bases[0]
        b = (b + digest(kind, -r, a, bases) % bases[1]) % bases[1]
    return a, b


def digits(kind, text):
    cut = len(text) // 2
    a, b = feistel(kind, int(text[:cut]), int(text[cut:]), (10 ** cut, 10 ** (len(text) - cut)))
    return f"{a:0{cut}}{b:0{len(text) - cut}}"


def luhn(text):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(text))) % 10 == 0


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymised(df, KEY).orderBy("doc_id").collect()]


def test_cards(spark):
    good = "4845168114407329"
    spaced = " ".join(good[i:i + 4] for i in range(0, 16, 4))
    texts = [f"a {good}.", f"({spaced})", "4845168114407328", f"x{good}", f"{good}1", "371449635398431"]
    got = replaced(spark, texts)
    new = digits("card", good[:15])
    new += next(d for d in "0123456789" if luhn(new + d))
    assert got[0] == f"a {new}." and got[1] == "(" + " ".join(new[i:i + 4] for i in range(0, 16, 4)) + ")"
    assert got[2:5] == texts[2:5] and got[5] != texts[5] and luhn(got[5]) and len(got[5]) == 15


def test_phones_and_addresses(spark):
    texts = ["+1 (017) 555-7713, 017-555-7713", "233.254.104.120", "256.1.1.1 1.2.3.4.5", "0.0.0.0", "555-7713"]
    got = replaced(spark, texts)
    new = digits("phone", "0175557713")
    assert got[0] == f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}, {new[:3]}-{new[3:6]}-{new[6:]}"
    a, b = feistel("ip", 233 * 256 + 254, 104 * 256 + 120, (65536, 65536))
    assert got[1] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    assert got[2] == texts[2] and got[3] != texts[3] and got[4] == texts[4]


def test_dates_and_ssn(spark):
    texts = ["1999-02-28 28.02.1999 1999/02/28", "1999-02-30 31.04.2001", "123-45-6789", "666-45-6789 000-12-3456 123-00-4567"]
    got = replaced(spark, texts)
    iso, dotted, slashed = got[0].split()
    assert iso == slashed.replace("/", "-") == "-".join(reversed(dotted.split("."))) != "1999-02-28"
    assert got[1] == texts[1] and got[3] == texts[3]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[2]) and got[2] != texts[2]


def test_mail(spark):
    texts = ["The.19@Mail5.example.com", "to the.19@mail5.example.com, or", "other.19@mail5.example.com", "a@b", "@x.de"]
    got = replaced(spark, texts)
    assert got[0].lower() in got[1] and got[0][0].isupper() and re.fullmatch(r"[A-Z][a-z]{2}\.\d\d@[A-Z]\w+\.\w+\.com", got[0])
    assert got[2] != got[0] and got[3:] == texts[3:]


@pytest.mark.parametrize("bases", [(17, 4297), (10, 10), (1, 7)])
def test_permutation(spark, bases):
    n = bases[0] * bases[1]
    pair = pii.feistel(KEY, "t", F.floor(F.col("id") / bases[1]), F.col("id") % bases[1], tuple(map(F.lit, bases)))
    rows = spark.range(n).select("id", pair.alias("p")).collect() if n < 100 else spark.range(0, n, 97).select("id", pair.alias("p")).collect()
    assert len({(r.p.a, r.p.b) for r in rows}) == len(rows)
    assert all((r.p.a, r.p.b) == feistel("t", *divmod(r.id, bases[1]), bases) for r in rows[:200])


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "no data", 9), (4, "1.2.3.4", 9), (4, "1.2.3.4", 9)],
                               "doc_id long, text string, n_ip int")
    got = pii.pseudonymised(df, KEY)
    assert set(got.columns) == {"doc_id", "text", *(f"n_{k}" for k in pii.PATTERNS)}
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == "no data" and rows[4].n_ip == 1
    assert rows[1].n_ip == rows[3].n_ip == 0 and got.count() == 5
    other = pii.pseudonymised(df, "another key").where("doc_id = 4").first().text
    assert other not in (rows[4].text, "1.2.3.4")
    assert pii.pseudonymised(df.limit(0), KEY).collect() == []
    long = "word " * 200_000 + "1.2.3.4"
    assert replaced(spark, [long]) == ["word " * 200_000 + rows[4].text]


def characters(kind, text):
    """The rounds of letters and digits in plain Python."""
    def shifted(t, other, step):
        hashed = hashlib.sha256(f"{KEY}|{kind}|{step}|{other.lower()}".encode()).digest()
        out = ""
        for i, c in enumerate(t):
            by = hashed[i % 32]
            for first, n in (("a", 26), ("A", 26), ("0", 10)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                    break
            out += c
        return out

    a, b = text[:len(text) // 2], text[len(text) // 2:]
    for r in range(1, pii.ROUNDS + 1):
        b = shifted(b, a, r)
        a = shifted(a, b, -r)
    return a + b


def test_more_dates(spark):
    texts = ["2024-01-15T10:30:00Z 2024-01-15", "1/15/1987 01/15/1987 15/1/1987 1987-01-15", "2/30/1999 13/13/2000",
             "1/2/2003/4", "2024-01-15Txt"]
    got = replaced(spark, texts)
    stamp, day = got[0].split()
    assert stamp == f"{day}T10:30:00Z" and day != "2024-01-15"
    short, full, other, iso = got[1].split()
    y, m, d = iso.split("-")
    assert full == f"{m}/{d}/{y}" and short == f"{int(m)}/{int(d)}/{y}" and other == f"{int(d)}/{int(m)}/{y}"
    assert iso != "1987-01-15" and got[2:] == texts[2:]


def test_more_phones(spark):
    texts = ["555 123 4567, 555-123-4567, +15551234567", "+44 20 7946 0958 or +442079460958 or +44-20-7946-0958",
             "+49 (30) 1234567", "+353 1 234 5678", "+12", "1+442079460958", "+44 20 7946 0958 2024-01-15"]
    got = replaced(spark, texts)
    new = digits("phone", "5551234567")
    assert got[0] == f"{new[:3]} {new[3:6]} {new[6:]}, {new[:3]}-{new[3:6]}-{new[6:]}, +1{new}"
    new = digits("phone", "2079460958")
    spaced = f"+44 {new[:2]} {new[2:6]} {new[6:]}"
    assert got[1] == f"{spaced} or +44{new} or {spaced.replace(' ', '-')}"
    new = digits("phone", "301234567")
    assert got[2] == f"+49 ({new[:2]}) {new[2:]}"
    new = digits("phone", "12345678")
    assert got[3] == f"+353 {new[0]} {new[1:4]} {new[4:]}"
    assert got[4:6] == texts[4:6]
    assert got[6].startswith("+44 ") and "20 7946 0958" not in got[6]


def test_ipv6(spark):
    texts = ["2001:db8::8a2e:370:7334, 2001:0DB8:0:0:0:8A2E:0370:7334", "std::move a::b 12:30:45 ::1",
             "1:2:3:4:5:6:7::8", "fe80::1%eth0", "00:1b:44:11:3a:b7", "1:2:3:4:5:6:7:8::9"]
    got = replaced(spark, texts)
    a, b = feistel("ipv6", 0x0db80000000000, 0x008a2e03707334, (1 << 56, 1 << 56))
    whole = f"2001{a:014x}{b:014x}"
    new = ":".join(f"{int(whole[i:i + 4], 16):x}" for i in range(0, 32, 4))
    assert got[0] == f"{new}, {new}" and got[1] == texts[1]
    assert got[3].startswith("fe80:") and got[3].endswith("%eth0") and got[3] != texts[3]
    assert got[4:] == texts[4:]


def test_iban(spark):
    texts = ["DE89 3704 0044 0532 0130 00, DE89370400440532013000.", "GB29NWBK60161331926819", "DE88370400440532013000",
             "FR14 2004 1010 0505 0001 3M02 606 now"]
    got = replaced(spark, texts)

    def value(text):
        return int("".join(str(int(c, 36)) for c in text))

    new = characters("iban", "370400440532013000")
    new = f"DE{98 - value(new + 'DE00') % 97:02}{new}"
    assert value(new[4:] + new[:4]) % 97 == 1
    assert got[0] == f"{' '.join(new[i:i + 4] for i in range(0, 22, 4))}, {new}."
    assert re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", got[1]) and value(got[1][4:] + got[1][:4]) % 97 == 1 and got[1] != texts[1]
    assert got[2] == texts[2] and got[3][:2] == "FR" and got[3].endswith(" now") and got[3][4:] != texts[3][4:]


def test_mail_rounds_and_punycode(spark):
    got = replaced(spark, ["to ann@mail.example.com", "to bob@xn--bcher-kva.xn--p1ai, now"])
    assert got[0] == f"to {characters('mail', 'ann@mail.example')}.com"
    assert got[1] == f"to {characters('mail', 'bob@xn--bcher-kva')}.xn--p1ai, now"
