"""Pseudonyms against a plain Feistel network over Python's own regular expressions, HMAC and calendar."""

import datetime
import hashlib
import hmac
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tracewell.llm import pii

KEY = "a key of the tests"


def mac(message):
    return hmac.new(KEY.encode(), message.encode(), hashlib.sha256).hexdigest()


def feistel_text(text, kind, alphabets, tweak=""):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(pii.ROUNDS):
        digest, new = mac(f"{kind}|{tweak}|{r}|{b}"), ""
        for i, c in enumerate(a):
            by = int(hashlib.sha256(f"{digest}|{i}".encode()).hexdigest()[:15], 16)
            new += next((x[(x.index(c) + by) % len(x)] for x in alphabets if c in x), c)
        a, b = b, new
    return a + b


def feistel_pair(a, b, sizes, kind):
    for r in range(pii.ROUNDS):
        by = int(mac(f"{kind}||{r}|{a if r % 2 else b}")[:15], 16)
        a, b = (a, (b + by) % sizes[1]) if r % 2 else ((a + by) % sizes[0], b)
    return a, b


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def fill(form, characters, kept):
    left = iter(characters)
    return "".join(c if kept(c) else next(left) for c in form)


def as_written(form, lower):
    return "".join(c.upper() if f.isupper() else c for f, c in zip(form, lower))


def day_of(value):
    """Days since 1600-01-01, by an own calendar that also knows years before 1."""
    for pattern, order in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd"), (r"(\d{4})/(\d\d)/(\d\d)", "ymd"), (r"(\d\d)/(\d\d)/(\d{4})", "mdy"), (r"(\d\d)\.(\d\d)\.(\d{4})", "dmy")):
        if m := re.fullmatch(pattern, value):
            part = dict(zip(order, map(int, m.groups())))
            try:
                return (datetime.date(part["y"], part["m"], part["d"]) - datetime.date(1600, 1, 1)).days, pattern
            except ValueError:
                return None
    return None


def date_written(days, pattern):
    d = datetime.date(2000, 1, 1) + datetime.timedelta(days=days % 146_097)
    y = 1600 + 400 * (days // 146_097) + d.year - 2000
    if pattern.endswith(r"(\d{4})"):
        return f"{d.month:02}/{d.day:02}/{y:04}" if "/" in pattern else f"{d.day:02}.{d.month:02}.{y:04}"
    sep = "/" if "/" in pattern else "-"
    return f"{y:04}{sep}{d.month:02}{sep}{d.day:02}"


def expected(found, kind):
    """The pseudonym of a match as one kind, or None if it isn't valid."""
    digits = re.sub(r"\D", "", found)
    number = lambda c: not c.isdigit()
    if kind == "email":
        lower = found.lower()
        front, _, last = lower.rpartition(".")
        return as_written(found, feistel_text(front + ".", "email", pii.LETTERS) + last)
    if kind == "account":
        plain = found.replace(" ", "")
        if not "02" <= plain[2:4] <= "98" or mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = feistel_text(plain[4:], "account", pii.CAPITALS, plain[:2])
        return fill(found, f"{plain[:2]}{98 - mod97(body + plain[:2] + '00'):02}{body}", lambda c: c == " ")
    if kind.endswith("phone"):
        country = re.match(pii.COUNTRY, digits)[0] if found[0] == "+" else "1"
        national = digits[len(country) :] if found[0] == "+" else digits
        if not (len(national) == 10 if country == "1" else 5 <= len(national) <= 14):
            return None
        new = feistel_text(national, "phone", pii.DIGITS, country)
        return fill(found, (country if found[0] == "+" else "") + new, number)
    if kind == "address":
        parts = found.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        a, b, c, d = map(int, parts)
        x, y = feistel_pair(a * 256 + b, c * 256 + d, (65536, 65536), "address")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "date":
        if not (day := day_of(found)):
            return None
        cycle, inside = divmod(day[0], 146_097)
        a, b = feistel_pair(*divmod(inside, pii.CYCLE[1]), pii.CYCLE, "date")
        return date_written(cycle * 146_097 + a * pii.CYCLE[1] + b, day[1])
    if kind == "ssn":
        area, group, serial = map(int, found.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        areas = [x for x in range(1, 900) if x != 666]
        a, b = feistel_pair(areas.index(area) * 99 + group - 1, serial - 1, pii.SSN, "ssn")
        return f"{areas[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"
    if kind == "card":
        if luhn(digits):
            return None
        body = feistel_text(digits[:-1], "card", pii.DIGITS)
        return fill(found, body + str(-luhn(body + "0") % 10), number)
    new = feistel_text(found.lower(), "secret", pii.HEX)
    return new.upper() if re.search("[A-F]", found) else new


def brute(text):
    """Every place outside of replaced values is tried as each kind in order."""
    if not text:
        return text, 0, 0
    out, at, found, replaced = [], 0, 0, 0
    begins, patterns = re.compile(pii.ANY, re.ASCII), {k: re.compile(p, re.ASCII) for k, p in pii.PATTERNS.items()}
    while at < len(text):
        new = None
        if begins.match(text, at):
            found += 1
            tried = ((m[0], expected(m[0], k)) for k, p in patterns.items() if (m := p.match(text, at)))
            old, new = next(((o, n) for o, n in tried if n is not None), (None, None))
        if new is None:
            out.append(text[at])
            at += 1
        else:
            replaced += new != old
            out.append(new)
            at += len(old)
    return "".join(out), found, replaced


def random_value():
    d = lambda n: "".join(random.choices(string.digits, k=n))
    name = "".join(random.choices(string.ascii_letters + "._%+-9", k=random.randint(1, 12)))
    card = d(random.choice([12, 15, 18]))
    card += str(-luhn(card + "0") % 10)
    body, country = "".join(random.choices(string.digits + string.ascii_uppercase, k=random.randint(12, 18))), random.choice(["DE", "GB", "FR"])
    account = f"{country}{98 - mod97(body + country + '00'):02}{body}"
    spaced = " ".join(account[i : i + 4] for i in range(0, len(account), 4))
    phone, cc = d(10), random.choice(["1", "49", "352", "7"])
    y, m, day = f"{random.choice([random.randint(0, 9999), random.randint(1900, 2100)]):04}", f"{random.randint(0, 13):02}", f"{random.randint(0, 31):02}"
    return random.choice([
        f"{name}@{random.choice(['mail', 'X-1', 'a'])}.{random.choice(['example.com', 'Org', 'co.uk'])}",
        account, spaced, account[:-1] + "Q", f"+{cc}{phone}", f"+{cc} {phone[:3]} {phone[3:6]}-{phone[6:]}", f"+{cc}({phone[:3]}){phone[3:6]} {phone[6:]}",
        f"{phone[:3]}-{phone[3:6]}-{phone[6:]}", f"({phone[:3]}) {phone[3:6]}-{phone[6:]}", ".".join(str(random.randint(0, 270)) for _ in range(4)), f"010.1.{d(1)}.2",
        f"{y}-{m}-{day}", f"{y}/{m}/{day}", f"{m}/{day}/{y}", f"{day}.{m}.{y}", f"{d(3)}-{d(2)}-{d(4)}", "666-12-3456", card, "-".join(card[i : i + 4] for i in range(0, len(card), 4)), d(16),
        "AB12 " + " ".join(card[i : i + 4] for i in range(0, len(card), 4)), f"{d(2)} {account}", f"12.{'.'.join(str(random.randint(0, 270)) for _ in range(4))}",
        random.choice("ABCDEF") + random.choice("ABCDEF") + d(2) + "".join(random.choices("0123456789ABCDEF", k=28)), f"{d(13)} {card}",
        "".join(random.choices("0123456789abcdef", k=random.choice([31, 32, 40]))), "".join(random.choices("0123456789ABCDEF", k=40)), d(3), "v2.0", "word", "Ünïcode",
    ])


def results(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.text, r.n_found, r.n_replaced) for r in pii.pseudonymise(rows, KEY).collect()}


def test_pseudonyms_against_brute_force(spark):
    random.seed(11)
    texts = []
    for _ in range(500):
        values = [random_value() for _ in range(random.randint(0, 6))]
        texts.append("".join(x for v in values for x in (v, random.choice([" ", "\n", ", ", "!! ", "; ", '"', ") "]))))
    texts += ["", None, "no data", " ".join(random_value() for _ in range(4000)), "x" * 200_000 + " 2024-02-29"]
    assert results(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


#: Texts and what is in them, by hand: (kind, place) of each valid value.
BY_HAND = [
    ("AB12CDEF0123456789ABCDEF01234567", [("secret", 0, 32)]),
    ("AB12 4111 1111 1111 1111", [("card", 5, 24)]),
    ("DE89 3704 0044 0532 0130 00", [("account", 0, 27)]),
    ("see DE89370400440532013001 or DE89370400440532013000", [("account", 30, 52)]),
    ("999.1.1.1 10.0.0.1", [("address", 10, 18)]),
    ("2024-02-30 2024-02-29", [("date", 11, 21)]),
    ("000-12-3456 123-45-6789", [("ssn", 12, 23)]),
    ("4111 1111 1111 1112 4111 1111 1111 1111", [("card", 20, 39)]),
    ("mail AB12 4111-1111-1111-1111, +1 212 555 0123", [("card", 10, 29), ("phone", 31, 46)]),
    ("Z@1 a.b@example.org", [("email", 4, 19)]),
]


def test_what_is_valid_is_replaced_wherever_it_stands(spark):
    got = results(spark, [t for t, _ in BY_HAND])
    for i, (text, values) in enumerate(BY_HAND):
        form, at = "", 0
        for _, start, end in values:
            form, at = form + re.escape(text[at:start]) + "(.+?)", end
        made = re.fullmatch(form + re.escape(text[at:]), got[i][0])
        assert made and got[i][2] == len(values)
        for (kind, start, end), new in zip(values, made.groups()):
            assert new != text[start:end] and (len(new) == end - start or kind == "address")
            plain = re.sub("[ -]", "", new)
            assert {"secret": lambda: re.fullmatch("[0-9A-F]{32}", new), "card": lambda: luhn(plain) == 0, "account": lambda: mod97(plain[4:] + plain[:4]) == 1}.get(kind, lambda: True)()


def test_all_texts_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: brute(r.text) for r in rows.collect()}
    got = {r.doc_id: (r.text, r.n_found, r.n_replaced) for r in pii.pseudonymise(rows, KEY).collect()}
    assert got == want and sum(n for _, _, n in want.values())


def test_equal_values_in_other_notations_stay_linked(spark):
    texts = ["+1 017 555 7713", "+1-017-555-7713", "+1 (017) 555-7713", "+10175557713", "017-555-7713", "(017) 555-7713"]
    numbers = {re.sub(r"\D", "", t)[-10:] for t, _, n in results(spark, texts).values() if n}
    assert len(numbers) == 1 and numbers != {"0175557713"}
    days = results(spark, ["2024-02-29", "2024/02/29", "02/29/2024", "29.02.2024"])
    assert len({day_of(t)[0] for t, _, _ in days.values()}) == 1 and days[0][0] != "2024-02-29"
    mails = {t.lower() for t, _, _ in results(spark, ["Bob@Foo.Org", "bob@foo.org", "BOB@FOO.ORG"]).values()}
    assert len(mails) == 1 and not mails & {"bob@foo.org"}
    cards = {re.sub(r"\D", "", t) for t, _, _ in results(spark, ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"]).values()}
    assert len(cards) == 1 and luhn(cards.pop()) == 0


def test_pseudonyms_of_repeated_rows_empty_tables_and_clashing_names(spark):
    schema = "n_found string, doc_id long, text string, row string, out string, _found string, `a.b` int"
    rows = [("u", 1, "on 2024-02-29", "r", "o", "f", 1)] * 2 + [("u", None, None, "r", "o", "f", 2)]
    docs = spark.createDataFrame(rows, schema)
    out = pii.pseudonymise(docs, KEY)
    assert out.columns == ["doc_id", "text", "row", "out", "_found", "a.b", "n_found", "n_replaced"]
    got = sorted(out.collect(), key=str)
    text = brute("on 2024-02-29")[0]
    assert [tuple(r) for r in got] == [(1, text, "r", "o", "f", 1, 1, 1)] * 2 + [(None, None, "r", "o", "f", 2, 0, 0)]
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0
    assert pii.pseudonymise(docs.select("text"), KEY).columns == ["text", "n_found", "n_replaced"]


@pytest.mark.parametrize("size", [1, 3, 4])
def test_permutations_have_no_collisions(spark, size):
    n = 10**size
    numbers = spark.range(n).select(F.lpad(F.col("id").cast("string"), size, "0").alias("v"))
    assert numbers.select(pii.permute_text(F.col("v"), "t", "k", pii.DIGITS).alias("p")).distinct().count() == n


def test_days_of_a_cycle_are_permuted(spark):
    days = spark.range(0, 146_097, 1, 8).select(F.date_format(F.date_add(F.lit("1600-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    row = days.select(pii._date(F.col("d"), "k").alias("p")).agg(F.count_distinct("p").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert (row.n, row.lo, row.hi) == (146_097, "1600-01-01", "1999-12-31")
