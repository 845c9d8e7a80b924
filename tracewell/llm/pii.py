"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Numbers and dates are found, validated, and permuted inside their own format:
card numbers stay Luhn-valid, account numbers keep their check digits,
addresses stay addresses, dates stay dates of the same 400-year cycle. The
permutation depends on the key and on the value behind the notation (digits,
days, lower-cased letters), so equal values stay equal in all documents however
they are written, and different values stay different.

A value is cut into two halves. In each round one half is moved by an
HMAC-SHA256 of the other half under the key, which makes every round, and so
the whole, a permutation.

What is claimed: without the key, a pseudonym tells no more about its value than
which occurrences are equal, its length and separators, and what is kept: the
country of phones and accounts, the last label of mail domains, the 400-year
cycle of dates. Who may have chosen texts pseudonymised can look values up. The
key stands in the query plan; keep plans and event logs as safe as the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import let, quoted

#: Even, so that the halves end up where they began.
ROUNDS = 10

_END = r"(?![0-9A-Za-z])"
#: What is found, in order of precedence.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "account": r"[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})" + _END,
    "phone": r"(?<![\w+])\+(?:\d{8,15}|\d{1,3}(?:[ .-]\(?|\()\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4})(?!\d)",
    "local_phone": r"(?<![\w+.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?![\w-])",
    "address": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "secret": r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + _END,
}
#: Every match begins at the beginning of a word; that is asked first, for speed.
ANY = r"(?<![0-9A-Za-z])(?=[0-9A-Za-z._%+(-])(?:" + "|".join(PATTERNS.values()) + ")"
#: Texts without any of these hold no match.
HINT = "[0-9@]"

DIGITS = ["0123456789"]
LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz"]
CAPITALS = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
HEX = ["0123456789abcdef"]
#: Calling codes of one and two digits as a rule of the numbering plan; the others have three.
COUNTRY = r"^([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: The notations of dates: a slash is month first, a full stop day first.
NOTATIONS = {"^....-": "yyyy-MM-dd", "^..../": "yyyy/MM/dd", "^../": "MM/dd/yyyy", r"^..\.": "dd.MM.yyyy"}
#: Days of a 400-year cycle, as two factors for the two halves; 1600-01-01 begins one.
CYCLE = (27, 5411)
EPOCH = "1600-01-01"
#: Areas (1 to 899 but 666) times groups (1 to 99), and serial numbers (1 to 9999), of social security numbers.
SSN = (898 * 99, 9999)


def _mac(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a string, as hexadecimal digits."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _number(digest: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _shift(c: Column, by: Column, alphabets: list[str]) -> Column:
    """The character ``by`` places on in its alphabet; others stay."""
    out = c
    for alphabet in alphabets:
        at = F.instr(F.lit(alphabet), c)
        moved = F.substring(F.lit(alphabet), ((at - 1 + by) % len(alphabet) + 1).cast("int"), F.lit(1))
        out = F.when((at > 0) & (c != ""), moved).otherwise(out)
    return out


def _message(kind: str, tweak: Column, number: Column, other: Column) -> Column:
    return F.concat(F.lit(f"{kind}|"), tweak, F.lit("|"), number.cast("string"), F.lit("|"), other.cast("string"))


def permute_text(text: Column, kind: str, key: str, alphabets: list[str], tweak: Column | None = None) -> Column:
    """Permute the characters of a string within their alphabets; others stay where they are."""
    tweak = F.lit("") if tweak is None else tweak

    def rounds(s: Column, number: Column) -> Column:
        def moved(digest: Column) -> Column:
            by = lambda i: _number(F.sha2(F.concat(digest, F.lit("|"), i.cast("string")), 256))
            return F.array_join(F.transform(F.split(s["a"], ""), lambda c, i: _shift(c, by(i), alphabets)), "")

        new = let(_mac(key, _message(kind, tweak, number, s["b"])), moved)
        return F.struct(s["b"].alias("a"), new.alias("b"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, rounds, lambda s: F.concat(s["a"], s["b"]))


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], kind: str, key: str, back, tweak: Column | None = None) -> Column:
    """Permute a pair of numbers below ``sizes``, then build the result with ``back``."""
    tweak = F.lit("") if tweak is None else tweak

    def rounds(s: Column, number: Column) -> Column:
        even = number % 2 == 0
        by = _number(_mac(key, _message(kind, tweak, number, F.when(even, s["b"]).otherwise(s["a"]))))
        move = lambda n: F.struct(
            F.when(even, (s["a"] + n % sizes[0]) % sizes[0]).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + n % sizes[1]) % sizes[1]).alias("b"),
        )
        return let(by, move)

    start = F.struct(left.cast("bigint").alias("a"), right.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, rounds, lambda s: back(s["a"], s["b"]))


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's rule; the last digit counts once."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(
            F.filter(F.split(digits, ""), lambda c: c != ""),
            lambda c, i: let(c.cast("int") * (1 + (n - 1 - i) % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _mod97(characters: Column) -> Column:
    """The remainder of an account number whose letters count 10 to 35."""
    value = lambda c: F.instr(F.lit(CAPITALS[0] + CAPITALS[1]), c).cast("bigint") - 1
    return F.aggregate(
        F.filter(F.split(characters, ""), lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97),
    )


def _fill(form: Column, characters: Column, kept: str = "[^0-9]") -> Column:
    """``form`` with the characters other than ``kept`` replaced in turn by ``characters``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.split(form, ""),
        start,
        lambda a, c: F.when(
            (c != "") & ~c.rlike(f"^{kept}$"),
            F.struct(F.concat(a["out"], F.substring(characters, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )


def _as_written(form: Column, lower: Column) -> Column:
    """``lower`` with the capitals of ``form``."""
    return F.array_join(
        F.transform(
            F.split(lower, ""), lambda c, i: F.when(F.substring(form, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)
        ),
        "",
    )


def _email(found: Column, key: str) -> Column:
    """Local part and domain but for its last label, letters by letters; capitals stay where they are."""
    lower = F.lower(found)
    last = F.substring_index(lower, ".", -1)
    front = F.substring(lower, F.lit(1), F.length(lower) - F.length(last))
    return let(permute_text(front, "email", key, LETTERS), lambda new: _as_written(found, F.concat(new, last)))


def _account(found: Column, key: str) -> Column:
    """An international account number with a valid check, with another valid one of its country; null for others."""

    def permuted(plain: Column) -> Column:
        country = F.substring(plain, 1, 2)
        body = permute_text(F.substring(plain, F.lit(5), F.length(plain)), "account", key, CAPITALS, country)
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        complete = let(body, lambda b: F.concat(country, check(b), b))
        ordered = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
        return F.when(
            F.substring(plain, 3, 2).between("02", "98") & (_mod97(ordered) == 1), let(complete, lambda c: _fill(found, c, " "))
        )

    return let(F.regexp_replace(found, " ", ""), permuted)


def _phone(found: Column, key: str) -> Column:
    """A phone number; numbers without a country belong to country 1. Null where the length is wrong for it."""

    def permuted(digits: Column) -> Column:
        abroad = found.startswith("+")
        country = F.when(abroad, F.regexp_extract(digits, COUNTRY, 1)).otherwise("1")

        def of_country(country: Column) -> Column:
            national = F.when(abroad, F.substring(digits, F.length(country) + 1, F.length(digits))).otherwise(digits)
            valid = F.when(country == "1", F.length(national) == 10).otherwise(F.length(national).between(5, 14))
            new = permute_text(national, "phone", key, DIGITS, country)
            return F.when(valid, let(new, lambda n: _fill(found, F.when(abroad, F.concat(country, n)).otherwise(n))))

        return let(country, of_country)

    return let(F.regexp_replace(found, "[^0-9]", ""), permuted)


def _card(found: Column, key: str) -> Column:
    """A number with a valid check digit, with another valid one; null for others."""

    def permuted(digits: Column) -> Column:
        body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key, DIGITS)
        complete = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(_luhn(digits) % 10 == 0, let(complete, lambda c: _fill(found, c)))

    return let(F.regexp_replace(found, "[^0-9]", ""), permuted)


def _ssn(found: Column, key: str) -> Column:
    """A number that can have been issued, with another such one; null for others."""
    part = lambda at, n: F.substring(found, at, n).cast("bigint")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    def back(a: Column, b: Column) -> Column:
        place = F.floor(a / 99) + 1
        text = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", text(place + F.when(place >= 666, 1).otherwise(0), 3), text(a % 99 + 1, 2), text(b + 1, 4))

    first = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    return F.when(valid, permute_pair(first, serial - 1, SSN, "ssn", key, back))


def _address(found: Column, key: str) -> Column:
    """Four bytes, permuted as two pairs of bytes; null if one is above 255 or begins with a needless 0."""
    part = lambda i: F.get(F.split(found, r"\."), i).cast("bigint")
    text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    valid = (F.greatest(*[part(i) for i in range(4)]) <= 255) & ~found.rlike(r"(^|\.)0\d")
    back = lambda a, b: F.concat_ws(".", text(a), text(b))
    pair = permute_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), (65536, 65536), "address", key, back)
    return F.when(valid, pair)


def _date(found: Column, key: str) -> Column:
    """A day of the same 400-year cycle in the same notation; null if there is no such day, or the year is 0."""
    one, two = CYCLE

    def written(form: Column) -> Column:
        day = F.try_to_timestamp(found, form).cast("date")

        def permuted(days: Column) -> Column:
            cycle = F.floor(days / (one * two))
            inside = F.pmod(days, F.lit(one * two))
            back = lambda a, b: F.date_add(F.lit(EPOCH).cast("date"), (cycle * (one * two) + a * two + b).cast("int"))
            new = permute_pair(F.floor(inside / two), inside % two, CYCLE, "date", key, back)
            return let(new, lambda d: F.coalesce(*[F.when(form == n, F.date_format(d, n)) for n in NOTATIONS.values()]))

        valid = F.regexp_extract(found, r"\d{4}", 0) != "0000"
        return F.when(valid & day.isNotNull(), let(F.datediff(day, F.lit(EPOCH).cast("date")).cast("bigint"), permuted))

    return let(F.coalesce(*[F.when(found.rlike(p), F.lit(n)) for p, n in NOTATIONS.items()]), written)


def _secret(found: Column, key: str) -> Column:
    """Hexadecimal digits in the case of those of ``found``."""
    return let(permute_text(F.lower(found), "secret", key, HEX), lambda new: F.when(found.rlike("[A-F]"), F.upper(new)).otherwise(new))


#: What makes a pseudonym of each kind, or null of what isn't valid.
MAKERS = {
    "email": _email, "account": _account, "phone": _phone, "local_phone": _phone, "address": _address, "date": _date, "ssn": _ssn, "card": _card, "secret": _secret,
}


def _replaced(line: Column, key: str) -> Column:
    """A line with its valid values replaced (text), and how many matches were looked at (n_found) and replaced (n_replaced).

    ``ANY`` without width holds at every place where a match begins, inside
    others too. The line is cut at these places; of each one the kinds are tried
    in their order until one is valid, and places inside a value that was
    replaced are left out.
    """
    at = f"(?={ANY})"
    matches = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(f"{at}(?=({PATTERNS[kind]})|)"), F.lit(1)).alias(kind) for kind in MAKERS])

    def of_kind(found: Column, kind: str) -> Column:
        new = let(F.when(found != "", found), lambda f: MAKERS[kind](f, key))
        return let(new, lambda n: F.when(n.isNotNull(), F.struct(n.alias("new"), F.length(found).alias("n"), (n != found).alias("moved"))))

    def walked(pieces: Column, values: Column, first: Column) -> Column:
        # ``end``: where the value that was replaced last ends; ``cuts``: how much of each piece it covers, or -1 for a new value.
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.array().cast("array<int>").alias("cuts"))

        def step(state: Column, i: Column) -> Column:
            value, size = F.get(values, i - first), F.length(F.get(pieces, i))
            inside = state["at"] < state["end"]
            taken = ~inside & (i >= first) & value.isNotNull()
            cut = F.when(taken, -1).when(inside, F.least(state["end"] - state["at"], size)).otherwise(0)
            return F.struct(
                (state["at"] + size).alias("at"), F.when(taken, state["at"] + value["n"]).otherwise(state["end"]).alias("end"), F.concat(state["cuts"], F.array(cut)).alias("cuts")
            )

        def out(cuts: Column) -> Column:
            def piece(p: Column, i: Column) -> Column:
                cut, value = F.get(cuts, i), F.get(values, i - first)
                kept = lambda n: F.substring(p, n + 1, F.length(p))
                return F.when(cut < 0, F.concat(value["new"], kept(F.least(value["n"], F.length(p))))).otherwise(kept(cut))

            tried = F.filter(F.transform(cuts, lambda c, i: (i >= first) & (c <= 0)), lambda t: t)
            changed = F.filter(cuts, lambda c, i: (c < 0) & F.get(values, i - first)["moved"])
            return F.struct(
                F.array_join(F.transform(pieces, piece), "").alias("text"), F.size(tried).cast("bigint").alias("n_found"), F.size(changed).cast("bigint").alias("n_replaced")
            )

        return let(F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, step, lambda state: state["cuts"]), out)

    values = F.transform(matches, lambda m: F.coalesce(*[of_kind(m[kind], kind) for kind in MAKERS]))
    both = F.struct(F.split(line, at).alias("pieces"), values.alias("values"))
    return let(both, lambda b: walked(b["pieces"], b["values"], F.size(b["pieces"]) - F.size(b["values"])))


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced, and n_found, n_replaced.

    Found are e-mail addresses, international account numbers, phone numbers,
    IPv4 addresses, dates, social security numbers, card numbers, and secrets of
    32 hexadecimal digits or more. Null and empty texts stay as they are, with 0
    found; texts of any length are replaced whole, line by line, as no value goes
    over a line's end. A match that isn't valid (a wrong check digit, an address
    part above 255, a day that doesn't exist, a number that is never issued)
    stays, but is tried as each of the other kinds, and what begins inside it is
    looked at as if it weren't there. n_found counts the places looked at: those
    outside of replaced values. Texts of one character to permute move by a
    constant. Every row is judged for itself, so repeated rows become equal rows,
    and an empty table stays empty. Of other columns, only those named n_found
    and n_replaced are replaced.
    """
    zero = F.lit(0).cast("bigint")
    same = lambda line: F.struct(line.alias("text"), zero.alias("n_found"), zero.alias("n_replaced"))
    each = lambda line: F.when(line.rlike(HINT) & line.rlike(ANY), _replaced(line, key)).otherwise(same(line))
    total = lambda lines, name: F.aggregate(lines, zero, lambda n, line: n + line[name])

    def joined(lines: Column) -> Column:
        text = F.array_join(F.transform(lines, lambda line: line["text"]), "\n")
        return F.struct(text.alias("text"), total(lines, "n_found").alias("n_found"), total(lines, "n_replaced").alias("n_replaced"))

    lines = F.transform(F.split("text", "\n"), each)
    result = F.when(F.col("text").rlike(HINT), let(lines, joined)).otherwise(same(F.col("text")))
    names = [n for n in documents.columns if n not in ("text", "n_found", "n_replaced")]
    places = ["out.text" if n == "text" else f"row.{quoted(n)}" for n in documents.columns if n in names or n == "text"]
    row = F.struct(*map(quoted, names)) if names else F.lit(None)
    return documents.select(row.alias("row"), result.alias("out")).select(*places, "out.n_found", "out.n_replaced")
