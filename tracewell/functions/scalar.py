"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone is."""
    name = ts if isinstance(ts, str) else None
    column = F.col(name) if name else ts
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), column.cast("timestamp_ntz"))


def cents(value: Column | str) -> Column:
    """Fixed-point hundredths, so that sums don't depend on their order."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 100).cast("bigint")


def milli(value: Column) -> Column:
    return F.round(value * 1000).cast("bigint")


def signed_wrap(delta: Column, modulus: int) -> Column:
    """A difference of counters that wrap, as the nearest signed step."""
    half = modulus // 2
    return F.pmod(delta + half, F.lit(modulus)) - half


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def redact_query(url: Column) -> Column:
    """The url with the values of its query replaced."""
    return F.regexp_replace(url, r"=[^&#]*", "=***")


def redact_mail(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "***@***")


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(value, low), high)


def magnitude(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def turned(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A point turned around the origin."""
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def dbfs_milli(level: Column, full: int = 32768) -> Column:
    """Thousandths of a decibel below full scale; null for silence."""
    return F.when(level > 0, F.round(20_000 * F.log10(level / full)).cast("bigint"))


def mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hz(mels: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mels / 2595) - 1)


def adjacent(values: Column) -> Column:
    """Each value of an array with the one after it."""
    pairs = F.arrays_zip(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))).alias("a"), F.slice(values, F.lit(2), F.size(values)).alias("b"))
    return F.when(F.size(values) > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def ticks_to_micros(ticks: Column, base: int, exponent: int) -> Column:
    """Microseconds of a time in units of ``base ** -exponent`` seconds."""
    whole = ticks.cast("decimal(20,0)") * 1_000_000 / F.lit(base**exponent).cast("decimal(20,0)")
    return F.floor(whole).cast("bigint")


def ntp_to_micros(seconds: Column, fraction: Column) -> Column:
    return seconds * 1_000_000 + F.shiftright(fraction * 1_000_000, 32)


def offset_ms(us: Column, base: Column) -> Column:
    """Whole milliseconds since ``base``, 0 before it."""
    return F.floor(F.greatest(us - base, F.lit(0)) / 1000)


def utc_of_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A time from its parts; null if there is none."""
    return F.try_make_timestamp_ntz(year, month, day, hour, minute, second)


def rfc3339(ts: Column) -> Column:
    """A time without zone as UTC in RFC 3339, to the second."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bit_field(data: Column, at: Column, size: int) -> Column:
    """``size`` bits (56 at most) of a binary from bit ``at`` on; null beyond its end."""
    first = F.floor(at / 8).cast("int")
    span = (size + 7) // 8 + 1
    part = F.conv(F.rpad(F.hex(F.substring(data, first + 1, F.lit(span))), 2 * span, "0"), 16, 10).cast("decimal(20,0)")
    shift = F.lit(span * 8 - size) - at % 8
    moved = F.floor(part / F.pow(F.lit(2), shift).cast("decimal(20,0)")).cast("decimal(20,0)") % F.lit(1 << size).cast("decimal(20,0)")
    return F.when(at + size <= F.octet_length(data) * 8, moved.cast("bigint"))


def crc32_msb(data: Column, polynomial: int = 0x04C11DB7) -> Column:
    """The 32-bit remainder with the highest bit first, from zero and without final inversion, as Ogg pages carry it."""

    def entry(byte: int) -> int:
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        return value

    table = F.lit([entry(i) for i in range(256)])
    digits = F.hex(data)
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    step = lambda crc, i: F.shiftleft(crc, 8).bitwiseAND(0xFFFFFFFF).bitwiseXOR(
        F.get(table, F.shiftright(crc, 24).bitwiseXOR(byte(i)).bitwiseAND(255).cast("int")).cast("bigint")
    )
    folded = F.aggregate(places, F.lit(0).cast("bigint"), step)
    return F.when(F.octet_length(data) > 0, folded).otherwise(F.when(data.isNotNull(), F.lit(0).cast("bigint")))
