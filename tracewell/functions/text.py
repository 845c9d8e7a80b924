"""Text functions: prefixes, headers, escaping, formatting, validation, redaction, tolerant numbers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(text: Column, prefix: str) -> Column:
    """What follows the prefix; null without it."""
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text)))


def first_characters(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def split_last(text: Column, separator: str) -> tuple[Column, Column]:
    """What stands before and after the last separator; before is null without one."""
    after = F.substring_index(text, separator, -1)
    before = F.substring(text, F.lit(1), F.length(text) - F.length(after) - len(separator))
    return F.when(F.instr(text, separator) > 0, before), after


def natural_key(text: Column) -> Column:
    """Sorts text with numbers by their value: its digits padded to twelve places."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def header_value(text: Column, name: str, short: str | None = None) -> Column:
    """The first value of a header whatever its case, also under its short name; null if there is none."""
    names = "|".join(filter(None, [name, short]))
    return F.when(
        text.rlike(rf"(?im)^(?:{names})[ \t]*:"), F.regexp_extract(text, rf"(?im)^(?:{names})[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    )


def escape_markup(text: Column) -> Column:
    """Text as it may stand in HTML or XML."""
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _fixed(value: Column, places: int) -> Column:
    """A number with so many places, rounded half to even on its exact binary value."""
    return F.replace(F.format_number(value.cast("double"), places), F.lit(","), F.lit(""))


def format_duration(ms: Column, none: str = "not run") -> Column:
    """Milliseconds below a second, else seconds with two places."""
    return F.coalesce(F.when(ms >= 1000, F.concat(_fixed(ms / 1000, 2), F.lit(" s"))).otherwise(F.concat(ms, F.lit(" ms"))), F.lit(none))


def format_bit_rate(bps: Column, none: str = "-") -> Column:
    mega = F.concat(_fixed(bps / 1_000_000, 2), F.lit(" Mbps"))
    return F.coalesce(F.when(bps >= 1_000_000, mega).otherwise(F.concat(_fixed(bps / 1000, 0), F.lit(" Kbps"))), F.lit(none))


def format_frequency(hz: Column) -> Column:
    """Hertz, from 1000 on in thousands, with a place below 10000 unless they are whole."""
    whole = (hz >= 10_000) | (hz % 1000 == 0)
    kilo = F.concat(F.when(whole, _fixed(hz / 1000, 0)).otherwise(_fixed(hz / 1000, 1)), F.lit("k"))
    return F.when(hz >= 1000, kilo).otherwise(hz.cast("string"))


def hex_dump(data: Column, base: Column, maximum: int) -> Column:
    """Lines of an eight-digit offset and up to sixteen bytes, for at most ``maximum`` bytes (a display's limit)."""
    shown = F.hex(F.substring(data, 1, maximum))
    lines = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(shown) / 32).cast("int"), F.lit(1)) - 1),
        lambda i: F.concat(
            F.lpad(F.hex(base + i * 16), 8, "0"),
            F.lit("  "),
            F.rtrim(F.regexp_replace(F.substring(shown, i * 32 + 1, F.lit(32)), "(..)", "$1 ")),
        ),
    )
    return F.when(F.length(shown) > 0, F.array_join(lines, "\n")).otherwise("")


def valid_stream_id(text: Column) -> Column:
    return text.rlike(r"^[0-9A-Za-z_-]{1,80}\z")


def valid_relative_path(text: Column) -> Column:
    """Up to 240 characters; parts of letters, digits, ``._-`` that don't end in a full stop and name no device."""
    device = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
    fine = lambda p: p.rlike(r"^[0-9A-Za-z._-]*[0-9A-Za-z_-]\z") & ~p.rlike(device)
    return (F.length(text) <= 240) & F.forall(F.split(text, "/"), fine)


def valid_package_id(text: Column) -> Column:
    """At least two parts of lower-case letters, digits and hyphens, up to 63 each and 128 together."""
    return (F.length(text) <= 128) & text.rlike(r"^[0-9a-z-]{1,63}(?:\.[0-9a-z-]{1,63})+\z")


def same_namespace(one: Column, two: Column) -> Column:
    """Whether two namespaces differ in slashes at their end at most."""
    return F.regexp_replace(one, "/+$", "") == F.regexp_replace(two, "/+$", "")


def endpoint(ip: Column, port: Column) -> Column:
    """``address:port``, with brackets around version 6."""
    return F.concat(F.when(F.instr(ip, ":") > 0, F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip), F.lit(":"), port)


def unspecified(ip: Column) -> Column:
    """Whether an address is all zero, in version 4 or 6."""
    return ip.rlike(r"^0{1,3}(?:\.0{1,3}){3}$") | (ip.rlike("^[0:]+$") & (F.instr(ip, "::") > 0)) | ip.rlike("^0{1,4}(?::0{1,4}){7}$")


def rtsp_url_error(url: Column) -> Column:
    """Why a url can't be asked for a stream: invalid, scheme, host; null if it can."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(url.isNull() | (scheme == "") | url.rlike(r"\s"), "invalid").when(~scheme.isin("rtsp", "rtsps"), "scheme").when(host == "", "host")


def redact_url(url: Column, word: str = "REDACTED") -> Column:
    """A url with the password of its user information replaced."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*):[^/?#@]*@", f"$1:{word}@")


def redact_text(text: Column, url: Column, word: str = "REDACTED") -> Column:
    """Text in which a url stands, without that url's password; a url that isn't valid is replaced whole."""
    password = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*:([^/?#@]*)@", 1)
    safe = F.replace(text, url, redact_url(url, word))
    kept = F.when(password != "", F.replace(safe, password, F.lit(word))).otherwise(safe)
    return F.when(rtsp_url_error(url).isNull(), kept).otherwise(F.replace(text, url, F.lit("<redacted-url>")))


def redact_all(texts: Column, url: Column) -> Column:
    """Every text of an array as ``redact_text`` leaves it."""
    return F.transform(texts, lambda t: redact_text(t, url))


_SECRET = re.compile("password|authorization|secret", re.IGNORECASE)


def _without_secrets(value):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if _SECRET.search(k) else _without_secrets(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_without_secrets(v) for v in value]
    if isinstance(value, str) and "://" in value and "@" in value:
        parts = urlsplit(value)
        return urlunsplit(parts._replace(netloc=parts.netloc.rpartition("@")[2]))
    return value


def _redacted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(text: str | None) -> str | None:
        try:
            return text and json.dumps(_without_secrets(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    for part in texts:
        yield pa.array([one(text) for text in part.to_pylist()], pa.string())


def redact_json(document: Column) -> Column:
    """JSON without what stands under secret keys at any depth and without user information in urls; null if it can't be read."""
    return F.arrow_udf(_redacted, "string")(document)


def tolerant_number(text: Column) -> Column:
    """A number that JSON holds as number or as text; null for others."""
    return F.trim(F.regexp_replace(text, '^"|"$', "")).try_cast("double")


def json_at(document: Column, *path: str) -> Column:
    """The value at a path of keys, as text; null if a key is missing."""
    return F.get_json_object(document, "$" + "".join(f"['{p}']" for p in path))


def frame_rate(text: Column) -> Column:
    """``30``, ``29.97`` or ``30000/1001`` as a number; null for others and for a zero below the line."""
    up, down = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.instr(text, "/") > 0, F.when(down != 0, up / down)).otherwise(text.try_cast("double"))


def dimensions(text: Column) -> tuple[Column, Column]:
    """Width and height of ``WxH``, ``W-H`` or ``W×H``, with whatever stands before the last blank."""
    last = F.substring_index(F.regexp_replace(text, "[-×]", "x"), " ", -1)
    part = lambda i: F.when(last.rlike(r"^\d+x\d+$"), F.split_part(last, F.lit("x"), F.lit(i))).try_cast("int")
    return part(1), part(2)


def invalid_dimensions(text: Column) -> Column:
    width, height = dimensions(text)
    return F.coalesce((width == 0) | (height == 0), F.lit(True))


def invalid_rate(text: Column) -> Column:
    rate = text.try_cast("double")
    return F.coalesce(F.isnan(rate) | (rate <= 0) | (rate == float("inf")), F.lit(True))


def marker_value(line: Column, marker: str) -> Column:
    """The number after the first ``marker`` of a line."""
    return F.regexp_extract(line, re.escape(marker) + r"\s*(\S+)", 1).try_cast("double")
