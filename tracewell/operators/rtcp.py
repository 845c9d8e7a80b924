"""RTCP: packets of compound payloads, their encoders, and sender reports joined to RTP streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Packet types, and the source description item that names the source.
SENDER_REPORT, RECEIVER_REPORT, SOURCE_DESCRIPTION, GOODBYE = 200, 201, 202, 203
CNAME = 1

_SR = ["ntp_seconds", "ntp_fraction", "rtp_timestamp", "packet_count", "octet_count"]
FIELDS = "part int, type int, ssrc bigint, " + ", ".join(f"{n} bigint" for n in _SR) + ", report_count int, cname string, error string"


def bytes_of(value: Column, size: int) -> Column:
    """A number as ``size`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


#: Fixed value: the profile of a header extension that holds how often a packet's sequence number has begun again.
ROLLOVER = 0x524F


def encode_rtp(payload_type: Column, marker: Column, seq: Column, rtp_ts: Column, ssrc: Column, payload: Column, rollover: Column | None = None) -> Column:
    """An RTP packet without contributing sources and padding; with an extension if its ``rollover`` count is given."""
    second = F.when(marker, 128).otherwise(0) + payload_type
    extension = [] if rollover is None else [bytes_of(F.lit(ROLLOVER), 2), bytes_of(F.lit(1), 2), bytes_of(rollover, 4)]
    first = F.lit(bytearray(b"\x80" if rollover is None else b"\x90"))
    return F.concat(first, bytes_of(second, 1), bytes_of(seq % 65536, 2), bytes_of(rtp_ts, 4), bytes_of(ssrc, 4), *extension, payload)


def encode_sender_report(
    ssrc: Column, ntp_seconds: Column, ntp_fraction: Column, rtp_timestamp: Column, packets: Column, octets: Column, cname: Column
) -> Column:
    """A compound of a sender report without report blocks and the source's canonical name."""
    report = F.concat(
        F.lit(bytearray([0x80, SENDER_REPORT, 0, 6])),
        *[bytes_of(c, 4) for c in (ssrc, ntp_seconds, ntp_fraction, rtp_timestamp, packets, octets)],
    )
    name = F.encode(cname, "UTF-8")
    size = F.octet_length(name)
    padded = F.floor((6 + size) / 4) * 4 + 4  # the chunk with at least one zero byte at its end
    zeros = F.unhex(F.repeat(F.lit("00"), (padded - 6 - size).cast("int")))
    chunk = F.concat(bytes_of(ssrc, 4), F.lit(bytearray([CNAME])), bytes_of(size, 1), name, zeros)
    return F.concat(report, F.lit(bytearray([0x81, SOURCE_DESCRIPTION])), bytes_of(padded / 4, 2), chunk)


def encode_goodbye(ssrc: Column) -> Column:
    return F.concat(F.lit(bytearray([0x81, GOODBYE, 0, 1])), bytes_of(ssrc, 4))


def _names(body: bytes, chunks: int) -> Iterator[tuple[int, str | None]]:
    """(source, canonical name) of each chunk of a source description; a cut chunk ends where the body does."""
    at = 0
    for _ in range(chunks):
        if at + 4 > len(body):
            return
        source, name, at = int.from_bytes(body[at : at + 4], "big"), None, at + 4
        while at < len(body) and body[at]:
            kind, size = body[at], body[at + 1] if at + 1 < len(body) else len(body)
            if at + 2 + size > len(body):
                at = len(body)
                break
            if kind == CNAME:
                name = body[at + 2 : at + 2 + size].decode("utf-8", "replace")
            at += 2 + size
        at = at // 4 * 4 + 4
        yield source, name


def parse_compound(data: bytes) -> list[tuple]:
    """Rows of ``FIELDS``: one for each report, name and source that leaves; a broken compound is one row with its error."""
    rows, at, part = [], 0, 0
    none = (None,) * len(_SR)
    while at < len(data):
        size = 4 * (int.from_bytes(data[at + 2 : at + 4], "big") + 1)
        if data[at] >> 6 != 2 or at + 4 > len(data) or at + size > len(data):
            return [(0, None, None, *none, None, None, "version" if data[at] >> 6 != 2 else "short")]
        count, kind, body = data[at] & 31, data[at + 1], data[at + 4 : at + size]
        word = lambda i: int.from_bytes(body[4 * i : 4 * i + 4], "big")
        if kind == SENDER_REPORT and len(body) >= 24:
            rows.append((part, kind, word(0), *map(word, range(1, 6)), count, None, None))
        elif kind == RECEIVER_REPORT and len(body) >= 4:
            rows.append((part, kind, word(0), *none, count, None, None))
        elif kind == SOURCE_DESCRIPTION:
            rows += [(part, kind, source, *none, None, name, None) for source, name in _names(body, count)]
        elif kind == GOODBYE and len(body) >= 4 * count:
            rows += [(part, kind, word(i), *none, None, None, None) for i in range(count)]
        else:
            rows.append((part, kind, None, *none, None, None, None))
        at, part = at + size, part + 1
    return rows


def is_rtcp(payload: Column) -> Column:
    """Version 2, and a second byte from 192 to 223."""
    byte = lambda i: F.conv(F.hex(F.substring(payload, i, 1)), 16, 10).cast("int")
    return (F.octet_length(payload) >= 4) & (F.shiftright(byte(1), 6) == 2) & byte(2).between(192, 223)


def rtcp_packets(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """The packets inside RTCP compounds, with the columns ``keep`` of their payload."""
    names = [part.split()[0] for part in FIELDS.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    types = [kinds[part.split()[1]] for part in FIELDS.split(", ")]
    schema = {f.name: f.dataType.simpleString() for f in payloads.select(*keep).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_compound(data) for data in batch.column(payload).to_pylist()]
            rows = [row for part in found for row in part]
            owner = pa.array([i for i, part in enumerate(found) for _ in part], pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(owner) for n in keep], *columns], names=[*keep, *names])

    found = payloads.filter(is_rtcp(F.col(payload))).select(*keep, payload)
    return found.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in schema.items()) + ", " + FIELDS)


def reports_of_streams(reports: DataFrame, streams: DataFrame, key: list[str], stream: str) -> DataFrame:
    """Reports with the one stream that has their ``key``; those of no stream or of several are left out."""
    alone = streams.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(stream).alias(stream)).filter("_n = 1").drop("_n")
    return reports.join(alone, key)


def reports_of_flows(reports: DataFrame, flows: DataFrame, stream: str) -> tuple[DataFrame, DataFrame]:
    """Reports with the ``stream`` that they speak of, and warnings: one row for each report of no stream or of several.

    A report's source (``ssrc``) belongs to a flow of the same capture, interface
    and addresses, whose ports are those of the report or one below each of them;
    on a TCP connection, whose channel is that of the report or one below. Each
    flow is looked up by all places that its reports may come from, in one join
    by equality. Warnings have the report's columns and ``candidates``.
    """
    one_above = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1))
    names = ["capture", "interface", "src_ip", "dst_ip", "ssrc"]
    datagrams = flows.filter("channel < 0").withColumn("src_port", one_above("src_port")).withColumn("dst_port", one_above("dst_port"))
    framed = flows.filter("channel >= 0").withColumn("channel", one_above("channel"))
    place = [*names, "src_port", "dst_port", "connection", "channel"]
    both = datagrams.unionByName(framed)
    known = both.groupBy(*place).agg(F.count(F.lit(1)).alias("candidates"), F.min(stream).alias(stream))
    joined = reports.join(known, place, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    spoken = joined.filter("candidates = 1").select(*reports.columns, stream)
    return spoken, joined.filter("candidates <> 1 and ssrc is not null").select(*reports.columns, "candidates")


def ntp_micros(seconds: Column, fraction: Column) -> Column:
    """Microseconds of an NTP time in 32.32 fixed point, since 1900."""
    return seconds * 1_000_000 + F.shiftright(fraction * 1_000_000, 32)


def drift_ppm(reports: DataFrame, stream: list[str], clock: Column) -> DataFrame:
    """Per stream: how much faster its media clock runs than its NTP clock from the first report to the last.

    ``reports`` need ``number`` (arrival order); fewer than two reports, or no time between them, give null.
    """
    from tracewell.functions.scalar import signed_wrap

    ends = reports.filter(f"type = {SENDER_REPORT}").groupBy(*stream).agg(
        F.min_by(F.struct("ntp_seconds", "ntp_fraction", "rtp_timestamp"), "number").alias("a"),
        F.max_by(F.struct("ntp_seconds", "ntp_fraction", "rtp_timestamp"), "number").alias("b"),
        F.max(clock).alias("clock"),
        F.count(F.lit(1)).alias("reports"),
    )
    wall = ntp_micros(F.col("b.ntp_seconds"), F.col("b.ntp_fraction")) - ntp_micros(F.col("a.ntp_seconds"), F.col("a.ntp_fraction"))
    media = signed_wrap(F.col("b.rtp_timestamp") - F.col("a.rtp_timestamp"), 1 << 32) * 1_000_000 / F.col("clock")
    return ends.select(*stream, "reports", F.when(wall > 0, F.round((media / wall - 1) * 1_000_000, 3)).alias("drift_ppm"))


def names_of_streams(packets: DataFrame, key: list[str]) -> DataFrame:
    """Distinct canonical names of each source."""
    return packets.filter("cname is not null").groupBy(*key, "ssrc").agg(F.sort_array(F.collect_set("cname")).alias("cnames"))


def last_reports(packets: DataFrame, key: list[str]) -> DataFrame:
    """The latest sender report of each source, and how many there were."""
    w = Window.partitionBy(*key, "ssrc").orderBy(F.desc("number"), F.desc("part"))
    rows = packets.filter(f"type = {SENDER_REPORT}").withColumn("rn", F.row_number().over(w))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "ssrc")).alias("reports")
    return rows.select("*", n).filter("rn = 1").drop("rn")
