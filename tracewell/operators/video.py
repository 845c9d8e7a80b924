"""H.264 and H.265 structure: reassembly of fragmented units, unit types, frames and GOPs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.packets import FLOW, uint

#: Fixed values of the payload formats: aggregation and fragmentation unit types.
H264_STAP_A, H264_FU_A = 24, 28
H265_AP, H265_FU = 48, 49
H265_SETS, H265_RANDOM_ACCESS = {"vps": 32, "sps": 33, "pps": 34}, (16, 23)
H264_SLICE, H264_IDR, H264_SEI, H264_SPS, H264_PPS = 1, 5, 6, 7, 8
#: How issues of fragments and of aggregates begin.
ISSUES = {"h264": ("fua", "stap_a"), "h265": ("h265_fu", "h265_ap")}
#: Bytes of a slice that hold what tells whether it begins a picture.
SLICE_HEAD = 28


def h264_type(data: Column) -> Column:
    return (uint(data, 0, 1) % 32).cast("int")


def h265_type(data: Column) -> Column:
    return (F.shiftright(uint(data, 0, 1), 1) % 64).cast("int")


def _h264_form(body: bytes) -> tuple[str, int, bytes, bool, bool]:
    """(form, where its contents begin, the unit header of a fragment, whether it begins, whether it ends)."""
    kind = body[0] % 32
    if kind == H264_FU_A and len(body) > 1:
        return "fragment", 2, bytes([body[0] & 0xE0 | body[1] & 0x1F]), bool(body[1] & 0x80), bool(body[1] & 0x40)
    form = "bad_fragment" if kind == H264_FU_A else "aggregate" if kind == H264_STAP_A else "single" if 0 < kind < H264_STAP_A else "other"
    return form, 1, b"", False, False


def _h265_form(body: bytes) -> tuple[str, int, bytes, bool, bool]:
    kind = body[0] >> 1 & 63
    if kind == H265_FU and len(body) > 2:
        return "fragment", 3, bytes([body[0] & 0x81 | (body[2] & 63) << 1, body[1]]), bool(body[2] & 0x80), bool(body[2] & 0x40)
    form = "bad_fragment" if kind == H265_FU or len(body) < 2 else "aggregate" if kind == H265_AP else "single" if kind < H265_AP else "other"
    return form, 2, b"", False, False


def depacketise(rtp: DataFrame, codec: str = "h264") -> DataFrame:
    """Units of H.264 or H.265 RTP flows in sequence order (single units, aggregates, fragments).

    Columns: the flow, unit (from 0, its place in the flow), rtp_ts, first_seq,
    last_seq, complete, marker, issue, data. A fragment whose neighbour is
    missing ends its unit as incomplete. ``rtp`` needs ``ext``, the unfolded
    sequence number; one flow is one sequential fold whose state is one open
    unit, whatever its length.
    """
    fragment, aggregate = ISSUES[codec]
    form_of = _h264_form if codec == "h264" else _h265_form
    kinds = {f.name: f.dataType.simpleString() for f in rtp.schema}
    fields = ", ".join(f"{c} {kinds[c]}" for c in FLOW)
    fields += ", unit bigint, rtp_ts bigint, first_seq bigint, last_seq bigint, complete boolean, marker boolean, issue string, data binary"
    names = [*FLOW, "rtp_ts", "ext", "marker", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, opened, last, number = None, None, None, 0

        def close(issue: str | None, marker: bool = False) -> tuple:
            nonlocal opened
            ts, first, data, had_end = opened
            opened = None
            return placed(flow, ts, first, last, issue is None and had_end, marker, issue or (None if had_end else f"{fragment}_missing_end"), bytes(data))

        def placed(key: tuple, *unit) -> tuple:
            nonlocal number
            number += 1
            return (*key, number - 1, *unit)

        def units(row: dict) -> Iterator[tuple]:
            nonlocal flow, opened, last, number
            key = tuple(row[c] for c in FLOW)
            if key != flow:
                if opened:
                    yield close(f"{fragment}_missing_end")
                flow, last, number = key, None, 0
            body, ts, seq, marker = row["body"], row["rtp_ts"], row["ext"], row["marker"]
            if last == seq:
                return
            if opened and seq != last + 1:
                yield close(f"{fragment}_sequence_gap")
            elif opened and ts != opened[0]:
                yield close(f"{fragment}_timestamp_changed")
            last = seq
            single = lambda data, issue=None: placed(key, ts, seq, seq, issue is None, marker, issue, data)
            if not body:
                yield single(b"", "empty_rtp_payload")
                return
            form, at, header, begins, ends = form_of(body)
            if form == "bad_fragment":
                yield single(body, f"{fragment}_header")
            elif form == "fragment":
                if begins:
                    if opened:
                        yield close(f"{fragment}_missing_end")
                    opened = (ts, seq, bytearray(header), False)
                elif not opened:
                    yield single(header + body[at:], f"{fragment}_missing_start")
                    return
                opened[2].extend(body[at:])
                if ends:
                    opened = (*opened[:3], True)
                    yield close(None, marker)
            elif form == "aggregate":
                while at + 2 <= len(body):
                    size = int.from_bytes(body[at : at + 2], "big")
                    if at + 2 + size > len(body):
                        yield single(body[at + 2 :], f"{aggregate}_length")
                        return
                    yield single(body[at + 2 : at + 2 + size])
                    at += 2 + size
            elif form == "single":
                yield single(body)
            else:
                yield single(body, "unsupported_packetization")

        def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [batch.schema.field(c) for c in FLOW]
                    + [pa.field("unit", pa.int64()), pa.field("rtp_ts", pa.int64()), pa.field("first_seq", pa.int64()), pa.field("last_seq", pa.int64())]
                    + [pa.field("complete", pa.bool_()), pa.field("marker", pa.bool_()), pa.field("issue", pa.string())]
                    + [pa.field("data", pa.binary())]
                )
            if rows := [u for row in batch.to_pylist() for u in units(row)]:
                yield batch_of(rows, schema)
        if opened:
            yield batch_of([close(f"{fragment}_missing_end")], schema)

    ordered = rtp.select(*names).repartition(*FLOW).sortWithinPartitions(*FLOW, "ext")
    return ordered.mapInArrow(run, fields)


def _bit_rows(heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first bits of each value as a row, and how many there are."""
    heads = heads.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(heads.buffers()[1], np.int64)[heads.offset : heads.offset + len(heads) + 1]
    data = np.frombuffer(heads.buffers()[2] or b"\0", np.uint8)
    at = offsets[:-1, None] + np.arange(SLICE_HEAD)
    inside = at < offsets[1:, None]
    return np.unpackbits(np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), axis=1), 8 * np.minimum(np.diff(offsets), SLICE_HEAD)


def _begins(heads: pa.Array, h264: bool) -> pa.Array:
    """Whether slices begin a picture: null for those whose header ends early."""
    bits, length = _bit_rows(heads)
    rows, width = np.arange(len(bits)), bits.shape[1]
    ones = np.minimum.accumulate(np.where(bits, np.arange(width), width)[:, ::-1], axis=1)[:, ::-1]
    ones = np.concatenate((ones, np.full((len(bits), 1), width)), axis=1)
    if h264:  # the first macroblock, the slice's type, its picture parameters
        at, numbers, begins = np.full(len(bits), 8), 3, bits[:, 8] == 1
    else:  # after the flag, and one more in random access pictures, the picture parameters
        kind = bits[:, 1:7] @ (1 << np.arange(5, -1, -1))
        at, numbers, begins = 17 + ((kind >= 16) & (kind <= 23)), 1, bits[:, 16] == 1
    good = at <= length
    for _ in range(numbers):
        zeros = ones[rows, np.minimum(at, width)] - at
        at = at + 2 * zeros + 1
        good &= (zeros >= 0) & (zeros < 32) & (at <= length)
        at = np.clip(at, 0, width)
    return pa.array(begins, pa.bool_(), mask=~good)


def slice_begins(data: Column, codec: str) -> Column:
    """Whether a slice is the first of its picture, by its header; null where that can't be read."""
    from tracewell.operators.parameter_sets import without_escapes

    @F.arrow_udf("boolean")
    def read(heads: pa.Array) -> pa.Array:
        return _begins(heads, codec == "h264")

    return read(without_escapes(F.substring(data, 1, SLICE_HEAD + 8)))


def frames_of_units(units: DataFrame, flow: list[str], codec: str = "h264") -> DataFrame:
    """Units without their data, with size, type, slice (it holds a part of a picture), boundary and frame, from 1.

    A frame begins with a slice whose header says so (boundary slice_header);
    where the header can't be read, with one whose RTP time differs from that of
    the slice before (rtp_timestamp), or that has none (single_unit). Units that
    aren't slices belong to the next slice's frame, the last ones to that before;
    units before the first frame belong to none. Units are in the order of
    first_seq, unit and nalu_number, as far as they have them: those of
    elementary streams have no times and markers.
    """
    order = [c for c in ("first_seq", "unit", "nalu_number") if c in units.columns]
    missing = {"rtp_ts": "bigint", "marker": "boolean", "complete": "boolean", "first_seq": "bigint", "last_seq": "bigint"}
    for name, kind in missing.items():
        if name not in units.columns:
            units = units.withColumn(name, F.lit(True if name == "complete" else None).cast(kind))
    data = F.col("data")
    kind = h264_type(data) if codec == "h264" else h265_type(data)
    is_slice = kind.isin(H264_SLICE, H264_IDR) if codec == "h264" else (kind < 10) | kind.between(*H265_RANDOM_ACCESS)
    order_only = [c for c in order if c not in missing]
    rows = units.select(
        *flow, *order_only, *missing, kind.alias("type"), F.octet_length(data).alias("size"), F.coalesce(is_slice, F.lit(False)).alias("slice"),
        F.when(is_slice, slice_begins(data, codec)).alias("_begins"),
    )
    w = Window.partitionBy(*flow).orderBy(*order)
    back = Window.partitionBy(*flow).orderBy(*[F.desc(c) for c in order])
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    by_time = F.col("rtp_ts").isNull() | ~F.col("rtp_ts").eqNullSafe(F.last(F.when(F.col("slice"), F.col("rtp_ts")), True).over(earlier))
    confidence = F.when(F.col("_begins"), "slice_header").when(
        F.col("_begins").isNull() & by_time, F.when(F.col("rtp_ts").isNull(), "single_unit").otherwise("rtp_timestamp")
    )
    rows = rows.withColumn("boundary", F.when(F.col("slice"), confidence))
    own = F.when(F.col("slice"), F.count("boundary").over(w))
    rows = rows.withColumn("_own", own)
    rows = rows.withColumn("_before", F.last("_own", True).over(earlier))
    frame = F.coalesce("_own", F.last("_own", True).over(back), "_before")
    return rows.withColumn("frame", frame).filter("frame > 0").drop("_begins", "_own", "_before")


def access_units(units: DataFrame, flow: list[str], codec: str = "h264") -> DataFrame:
    """Frames of H.264 or H.265 units, of RTP flows or elementary streams, as ``frames_of_units`` finds them.

    Columns: flow, frame (from 1), rtp_ts, first_seq, last_seq, units, bytes, idr
    (any random access picture of H.265), vps, sps, pps, complete, has_marker,
    boundary, missing_marker (the next frame has another time and began without
    one; never the last, nor without times).
    """
    kind = F.col("type")
    if codec == "h264":
        idr, sets = kind == H264_IDR, {"vps": F.lit(False), "sps": kind == H264_SPS, "pps": kind == H264_PPS}
    else:
        idr, sets = kind.between(*H265_RANDOM_ACCESS), {name: kind == number for name, number in H265_SETS.items()}
    found = frames_of_units(units, flow, codec)
    frames = found.groupBy(*flow, "frame").agg(
        F.min_by("rtp_ts", F.when(F.col("slice"), F.col("first_seq"))).alias("rtp_ts"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.count(F.lit(1)).alias("units"),
        F.sum("size").alias("bytes"),
        F.bool_or(idr).alias("idr"),
        *[F.bool_or(test).alias(name) for name, test in sets.items()],
        F.every("complete").alias("complete"),
        F.bool_or("marker").alias("has_marker"),
        F.max("boundary").alias("boundary"),
    )
    following = F.lead("rtp_ts").over(Window.partitionBy(*flow).orderBy("frame"))
    return frames.withColumn("frame", F.col("frame").cast("bigint")).withColumn(
        "missing_marker", F.coalesce(~F.col("has_marker") & (following != F.col("rtp_ts")), F.lit(False))
    )


def gop_statistics(frames: DataFrame, flow: list[str]) -> DataFrame:
    """Per flow: frames, IDR frames, first IDR, mean (whole frames) and longest GOP, parameter sets before the first IDR."""
    w = Window.partitionBy(*flow).orderBy("frame")
    keys = F.when(F.col("idr"), F.col("frame"))
    before = F.last(keys, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = frames.withColumn("_gap", F.when(F.col("idr"), F.col("frame") - before)).withColumn(
        "_sps", F.max("sps").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_pps", F.max("pps").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("_vps", F.max("vps").over(w.rowsBetween(Window.unboundedPreceding, 0)) if "vps" in frames.columns else F.lit(False))
    return marked.groupBy(*flow).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("idr").alias("idr_frames"),
        F.min(keys).alias("first_idr_frame"),
        F.expr("sum(_gap) div count(_gap)").alias("average_gop_frames"),
        F.max("_gap").alias("maximum_gop_frames"),
        F.min_by("_vps", F.when(F.col("idr"), F.col("frame"))).alias("vps_before_idr"),
        F.min_by("_sps", F.when(F.col("idr"), F.col("frame"))).alias("sps_before_idr"),
        F.min_by("_pps", F.when(F.col("idr"), F.col("frame"))).alias("pps_before_idr"),
        F.count_if(~F.col("complete")).alias("incomplete_frames"),
        F.count_if("missing_marker").alias("missing_markers"),
    )


def unit_histogram(units: DataFrame, flow: list[str], codec: str = "h264") -> DataFrame:
    kind = h264_type(F.col("data")) if codec == "h264" else h265_type(F.col("data"))
    return units.groupBy(*flow, kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def merged_ranges(frames: DataFrame, flow: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Byte ranges of frames with those that overlap or touch the one before merged: flow, start, end, frames."""
    w = Window.partitionBy(*flow).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = frames.withColumn("_new", (reached.isNull() | (F.col(start) > reached)).cast("int"))
    rows = rows.withColumn("_range", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*flow, "_range").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("frames")).drop("_range")


def frame_documents(inspected: DataFrame, flow: list[str], frame: str, order: str) -> DataFrame:
    """One JSON document per frame with its units in order, from rows of ``parameter_sets.inspected``."""
    fields = [c for c in inspected.columns if c not in (*flow, frame, order)]
    units = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("unit")))), lambda x: x["unit"])
    return inspected.groupBy(*flow, frame).agg(units.alias("units")).select(*flow, frame, F.to_json(F.struct(F.col(frame).alias("frame"), "units")).alias("document"))
