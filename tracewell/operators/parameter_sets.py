"""Parameter sets, slice headers and timing messages of H.264 and H.265 units.

Escapes are removed by a column expression over all units; the bits of the few
units that hold parameters are read inside tasks, unit by unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import clamp
from tracewell.operators.video import h264_type, h265_type

#: Names of unit types.
H264_NAMES = {
    1: "non_idr_slice", 5: "idr_slice", 6: "sei", 7: "sps", 8: "pps", 9: "aud", 10: "end_of_sequence", 11: "end_of_stream", 12: "filler",
    24: "stap_a", 28: "fu_a",
}
H265_NAMES = {
    **dict.fromkeys(range(10), "trail_slice"), **dict.fromkeys((16, 17, 18), "bla_slice"), 19: "idr_slice", 20: "idr_slice", 21: "cra_slice",
    22: "irap_reserved", 23: "irap_reserved", 32: "vps", 33: "sps", 34: "pps", 35: "aud", 39: "prefix_sei", 40: "suffix_sei", 48: "ap", 49: "fu",
}
#: Profiles with a chroma format in their H.264 sequence parameters, and names of profiles.
HIGH_PROFILES = {44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244}
PROFILES = {"h264": {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High 10", 122: "High 4:2:2", 244: "High 4:4:4"}, "h265": {1: "Main", 2: "Main 10", 3: "Main Still Picture"}}
#: Samples of chroma for one of luma, across and down, by chroma format.
_CHROMA = {1: (2, 2), 2: (2, 1)}

_LONGS = [
    "id", "sps_id", "pps_id", "vps_id", "profile_idc", "level_idc", "sub_layers", "chroma_format_idc", "bit_depth_luma", "bit_depth_chroma", "max_frame_num",
    "pic_order_cnt_type", "reference_frames", "reorder_frames", "buffered_frames", "width", "height", "fps_milli", "units_in_tick", "time_scale",
    "cpb_count", "bit_rate_bps", "cpb_size_bits", "initial_delay_bits", "removal_delay_bits", "output_delay_bits", "slice_groups", "initial_qp",
    "first_mb", "slice_type", "ref_idc",
]
_FLAGS = ["progressive", "cbr", "entropy_coding", "weighted_prediction", "deblocking_control", "first_slice", "idr"]
FIELDS = ["unit", *_LONGS, *_FLAGS, "problem"]


def without_escapes(data: Column) -> Column:
    """A unit's bytes without the 3 that stands after each two zeros."""
    text = F.regexp_replace(F.decode(data, "ISO-8859-1"), "\x00\x00\x03", "\x00\x00")
    return F.encode(text, "ISO-8859-1")


def with_escapes(data: Column) -> Column:
    text = F.regexp_replace(F.decode(data, "ISO-8859-1"), "\x00\x00(?=[\x00-\x03])", "\x00\x00\x03")
    return F.encode(text, "ISO-8859-1")


class Bits:
    """Reads numbers from the front of some bytes."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, n: int) -> int:
        if n > self.left:
            raise ValueError("ends early")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def ue(self) -> int:
        """A number whose length stands before it as zeros."""
        zeros = self.left - (self.value & ((1 << self.left) - 1)).bit_length()
        if zeros > 31 or zeros == self.left:
            raise ValueError("number too long")
        return self.u(2 * zeros + 1) - 1

    def se(self) -> int:
        """The same, where odd ones are positive and even ones negative."""
        n = self.ue()
        return (n + 1) // 2 if n % 2 else -n // 2


def _buffer(bits: Bits) -> dict:
    """A decoder buffer's rates and sizes."""
    count = bits.ue() + 1
    if count > 32:
        raise ValueError("too many buffers")
    rate_shift, size_shift = 6 + bits.u(4), 4 + bits.u(4)
    each = [(bits.ue() + 1 << rate_shift, bits.ue() + 1 << size_shift, bits.u(1)) for _ in range(count)]
    lengths = [bits.u(5) for _ in range(4)]
    return dict(
        cpb_count=count, bit_rate_bps=max(e[0] for e in each), cpb_size_bits=max(e[1] for e in each), cbr=all(e[2] for e in each),
        initial_delay_bits=lengths[0] + 1, removal_delay_bits=lengths[1] + 1, output_delay_bits=lengths[2] + 1,
    )


def _usability(bits: Bits) -> dict:
    """The display and timing part of H.264 sequence parameters."""
    out: dict = {}
    if bits.u(1) and bits.u(8) == 255:
        bits.u(32)
    if bits.u(1):
        bits.u(1)
    if bits.u(1):
        bits.u(4)
        if bits.u(1):
            bits.u(24)
    if bits.u(1):
        bits.ue(), bits.ue()
    if bits.u(1):
        tick, scale, _ = bits.u(32), bits.u(32), bits.u(1)
        out |= dict(units_in_tick=tick, time_scale=scale, fps_milli=scale * 1000 // (2 * tick) if tick else None)
    found = [_buffer(bits) if bits.u(1) else None for _ in range(2)]
    out |= next(filter(None, found), {})
    if any(found):
        bits.u(1)
    bits.u(1)
    if bits.u(1):
        bits.u(1)
        *_, reorder, buffered = [bits.ue() for _ in range(6)]
        out |= dict(reorder_frames=reorder, buffered_frames=buffered)
    return out


def _skip_scaling(bits: Bits, size: int) -> None:
    last = scale = 8
    for _ in range(size):
        if scale:
            scale = (last + bits.se()) % 256
        last = scale or last


def _cropped(bits: Bits, width: int, height: int, chroma: int, rows: int = 1) -> dict:
    across, down = _CHROMA.get(chroma, (1, 1))
    left, right, top, bottom = [bits.ue() for _ in range(4)] if bits.u(1) else [0] * 4
    return dict(width=max(width - (left + right) * across, 0), height=max(height - (top + bottom) * down * rows, 0))


def h264_sequence(data: bytes) -> dict:
    bits = Bits(data)
    profile, _, level, number = bits.u(8), bits.u(8), bits.u(8), bits.ue()
    chroma, luma_depth, chroma_depth, separate = 1, 8, 8, 0
    if profile in HIGH_PROFILES:
        chroma = bits.ue()
        separate = bits.u(1) if chroma == 3 else 0
        luma_depth, chroma_depth, _ = bits.ue() + 8, bits.ue() + 8, bits.u(1)
        if bits.u(1):
            for i in range(12 if chroma == 3 else 8):
                if bits.u(1):
                    _skip_scaling(bits, 16 if i < 6 else 64)
    frame_numbers, order = 1 << bits.ue() + 4, bits.ue()
    if order == 0:
        bits.ue()
    elif order == 1:
        bits.u(1), bits.se(), bits.se()
        for _ in range(bits.ue()):
            bits.se()
    references, _ = bits.ue(), bits.u(1)
    width, height, progressive = 16 * (bits.ue() + 1), 16 * (bits.ue() + 1), bits.u(1)
    fields = 1 if progressive else 2
    if not progressive:
        bits.u(1)
    bits.u(1)
    size = _cropped(bits, width, height * fields, 0 if separate else chroma, fields)
    return dict(
        unit="sps", id=number, profile_idc=profile, level_idc=level, chroma_format_idc=chroma, bit_depth_luma=luma_depth, bit_depth_chroma=chroma_depth,
        max_frame_num=frame_numbers, pic_order_cnt_type=order, reference_frames=references, progressive=bool(progressive), **size,
        **(_usability(bits) if bits.u(1) else {}),
    )


def _skip_slice_groups(bits: Bits, groups: int) -> None:
    kind = bits.ue()
    if kind == 0:
        for _ in range(groups):
            bits.ue()
    elif kind == 2:
        for _ in range(2 * (groups - 1)):
            bits.ue()
    elif kind in (3, 4, 5):
        bits.u(1), bits.ue()
    elif kind == 6:
        for _ in range(bits.ue() + 1):
            bits.u((groups - 1).bit_length())


def h264_picture(data: bytes) -> dict:
    bits = Bits(data)
    number, sequence, entropy, _, groups = bits.ue(), bits.ue(), bits.u(1), bits.u(1), bits.ue() + 1
    if groups > 1:
        _skip_slice_groups(bits, groups)
    bits.ue(), bits.ue()
    weighted, _, quantiser, *_ = bits.u(1), bits.u(2), 26 + bits.se(), bits.se(), bits.se()
    return dict(
        unit="pps", id=number, sps_id=sequence, entropy_coding=bool(entropy), slice_groups=groups, weighted_prediction=bool(weighted), initial_qp=quantiser,
        deblocking_control=bool(bits.u(1)),
    )


def h264_slice(data: bytes, header: int) -> dict:
    bits = Bits(data[:32])
    return dict(unit="slice", first_mb=bits.ue(), slice_type=bits.ue() % 5, pps_id=bits.ue(), idr=header % 32 == 5, ref_idc=header >> 5 & 3)


def h265_sequence(data: bytes) -> dict:
    bits = Bits(data)
    video, layers, _ = bits.u(4), bits.u(3) + 1, bits.u(1)
    profile, _, level = bits.u(8) & 31, bits.u(80), bits.u(8)
    present = [(bits.u(1), bits.u(1)) for _ in range(layers - 1)]
    if layers > 1:
        bits.u(2 * (9 - layers))
    for has_profile, has_level in present:
        bits.u(88 * has_profile + 8 * has_level)
    number, chroma = bits.ue(), bits.ue()
    if chroma == 3:
        bits.u(1)
    size = _cropped(bits, bits.ue(), bits.ue(), chroma)
    luma_depth, chroma_depth, _ = bits.ue() + 8, bits.ue() + 8, bits.ue()
    order = [(bits.ue() + 1, bits.ue(), bits.ue()) for _ in range(layers if bits.u(1) else 1)]
    if not size["width"] or not size["height"]:
        raise ValueError("no size")
    return dict(
        unit="sps", id=number, vps_id=video, sub_layers=layers, profile_idc=profile, level_idc=level, chroma_format_idc=chroma, bit_depth_luma=luma_depth,
        bit_depth_chroma=chroma_depth, buffered_frames=order[-1][0], reorder_frames=order[-1][1], **size,
    )


def h265_picture(data: bytes) -> dict:
    bits = Bits(data)
    return dict(unit="pps", id=bits.ue(), sps_id=bits.ue())


def h265_slice(data: bytes, kind: int) -> dict:
    bits = Bits(data[:32])
    first = bits.u(1)
    if 16 <= kind <= 23:
        bits.u(1)
    return dict(unit="slice", first_slice=bool(first), pps_id=bits.ue(), idr=kind in (19, 20))


def _read_h264(data: bytes) -> dict:
    readers: dict[int, Callable] = {7: h264_sequence, 8: h264_picture}
    return readers[data[0] % 32](data[1:]) if data[0] % 32 in readers else h264_slice(data[1:], data[0])


def _read_h265(data: bytes) -> dict:
    kind = data[0] >> 1 & 63
    readers: dict[int, Callable] = {33: h265_sequence, 34: h265_picture}
    return readers[kind](data[2:]) if kind in readers else h265_slice(data[2:], kind)


def parameters(units: DataFrame, keep: list[str], codec: str = "h264") -> DataFrame:
    """What sequence and picture parameter sets and slices say, one row per such unit, with the columns ``keep``.

    unit is sps, pps or slice; fields that it lacks are null. A unit that can't
    be read has its ``problem`` instead. Only the first bytes of slices are sent.
    """
    h264 = codec == "h264"
    kind = h264_type(F.col("data")) if h264 else h265_type(F.col("data"))
    wanted = kind.isin(1, 5, 7, 8) if h264 else (kind < 10) | kind.between(16, 21) | kind.isin(33, 34)
    is_set = kind.isin(7, 8) if h264 else kind.isin(33, 34)
    schema = {f.name: f.dataType.simpleString() for f in units.select(*keep).schema}
    types = [pa.string(), *[pa.int64()] * len(_LONGS), *[pa.bool_()] * len(_FLAGS), pa.string()]
    spark_types = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean"}
    read = _read_h264 if h264 else _read_h265

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column("data").to_pylist():
                try:
                    found.append(read(data))
                except (ValueError, IndexError) as error:
                    found.append({"problem": str(error)})
            columns = [pa.array([row.get(n) for row in found], t) for n, t in zip(FIELDS, types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *columns], names=[*keep, *FIELDS])

    some = units.filter(wanted).select(*keep, without_escapes(F.when(is_set, F.col("data")).otherwise(F.substring("data", 1, 48))).alias("data"))
    fields = [f"{n} {k}" for n, k in schema.items()] + [f"{n} {spark_types[t]}" for n, t in zip(FIELDS, types)]
    return some.mapInArrow(run, ", ".join(fields))


def type_name(kind: Column, codec: str) -> Column:
    """The name of a unit type."""
    names = H264_NAMES if codec == "h264" else H265_NAMES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind.cast("int")), F.lit("unknown" if codec == "h264" else "other"))


def changed_fields(sets: DataFrame, flow: list[str], order: str, fields: list[str]) -> DataFrame:
    """Parameter sets that differ from the one before with their id: the names of the fields that changed."""
    sets = sets.select(*dict.fromkeys([*flow, order, "unit", "id", *fields]))
    w = Window.partitionBy(*flow, "unit", "id").orderBy(order)
    moved = [F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)) & F.lag(order).over(w).isNotNull(), F.lit(f)) for f in fields]
    return sets.withColumn("changed", F.array_compact(F.array(*moved))).filter(F.size("changed") > 0).select(*flow, order, "unit", "id", "changed")


def stream_summary(sets: DataFrame, flow: list[str], order: str, codec: str) -> DataFrame:
    """Codec, profile, level, size and frame rate of each flow, from its first sequence parameters."""
    names = F.create_map(*[F.lit(x) for pair in PROFILES[codec].items() for x in pair])
    first = sets.filter("unit = 'sps'").groupBy(*flow).agg(
        F.min_by(F.struct("profile_idc", "level_idc", "width", "height", "fps_milli"), order).alias("s")
    )
    return first.select(
        *flow,
        F.lit(codec).alias("codec"),
        F.coalesce(F.try_element_at(names, F.col("s.profile_idc").cast("int")), F.col("s.profile_idc").cast("string")).alias("profile"),
        F.col("s.level_idc").alias("level_idc"),
        "s.width",
        "s.height",
        (F.col("s.fps_milli") / 1000).alias("frame_rate"),
    )


def dangling(sets: DataFrame, flow: list[str], order: str) -> DataFrame:
    """Picture sets whose sequence set, and slices whose picture set, did not stand before them."""
    # The first set of each number is a small table; a window would put all rows of a number into one task.
    first = lambda unit, key, at: sets.filter(F.col("unit") == unit).groupBy(*flow, F.col("id").alias(key)).agg(F.min(order).alias(at))
    rows = sets.filter(F.col("unit").isin("pps", "slice")).select(
        *flow, order, "unit", F.when(F.col("unit") == "pps", F.col("sps_id")).alias("_sps_key"), F.when(F.col("unit") == "slice", F.col("pps_id")).alias("_pps_key")
    )
    rows = rows.join(first("sps", "_sps_key", "_sps_at"), [*flow, "_sps_key"], "left").join(first("pps", "_pps_key", "_pps_at"), [*flow, "_pps_key"], "left")
    late = lambda unit, at: (F.col("unit") == unit) & (F.col(at).isNull() | (F.col(at) > F.col(order)))
    missing = F.when(late("pps", "_sps_at"), F.lit("sps")).when(late("slice", "_pps_at"), F.lit("pps"))
    return rows.withColumn("missing", missing).filter("missing is not null").select(*flow, order, "unit", "missing")


def inferred_codec(counts: DataFrame) -> Column:
    """Whether an undeclared stream is video: few broken packets, parameter sets and at least one frame.

    ``counts`` needs packets, invalid, parameter_sets and frames.
    """
    return (F.col("invalid") * 20 <= F.col("packets")) & (F.col("parameter_sets") > 0) & (F.col("frames") >= 1)


def timing_messages(units: DataFrame, sets: DataFrame, flow: list[str], order: str) -> DataFrame:
    """Buffering periods and picture timings of H.264 messages, read by the sequence parameters before them.

    Columns: flow, order, message (buffering_period or pic_timing), sps_id,
    initial_delay, removal_delay, output_delay, problem.
    """
    needed = ["id", "cpb_count", "initial_delay_bits", "removal_delay_bits", "output_delay_bits", "units_in_tick", "time_scale"]
    known = sets.filter("unit = 'sps'").select(*flow, F.col(order).alias("_at"), F.struct(*needed).alias("s"))
    some = units.filter(h264_type(F.col("data")) == 6).select(*flow, order, without_escapes(F.col("data")).alias("data"))
    both = some.unionByName(known.select(*flow, F.col("_at").alias(order), "s"), allowMissingColumns=True)
    w = Window.partitionBy(*flow).orderBy(order)
    last = both.withColumn("s", F.last("s", True).over(w)).filter("data is not null")
    schema = {f.name: f.dataType.simpleString() for f in last.select(*flow, order).schema}
    names = ["message", "sps_id", "initial_delay", "removal_delay", "output_delay", "problem"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def messages(data: bytes, s: dict | None) -> Iterator[tuple]:
        at, none = 1, (None, None, None)
        while at < len(data) and data[at:].rstrip(b"\x00") != b"\x80":
            head = []
            for _ in range(2):
                run = len(data[at:]) - len(data[at:].lstrip(b"\xff"))
                if at + run >= len(data):
                    yield None, None, *none, "ends early"
                    return
                head.append(255 * run + data[at + run])
                at += run + 1
            kind, size = head
            bits, body_ends = Bits(data[at : at + size]), at + size
            if body_ends > len(data):
                yield None, None, *none, "ends early"
                return
            at = body_ends
            name = {0: "buffering_period", 1: "pic_timing"}.get(kind)
            if name is None:
                continue
            try:
                if not s or not s["cpb_count"]:
                    yield name, None, *none, "no buffer parameters before"
                elif kind == 0:
                    number = bits.ue()
                    problem = None if number == s["id"] else "other sequence parameters"
                    yield name, number, bits.u(s["initial_delay_bits"]), None, None, problem
                else:
                    yield name, s["id"], None, bits.u(s["removal_delay_bits"]), bits.u(s["output_delay_bits"]), None
            except ValueError as error:
                yield name, None, *none, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(messages(d, s)) for d, s in zip(batch.column("data").to_pylist(), batch.column("s").to_pylist())]
            owner = pa.array([i for i, part in enumerate(found) for _ in part], pa.int64())
            rows = [row for part in found for row in part]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(owner) for n in schema], *columns], names=[*schema, *names])

    fields = [f"{n} {k}" for n, k in schema.items()] + ["message string", "sps_id bigint", "initial_delay bigint", "removal_delay bigint", "output_delay bigint", "problem string"]
    return last.select(*flow, order, "data", "s").mapInArrow(run, ", ".join(fields))


def unit_ranges(units: DataFrame, flow: list[str], order: str, prefix: int = 4) -> DataFrame:
    """Where each unit begins and ends in its elementary stream, start codes of ``prefix`` bytes included."""
    w = Window.partitionBy(*flow).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("data") + prefix).over(w)
    return units.withColumn("end", end).withColumn("start", F.col("end") - F.octet_length("data") - prefix)


def inspected(units: DataFrame, keep: list[str], codec: str, maximum: int = 4096) -> DataFrame:
    """Units with their type, its name, reference priority, size and a dump of their first bytes."""
    from tracewell.functions.text import hex_dump

    data = F.col("data")
    kind = h264_type(data) if codec == "h264" else h265_type(data)
    first = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
    second = F.conv(F.hex(F.substring(data, 2, 1)), 16, 10).cast("int")
    extra = {"ref_idc": F.shiftright(first, 5) % 4} if codec == "h264" else {
        "layer": (first % 2) * 32 + F.shiftright(second, 3), "temporal": clamp(second % 8 - 1, 0, 7),
    }
    return units.select(
        *keep, kind.alias("type"), type_name(kind, codec).alias("name"), *[c.alias(n) for n, c in extra.items()],
        F.octet_length(data).alias("size"), (F.octet_length(data) > maximum).alias("cut"), hex_dump(data, F.lit(0), maximum).alias("dump"),
    )
