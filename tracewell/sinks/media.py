"""Media files: their contents as binary columns, and a writer that puts each row's content into a file of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import crc32_msb

START_CODE = bytearray(b"\x00\x00\x00\x01")


def little(value: Column, size: int) -> Column:
    """A number as ``size`` little-endian bytes, 8 at most; negative ones as two's complement."""
    digits = F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(size - 1), F.lit(0)), lambda i: F.substring(digits, i * 2 + 1, F.lit(2))), ""))


def joined(rows: DataFrame, key: list[str], order: str, data: Column) -> DataFrame:
    """(key, content): the pieces of each key, in order, as one binary.

    A row can hold 2 GiB at most: longer streams are cut into files by a part number in ``key``.
    """
    sorted_pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(data).alias("d"))))
    return rows.groupBy(*key).agg(F.unhex(F.array_join(F.transform(sorted_pieces, lambda p: p["d"]), "")).alias("content"))


def elementary_stream(units: DataFrame, key: list[str], order: str, part_bytes: int = 1 << 28) -> DataFrame:
    """Complete units behind start codes, as parts of about ``part_bytes``: key, part, content."""
    complete = units.filter("complete") if "complete" in units.columns else units
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("data") + 4).over(w), F.lit(0))
    return joined(complete.withColumn("part", F.floor(before / part_bytes)), [*key, "part"], order, F.concat(F.lit(START_CODE), F.col("data")))


def wav(pcm: Column, rate: Column, channels: Column) -> Column:
    """A RIFF file of 16-bit samples."""
    data = F.unhex(F.array_join(F.transform(pcm, lambda x: F.hex(little(x.cast("int"), 2))), ""))
    return F.concat(wav_head(F.size(pcm) * 2, rate, channels), data)


def wav_head(size: Column, rate: Column, channels: Column) -> Column:
    """What stands before the samples of a RIFF file; ``size`` is their bytes."""
    return F.concat(
        F.lit(bytearray(b"RIFF")), little(size + 36, 4), F.lit(bytearray(b"WAVEfmt ")), little(F.lit(16), 4), little(F.lit(1), 2), little(channels, 2),
        little(rate, 4), little(rate * channels * 2, 4), little(channels * 2, 2), little(F.lit(16), 2), F.lit(bytearray(b"data")), little(size, 4),
    )


def ogg_page(serial: Column, sequence: Column, kind: Column, granule: Column, packet: Column) -> Column:
    """One Ogg page with one packet, its checksum included."""
    size = F.octet_length(packet)
    laces = F.concat(F.repeat(F.lit("FF"), F.floor(size / 255).cast("int")), F.lpad(F.hex(size % 255), 2, "0"))
    head = F.concat(F.lit(bytearray(b"OggS\x00")), little(kind, 1), little(granule, 8), little(serial, 4), little(sequence, 4))
    tail = F.concat(little(F.floor(size / 255) + 1, 1), F.unhex(laces), packet)
    return F.concat(head, little(crc32_msb(F.concat(head, little(F.lit(0), 4), tail)), 4), tail)


def opus_headers(channels: Column, vendor: str = "tracewell") -> tuple[Column, Column]:
    """The identification and comment packets of an Opus stream."""
    head = F.concat(F.lit(bytearray(b"OpusHead\x01")), little(F.least(F.greatest(channels, F.lit(1)), F.lit(2)), 1), F.lit(bytearray(2)), little(F.lit(48_000), 4), F.lit(bytearray(3)))
    name = vendor.encode()
    return head, F.lit(bytearray(b"OpusTags" + len(name).to_bytes(4, "little") + name + bytes(4)))


def opus_pages(packets: DataFrame, key: list[str], order: str, samples: str, channels: Column, serial: Column) -> DataFrame:
    """(key, number, content): Opus payloads ``body`` as Ogg pages after the two header pages; the granule counts samples up to each page's end."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = packets.filter(F.octet_length("body") > 0)
    number = F.row_number().over(w) + 1
    last = F.lead(order).over(w).isNull()
    pages = rows.select(
        *key, number.alias("_page"), ogg_page(serial, number, F.when(last, 4).otherwise(0), F.sum(samples).over(w), F.col("body")).alias("_data")
    )
    first = rows.groupBy(*key).agg(F.max(channels).alias("_channels"), F.max(serial).alias("_serial"))
    intro = first.select(
        *key, F.inline(F.array(*[
            F.struct(F.lit(i).alias("_page"), ogg_page(F.col("_serial"), F.lit(i), F.lit(kind), F.lit(0), packet).alias("_data"))
            for i, (kind, packet) in enumerate(zip((2, 0), opus_headers(F.col("_channels"))))
        ])),
    )
    return intro.unionByName(pages).select(*key, F.col("_page").cast("bigint").alias("number"), F.col("_data").alias("content"))


def opus_file(packets: DataFrame, key: list[str], order: str, samples: str, channels: Column, serial: Column) -> DataFrame:
    """(key, content): the pages of ``opus_pages`` as one value, for short recordings; write long ones by ``files.write_recordings``."""
    return joined(opus_pages(packets, key, order, samples, channels, serial), key, "number", F.col("content"))


def wav_parts(pieces: DataFrame, key: list[str], order: str, rate: str, channels: str) -> DataFrame:
    """(key, number, content): PCM tracks that are held as pieces (``pcm``, in ``order``) as the parts of RIFF files, the header first."""

    @F.arrow_udf("binary")
    def samples(pcm: pa.Array) -> pa.Array:
        return pa.array([None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype("<i2").tobytes() for x in pcm], pa.binary())

    none = F.array().cast("array<int>")
    totals = pieces.groupBy(*key).agg(F.sum(F.size("pcm")).alias("_n"), F.max(rate).alias("_rate"), F.max(channels).alias("_channels"))
    head = totals.select(*key, F.lit(-1).cast("bigint").alias("number"), wav_head(F.col("_n") * 2, F.col("_rate"), F.col("_channels")).alias("content"))
    return head.unionByName(pieces.select(*key, F.col(order).cast("bigint").alias("number"), samples(F.coalesce(F.col("pcm").cast("array<int>"), none)).alias("content")))


def write_files(contents: DataFrame, folder: str, name: Column) -> DataFrame:
    """Write each row's ``content`` to ``folder``/``name``: (path, bytes) once the result is computed.

    ``folder`` is a URI that all executors share, for Arrow's file systems. A
    task that runs again writes the same file again, and a job that fails leaves
    what was written: ``files.write_recordings`` leaves all or nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, sizes = [], []
            for file, data in zip(batch.column("name").to_pylist(), batch.column("content")):
                store.create_dir(base, recursive=True)
                with store.open_output_stream(f"{base}/{file}") as out:
                    out.write(data.as_buffer())
                paths.append(f"{folder}/{file}")
                sizes.append(data.as_buffer().size)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return contents.select(name.alias("name"), "content").mapInArrow(run, "path string, bytes bigint")
