"""Reports and media files written and read back, and sound in bands."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import audio, evidence
from tracewell.rules import facts
from tracewell.sinks import media, reports


def test_reports_are_written_once_per_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s-1", 1, "2024-01-01"), ("s-2", 2, "2024-02-01")], "stream_id string, n int, generated_at string")
    folder = str(tmp_path / "out")
    reports.write_reports(rows, folder)
    found = reports.read_reports(spark, folder, "n int, generated_at string")
    assert [(r.n, r.generated_at) for r in found.collect()] == [(2, "2024-02-01"), (1, "2024-01-01")]
    for bad in (["s-1", "s-1"], ["../x"], [None]):
        with pytest.raises(ValueError):
            reports.write_reports(spark.createDataFrame([(b, 1) for b in bad], "stream_id string, n int"), str(tmp_path / "bad"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.json").write_text('{"n": 1, "gen')
    assert reports.read_reports(spark, str(tmp_path / "broken"), "n int, generated_at string").count() == 0


def test_evidence_is_quoted_and_ends_lines_with_both_characters(spark, tmp_path):
    issues = spark.createDataFrame([("timestamp_gap", 5, 'a "b", c')], "kind string, start_ms int, detail string")
    intervals = spark.createDataFrame([("silence", 0, 200, 1)], "kind string, start_ms int, end_ms int, channel int")
    reports.write_evidence(reports.audio_evidence(issues, intervals).coalesce(1), str(tmp_path / "csv"), mark=True)
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    lines = text.split("\r\n")
    assert lines[0].replace('"', "") == "﻿" + ",".join(reports.AUDIO_COLUMNS) and len(lines) == 4 and lines[3] == ""
    assert all(line.count('","') == 18 or line.count('",') >= 18 for line in lines[1:3]) and "silence" in text


def test_files_of_sound(spark, tmp_path):
    pcm = [0, 1, -1, 32767, -32768, 5]
    df = spark.createDataFrame([("a", pcm)], "name string, pcm array<smallint>").withColumn("content", media.wav(F.col("pcm"), F.lit(8000), F.lit(2)))
    out = media.write_files(df, (tmp_path / "media").as_uri(), F.concat("name", F.lit(".wav"))).collect()
    assert [r.bytes for r in out] == [44 + 12]
    with wave.open(str(tmp_path / "media" / "a.wav")) as file:
        assert (file.getnchannels(), file.getframerate(), file.getsampwidth()) == (2, 8000, 2)
        assert list(struct.unpack("<6h", file.readframes(10))) == pcm


def ogg_pages(data):
    at, pages = 0, []
    while at < len(data):
        kind, granule, serial, number, crc, laces = struct.unpack_from("<BqIIIB", data, at + 5)
        sizes = data[at + 27 : at + 27 + laces]
        end = at + 27 + laces + sum(sizes)
        value = 0
        for byte in data[at : at + 22] + bytes(4) + data[at + 26 : end]:
            value ^= byte << 24
            for _ in range(8):
                value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        assert data[at : at + 5] == b"OggS\0" and crc == value
        pages.append((kind, granule, serial, number, data[at + 27 + laces : end]))
        at = end
    return pages


def test_opus_pages(spark):
    bodies = [b"\x08" + bytes(10), b"\x09" + bytes(600), b"", b"\x08a"]
    df = spark.createDataFrame([("k", i, bytearray(b)) for i, b in enumerate(bodies)], "k string, i int, body binary").withColumn("samples", audio.opus_samples(F.col("body")))
    pages = ogg_pages(bytes(media.opus_file(df, ["k"], "i", "samples", F.lit(2), F.lit(7)).first().content))
    assert [p[0] for p in pages] == [2, 0, 0, 0, 4] and [p[3] for p in pages] == [0, 1, 2, 3, 4]
    assert [p[1] for p in pages] == [0, 0, 960, 2880, 3840] and {p[2] for p in pages} == {7}
    assert [p[4] for p in pages[2:]] == [b for b in bodies if b] and pages[0][4][:8] == b"OpusHead"


def test_bands_of_a_tone(spark):
    rate, hz = 16_000, 1000
    t = np.arange(rate)
    tone = (10_000 * np.sin(2 * np.pi * hz * t / rate)).astype(int)
    stereo = np.stack([tone, tone], 1).ravel().tolist()
    df = spark.createDataFrame([("a", 1, rate, tone.tolist()), ("b", 2, rate, stereo), ("c", 1, rate, [1] * 100), ("d", 1, rate, None)], "id string, channels int, rate int, pcm array<smallint>")
    rows = audio.mel_spectrogram(df, "id").collect()
    assert {r.id for r in rows} == {"a", "b"}
    for r in rows:
        assert len(r.levels) == 48 and abs(r.centers_hz[int(np.argmax(r.levels))] - hz) < 120
    assert sorted(r.levels for r in rows if r.id == "a") == sorted(r.levels for r in rows if r.id == "b")
    starts = sorted(r.offset_ms for r in rows if r.id == "a")
    assert starts[0] == 0 and starts[-1] == (rate - 2048) * 1000 // rate and len(starts) == rate // 1024


def test_intervals_end_with_the_last_sample(spark):
    df = spark.createDataFrame([("a", 1, 8000, [0] * 1040)], "id string, channels int, rate int, pcm array<smallint>")
    assert [(r.kind, r.start_ms, r.end_ms) for r in audio.quality_intervals(df, "id").collect()] == [("silence", 0, 130)]


def test_even_positions(spark):
    df = spark.createDataFrame([(5, 100), (1, 100), (0, 9), (3, 7)], "n int, a int")
    assert [r.p for r in df.select(audio.evenly(F.col("n"), F.col("a")).alias("p")).collect()] == [[0, 25, 50, 75, 100], [0], [], [0, 3, 7]]


def test_facts_of_streams_fire_rules(spark):
    from tracewell.rules.catalog import RULES
    from tracewell.rules.engine import findings

    streams = spark.createDataFrame([("a", "h264"), ("b", "pcmu")], "stream_id string, codec string")
    rtp = spark.createDataFrame([("a", 5, 2, 4, 1), ("b", 3, 0, 0, 0)], "stream_id string, packets long, lost long, max_gap long, rollbacks long")
    video = spark.createDataFrame([("a", False, 1, 3, 4)], "stream_id string, first_frame_is_idr boolean, incomplete_units long, reference_frames long, buffered_frames long")
    gathered = facts.stream_facts(streams, ["stream_id"], rtp, video.withColumn("dpb_limit", facts.dpb_limit(F.lit(30), F.lit(1920), F.lit(1080))))
    found = {(r.stream_id, r.rule_id) for r in findings(gathered, RULES, ["stream_id"]).collect()}
    assert found == {("a", r) for r in ("RTP-015", "RTP-016", "RTP-019", "H264-022", "H264-023", "H264-051")}


def test_missing_frames_recover_at_the_next_access_point(spark):
    df = spark.createDataFrame([(1, i, i in (2, 5), i in (0, 4)) for i in range(7)], "f int, i int, broken boolean, access boolean")
    rows = evidence.next_random_access(df, ["f"], "i", F.col("broken"), F.col("access")).filter("broken").orderBy("i").collect()
    assert [(r.i, r.recovers_at, r.recovery_frames) for r in rows] == [(2, 4, 2), (5, None, None)]
