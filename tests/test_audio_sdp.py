import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import audio, sdp

OFFER = "v=0\r\nc=IN IP4 10.0.0.1\r\nm=audio 4000 RTP/AVP 0 8\r\na=rtpmap:0 PCMU/8000\r\na=sendonly\r\nm=video 4002 RTP/AVP 96\r\nc=IN IP4 10.0.0.2\r\na=rtpmap:97 X/1\r\na=rtpmap:96 H264/90000\r\na=control:track2\r\n"
ANSWER = "v=0\r\nc=IN IP4 10.0.0.9\r\nm=audio 5000 RTP/AVP 0\r\na=sendonly\r\nm=video 5002 RTP/AVP 97\r\n"


def test_media_sections(spark):
    rows = sdp.media(spark.createDataFrame([(1, OFFER), (2, None), (3, "v=0")], "id int, t string"), ["id"], "t").orderBy("index").collect()
    assert [(r.kind, r.port, r.payload_types, r.address, r.codec, r.clock_rate, r.control, r.direction) for r in rows] == [
        ("audio", 4000, [0, 8], "10.0.0.1", "PCMU", 8000, None, "sendonly"),
        ("video", 4002, [96], "10.0.0.2", "H264", 90000, "track2", "sendrecv"),
    ]


def test_answers_are_compared_by_position(spark):
    one = sdp.media(spark.createDataFrame([(1, OFFER)], "id int, t string"), ["id"], "t")
    two = sdp.media(spark.createDataFrame([(1, ANSWER)], "id int, t string"), ["id"], "t")
    assert [r.finding for r in sdp.answers(one, two, ["id"]).orderBy("index").collect()] == ["direction_mismatch", "payload_mismatch"]


def test_g711(spark):
    alaw, mulaw = audio.g711_tables()
    assert (alaw[0xD5], alaw[0x55], alaw[0x2A], alaw[0xAA]) == (8, -8, -32256, 32256)
    assert (mulaw[0xFF], mulaw[0x7F], mulaw[0x00], mulaw[0x80]) == (0, 0, -32124, 32124)
    rows = audio.decode_g711(spark.createDataFrame([(1, bytearray(b"\xd5\x55")), (2, None)], "n int, body binary"), "a").orderBy("n").collect()
    assert rows[0].pcm == [8, -8] and rows[1].pcm is None


def test_intervals_of_silence_and_clipping(spark):
    left = np.r_[np.full(800, 2500), np.zeros(1600), np.full(8000, 2500)]
    right = np.full(10_400, 700)
    right[6400:8000] = -32_768
    pcm = np.stack([left, right], 1).astype(int).ravel().tolist()
    df = spark.createDataFrame([("a", 2, 8000, pcm), ("b", 1, 8000, None)], "id string, channels int, rate int, pcm array<smallint>")
    rows = {(r.channel, r.kind): (r.start_ms, r.end_ms) for r in audio.quality_intervals(df, "id").collect()}
    assert rows == {(1, "silence"): (100, 300), (2, "clipping"): (800, 1000)}
