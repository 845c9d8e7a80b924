"""Probe documents with scalars of any kind."""

from tracewell.sources import probe

TEXTS = [
    '{"frames":[{"coded_picture_number":"1","pts_time":"0.0405","pkt_duration_time":"0.04","key_frame":1,"pict_type":"I","pkt_pos":"44","pkt_size":7},'
    '{"coded_picture_number":0,"best_effort_timestamp_time":0.08,"pkt_dts_time":-0.04,"key_frame":"x","top_field_first":false},'
    '{"coded_picture_number":1,"pts_time":"N/A","best_effort_timestamp_time":1,"pkt_size":-5},{"coded_picture_number":9,"pts_time":1e-1,"pkt_pos":true},{}]}',
    '{"frames":[]}', '{"frames":{"a":1}}', "{}", "not json", None, "[1,2]",
]


def test_frames_of_documents(spark):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "d int, t string")
    rows = probe.probe_frames(documents, ["d"], "t").orderBy("d", "display_index").collect()
    assert [(r.d, r.display_index, r.decode_index, r.decode_precision) for r in rows] == [
        (0, 0, None, "not_unique"), (0, 1, 0, "coded_picture_number"), (0, 2, None, "not_unique"), (0, 3, None, "not_unique"), (0, 4, None, "unavailable"),
    ]
    assert [r.pts_ms for r in rows] == [41, 80, None, 100, None] and [r.dts_ms for r in rows] == [None, -40, None, None, None]
    assert [r.duration_ms for r in rows] == [40, None, None, None, None] and [r.packet_position for r in rows] == [44, None, None, 1, None]
    assert [r.packet_size for r in rows] == [7, None, None, None, None] and [r.key_frame for r in rows] == [True, False, False, False, False]
    assert [r.top_field_first for r in rows] == [None, False, None, None, None] and rows[0].picture_type == "I"
    covered = probe.probe_coverage(probe.probe_frames(documents, ["d"], "t"), ["d"]).collect()
    assert [tuple(r) for r in covered] == [(0, 5, 41, 100, 1)]
