"""Files that are there whole or not at all."""

import wave

import pytest
from pyspark.sql import functions as F

from tests.test_sinks import ogg_pages
from tracewell.operators import audio
from tracewell.sinks import files, media


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(folder.rglob("*")) if p.is_file()}


def parts(spark, n=200):
    return spark.range(n).select((F.col("id") % 7).alias("f"), F.col("id").alias("i"), F.encode(F.concat(F.col("id").cast("string"), F.lit(";")), "UTF-8").alias("content")).repartition(5)


def test_rows_of_a_name_are_one_file_in_order(spark, tmp_path):
    files.write_recordings(parts(spark), str(tmp_path), F.concat(F.lit("d/"), "f", F.lit(".txt")), "i")
    assert tree(tmp_path) == {f"d/{f}.txt": "".join(f"{i};" for i in range(f, 200, 7)).encode() for f in range(7)}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_pending")]
    files.write_recordings(parts(spark, 14), "file://" + str(tmp_path), F.concat(F.lit("d/"), "f", F.lit(".txt")), "i")
    assert tree(tmp_path)["d/3.txt"] == b"3;10;"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    broken = parts(spark).withColumn("content", F.when(F.col("i") == 150, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        files.write_recordings(broken, str(tmp_path), F.col("f").cast("string"), "i")
    with pytest.raises(Exception, match="no name"):
        files.write_recordings(parts(spark), str(tmp_path), F.when(F.col("f") == 3, "../out").otherwise("a"), "i")
    assert list(tmp_path.rglob("*")) == []


def test_one_attempt_of_a_task_counts(tmp_path):
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([{"name": n, "content": c} for n, c in rows], schema=pa.schema([("name", pa.string()), ("content", pa.binary())]))
    writer = files.RecordingWriter(str(tmp_path))
    writer.write(iter([batch(("a", b"half"))]))  # the executor is lost
    again = writer.write(iter([batch(("a", b"wh"), ("a", b"ole")), batch(("a", None), ("b", b""))]))
    writer.commit([again, None])
    assert tree(tmp_path) == {"a": b"whole", "b": b""}
    twice = files.RecordingWriter(str(tmp_path))
    with pytest.raises(ValueError):
        twice.commit([twice.write(iter([batch(("c", b"1"))])), twice.write(iter([batch(("c", b"2"))]))])
    assert tree(tmp_path) == {"a": b"whole", "b": b""} and not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_long_recordings_as_parts(spark, tmp_path):
    tracks = spark.range(40).select((F.col("id") % 2).alias("f"), F.col("id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: (x * 300 - F.col("id") * 100).cast("smallint")).alias("pcm"), F.lit(8000).alias("rate"), F.lit(2).alias("channels"))
    files.write_recordings(media.wav_parts(tracks, ["f"], "i", "rate", "channels"), str(tmp_path), F.concat("f", F.lit(".wav")), "number")
    with wave.open(str(tmp_path / "1.wav")) as found:
        assert (found.getframerate(), found.getnchannels(), found.getnframes()) == (8000, 2, 20 * 25)
        data = found.readframes(500)
    assert data == b"".join((x * 300 - i * 100).to_bytes(2, "little", signed=True) for i in range(1, 40, 2) for x in range(1, 51))
    bodies = [b"\x08" + bytes(10), b"\x09" + bytes(600)]
    packets = spark.createDataFrame([("k", i, bytearray(b)) for i, b in enumerate(bodies)], "k string, i int, body binary").withColumn("samples", audio.opus_samples(F.col("body")))
    files.write_recordings(media.opus_pages(packets, ["k"], "i", "samples", F.lit(2), F.lit(7)), str(tmp_path), F.concat("k", F.lit(".ogg")), "number")
    assert [p[0] for p in ogg_pages((tmp_path / "k.ogg").read_bytes())] == [2, 0, 0, 4]
