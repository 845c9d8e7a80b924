"""Removal of multi-line passages that occur elsewhere in the corpus.

A rolling hash over the last ``ROLL`` line hashes ends a chunk where it is a
multiple of ``DIVISOR``, so that boundaries move along with inserted lines.
Chunks of several lines are counted by hash over the whole corpus; the texts of
repeated hashes are compared byte by byte before any is removed.

Chunks find a short passage only if boundaries fall inside it. ``passage_dedup``
takes out repeated chunks, and follows the passages beyond them line by line:
what no repeated chunk covers is compared by pairs of neighbouring lines, so
that none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, let, quoted

#: Lines that a boundary depends on, the factor from one to the next, and one line in how many ends a chunk.
ROLL, BASE, DIVISOR = 2, 31, 4
MIN_LINES = 2


def _line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _rolled(hashes: Column, i: Column, roll: int) -> Column:
    """The rolling hash at line i: the sum of BASE**k * hash of line i - k, without what lies before the text.

    It is what adding line i to BASE times the last value and taking out the
    oldest line gives; ``roll`` is small, so the terms are simply added up.
    """
    return sum((F.coalesce(F.get(hashes, i - k), F.lit(0).cast("bigint")) * BASE**k for k in range(1, roll)), F.get(hashes, i))


def _ends(lines: Column, roll: int, divisor: int) -> Column:
    """The numbers of the lines that end a chunk."""
    return let(
        F.transform(lines, _line_hash),
        lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (_rolled(h, i, roll) % divisor == 0) | (i == F.size(h) - 1)),
    )


def _start(ends: Column, k: Column) -> Column:
    """The first line of chunk k."""
    return F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)


def _chunks(text: Column, roll: int = ROLL, divisor: int = DIVISOR) -> Column:
    """The chunks of a text, each an array of lines."""
    return let(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda lines: let(
            _ends(lines, roll, divisor),
            lambda e: F.transform(e, lambda end, k: let(_start(e, k), lambda start: F.slice(lines, start + 1, end - start + 1))),
        ),
    )


def repeated_chunks(documents: DataFrame, min_lines: int = MIN_LINES, roll: int = ROLL, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, hash, at): the chunks that are removed, by document, its text's hash and their number in the text.

    A chunk counts if at least ``min_lines`` of its lines hold a word. Of equal
    chunks the one with the smallest (doc_id, hash, number) stays.

    Texts are compared by grouping on (key, text), so of a chunk with many
    copies each task sends one. Where all texts of a key are equal, which is so
    but for collisions of the 64-bit key, the members need no text any more.
    """
    rows = (
        documents.filter("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(_chunks(F.col("text"), roll, divisor)).alias("at", "lines"))
        .filter(F.size(F.filter("lines", lambda x: x.rlike(r"[^ \t-\r]"))) >= min_lines)
        .select("doc_id", "hash", "at", F.array_join("lines", "\n").alias("chunk"))
        .withColumn("key", F.xxhash64("chunk"))
    )
    place = F.struct("doc_id", "hash", "at")
    keyed = cut(rows.drop("chunk"))
    groups = (
        keyed.groupBy("key")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first != last")
        .select("key", "first")
    )
    texts = rows.join(groups, "key").select("key", "chunk").distinct()
    mixed = cut(texts.groupBy("key").count().filter("count > 1").select("key"))
    repeated = keyed.join(groups, "key").filter(F.col("first") != place)
    if mixed.isEmpty():
        return repeated.select("doc_id", "hash", "at").distinct()
    equal = repeated.join(mixed, "key", "left_anti")
    members = rows.join(mixed, "key")
    firsts = members.groupBy("key", "chunk").agg(F.min(place).alias("first"))
    others = members.join(firsts, ["key", "chunk"]).filter(F.col("first") != place)
    return equal.select("doc_id", "hash", "at").unionByName(others.select("doc_id", "hash", "at")).distinct()


def _with_removed(documents: DataFrame, removed: DataFrame, added: dict[str, Column]) -> DataFrame:
    """``documents`` with the columns of ``added``, made from row (all of the row) and removed (null, or what belongs to it)."""
    held = documents.select(
        F.struct(*map(quoted, documents.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of")
    )
    joined = held.join(removed.select(F.col("doc_id").alias("id"), F.col("hash").alias("of"), "removed"), ["id", "of"], "left")
    places = [added[n].alias(n) if n in added else F.col(f"row.{quoted(n)}") for n in documents.columns]
    return joined.select(*places, *[c.alias(n) for n, c in added.items() if n not in documents.columns])


def line_dedup(documents: DataFrame, min_lines: int = MIN_LINES, roll: int = ROLL, divisor: int = DIVISOR) -> DataFrame:
    """``documents`` with repeated chunks taken out of ``text``, and the columns n_chunks and n_removed.

    Null texts stay null, with no chunk; an empty text is one chunk that stays.
    Rows with one doc_id and one text count as one document, and those with one
    doc_id and different texts as several; rows without an id are left as they
    are. Texts of any length are cut whole. Columns of the added names are
    replaced, others stay.
    """
    removed = (
        repeated_chunks(documents, min_lines, roll, divisor).groupBy("doc_id", "hash").agg(F.collect_list("at").alias("removed"))
    )
    text, gone = F.col("row.text"), F.col("removed")

    def rebuilt(chunks: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), gone)
        return F.array_join(F.flatten(F.transform(stay, lambda i: F.get(chunks, i))), "\n")

    chunks = _chunks(text, roll, divisor)
    added = {
        "text": F.when(gone.isNull(), text).otherwise(let(chunks, rebuilt)),
        "n_chunks": F.when(text.isNull(), 0).otherwise(F.size(chunks)),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)),
    }
    return _with_removed(documents, removed, added)


def _between(lines: Column, a: Column, b: Column) -> Column:
    """The text from line a to line b."""
    return F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")


def _pairs(text: Column, roll: int, divisor: int) -> Column:
    """Neighbouring lines with a word, and the blank ones between them: first and last line, the chunk that both are in, text."""

    def pairs(lines: Column, at: Column, chunk: Column) -> Column:
        return F.transform(
            F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
            lambda a, k: let(
                F.get(at, k + 1),
                lambda b: F.struct(
                    a.alias("a"),
                    b.alias("b"),
                    F.when(F.get(chunk, a) == F.get(chunk, b), F.get(chunk, a)).alias("at"),
                    _between(lines, a, b).alias("chunk"),
                ),
            ),
        )

    def chunk_of(lines: Column) -> Column:
        return let(
            _ends(lines, roll, divisor),
            lambda e: F.flatten(F.transform(e, lambda end, k: F.array_repeat(k, end - _start(e, k) + 1))),
        )

    return let(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda lines: let(
            F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"[^ \t-\r]")),
            lambda at: let(chunk_of(lines), lambda chunk: pairs(lines, at, chunk)),
        ),
    )


def repeated_pairs(documents: DataFrame, roll: int = ROLL, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, hash, a, b): pairs of neighbouring lines with a word that also stand at a smaller (doc_id, hash, a).

    Those inside a repeated chunk are known from it. Each also stands in the
    chunk that stays, so no first place is among them, and only the others are
    compared: by a 64-bit key, and where a key is repeated by their texts, which
    are grouped byte by byte.
    """
    chunks = repeated_chunks(documents, MIN_LINES, roll, divisor).withColumn("inside", F.lit(True))
    named = documents.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"), "text")
    pairs = named.select("doc_id", "hash", F.explode(_pairs(F.col("text"), roll, divisor)).alias("pair")).select("doc_id", "hash", "pair.*")
    keyed = pairs.withColumn("key", F.xxhash64("chunk")).drop("chunk")
    keyed = cut(keyed.join(chunks, ["doc_id", "hash", "at"], "left"))
    others, place = keyed.filter("inside is null"), F.struct("doc_id", "hash", "a")
    groups = others.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last")
    members = cut(others.join(groups.select("key", "first"), "key").select("doc_id", "hash", "a", "b", "key", "first"))
    wanted = members.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("a", "b", "key")).alias("wanted"))
    texts = (
        named.join(wanted, ["doc_id", "hash"])
        .select(
            "doc_id",
            "hash",
            F.explode(
                let(
                    F.split("text", "\n"),
                    lambda lines: F.transform("wanted", lambda r: F.struct(r["a"].alias("a"), r["key"].alias("key"), _between(lines, r["a"], r["b"]).alias("chunk"))),
                )
            ).alias("pair"),
        )
        .select("doc_id", "hash", "pair.*")
    )
    mixed = cut(texts.select("key", "chunk").distinct().groupBy("key").count().filter("count > 1").select("key"))
    found = keyed.filter("inside").select("doc_id", "hash", "a", "b")
    later = members.filter(F.col("first") != place)
    if not mixed.isEmpty():
        told = texts.join(mixed, "key")
        firsts = told.groupBy("key", "chunk").agg(F.min(place).alias("first"))
        again = told.join(firsts, ["key", "chunk"]).filter(F.col("first") != place).select("doc_id", "hash", "a", "key")
        later = later.join(mixed, "key", "left_anti").unionByName(members.join(again, ["doc_id", "hash", "a", "key"], "left_semi").select(later.columns))
    return found.unionByName(later.select("doc_id", "hash", "a", "b"))


def passage_dedup(documents: DataFrame, roll: int = ROLL, divisor: int = DIVISOR) -> DataFrame:
    """``documents`` with every repeated passage of two or more lines taken out of ``text``, and the column n_removed.

    A line is removed if it lies in two neighbouring lines with words that also
    stand, with the same blank lines between them, at a smaller (doc_id, text
    hash, line); so each passage stays once, wherever it begins and ends.
    Repeated chunks are found first, then the pairs of lines outside them; texts
    are compared byte by byte. Passages with one line that holds a word
    stay. Null texts stay null. Rows with one doc_id and one text count as one
    document; rows without an id are left as they are.
    """
    removed = (
        repeated_pairs(documents, roll, divisor)
        .groupBy("doc_id", "hash")
        .agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
        .select(
            "doc_id", "hash", F.array_distinct(F.flatten(F.transform("pairs", lambda r: F.sequence(r["a"], r["b"])))).alias("removed")
        )
    )
    text, gone = F.col("row.text"), F.col("removed")

    def rebuilt(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    added = {
        "text": F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n"), rebuilt)),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)),
    }
    return _with_removed(documents, removed, added)
