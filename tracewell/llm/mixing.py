"""Interleaving of sources by target weights: Pfair windows, earliest deadline first.

Block j of a source with weight w may take a place from floor(j / w) on and has
to take one before ceil((j + 1) / w). Of the blocks that are released, the one
with the earliest deadline goes next. At every place, each source that has not
run out has then taken its share to within one block.

Weights are whole shares of a frame of places that holds them exactly, so the
order of one frame is the order of all; it depends on the weights alone.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import quoted

#: Documents in a block, places in a frame, sources at most (their names and counts are read by the driver).
BLOCK_DOCS = 16
FRAME = 1000
MAX_SOURCES = 10_000
#: Places in a frame at most, and places for one of ``FRAME`` where weights have to be rounded.
MAX_PLACES, FINER = 1 << 20, 64
#: Rows of a table that stands in the plan; larger ones are sent as Arrow batches.
IN_PLAN = 10_000
#: Documents that are numbered together, and groups whose sizes are added up together.
GROUP_DOCS, FAR_GROUPS = 1000, 1000


def _fraction(weight: float) -> Fraction:
    """The weight as it is written: 0.15 is 3/20, and 1 / 3 is a third."""
    exact = Fraction(repr(float(weight)))
    near = exact.limit_denominator(10_000)
    return max(near if abs(near - exact) < Fraction(1, 10**15) else exact, Fraction(0))


def shares(sources: list[str], weights: dict[str, float], frame: int = FRAME) -> dict[str, int]:
    """Places of each source in a frame.

    Sources without a weight share what is left of 1 equally. Weights are
    divided by their sum. The frame is the smallest that holds all of them
    exactly. If that has over ``MAX_PLACES`` places, they are rounded by largest
    remainder to a frame of ``FINER`` times as many places as ``frame`` or as
    there are sources, doubled up to ``MAX_PLACES`` until each weight has a place.
    A source without a place has only what is left over (see ``mix``).
    """
    given = {s: _fraction(weights[s]) for s in sources if s in weights}
    rest = len(sources) - len(given)
    left = max(Fraction(1) - sum(given.values()), Fraction(0))
    each = {s: given[s] if s in given else left / rest for s in sources}
    total = sum(each.values())
    if not total:
        return dict.fromkeys(sources, 0)
    each = {s: w / total for s, w in each.items()}
    size = 1
    for w in set(each.values()):
        size = math.lcm(size, w.denominator)
        if size > MAX_PLACES:
            break
    else:
        return {s: int(w * size) for s, w in each.items()}
    least = min(w for w in each.values() if w)
    size = min(FINER * max(frame, len(sources)), MAX_PLACES)
    while size * least < 1 and 2 * size <= MAX_PLACES:
        size *= 2
    out = {s: int(w * size) for s, w in each.items()}
    order = sorted((s for s in sources if each[s]), key=lambda s: (out[s] - each[s] * size, s))
    for s in order[: size - sum(out.values())]:
        out[s] += 1
    return out


def frame_order(places: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) for each place of a frame."""
    frame = sum(places.values())
    waiting = [(0, -(-frame // q), s, 0) for s, q in sorted(places.items()) if q]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    order = []
    for place in range(frame):
        while waiting and waiting[0][0] <= place:
            _, deadline, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, source, block))
        _, source, block = heapq.heappop(ready)
        order.append((source, block))
        if (nxt := block + 1) < places[source]:
            q = places[source]
            heapq.heappush(waiting, (nxt * frame // q, -(-(nxt + 1) * frame // q), source, nxt))
    return order


def _key(source: Column) -> Column:
    """The source's name; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(
    documents: DataFrame,
    weights: dict[str, float],
    block_docs: int = BLOCK_DOCS,
    frame: int = FRAME,
    filled: bool = False,
    names: tuple[str, str, str] = ("block", "slot", "offset"),
) -> DataFrame:
    """``documents`` with their place in the mixture: block, slot and offset, or what ``names`` calls them.

    ``slot`` is the place of the document's block, ``offset`` its number in the
    block. Within a source, documents stand by the MD5 of their doc_id, then by
    doc_id; equal ids, and rows without one, in any order. Texts play no part.
    Every row is returned: places of a source that has run out stay empty, and
    sources of weight 0 take turns after the last place of the others. A null
    source is a source of its own. An empty table gives no row. Columns of the
    added names are replaced, others stay.

    ``filled`` returns only the slots before the first one that a source named
    in ``weights`` can't fill; there, shares are as the weights say.
    """
    spark = documents.sparkSession
    counts = {
        r["k"]: r["n"]
        for r in documents.groupBy(_key(F.col("source")).alias("k")).agg(F.count(F.lit(1)).alias("n")).take(MAX_SOURCES + 1)
    }
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    places = shares(sorted(counts), {"s" + s: w for s, w in weights.items()}, frame)
    order = frame_order(places)

    frames = len(order)
    at = {place: i for i, place in enumerate(order)}

    def slot(source: str, block: int) -> int:
        q = places[source]
        return block // q * frames + at[source, block % q]

    after = max((slot(s, (n - 1) // block_docs) + 1 for s, n in counts.items() if places[s]), default=0)
    late = [s for s in sorted(counts) if not places[s]]
    named = [s for s in counts if places[s] and s[1:] in weights and s != "n"]
    end = min((slot(s, counts[s] // block_docs) for s in named), default=None)

    def table(rows: list, fields: str) -> DataFrame:
        if len(rows) > IN_PLAN:
            return spark.createDataFrame(pa.Table.from_pylist(rows))
        schema = f"array<struct<{fields}>>"
        return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema))))

    groups = table([{"k": k, "groups": 1 + n // GROUP_DOCS} for k, n in sorted(counts.items())], "k:string,groups:bigint")
    pattern = table(
        [{"k": s, "in_frame": b, "place": i} for i, (s, b) in enumerate(order)], "k:string,in_frame:bigint,place:bigint"
    )
    kept = [n for n in documents.columns if n not in names]
    high = F.coalesce(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), F.lit(0))
    rows = (
        documents.select(
            F.struct(*map(quoted, kept)).alias("row"),
            F.col("doc_id").alias("id"),
            _key(F.col("source")).alias("k"),
            F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("digest"),
        )
        .join(groups, "k")
        .withColumn("group", F.floor(high * F.col("groups") / F.lit(1 << 32)))
    )
    inside = Window.partitionBy("k", "group").orderBy("digest", "id")
    numbered = (
        rows.withColumn("number", F.row_number().over(inside))
        .join(_starts(rows), ["k", "group"])
        .withColumn("index", F.col("start") + F.col("number") - 1)
        .withColumn("block", F.floor(F.col("index") / block_docs))
    )
    shares_only = table(
        [{"k": s, "q": q or 1, "late": None if q else after + late.index(s)} for s, q in places.items()],
        "k:string,q:bigint,late:bigint",
    )
    placed = (
        numbered.join(shares_only, "k")
        .withColumn("in_frame", F.col("block") % F.col("q"))
        .join(pattern, ["k", "in_frame"], "left")
        .withColumn(
            "slot",
            F.coalesce(
                F.col("late") + F.col("block") * len(late), F.floor(F.col("block") / F.col("q")) * frames + F.col("place")
            ),
        )
    )
    placed = placed.filter(F.col("slot") < end) if filled and end is not None else placed
    added = [F.col("block"), F.col("slot"), F.col("index") % block_docs]
    return placed.select(*[f"row.{quoted(n)}" for n in kept], *[c.alias(n) for c, n in zip(added, names)])


def _starts(rows: DataFrame) -> DataFrame:
    """(k, group, start): rows of the source before each group, from sums over groups of groups."""
    sizes = rows.groupBy("k", "group").agg(F.count(F.lit(1)).alias("n")).withColumn("far", F.floor(F.col("group") / FAR_GROUPS))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    far = sizes.groupBy("k", "far").agg(F.sum("n").alias("n"))
    far = far.select("k", "far", F.coalesce(F.sum("n").over(before("k", "far")), zero).alias("far_start"))
    near = sizes.withColumn("near_start", F.coalesce(F.sum("n").over(before("k", "far", "group")), zero))
    return near.join(far, ["k", "far"]).select("k", "group", (F.col("far_start") + F.col("near_start")).alias("start"))


def mixed(documents: DataFrame, weights: dict[str, float], **settings) -> DataFrame:
    """All rows of ``documents`` with their own columns, sorted by their place."""
    names = ("__mix_block", "__mix_slot", "__mix_offset")
    return mix(documents, weights, **settings, names=names).orderBy(*names[1:]).drop(*names)
