"""One timeline out of all feeds of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The feeds in the order that breaks ties: control connection, packets, pictures, buffers, sound, decoder, recovery, run.
FEEDS = ["rtsp", "capture", "h264", "hrd", "h265", "audio", "pcm", "decoder", "recovery", "runtime"]


def timeline(feeds: dict[str, DataFrame], order: str, sort: bool = True) -> DataFrame:
    """The rows of all feeds (offset_ms, kind, ``order`` and whatever else they have) with their layer.

    Sorted by time, rows without one last; ties by feed, then by ``order``. A
    range partitioning does the sort, so that no task holds all rows.
    """
    unknown = set(feeds) - set(FEEDS)
    if unknown:
        raise ValueError(f"no such feed: {', '.join(sorted(unknown))}")
    named = [rows.withColumns({"layer": F.lit(name), "_rank": F.lit(FEEDS.index(name))}) for name, rows in feeds.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return (whole.orderBy(F.asc_nulls_last("offset_ms"), "_rank", order) if sort else whole).drop("_rank")
