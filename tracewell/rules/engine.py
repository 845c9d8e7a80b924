"""Evaluation of rules: all of them in one pass over the facts, without a join or shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities in ascending order.
SEVERITIES = ["info", "low", "medium", "high", "critical"]


@dataclass(frozen=True)
class Rule:
    """A finding that is made where ``test`` holds; ``evidence`` are columns of the facts."""

    id: str
    category: str
    severity: str
    confidence: int
    test: str
    evidence: tuple[str, ...] = ()
    capped: bool = True


def findings(facts: DataFrame, rules: list[Rule], key: list[str], sufficient: Column | None = None) -> DataFrame:
    """One row per rule that fires: key, ordinal, rule_id, category, severity, confidence, evidence.

    Where the data of a stream is not ``sufficient``, findings of capped rules
    have medium severity and confidence 55 at most, and say so in the evidence.
    A test that is null does not fire. Order is that of ``rules``.
    """
    enough = F.coalesce(sufficient, F.lit(True)) if sufficient is not None else F.lit(True)

    def row(number: int, rule: Rule) -> Column:
        cap = ~enough if rule.capped else F.lit(False)
        level = SEVERITIES.index(rule.severity)
        shown = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in rule.evidence]
        return F.struct(
            F.lit(number).alias("ordinal"),
            F.lit(rule.id).alias("rule_id"),
            F.lit(rule.category).alias("category"),
            F.when(cap, F.lit(SEVERITIES[min(level, 2)])).otherwise(F.lit(rule.severity)).alias("severity"),
            F.when(cap, F.lit(min(rule.confidence, 55))).otherwise(F.lit(rule.confidence)).alias("confidence"),
            F.concat_ws(";", *shown, F.when(cap, F.lit("insufficient sample"))).alias("evidence"),
        )

    fired = F.array_compact(F.array(*[F.when(F.expr(r.test), row(i, r)) for i, r in enumerate(rules)]))
    return facts.select(*key, F.inline(fired))


def of_source(found: DataFrame, live: Column) -> DataFrame:
    """Findings without those on a control connection where the source isn't live."""
    return found.filter(live | ~F.col("rule_id").startswith("RTSP-"))


def concatenated(*feeds: DataFrame) -> DataFrame:
    """The events of a run followed by those of its streams, numbered through by feed and place."""
    out = None
    for i, feed in enumerate(feeds):
        rows = feed.withColumn("feed", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
