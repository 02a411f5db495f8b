"""Readers as of a cutoff: nothing first seen after it is visible.

A period may be open (vol_end null).  At cutoff t an interval that ends after t
is still current, and its end is not shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _current(t: int):
    return (F.col("vol_start") <= t) & (F.col("vol_end").isNull() | (F.col("vol_end") >= t))


def state_at(intervals: DataFrame, t: int) -> DataFrame:
    """What holds at t, the end scrubbed."""
    return intervals.where(_current(t)).withColumn("vol_end", F.lit(None).cast("int"))


def history_at(intervals: DataFrame, t: int) -> DataFrame:
    """What held before t and has ended by then."""
    return intervals.where((F.col("vol_start") <= t) & (F.col("vol_end") < t))


def state_at_each(intervals: DataFrame, cutoffs: list[int]) -> DataFrame:
    """state_at for several cutoffs in one pass: each interval yields the cutoffs it holds at."""
    holds = F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: (F.col("vol_start") <= c) & (F.col("vol_end").isNull() | (F.col("vol_end") >= c)))
    return intervals.withColumn("cutoff", F.explode(holds)).withColumn("vol_end", F.lit(None).cast("int"))


def _either_end(edges: DataFrame, node) -> DataFrame:
    """Edges at a node, by a union of two equalities: an OR would defeat hash joins."""
    return edges.where(F.col("subject") == node).unionAll(edges.where((F.col("object") == node) & (F.col("subject") != node)))


def relations_at(edges: DataFrame, node, t: int) -> DataFrame:
    return _either_end(state_at(edges, t), node)


def relation_history_at(edges: DataFrame, node, t: int) -> DataFrame:
    return _either_end(history_at(edges, t), node)


def relations_of_each_at(edges: DataFrame, nodes: DataFrame, t: int) -> DataFrame:
    """relations_at for every row of nodes(node)."""
    now = state_at(edges, t)
    one = now.join(nodes.withColumnRenamed("node", "subject"), "subject").withColumn("node", F.col("subject"))
    two = now.where("subject <> object").join(nodes.withColumnRenamed("node", "object"), "object").withColumn("node", F.col("object"))
    return one.unionByName(two)


def _pair(df: DataFrame, a, b) -> DataFrame:
    lo, hi = sorted([a, b])
    return df.where((F.least("subject", "object") == lo) & (F.greatest("subject", "object") == hi))


def relations_between(edges: DataFrame, a, b, t: int) -> DataFrame:
    return _pair(state_at(edges, t), a, b)


def relation_history_between(edges: DataFrame, a, b, t: int) -> DataFrame:
    return _pair(history_at(edges, t), a, b)


def evidence_at(intervals: DataFrame, claims: DataFrame, t: int) -> DataFrame:
    """Each interval's claims in order with their evidence seen by t: the fence is on each quote, not on the claim.

    claims has claim_id and evidence, an array of structs with vol.
    """
    ids = intervals.select("interval_id", F.posexplode("claim_ids").alias("place", "claim_id"))
    rows = ids.join(claims.select("claim_id", F.posexplode("evidence").alias("quote_place", "quote")), "claim_id")
    return rows.where(F.col("quote.vol") <= t)


def polarity_at(claims: DataFrame, keys: list[str], t: int) -> DataFrame:
    """The polarity of the latest claim visible at t."""
    return claims.where(F.col("vol") <= t).groupBy(*keys).agg(F.max_by("polarity", F.struct("vol", "claim_id")).alias("polarity"))


def latest_at(documents: DataFrame, keys: list[str], t: int, value: str) -> DataFrame:
    """As-of lookup: for each key the value of the greatest period up to t."""
    return documents.where(F.col("vol") <= t).groupBy(*keys).agg(F.max_by(value, "vol").alias(value), F.max("vol").alias("vol"))


def changes_only(documents: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Rows whose state differs from that of the period before."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy("vol"))
    return documents.withColumn("before_", before).where(~F.col("before_").eqNullSafe(F.col(state))).drop("before_")


def future_of(facts: DataFrame, t: int, vol: str = "vol_start") -> DataFrame:
    """What a reader at t must not see."""
    return facts.where(F.col(vol) > t)


def judged(intervals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Intervals that no verdict calls unsupported.

    A verdict is on the interval that equals it in all its other columns: an
    interval_id is 32 bits of a hash, which several intervals of a large table have
    in common, so verdicts should name the subject and the start too.
    """
    keys = [c for c in verdicts.columns if c != "verdict"]
    return intervals.join(verdicts.where("verdict = 'unsupported'").select(*keys), keys, "left_anti")
