"""From claims to validity intervals.

Every order that a result depends on is total: ties end in the claim's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold, short_hash

#: Confidence by which a claim must lead to win by the rule.
GAP = 0.10


def collapse_same_value(claims: DataFrame) -> DataFrame:
    """One row for each subject, predicate, period and normalised value: its best claim and all claim ids."""
    keys = ["subject", "predicate", "vol", "norm"]
    best = F.struct((-F.col("confidence")).alias("c"), F.col("claim_id"))
    out = claims.withColumn("norm", fold(F.col("value"))).groupBy(*keys).agg(
        F.min_by("value", best).alias("value"), F.min_by("claim_id", best).alias("claim_id"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids")
    )
    return out


def ranked_values(claims: DataFrame) -> DataFrame:
    """The values of a subject, predicate and period in order: confidence, then id."""
    order = Window.partitionBy("subject", "predicate", "vol").orderBy(F.desc("confidence"), "claim_id")
    return collapse_same_value(claims).withColumn("place", F.row_number().over(order)).withColumn("n_values", F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def arbitrate(claims: DataFrame) -> DataFrame:
    """The value that stands for each subject, predicate and period."""
    return ranked_values(claims).where("place = 1").drop("place")


def same_period_conflicts(claims: DataFrame, gap: float = GAP) -> DataFrame:
    """Two or more values in one period: the winner, the second, and how it was settled."""
    keys = ["subject", "predicate", "vol"]
    pick = lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))
    out = ranked_values(claims).where("n_values > 1").groupBy(*keys).agg(
        pick("value", 1).alias("kept"), pick("value", 2).alias("dropped"), pick("confidence", 1).alias("kept_confidence"), pick("confidence", 2).alias("dropped_confidence"), F.sum(F.when(F.col("place") > 2, 1).otherwise(0)).alias("outliers")
    )
    return out.withColumn("resolution", F.when(F.round(F.col("kept_confidence") - F.col("dropped_confidence"), 6) >= gap, "rule:higher_confidence").otherwise("rule:higher_confidence_fallback"))


def supersede(best: DataFrame, keys: list[str], value: str = "value", norm: Column | None = None) -> DataFrame:
    """One row a period -> intervals: consecutive equal values merge, and the next value ends the one before.

    best has keys, vol, value, claim_ids and confidence.  vol_end is null while
    nothing follows; superseded_by is the next interval.
    """
    order = Window.partitionBy(*keys).orderBy("vol")
    norm = fold(F.col(value)) if norm is None else norm
    rows = best.withColumn("norm_", norm)
    rows = rows.withColumn("new_", F.when(F.lag("norm_").over(order).eqNullSafe(F.col("norm_")), 0).otherwise(1)).withColumn("island", F.sum("new_").over(order))
    merged = rows.groupBy(*keys, "island").agg(
        F.min_by(value, "vol").alias(value), F.min("vol").alias("vol_start"), F.max("confidence").alias("confidence"),
        F.array_sort(F.flatten(F.collect_list("claim_ids"))).alias("claim_ids"),
    )
    merged = merged.withColumn("interval_id", short_hash("i_", *[F.col(k) for k in keys], F.col(value), F.col("vol_start")))
    order = Window.partitionBy(*keys).orderBy("island")
    merged = merged.withColumn("vol_end", F.lead("vol_start").over(order) - 1).withColumn("superseded_by", F.lead("interval_id").over(order))
    return merged.withColumn("evidence_count", F.size("claim_ids")).drop("island")


def single_valued_intervals(claims: DataFrame) -> DataFrame:
    return supersede(arbitrate(claims), ["subject", "predicate"])


def narrative_changes(claims: DataFrame) -> DataFrame:
    """Each change of a single value from one period to the next that has one."""
    order = Window.partitionBy("subject", "predicate").orderBy("vol")
    rows = arbitrate(claims).withColumn("before", F.lag("value").over(order)).withColumn("vol_before", F.lag("vol").over(order)).withColumn("norm_before", F.lag("norm").over(order))
    return rows.where("norm_before is not null and norm_before <> norm").select("subject", "predicate", "vol_before", "before", "vol", F.col("value").alias("after"))


def multi_valued_intervals(claims: DataFrame) -> DataFrame:
    """One open interval for each normalised value, shown as it was first seen.

    The qualifier is the earliest non-empty one, and only if it was there in
    the first period.
    """
    keys = ["subject", "predicate", "norm"]
    seen = F.struct("vol", "claim_id")
    out = claims.withColumn("norm", fold(F.col("value"))).groupBy(*keys).agg(
        F.min_by("value", seen).alias("value"), F.min("vol").alias("vol_start"),
        F.min(F.when(F.col("qualifier") != "", F.struct("vol", "claim_id", "qualifier"))).alias("q"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence_count"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids"),
    )
    out = out.withColumn("qualifier", F.when(F.col("q.vol") == F.col("vol_start"), F.col("q.qualifier"))).drop("q")
    return out.withColumn("interval_id", short_hash("i_", F.col("subject"), F.col("predicate"), F.col("norm"), F.col("vol_start"))).withColumn("vol_end", F.lit(None).cast("int"))


def merge_claims(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claims of one content are one: highest confidence, earliest period, evidence without repeats in order of first sight."""
    out = claims.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.min("vol").alias("first_vol"), F.array_sort(F.collect_set(F.struct("vol", "evidence"))).alias("seen"))
    return out.withColumn("evidence", F.array_distinct(F.transform("seen", lambda s: s["evidence"]))).drop("seen")
