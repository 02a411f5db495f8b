"""Validation cascades: the first reason that applies, and counts of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """rows with reason: that of the first check that holds, or null."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in checks])
    return rows.withColumn("reason", reason)


def passed(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").drop("reason")


def reason_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def names_any(text: Column, names: list[str]) -> Column:
    """Whether any of the names occurs in the text, in any case."""
    return F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(F.lower(text), n))


def membership(words: Column, markers: list[str]) -> Column:
    """Whether none of the markers is among the words."""
    return ~F.arrays_overlap(words, F.array(*[F.lit(m) for m in markers]))


def dangling(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References to nothing."""
    return references.join(targets.select(key).distinct(), key, "left_anti")


def keywords_match(asked: Column, found: Column, least: int = 2, share: float = 0.5) -> Column:
    """Enough of the asked keywords are found: the share of them, halves to even, and least at least."""
    return F.size(F.array_intersect(asked, found)) >= F.greatest(F.lit(least), F.bround(F.size(asked) * share).cast("int"))
