"""From model decisions to claims, scenes and events: a decision table, never a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import short_hash
from tessera.operators.validate import first_reason


def request_key(*parts: Column) -> Column:
    """Content address of a request: what decides the answer, not how it is sent."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def decided(requests: DataFrame, decisions: DataFrame, fallback: Column) -> DataFrame:
    """requests(key, ...) with answer: the decision of that key, or the rule's."""
    return requests.join(decisions.select("key", "answer"), "key", "left").withColumn("by_rule", F.col("answer").isNull()).withColumn("answer", F.coalesce("answer", fallback))


def undecided(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """What still has to be asked."""
    return requests.join(decisions.select("key"), "key", "left_anti")


def classified(candidates: DataFrame, decisions: DataFrame, kinds: list[str]) -> DataFrame:
    """candidates(surface) with the decided type; dropped where none of the vocabulary was given."""
    known = decisions.where(F.col("type").isin(kinds)).select("surface", "type")
    return candidates.join(known, "surface")


def build_claims(raw: DataFrame, passages: DataFrame, predicates: DataFrame, least: float = 0.3, most_words: int = 60) -> DataFrame:
    """raw(subject, predicate, value, para_id, quote, confidence) -> claims with reason: null, or why one is dropped."""
    joined = raw.join(passages.select("para_id", "vol", F.col("text").alias("text_")), "para_id", "left").join(predicates.select("predicate", F.lit(True).alias("known_")), "predicate", "left")
    checks = [
        ("unknown_predicate", F.col("known_").isNull()), ("citation_outside", F.col("text_").isNull()), ("quote_not_verbatim", ~F.contains("text_", "quote")),
        ("quote_too_long", F.size(F.split("quote", " ")) > most_words), ("low_confidence", F.col("confidence") < least), ("empty_value", F.trim(F.coalesce("value", F.lit(""))) == ""),
    ]
    out = first_reason(joined, checks).drop("text_", "known_")
    return out.withColumn("claim_id", short_hash("c_", F.col("subject"), F.col("predicate"), F.lower("value"), F.col("vol")))


def scenes_to_events(scenes: DataFrame) -> DataFrame:
    """Scenes with a summary as events, the participants in order of first sight."""
    return scenes.where(F.trim("summary") != "").select(F.format_string("ev_v%02dc%02ds%03d", "vol", "chapter_idx", "span_index").alias("event_id"), "vol", "chapter_idx", F.array_distinct("participants").alias("participants"), "summary")
