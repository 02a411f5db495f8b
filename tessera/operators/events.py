"""Events and their participants, fenced by a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_at(events: DataFrame, t: int) -> DataFrame:
    return events.where(F.col("vol") <= t)


def events_of(events: DataFrame, who, t: int) -> DataFrame:
    return events_at(events, t).where(F.array_contains("participants", who))


def shared_events(events: DataFrame, a, b, t: int) -> DataFrame:
    return events_at(events, t).where(F.array_contains("participants", a) & F.array_contains("participants", b))


def group_events(events: DataFrame, ids: list, t: int, k: int) -> DataFrame:
    """Events with k of the ids at least; none if there are fewer ids than k."""
    if len(set(ids)) < k:
        return events.limit(0)
    return events_at(events, t).where(F.size(F.array_intersect("participants", F.array(*[F.lit(i) for i in ids]))) >= k)


def co_presence(events: DataFrame, t: int) -> DataFrame:
    """(a, b, n): how many events each pair shares.

    Pairs are made within an event, whose cast is small by nature, from its
    array; no key brings the events of a busy participant together.
    """
    cast = F.array_sort(F.array_distinct("participants"))
    pairs = F.flatten(F.transform(cast, lambda a: F.transform(F.filter(cast, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return events_at(events, t).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def event_claims(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One claim for each array column of kinds (column -> kind) and element."""
    parts = [events.select("event_id", "vol", F.lit(kind).alias("kind"), F.posexplode(c).alias("place", "text")) for c, kind in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
