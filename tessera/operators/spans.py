"""Spans over ordered passages, folds of contained rows, dominance carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_before(groups: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """groups(keys, order, size, group) -> (keys, group, first, overlap_first): how far back a span may reach into the one before.

    The overlap is the longest run of earlier rows whose sizes sum to the limit
    at most; the core is never shortened.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    rows = groups.withColumn("upto", F.sum(size).over(by))
    core = rows.groupBy(*keys, "group").agg(F.min(order).alias("first"), F.min(F.col("upto") - F.col(size)).alias("before"))
    span = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (F.col("upto") - F.col(size)).alias("start")))).alias("rows_"))
    joined = core.join(span, keys)
    reach = F.filter("rows_", lambda r: (r["o"] < F.col("first")) & (F.col("before") - r["start"] <= limit))
    return joined.select(*keys, "group", "first", F.when(F.size(reach) > 0, F.array_min(F.transform(reach, lambda r: r["o"]))).otherwise(F.col("first")).alias("overlap_first"))


def fold_contained(rows: DataFrame, keys: list[str], item: str, members: str) -> DataFrame:
    """rows(keys, item, members array) without those whose members lie strictly in a larger row's; host takes their evidence.

    Returns (keys, item, folded): folded counts the rows that item, the largest
    host of each, has taken in.
    """
    r = rows.select(*keys, item, F.array_sort(F.array_distinct(members)).alias("m"))
    # rows of the same members share their host, so sets are compared, each once: one lies in another if that has its rarest member
    sets = r.groupBy(*keys, "m").agg(F.max(item).alias("best"))
    held = sets.select(*keys, "m", "best", F.explode("m").alias("w"))
    counts = held.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"))
    asked = held.join(counts.withColumnsRenamed({"w": "w_", **{k: f"{k}_" for k in keys}}), _same([*keys, "w"])).groupBy(*keys, "m").agg(F.min(F.struct("n", "w"))["w"].alias("w"))
    other = held.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("w").alias("w_"), F.col("m").alias("hm"), F.struct(F.size("m").alias("size"), F.col("best").alias("host")).alias("h"))
    inside = asked.join(other, _same([*keys, "w"])).where((F.size("hm") > F.size("m")) & (F.size(F.array_except("m", "hm")) == 0)).select(*keys, "m", "h")
    # the empty set lies in every other
    empty = sets.where(F.size("m") == 0).select(*keys, "m")
    largest = sets.where(F.size("m") > 0).groupBy(*keys).agg(F.max(F.struct(F.size("m").alias("size"), F.col("best").alias("host"))).alias("h"))
    hosts = inside.unionByName(empty.join(largest, keys)).groupBy(*keys, "m").agg(F.max("h").alias("h"))
    host = r.join(hosts, [*keys, "m"]).groupBy(*keys, item).agg(F.max("h")["host"].alias("host"))
    kept = r.select(*keys, item).join(host.select(*keys, item), [*keys, item], "left_anti")
    taken = host.groupBy(*keys, F.col("host").alias(item)).agg(F.count(F.lit(1)).alias("folded"))
    return kept.join(taken, [*keys, item], "left").select(*keys, item, F.coalesce("folded", F.lit(0)).alias("folded"))


def _same(columns: list[str]) -> Column:
    """Each column equals the one with a line after its name; a null member equals a null, a null key nothing."""
    *keys, member = columns
    both = F.col(member).eqNullSafe(F.col(f"{member}_"))
    for k in keys:
        both = both & (F.col(k) == F.col(f"{k}_"))
    return both


def dominant(counts: DataFrame, key: str, owner: str, n: str, share: float = 0.6) -> DataFrame:
    """counts(key, vol, owner, n) -> (key, vol, owner): the owner with that share of a period, else the last one decided."""
    by = Window.partitionBy(key, "vol")
    ranked = counts.withColumn("total", F.sum(n).over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc(n), owner))).where("r = 1")
    decided = ranked.withColumn("own", F.when(F.col(n) >= share * F.col("total"), F.col(owner)))
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy(key).orderBy("vol").rowsBetween(Window.unboundedPreceding, 0))
    return decided.select(key, "vol", carried.alias(owner))


def evidence_context(facts: DataFrame, passages: DataFrame, radius: int) -> DataFrame:
    """facts(fact_id, chapter, seq) with the passages around, in order, of the same chapter."""
    reach = facts.select("fact_id", "chapter", F.explode(F.sequence(F.col("seq") - radius, F.col("seq") + radius)).alias("seq"))
    return reach.join(passages, ["chapter", "seq"])


def paragraph_id(text: Column, valid: Column) -> Column:
    """An id with its numbers padded again, if that is valid, else null."""
    p = F.split(F.trim(text), ":")
    tail = F.regexp_extract(F.element_at(p, 3), "([0-9]+)$", 1)
    tries = F.transform(F.array(F.lit(4), F.lit(3), F.lit(5)), lambda w: F.concat(p[0], F.lit(":"), p[1], F.lit(":p"), F.lpad(tail, w, "0")))
    return F.try_element_at(F.filter(tries, lambda t: F.array_contains(valid, t)), F.lit(1))


def cited_only(evidence: Column, allowed: Column, most: int) -> Column:
    """The allowed citations, the first few."""
    return F.slice(F.filter(evidence, lambda e: F.array_contains(allowed, e)), 1, most)


def sentence_bounds(n_evidence: Column, low: int = 2, high: int = 8) -> tuple[Column, Column]:
    """How many sentences a text on so many pieces of evidence should have."""
    least = F.greatest(F.lit(1), F.least(F.lit(low), n_evidence))
    return least, F.least(F.lit(high), F.greatest(least, F.ceil(n_evidence * 1.5).cast("int")))
