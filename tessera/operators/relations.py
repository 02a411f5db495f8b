"""Relations between entities: direction, conflict groups, arbitration, gates.

A catalog row has predicate, symmetric, inverse, conflicts_with (array), mutual
and subject_type/object_type.  Catalogs are configuration: a few hundred rows at
most, built on the driver and broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.intervals import supersede

CATALOG_SCHEMA = "predicate string, symmetric boolean, inverse string, conflicts_with array<string>, mutual boolean, subject_type string, object_type string"


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    if len(rows) > 10_000:
        raise ValueError("a catalog is configuration, not data")
    return F.broadcast(spark.createDataFrame(rows, CATALOG_SCHEMA))


def canonical_direction(claims: DataFrame, predicates: DataFrame) -> DataFrame:
    """Symmetric relations with their ends in order; of two inverse predicates the alphabetically smaller, ends swapped."""
    c = claims.join(predicates.select("predicate", "symmetric", "inverse"), "predicate", "left")
    symmetric = F.coalesce("symmetric", F.lit(False))
    flip = (symmetric & (F.col("subject") > F.col("object"))) | (~symmetric & F.coalesce(F.col("inverse") < F.col("predicate"), F.lit(False)))
    renamed = F.when(~symmetric & F.coalesce(F.col("inverse") < F.col("predicate"), F.lit(False)), F.col("inverse")).otherwise(F.col("predicate"))
    s, o = F.when(flip, F.col("object")).otherwise(F.col("subject")), F.when(flip, F.col("subject")).otherwise(F.col("object"))
    return c.withColumns({"subject": s, "object": o, "predicate": renamed}).drop("symmetric", "inverse")


def conflict_groups(predicates: DataFrame) -> DataFrame:
    """(predicate, other) where each declares the other: a one-sided declaration doesn't count."""
    one = predicates.select("predicate", F.explode("conflicts_with").alias("other"))
    two = one.select(F.col("predicate").alias("other"), F.col("other").alias("predicate"))
    return one.join(two, ["predicate", "other"], "left_semi")


def cliques(present: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """present(keys, predicate) -> with clique, the least predicate that a chain of conflicts joins to it within the key.

    Rounds of taking the least neighbour's label go on for as long as a chain
    of the catalog's conflicts can be: the catalog is configuration, so it is
    walked on the driver.
    """
    near: dict[str, set[str]] = {}
    for r in conflicts.collect():
        near.setdefault(r["predicate"], set()).add(r["other"])
    longest = 0
    for start in near:  # the longest shortest path bounds the chains of any subset only by its number of predicates
        seen, front = {start}, {start}
        while front := {y for x in front for y in near.get(x, ())} - seen:
            seen |= front
        longest = max(longest, len(seen) - 1)
    names = {p: sorted(reach) for p, reach in near.items()}
    one = present.select(*keys, "predicate").distinct()
    if not names:
        return one.withColumn("clique", F.col("predicate"))
    around = F.create_map(*[x for p, others in sorted(names.items()) for x in (F.lit(p), F.array(*[F.lit(o) for o in others]))])
    # all predicates of a key, at most the catalog's, and their labels after enough rounds
    group = one.groupBy(*keys).agg(F.array_sort(F.collect_set("predicate")).alias("all"))

    def spread(labels):
        least = lambda p: F.array_min(F.concat(F.array(labels[p]), F.transform(F.filter(F.coalesce(F.try_element_at(around, p), F.array().cast("array<string>")), lambda o: F.map_contains_key(labels, o)), lambda o: labels[o])))
        return F.transform_values(labels, lambda p, _: least(p))

    labels = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, longest))), F.map_from_arrays("all", "all"), lambda acc, _: spread(acc))
    return group.select(*keys, F.explode(labels).alias("predicate", "clique"))


def direction_strength(claims: DataFrame, keys: list[str]) -> DataFrame:
    """How strong each directed claim is: best confidence, then distinct evidence, then least id."""
    return claims.groupBy(*keys).agg(F.max("confidence").alias("best"), F.sum("n_evidence").alias("support"), F.min("claim_id").alias("least_id"))


def drop_weaker_direction(claims: DataFrame) -> DataFrame:
    """Where a relation is claimed both ways, the claims of the stronger way."""
    keys = ["subject", "object", "predicate"]
    strength = direction_strength(claims.where("subject <> object"), keys)
    back = strength.select(F.col("subject").alias("object"), F.col("object").alias("subject"), "predicate", F.struct((-F.col("best")).alias("b"), (-F.col("support")).alias("s"), "least_id").alias("theirs"))
    mine = F.struct((-F.col("best")).alias("b"), (-F.col("support")).alias("s"), "least_id")
    losers = strength.join(back, keys).where(mine > F.col("theirs")).select(*keys)
    return claims.join(losers, keys, "left_anti")


def type_gate(claims: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """claims with reason: null, or why the relation can't stand (itself, or an end of the wrong type)."""
    ends = entities.select(F.col("entity").alias("subject"), F.col("type").alias("st"))
    others = entities.select(F.col("entity").alias("object"), F.col("type").alias("ot"))
    c = claims.join(ends, "subject", "left").join(others, "object", "left").join(predicates.select("predicate", "subject_type", "object_type"), "predicate", "left")
    wrong = lambda want, is_: F.col(want).isNotNull() & (F.coalesce(F.col(is_), F.lit("")) != F.col(want))
    reason = F.when(F.col("subject") == F.col("object"), "self_relation").when(wrong("object_type", "ot"), "object_type").when(wrong("subject_type", "st"), "subject_type")
    return c.withColumn("reason", reason).drop("st", "ot", "subject_type", "object_type")


def arbitrate_relations(claims: DataFrame, keys: list[str]) -> DataFrame:
    """One predicate for each pair, clique and period: confidence, then id."""
    order = Window.partitionBy(*keys, "vol").orderBy(F.desc("confidence"), "claim_id")
    return claims.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


def relation_intervals(claims: DataFrame) -> DataFrame:
    """Exclusive relations of a directed pair as intervals, the predicate being the value."""
    best = arbitrate_relations(claims, ["subject", "object"]).withColumn("claim_ids", F.array("claim_id"))
    return supersede(best, ["subject", "object"], value="predicate", norm=F.col("predicate"))


def drop_contradicted(edges: DataFrame, states: DataFrame, implied: dict[str, str]) -> DataFrame:
    """Edges whose predicate implies a state of its object that the object's state at its start contradicts."""
    value = F.create_map(*[F.lit(x) for k, v in implied.items() for x in (k, v)])
    s = states.select(F.col("subject").alias("object"), F.col("value").alias("state"), F.col("vol_start").alias("from_"), F.col("vol_end").alias("to_"))
    keys = ["interval_id", "subject", "object", "predicate", "vol_start"]  # the id alone is 32 bits of a hash
    e = edges.withColumn("implies", F.try_element_at(value, F.col("predicate")))
    hit = e.where("implies is not null").join(s, "object").where("from_ <= vol_start and (to_ is null or to_ >= vol_start) and state <> implies").select(*keys).distinct()
    return edges.join(hit, keys, "left_anti")


def subsume(values: DataFrame, keys: list[str]) -> DataFrame:
    """values(keys, value): without those whose words all lie in a longer sibling."""
    v = values.select(*keys, "value", F.array_distinct(F.split(F.lower("value"), " ")).alias("words"))
    longer = v.select(*keys, F.col("words").alias("w2"), F.col("value").alias("v2"))
    inside = v.join(longer, keys).where((F.size(F.array_except("words", "w2")) == 0) & (F.size("w2") > F.size("words"))).select(*keys, "value").distinct()
    return v.select(*keys, "value").join(inside, [*keys, "value"], "left_anti")


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, alpha: float = 0.85, every: int = 5) -> DataFrame:
    """Personalised PageRank over undirected weighted edges(a, b, w) from seeds(node): (node, score).

    rounds of power iteration from the uniform start; a node without edges
    keeps giving its mass to the seeds.  The lineage is cut every few rounds.
    """
    from tessera.operators.lineage import cut

    both = edges.select("a", "b", "w").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = both.groupBy("a", "b").agg(F.sum("w").alias("w"))
    share = cut(both.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("a"))).select("a", "b", "p"))
    nodes = share.select(F.col("a").alias("node")).distinct()
    nodes = nodes.join(seeds.select("node").distinct().withColumn("seed", F.lit(1)), "node", "left")
    totals = nodes.agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("k")).first()
    if not totals["n"] or not totals["k"]:
        return nodes.select("node", F.lit(0.0).alias("score"))
    jump = F.when(F.col("seed") == 1, F.lit((1 - alpha) / totals["k"])).otherwise(0.0)
    nodes = cut(nodes.select("node", jump.alias("jump")))
    rank = nodes.select("node", F.lit(1.0 / totals["n"]).alias("score"))
    for i in range(rounds):
        flow = share.join(rank, share["a"] == rank["node"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("flow"))
        rank = nodes.join(flow, "node", "left").select("node", (F.col("jump") + alpha * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if i % every == every - 1:
            rank = cut(rank)
    return rank


def build(claims: DataFrame, predicates: DataFrame, decisions: DataFrame | None = None, gap: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """The graph of relation claims: (intervals, log of what was settled).

    Ends in canonical order, chains of conflicting predicates as one slot, one
    predicate a slot and period (a decision of (subject, object, clique, vol,
    kept) for leads below the gap, else confidence and id), then supersession
    along the slot.
    """
    keys = ["subject", "object", "clique"]
    c = canonical_direction(claims, predicates).where("subject <> object")
    slots = cliques(c, conflict_groups(predicates), ["subject", "object"])
    c = c.join(slots, ["subject", "object", "predicate"])
    # what is claimed again in one period is one candidate: best confidence, all ids
    c = c.groupBy(*keys, "predicate", "vol").agg(F.max("confidence").alias("confidence"), F.min("claim_id").alias("first_id"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
    order = Window.partitionBy(*keys, "vol").orderBy(F.desc("confidence"), "first_id")
    c = c.withColumn("place", F.row_number().over(order)).withColumn("lead_by", F.round(F.first("confidence").over(order) - F.lead("confidence").over(order), 6))
    c = c.withColumn("close", F.coalesce(F.max(F.when(F.col("place") == 1, F.col("lead_by"))).over(Window.partitionBy(*keys, "vol")) < gap, F.lit(False)))
    if decisions is not None:
        c = c.join(decisions, [*keys, "vol"], "left")
        named = F.max(F.coalesce(F.col("close") & (F.col("kept") == F.col("predicate")), F.lit(False))).over(Window.partitionBy(*keys, "vol"))
        wins = F.when(named, F.col("kept") == F.col("predicate")).otherwise(F.col("place") == 1)
        c = c.withColumn("how", F.when(named, "decision").when(F.col("close"), "rule:higher_confidence_fallback").otherwise("rule:higher_confidence"))
    else:
        wins = F.col("place") == 1
        c = c.withColumn("how", F.when(F.col("close"), "rule:higher_confidence_fallback").otherwise("rule:higher_confidence"))
    c = c.withColumn("wins", wins).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "vol")))
    log = c.where("n > 1 and not wins").select(*keys, "vol", F.col("predicate").alias("dropped"), "how")
    intervals = supersede(c.where("wins").select(*keys, "predicate", "vol", "confidence", "claim_ids"), keys, "predicate", F.col("predicate"))
    return intervals, log
