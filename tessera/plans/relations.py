"""Relations between nations: canonical, gated, arbitrated, as of a cutoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import asof, relations
from tessera.plans.core import INTERVALS, built, flat
from tessera.plans.registry import query
from tessera.sources.tables import RELATIONS, relation_claims

CATALOG = [
    ("TRADES_WITH", True, None, ["OPPOSES"], False, None, None),
    ("OPPOSES", True, None, ["TRADES_WITH"], False, None, None),
    ("SUPPLIES", False, "BUYS_FROM", [], True, None, None),
    ("BUYS_FROM", False, "SUPPLIES", ["SUPPLIES"], True, None, None),
]

REL_INTERVALS = f"""{RELATIONS}, rbest AS (SELECT *, row_number() OVER (PARTITION BY subject, object, vol ORDER BY confidence DESC, claim_id) AS rn FROM rel),
  rflag AS (SELECT *, CASE WHEN lag(predicate) OVER w IS NOT DISTINCT FROM predicate THEN 0 ELSE 1 END AS fresh FROM rbest WHERE rn = 1 WINDOW w AS (PARTITION BY subject, object ORDER BY vol)),
  risl AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, object ORDER BY vol) AS island FROM rflag),
  rmerged AS (SELECT subject, object, island, min(predicate) AS predicate, min(vol) AS vol_start, max(confidence) AS confidence, list_sort(list(claim_id)) AS claim_ids FROM risl GROUP BY ALL),
  rnamed AS (SELECT *, 'i_' || substr(sha1(subject || '|' || object || '|' || predicate || '|' || vol_start), 1, 8) AS interval_id FROM rmerged),
  riv AS (SELECT *, lead(vol_start) OVER w - 1 AS vol_end, lead(interval_id) OVER w AS superseded_by FROM rnamed WINDOW w AS (PARTITION BY subject, object ORDER BY island))"""
NOW = "vol_start <= 4 AND (vol_end IS NULL OR vol_end >= 4)"


def edges(spark, sf):
    return relations.relation_intervals(relation_claims(spark, sf))


def predicates(spark):
    return relations.catalog(spark, CATALOG)


def supply(spark, sf):
    """Directed claims: a supplies b for TRADES_WITH, buys from b for OPPOSES."""
    c = relation_claims(spark, sf)
    return c.withColumn("predicate", F.when(F.col("predicate") == "TRADES_WITH", "SUPPLIES").otherwise("BUYS_FROM"))


@query("rel_claims", f"WITH {RELATIONS} SELECT * FROM rel")
def _(spark, sf):
    return relation_claims(spark, sf)


@query("rel_canonical_symmetric", f"WITH {RELATIONS} SELECT least(subject, object) AS subject, greatest(subject, object) AS object, predicate, vol, claim_id FROM rel")
def _(spark, sf):
    return relations.canonical_direction(relation_claims(spark, sf), predicates(spark)).select("subject", "object", "predicate", "vol", "claim_id")


@query("rel_canonical_inverse", f"WITH {RELATIONS} SELECT CASE WHEN predicate = 'TRADES_WITH' THEN object ELSE subject END AS subject, CASE WHEN predicate = 'TRADES_WITH' THEN subject ELSE object END AS object, 'BUYS_FROM' AS predicate, claim_id FROM rel")
def _(spark, sf):
    return relations.canonical_direction(supply(spark, sf), predicates(spark)).select("subject", "object", "predicate", "claim_id")


@query("rel_conflict_groups", "SELECT * FROM (VALUES ('TRADES_WITH', 'OPPOSES'), ('OPPOSES', 'TRADES_WITH')) AS t(predicate, other)")
def _(spark, sf):
    return relations.conflict_groups(predicates(spark))


@query("rel_conflict_cliques", f"""WITH {RELATIONS}, p AS (SELECT DISTINCT subject, object, predicate FROM rel UNION SELECT DISTINCT subject, object, 'SUPPLIES' FROM rel WHERE vol = 2)
SELECT subject, object, predicate, CASE WHEN predicate = 'SUPPLIES' THEN predicate ELSE min(predicate) FILTER (predicate <> 'SUPPLIES') OVER (PARTITION BY subject, object) END AS clique FROM p""")
def _(spark, sf):
    c = relation_claims(spark, sf)
    present = c.select("subject", "object", "predicate").unionAll(c.where("vol = 2").select("subject", "object", F.lit("SUPPLIES").alias("predicate")))
    return relations.cliques(present, relations.conflict_groups(predicates(spark)), ["subject", "object"])


@query("rel_direction_strength", f"WITH {RELATIONS} SELECT subject, object, predicate, max(confidence) AS best, sum(n_evidence)::BIGINT AS support, min(claim_id) AS least_id FROM rel GROUP BY ALL")
def _(spark, sf):
    return relations.direction_strength(relation_claims(spark, sf), ["subject", "object", "predicate"])


@query("rel_mutual_strip", f"""WITH {RELATIONS}, s AS (SELECT subject, object, predicate, max(confidence) AS best, sum(n_evidence) AS support, min(claim_id) AS id FROM rel WHERE subject <> object GROUP BY ALL),
  losers AS (SELECT a.subject, a.object, a.predicate FROM s a JOIN s b ON a.subject = b.object AND a.object = b.subject AND a.predicate = b.predicate WHERE (-a.best, -a.support, a.id) > (-b.best, -b.support, b.id))
SELECT claim_id, subject, object, predicate, vol FROM rel WHERE (subject, object, predicate) NOT IN (SELECT (subject, object, predicate) FROM losers)""")
def _(spark, sf):
    return relations.drop_weaker_direction(relation_claims(spark, sf)).select("claim_id", "subject", "object", "predicate", "vol")


@query("rel_type_gate", f"""WITH {RELATIONS}, t AS (SELECT n_name AS entity, r_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT claim_id, CASE WHEN subject = object THEN 'self_relation' WHEN predicate = 'OPPOSES' AND o.type <> 'EUROPE' THEN 'object_type' WHEN predicate = 'OPPOSES' AND s.type <> 'ASIA' THEN 'subject_type' END AS reason
FROM rel LEFT JOIN t s ON s.entity = subject LEFT JOIN t o ON o.entity = object""")
def _(spark, sf):
    nation, region = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    entities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("type"))
    rows = relations.catalog(spark, [("OPPOSES", True, None, [], False, "ASIA", "EUROPE")])
    return relations.type_gate(relation_claims(spark, sf), entities, rows).select("claim_id", "reason")


@query("rel_arbitrate", f"WITH {RELATIONS} SELECT claim_id, subject, object, vol, predicate FROM rel QUALIFY row_number() OVER (PARTITION BY subject, object, vol ORDER BY confidence DESC, claim_id) = 1")
def _(spark, sf):
    return relations.arbitrate_relations(relation_claims(spark, sf), ["subject", "object"]).select("claim_id", "subject", "object", "vol", "predicate")


@query("rel_supersession", f"WITH {REL_INTERVALS} SELECT interval_id, subject, object, predicate, vol_start, vol_end, superseded_by, confidence, array_to_string(claim_ids, '|') AS claim_ids FROM riv")
def _(spark, sf):
    return flat(edges(spark, sf).select("interval_id", "subject", "object", "predicate", "vol_start", "vol_end", "superseded_by", "confidence", "claim_ids"))


@query("rel_relations_at", f"WITH {REL_INTERVALS} SELECT interval_id, subject, object, predicate FROM riv WHERE {NOW} AND (subject = 'NATION_3' OR object = 'NATION_3')")
def _(spark, sf):
    return asof.relations_at(edges(spark, sf), "NATION_3", 4).select("interval_id", "subject", "object", "predicate")


@query("rel_history_at", f"WITH {REL_INTERVALS} SELECT interval_id, subject, object, predicate, vol_end FROM riv WHERE vol_start <= 4 AND vol_end < 4 AND (subject = 'NATION_3' OR object = 'NATION_3')")
def _(spark, sf):
    return asof.relation_history_at(edges(spark, sf), "NATION_3", 4).select("interval_id", "subject", "object", "predicate", "vol_end")


@query("rel_of_each_at", f"WITH {REL_INTERVALS} SELECT n_name AS node, interval_id FROM riv JOIN nation ON n_name = subject OR n_name = object WHERE {NOW}")
def _(spark, sf):
    nodes = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("node"))
    return asof.relations_of_each_at(edges(spark, sf), nodes, 4).select("node", "interval_id")


@query("rel_between", f"WITH {REL_INTERVALS} SELECT interval_id, subject, object, predicate FROM riv WHERE {NOW} AND subject IN ('NATION_3', 'NATION_7') AND object IN ('NATION_3', 'NATION_7') AND subject <> object")
def _(spark, sf):
    return asof.relations_between(edges(spark, sf), "NATION_7", "NATION_3", 4).select("interval_id", "subject", "object", "predicate")


@query("rel_history_between", f"WITH {REL_INTERVALS} SELECT least(subject, object) AS a, greatest(subject, object) AS b, count(*) AS n FROM riv WHERE vol_start <= 6 AND vol_end < 6 GROUP BY ALL")
def _(spark, sf):
    closed = asof.history_at(edges(spark, sf), 6)
    return closed.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("rel_all_edges_at", f"WITH {REL_INTERVALS} SELECT subject, object, predicate, vol_start FROM riv WHERE {NOW}")
def _(spark, sf):
    return asof.state_at(edges(spark, sf), 4).select("subject", "object", "predicate", "vol_start")


@query("rel_oriented_entries", f"""WITH {REL_INTERVALS}, e AS (SELECT n_name AS node, CASE WHEN subject = n_name THEN object ELSE subject END AS other, predicate, subject = n_name OR predicate = 'TRADES_WITH' AS forward, vol_start FROM riv JOIN nation ON n_name = subject OR n_name = object WHERE {NOW} AND subject <> object)
SELECT node, other, min(vol_start) AS since, bool_or(predicate = 'OPPOSES') AS adversary, count(*) FILTER (forward) AS forward FROM e GROUP BY ALL""")
def _(spark, sf):
    nodes = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("node"))
    rows = asof.relations_of_each_at(edges(spark, sf).where("subject <> object"), nodes, 4)
    forward = (F.col("subject") == F.col("node")) | (F.col("predicate") == "TRADES_WITH")
    other = F.when(F.col("subject") == F.col("node"), F.col("object")).otherwise(F.col("subject"))
    return rows.groupBy("node", other.alias("other")).agg(F.min("vol_start").alias("since"), F.bool_or(F.col("predicate") == "OPPOSES").alias("adversary"), F.count_if(forward).alias("forward"))


@query("rel_members_minus_adversaries", f"""WITH {REL_INTERVALS}, now AS (SELECT * FROM riv WHERE {NOW} AND subject <> object), m AS (SELECT subject, object FROM now WHERE predicate = 'TRADES_WITH' EXCEPT SELECT object, subject FROM now WHERE predicate = 'OPPOSES')
SELECT subject, count(*) AS members FROM m GROUP BY ALL""")
def _(spark, sf):
    now = asof.state_at(edges(spark, sf), 4).where("subject <> object")
    members = now.where("predicate = 'TRADES_WITH'").select("subject", "object").distinct()
    adversaries = now.where("predicate = 'OPPOSES'").select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    return members.join(adversaries, ["subject", "object"], "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("members"))


@query("rel_status_strip", f"""WITH {REL_INTERVALS}, st AS (SELECT n_name AS object, CASE WHEN n_nationkey % 2 = 0 THEN 'open' ELSE 'closed' END AS state, 2 AS f, 5 AS t FROM nation)
SELECT interval_id FROM riv WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.object = riv.object AND riv.predicate = 'TRADES_WITH' AND f <= vol_start AND t >= vol_start AND state <> 'open')""")
def _(spark, sf):
    states = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("subject"), F.when(F.col("n_nationkey") % 2 == 0, "open").otherwise("closed").alias("value"), F.lit(2).alias("vol_start"), F.lit(5).alias("vol_end"))
    return relations.drop_contradicted(edges(spark, sf), states, {"TRADES_WITH": "open"}).select("interval_id")


@query("rel_pairs", f"WITH {RELATIONS} SELECT least(subject, object) AS a, greatest(subject, object) AS b, min(vol) AS first_vol, count(DISTINCT predicate) AS kinds FROM rel WHERE subject <> object GROUP BY ALL")
def _(spark, sf):
    c = relation_claims(spark, sf).where("subject <> object")
    return c.groupBy(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).agg(F.min("vol").alias("first_vol"), F.countDistinct("predicate").alias("kinds"))


@query("value_subsume", """WITH v AS (SELECT DISTINCT p_brand AS k, p_type AS value, list_distinct(string_split(lower(p_type), ' ')) AS w FROM part UNION SELECT DISTINCT p_brand, split_part(p_type, ' ', 1), [lower(split_part(p_type, ' ', 1))] FROM part)
SELECT k, value FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.k = a.k AND list_has_all(b.w, a.w) AND len(b.w) > len(a.w))""")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    values = part.select(F.col("p_brand").alias("k"), F.col("p_type").alias("value")).union(part.select("p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)))).distinct()
    return relations.subsume(values, ["k"])


PPR = f"""WITH RECURSIVE {RELATIONS}, e AS (SELECT subject AS a, object AS b, count(*)::DOUBLE AS w FROM rel GROUP BY ALL),
  u AS (SELECT a, b, sum(w) AS w FROM (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e WHERE a <> b) GROUP BY a, b),
  p AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM u), n AS (SELECT DISTINCT a AS node FROM p), k AS (SELECT node, CASE WHEN node = 'NATION_3' THEN 0.15 ELSE 0 END::DOUBLE AS jump, (SELECT count(*) FROM n) AS n FROM n),
  r AS (SELECT 0 AS i, list({{'node': node, 's': 1.0::DOUBLE / n}}) AS ranks FROM k
    UNION ALL SELECT i + 1, (SELECT list({{'node': node, 's': jump + 0.85::DOUBLE * coalesce(f, 0)}}) FROM k LEFT JOIN (SELECT b, sum(p * x.r.s) AS f FROM (SELECT unnest(r.ranks) AS r) x JOIN p ON p.a = x.r.node GROUP BY b) g ON g.b = k.node) FROM r WHERE i < 10)
SELECT x.node, round(x.s, 9) AS score FROM (SELECT unnest(ranks) AS x FROM r WHERE i = 10)"""


@query("graph_ppr_k10", PPR)
def _(spark, sf):
    e = relation_claims(spark, sf).groupBy(F.col("subject").alias("a"), F.col("object").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    seeds = spark.read.parquet(f"{sf}/nation.parquet").where("n_name = 'NATION_3'").select(F.col("n_name").alias("node"))
    return relations.pagerank(e, seeds, rounds=10).select("node", F.round("score", 9).alias("score"))


@query("graph_ppr_topk", f"SELECT node, score FROM ({PPR}) WHERE node <> 'NATION_3' ORDER BY score DESC, node LIMIT 5")
def _(spark, sf):
    e = relation_claims(spark, sf).groupBy(F.col("subject").alias("a"), F.col("object").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    seeds = spark.read.parquet(f"{sf}/nation.parquet").where("n_name = 'NATION_3'").select(F.col("n_name").alias("node"))
    return relations.pagerank(e, seeds, rounds=10).where("node <> 'NATION_3'").select("node", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(5)


@query("rel_mentions_unshown", f"""WITH {REL_INTERVALS}, shown AS (SELECT object AS n FROM riv WHERE {NOW} AND predicate = 'OPPOSES' AND subject = 'NATION_3' UNION SELECT subject FROM riv WHERE {NOW} AND predicate = 'OPPOSES' AND object = 'NATION_3')
SELECT n_name FROM nation WHERE n_name NOT IN (SELECT n FROM shown) AND n_name <> 'NATION_3'""")
def _(spark, sf):
    # a page of opponents
    now = asof.relations_at(edges(spark, sf), "NATION_3", 4)
    shown = now.where("predicate = 'OPPOSES'").select(F.explode(F.array("subject", "object")).alias("n_name"))
    return spark.read.parquet(f"{sf}/nation.parquet").where("n_name <> 'NATION_3'").select("n_name").join(shown, "n_name", "left_anti")


@query("rel_state_hash_changes", f"""WITH {RELATIONS}, h AS (SELECT subject, object, vol, sha256(string_agg(predicate, '|' ORDER BY predicate)) AS state FROM rel GROUP BY ALL), x AS (SELECT *, lag(state) OVER (PARTITION BY subject, object ORDER BY vol) AS before FROM h)
SELECT subject, object, vol, state FROM x WHERE before IS DISTINCT FROM state""")
def _(spark, sf):
    pages = relation_claims(spark, sf).groupBy("subject", "object", "vol").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("predicate")), "|"), 256).alias("state"))
    return asof.changes_only(pages, ["subject", "object"], "state")


@query("rel_state_of_subject_join", f"WITH {INTERVALS}, n AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, value, count(*) AS n FROM iv JOIN n ON subject = c_custkey WHERE {NOW} GROUP BY ALL")
def _(spark, sf):
    customer, nation = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "nation"))
    names = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("subject"), "n_name")
    return asof.state_at(built(spark, sf), 4).join(names, "subject").groupBy("n_name", "value").agg(F.count(F.lit(1)).alias("n"))
