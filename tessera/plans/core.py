"""Claims to intervals, and the readers as of a cutoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import short_hash
from tessera.operators import asof, intervals
from tessera.plans.registry import query
from tessera.sources.tables import CLAIMS, PRIORITIES, priority_claims, status_claims

COLLAPSED = f"""{CLAIMS}, col AS (SELECT subject, predicate, vol, lower(trim(value)) AS norm, arg_min(value, (-confidence, claim_id)) AS value,
    arg_min(claim_id, (-confidence, claim_id)) AS claim_id, max(confidence) AS confidence, list(claim_id ORDER BY claim_id) AS claim_ids FROM claims GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY subject, predicate, vol) AS n_values FROM col
    WINDOW w AS (PARTITION BY subject, predicate, vol ORDER BY confidence DESC, claim_id)),
  best AS (SELECT * FROM ranked WHERE place = 1)"""
INTERVALS = f"""{COLLAPSED}, flagged AS (SELECT *, CASE WHEN lag(norm) OVER w IS NOT DISTINCT FROM norm THEN 0 ELSE 1 END AS fresh FROM best WINDOW w AS (PARTITION BY subject, predicate ORDER BY vol)),
  isl AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, predicate ORDER BY vol) AS island FROM flagged),
  merged AS (SELECT subject, predicate, island, arg_min(value, vol) AS value, min(vol) AS vol_start, max(confidence) AS confidence, list_sort(flatten(list(claim_ids))) AS claim_ids FROM isl GROUP BY ALL),
  named AS (SELECT *, 'i_' || substr(sha1(subject || '|' || predicate || '|' || value || '|' || vol_start), 1, 8) AS interval_id FROM merged),
  iv AS (SELECT *, lead(vol_start) OVER w - 1 AS vol_end, lead(interval_id) OVER w AS superseded_by, len(claim_ids) AS evidence_count FROM named WINDOW w AS (PARTITION BY subject, predicate ORDER BY island))"""


def built(spark, sf_dir):
    return intervals.single_valued_intervals(status_claims(spark, sf_dir))


def flat(df):
    """Array columns as text, so that results compare by value."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|") for c, t in df.dtypes if t.startswith("array")})


@query("interval_same_value_collapse", f"WITH {COLLAPSED} SELECT * REPLACE (array_to_string(claim_ids, '|') AS claim_ids) FROM col")
def _(spark, sf):
    return flat(intervals.collapse_same_value(status_claims(spark, sf)))


@query("interval_rank_same_period", f"WITH {COLLAPSED} SELECT subject, vol, value, place, n_values FROM ranked")
def _(spark, sf):
    return intervals.ranked_values(status_claims(spark, sf)).select("subject", "vol", "value", "place", "n_values")


@query("interval_same_period_conflicts", f"""WITH {COLLAPSED}, c AS (SELECT subject, predicate, vol, max(value) FILTER (place = 1) AS kept, max(value) FILTER (place = 2) AS dropped,
  max(confidence) FILTER (place = 1) AS kept_confidence, max(confidence) FILTER (place = 2) AS dropped_confidence, count(*) FILTER (place > 2) AS outliers FROM ranked WHERE n_values > 1 GROUP BY ALL)
SELECT *, CASE WHEN round(kept_confidence - dropped_confidence, 6) >= 0.1 THEN 'rule:higher_confidence' ELSE 'rule:higher_confidence_fallback' END AS resolution FROM c""")
def _(spark, sf):
    return intervals.same_period_conflicts(status_claims(spark, sf))


@query("interval_conflict_summary", f"""WITH {COLLAPSED}, c AS (SELECT subject, vol, round(max(confidence) FILTER (place = 1) - max(confidence) FILTER (place = 2), 6) AS gap FROM ranked WHERE n_values > 1 GROUP BY ALL)
SELECT CASE WHEN gap >= 0.1 THEN 'rule:higher_confidence' ELSE 'rule:higher_confidence_fallback' END AS resolution, count(*) AS n FROM c GROUP BY ALL""")
def _(spark, sf):
    return intervals.same_period_conflicts(status_claims(spark, sf)).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


@query("interval_supersede_single", f"WITH {INTERVALS} SELECT interval_id, subject, predicate, value, vol_start, vol_end, superseded_by, confidence, evidence_count, array_to_string(claim_ids, '|') AS claim_ids FROM iv")
def _(spark, sf):
    return flat(built(spark, sf).select("interval_id", "subject", "predicate", "value", "vol_start", "vol_end", "superseded_by", "confidence", "evidence_count", "claim_ids"))


@query("interval_narrative_changes", f"""WITH {COLLAPSED}, x AS (SELECT *, lag(norm) OVER w AS nb, lag(value) OVER w AS before, lag(vol) OVER w AS vol_before FROM best WINDOW w AS (PARTITION BY subject, predicate ORDER BY vol))
SELECT subject, predicate, vol_before, before, vol, value AS after FROM x WHERE nb <> norm""")
def _(spark, sf):
    return intervals.narrative_changes(status_claims(spark, sf))


@query("interval_multi_bucket", f"""WITH {PRIORITIES}, b AS (SELECT subject, predicate, lower(trim(value)) AS norm, arg_min(value, (vol, claim_id)) AS value, min(vol) AS vol_start, max(confidence) AS confidence, count(*) AS evidence_count,
  min((vol, claim_id, qualifier)) FILTER (qualifier <> '') AS q, string_agg(claim_id, '|' ORDER BY claim_id) AS claim_ids FROM prio GROUP BY ALL)
SELECT subject, predicate, norm, value, vol_start, confidence, evidence_count, claim_ids, CASE WHEN q[1] = vol_start THEN q[3] END AS qualifier,
  'i_' || substr(sha1(subject || '|' || predicate || '|' || norm || '|' || vol_start), 1, 8) AS interval_id, NULL::INT AS vol_end FROM b""".replace("q[1]", "struct_extract_at(q, 1)").replace("q[3]", "struct_extract_at(q, 3)"))
def _(spark, sf):
    return flat(intervals.multi_valued_intervals(priority_claims(spark, sf)))


@query("asof_state_at", f"WITH {INTERVALS} SELECT interval_id, subject, predicate, value, vol_start, NULL::INT AS vol_end, confidence, evidence_count FROM iv WHERE vol_start <= 4 AND (vol_end IS NULL OR vol_end >= 4)")
def _(spark, sf):
    return asof.state_at(built(spark, sf), 4).select("interval_id", "subject", "predicate", "value", "vol_start", "vol_end", "confidence", "evidence_count")


@query("asof_history_at", f"WITH {INTERVALS} SELECT interval_id, subject, value, vol_start, vol_end FROM iv WHERE vol_start <= 4 AND vol_end < 4")
def _(spark, sf):
    return asof.history_at(built(spark, sf), 4).select("interval_id", "subject", "value", "vol_start", "vol_end")


@query("asof_state_at_each_cutoff", f"WITH {INTERVALS} SELECT c AS cutoff, value, count(*) AS n FROM iv JOIN range(1, 8) r(c) ON vol_start <= c AND (vol_end IS NULL OR vol_end >= c) GROUP BY ALL")
def _(spark, sf):
    return asof.state_at_each(built(spark, sf), list(range(1, 8))).groupBy(F.col("cutoff").cast("long").alias("cutoff"), "value").agg(F.count(F.lit(1)).alias("n"))


@query("asof_future_intervals", f"WITH {INTERVALS} SELECT interval_id, subject, value, vol_start FROM iv WHERE vol_start > 4")
def _(spark, sf):
    return asof.future_of(built(spark, sf), 4).select("interval_id", "subject", "value", "vol_start")


@query("asof_future_claims", f"WITH {CLAIMS} SELECT claim_id, subject, value, vol FROM claims WHERE vol > 5")
def _(spark, sf):
    return asof.future_of(status_claims(spark, sf), 5, "vol").select("claim_id", "subject", "value", "vol")


@query("asof_evidence_at", f"""WITH {INTERVALS}, ids AS (SELECT interval_id, unnest(claim_ids) AS claim_id, unnest(range(len(claim_ids))) AS place FROM iv)
SELECT interval_id, place, ids.claim_id, l_linenumber AS quote, (year(l_shipdate) - 1994)::INT AS vol FROM ids JOIN lineitem ON l_orderkey = claim_id WHERE year(l_shipdate) - 1994 <= 3""")
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    claims = line.groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_list(F.struct((F.year("l_shipdate") - 1994).alias("vol"), F.col("l_linenumber").alias("line")))).alias("evidence"))
    return asof.evidence_at(built(spark, sf), claims, 3).select("interval_id", "place", "claim_id", F.col("quote.line").alias("quote"), F.col("quote.vol").alias("vol"))


@query("asof_polarity_at", f"""WITH {CLAIMS} SELECT subject, value, arg_max(CASE WHEN claim_id % 7 = 0 THEN 'denied' WHEN claim_id % 11 = 0 THEN 'presumed' ELSE 'asserted' END, (vol, claim_id)) AS polarity FROM claims WHERE vol <= 4 GROUP BY ALL""")
def _(spark, sf):
    claims = status_claims(spark, sf).withColumn("polarity", F.when(F.col("claim_id") % 7 == 0, "denied").when(F.col("claim_id") % 11 == 0, "presumed").otherwise("asserted"))
    return asof.polarity_at(claims, ["subject", "value"], 4)


@query("asof_latest_document", f"WITH {COLLAPSED} SELECT subject, arg_max(value, vol) AS value, max(vol) AS vol FROM best WHERE vol <= 4 GROUP BY ALL")
def _(spark, sf):
    return asof.latest_at(intervals.arbitrate(status_claims(spark, sf)), ["subject"], 4, "value")


@query("asof_changes_only", f"""WITH {COLLAPSED}, h AS (SELECT subject, vol, sha256(value) AS state FROM best), x AS (SELECT *, lag(state) OVER (PARTITION BY subject ORDER BY vol) AS before FROM h)
SELECT subject, vol, state FROM x WHERE before IS DISTINCT FROM state""")
def _(spark, sf):
    pages = intervals.arbitrate(status_claims(spark, sf)).select("subject", "vol", F.sha2("value", 256).alias("state"))
    return asof.changes_only(pages, ["subject"], "state")


@query("asof_unjudged_state", f"WITH {INTERVALS} SELECT interval_id, subject, value FROM iv WHERE vol_start <= 4 AND (vol_end IS NULL OR vol_end >= 4) AND NOT (subject % 5 = 0 AND confidence < 0.5)")
def _(spark, sf):
    rows = built(spark, sf)
    verdicts = rows.select("interval_id", "subject", "predicate", "vol_start", F.when((F.col("subject") % 5 == 0) & (F.col("confidence") < 0.5), "unsupported").otherwise("supported").alias("verdict"))
    return asof.judged(asof.state_at(rows, 4), verdicts).select("interval_id", "subject", "value")


@query("asof_visible_ids_hash", f"""WITH {INTERVALS} SELECT subject, sha256(string_agg(DISTINCT interval_id, '|' ORDER BY interval_id)) AS state, count(DISTINCT interval_id) AS n FROM iv WHERE vol_start <= 4 GROUP BY ALL""")
def _(spark, sf):
    rows = built(spark, sf)
    seen = asof.state_at(rows, 4).select("subject", "interval_id").unionAll(asof.history_at(rows, 4).select("subject", "interval_id")).distinct()
    ids = F.array_sort(F.collect_set("interval_id"))
    return seen.groupBy("subject").agg(F.sha2(F.array_join(ids, "|"), 256).alias("state"), F.count(F.lit(1)).alias("n"))


@query("asof_min_evidence", f"WITH {INTERVALS} SELECT subject, count(DISTINCT interval_id) AS n FROM iv WHERE vol_start <= 4 GROUP BY ALL HAVING count(DISTINCT interval_id) >= 3")
def _(spark, sf):
    return built(spark, sf).where("vol_start <= 4").groupBy("subject").agg(F.countDistinct("interval_id").alias("n")).where("n >= 3")


@query("claim_ids", f"WITH {CLAIMS} SELECT claim_id, 'c_' || substr(sha1(subject || '|' || predicate || '|' || lower(value) || '|' || vol || '|asserted|'), 1, 8) AS content_id FROM claims")
def _(spark, sf):
    c = status_claims(spark, sf)
    return c.select("claim_id", short_hash("c_", F.col("subject"), F.col("predicate"), F.lower("value"), F.col("vol"), F.lit("asserted"), F.lit(None)).alias("content_id"))


@query("claim_merge_by_id", f"""WITH {CLAIMS} SELECT subject, value, max(confidence) AS confidence, min(vol) AS first_vol, string_agg(evidence, '|' ORDER BY v, evidence) AS evidence FROM (
  SELECT subject, value, max(confidence) AS confidence, min(vol) AS vol, min(vol) AS v, (claim_id % 10)::VARCHAR AS evidence FROM claims GROUP BY subject, value, claim_id % 10) GROUP BY subject, value""")
def _(spark, sf):
    claims = status_claims(spark, sf).withColumn("evidence", (F.col("claim_id") % 10).cast("string"))
    return flat(intervals.merge_claims(claims, ["subject", "value"]))


@query("claim_union_of_producers", f"WITH {CLAIMS}, {PRIORITIES} SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects FROM (SELECT subject, predicate FROM claims UNION ALL SELECT subject, predicate FROM prio) GROUP BY ALL")
def _(spark, sf):
    both = status_claims(spark, sf).unionByName(priority_claims(spark, sf), allowMissingColumns=True)
    return both.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"))


@query("claim_partial_recompute", f"WITH {CLAIMS} SELECT claim_id, subject, CASE WHEN vol = 3 THEN 'fresh' ELSE 'kept' END AS origin FROM claims WHERE vol = 3 OR subject NOT IN (SELECT subject FROM claims WHERE vol = 3)")
def _(spark, sf):
    old = status_claims(spark, sf)
    fresh = old.where("vol = 3")
    kept = old.join(fresh.select("subject").distinct(), "subject", "left_anti")
    return kept.select("claim_id", "subject", F.lit("kept").alias("origin")).unionByName(fresh.select("claim_id", "subject", F.lit("fresh").alias("origin")))


@query("store_upsert_latest", f"WITH {CLAIMS} SELECT subject, vol, claim_id, value FROM claims QUALIFY row_number() OVER (PARTITION BY subject, vol ORDER BY claim_id DESC) = 1")
def _(spark, sf):
    from tessera.sources.store import upsert

    claims = status_claims(spark, sf).select("subject", "vol", "claim_id", "value")
    return upsert(claims, ["subject", "vol"], "claim_id")


@query("store_prune_orphans", f"WITH {CLAIMS} SELECT claim_id FROM claims WHERE claim_id % 3 = 0 AND subject IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    verdicts = status_claims(spark, sf).where("claim_id % 3 = 0").select("claim_id", F.col("subject").alias("c_custkey"))
    live = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select("c_custkey")
    return verdicts.join(live, "c_custkey", "left_semi").select("claim_id")
