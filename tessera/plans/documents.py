"""Pages at a cutoff, bundles, and change-only documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import slug
from tessera.operators import asof, intervals
from tessera.plans.core import INTERVALS, built
from tessera.plans.registry import query
from tessera.plans.relations import NOW, REL_INTERVALS, edges
from tessera.sources.tables import CLAIMS, EVENTS, PASSAGES, PRIORITIES, log_events, passages, priority_claims, status_claims, table


@query("doc_page_at", f"""WITH {INTERVALS}, s AS (SELECT subject, string_agg(value, ' · ' ORDER BY value) AS now FROM iv WHERE {NOW} GROUP BY ALL), h AS (SELECT subject, count(*) AS closed FROM iv WHERE vol_start <= 4 AND vol_end < 4 GROUP BY ALL)
SELECT c_custkey AS subject, c_name AS canonical, coalesce(now, 'unknown') AS now, now IS NULL AS inferred, coalesce(closed, 0) AS closed FROM customer LEFT JOIN s ON subject = c_custkey LEFT JOIN h ON h.subject = c_custkey""")
def _(spark, sf):
    rows = built(spark, sf)
    now = asof.state_at(rows, 4).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("value")), " · ").alias("now"))
    closed = asof.history_at(rows, 4).groupBy("subject").agg(F.count(F.lit(1)).alias("closed"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("canonical"))
    return c.join(now, "subject", "left").join(closed, "subject", "left").select("subject", "canonical", F.coalesce("now", F.lit("unknown")).alias("now"), F.col("now").isNull().alias("inferred"), F.coalesce("closed", F.lit(0)).alias("closed"))


@query("doc_multi_fields", f"WITH {PRIORITIES} SELECT subject, string_agg(DISTINCT value, ', ' ORDER BY value) AS fields FROM prio WHERE vol <= 4 GROUP BY ALL")
def _(spark, sf):
    seen = intervals.multi_valued_intervals(priority_claims(spark, sf).where("vol <= 4"))
    return seen.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("fields"))


@query("doc_sparse_cutoffs", f"WITH {INTERVALS} SELECT subject, string_agg(vol_start || ':' || value, '|' ORDER BY vol_start) AS cutoffs, count(*) AS n FROM iv GROUP BY ALL")
def _(spark, sf):
    rows = built(spark, sf).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("vol_start", "value"))).alias("c"))
    return rows.select("subject", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["vol_start"].cast("string"), x["value"])), "|").alias("cutoffs"), F.size("c").cast("long").alias("n"))


@query("doc_written_pages", f"WITH {CLAIMS} SELECT t, count(DISTINCT subject) AS pages FROM claims JOIN range(1, 8) r(t) ON vol <= t GROUP BY ALL")
def _(spark, sf):
    first = status_claims(spark, sf).groupBy("subject").agg(F.min("vol").alias("vol"))
    t = F.explode(F.sequence(F.col("vol"), F.lit(7)))
    return first.where("vol <= 7").select("subject", t.alias("t")).groupBy(F.col("t").cast("long").alias("t")).agg(F.count(F.lit(1)).alias("pages"))


@query("doc_index_order", f"WITH {EVENTS}, c AS (SELECT user_id, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS place FROM c ORDER BY place LIMIT 100")
def _(spark, sf):
    c = log_events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(100)
    return c.select("user_id", F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).alias("place"))


@query("doc_links", f"WITH {REL_INTERVALS} SELECT subject, md5(string_agg(DISTINCT object, '|' ORDER BY object)) AS links, count(DISTINCT object) AS n FROM riv WHERE {NOW} GROUP BY ALL")
def _(spark, sf):
    now = asof.state_at(edges(spark, sf), 4)
    return now.groupBy("subject").agg(F.md5(F.array_join(F.array_sort(F.collect_set("object")), "|")).alias("links"), F.countDistinct("object").alias("n"))


@query("doc_timeline", f"WITH {EVENTS} SELECT vol, event_type, count(*) AS n, min(event_id) AS first_event, max(ts) - min(ts) >= INTERVAL 1 DAY AS long FROM ev GROUP BY ALL")
def _(spark, sf):
    return log_events(spark, sf).groupBy("vol", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), (F.max("ts") - F.min("ts") >= F.expr("INTERVAL '1' DAY")).alias("long"))


@query("doc_routes", "SELECT c_custkey, 'entities/' || trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') || '/t' || printf('%02d', c_nationkey) || '#top' AS href FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.concat(F.lit("entities/"), slug(F.col("c_name")), F.lit("/t"), F.format_string("%02d", F.col("c_nationkey")), F.lit("#top")).alias("href"))


@query("doc_family_lines", f"WITH {REL_INTERVALS}, r AS (SELECT subject, object, predicate, row_number() OVER (PARTITION BY subject, object ORDER BY CASE WHEN predicate = 'TRADES_WITH' THEN 1 ELSE 0 END, vol_start, interval_id) AS rn FROM riv WHERE vol_start <= 4) SELECT subject, md5(string_agg(object || ':' || predicate, '|' ORDER BY object)) AS lines, count(*) AS n FROM r WHERE rn = 1 GROUP BY ALL")
def _(spark, sf):
    generic = F.when(F.col("predicate") == "TRADES_WITH", 1).otherwise(0)
    order = Window.partitionBy("subject", "object").orderBy(generic, "vol_start", "interval_id")
    r = edges(spark, sf).where("vol_start <= 4").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    r = r.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("object", "predicate"))).alias("l"))
    return r.select("subject", F.md5(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["object"], x["predicate"])), "|")).alias("lines"), F.size("l").cast("long").alias("n"))


@query("doc_relationship_order", f"WITH {REL_INTERVALS} SELECT subject, object, min(vol_start) AS since, row_number() OVER (PARTITION BY subject ORDER BY min(vol_start), object) AS place FROM riv WHERE {NOW} GROUP BY subject, object")
def _(spark, sf):
    now = asof.state_at(edges(spark, sf), 4).groupBy("subject", "object").agg(F.min("vol_start").alias("since"))
    return now.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy("since", "object")))


@query("doc_emitted_here", f"WITH {CLAIMS}, f AS (SELECT subject, min(vol) AS page FROM claims GROUP BY ALL) SELECT c_custkey, greatest(page, 1 + c_nationkey % 4) AS listed FROM customer JOIN f ON subject = c_custkey WHERE page <= 3 AND 1 + c_nationkey % 4 <= 3")
def _(spark, sf):
    f = status_claims(spark, sf).groupBy(F.col("subject").alias("c_custkey")).agg(F.min("vol").alias("page"))
    born = F.col("c_nationkey") % 4 + 1
    return table(spark, sf, "customer").join(f, "c_custkey").where((F.col("page") <= 3) & (born <= 3)).select("c_custkey", F.greatest("page", born).alias("listed"))


@query("doc_quotes_section", f"""WITH {PASSAGES}, q AS (SELECT chapter_idx, para_id, text, n_words, row_number() OVER (PARTITION BY chapter_idx, left(text, 60) ORDER BY para_id) AS dup FROM para),
  s AS (SELECT *, round(0.45 * least(n_words, 25) / 25 + 0.25 * regexp_matches(text, '[.!?]$')::INT + 0.2 * regexp_matches(text, '(^| )I( |$)')::INT, 6) AS score FROM q WHERE dup = 1)
SELECT chapter_idx, para_id, score FROM s QUALIFY row_number() OVER (PARTITION BY chapter_idx ORDER BY score DESC, para_id) <= 3""")
def _(spark, sf):
    from tessera.operators.sequences import top_k

    p = passages(spark, sf)
    p = p.withColumn("dup", F.row_number().over(Window.partitionBy("chapter_idx", F.left("text", F.lit(60))).orderBy("para_id"))).where("dup = 1")
    score = F.round(0.45 * F.least("n_words", F.lit(25)) / 25 + 0.25 * F.col("text").rlike("[.!?]$").cast("int") + 0.2 * F.col("text").rlike("(^| )I( |$)").cast("int"), 6)
    return top_k(p.withColumn("score", score), ["chapter_idx"], [F.desc("score"), F.col("para_id")], 3).select("chapter_idx", "para_id", "score")


@query("doc_name_fields_dedupe", "WITH n AS (SELECT p_brand AS e, lower(p_type) AS norm, p_size % 3 AS precedence, p_partkey FROM part) SELECT e, norm, precedence, p_partkey FROM n QUALIFY row_number() OVER (PARTITION BY e, norm ORDER BY precedence, p_partkey) = 1")
def _(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_brand").alias("e"), F.lower("p_type").alias("norm"), (F.col("p_size") % 3).alias("precedence"), "p_partkey")
    order = Window.partitionBy("e", "norm").orderBy("precedence", "p_partkey")
    return n.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


@query("doc_cumulative_evidence", f"WITH {EVENTS}, c AS (SELECT user_id, vol, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, vol, sum(n) OVER (PARTITION BY user_id ORDER BY vol)::BIGINT AS upto FROM c")
def _(spark, sf):
    c = log_events(spark, sf).groupBy("user_id", "vol").agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", "vol", F.sum("n").over(Window.partitionBy("user_id").orderBy("vol")).alias("upto"))
