"""Validation, metrics, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.text import word_count
from tessera.operators import validate as V
from tessera.plans.core import COLLAPSED, INTERVALS, built
from tessera.plans.registry import query
from tessera.plans.relations import REL_INTERVALS, edges
from tessera.sources.tables import CLAIMS, EVENTS, PASSAGES, log_events, passages, status_claims, table

WORDS = r"len(list_filter(regexp_split_to_array(text, '[ \t\x0b\f\r\n]+'), lambda x: x <> ''))"
CHECKED = f"""chk AS (SELECT doc_id, lang, CASE WHEN {WORDS} < 8 THEN 'too_short' WHEN contains(lower(text), 'http') THEN 'has_link' WHEN regexp_matches(text, '[0-9]{{6,}}') THEN 'has_number' WHEN lang <> 'en' THEN 'other_language' END AS reason FROM documents)"""


def checked(spark, sf):
    docs = table(spark, sf, "documents")
    return V.first_reason(docs, [("too_short", word_count(F.col("text")) < 8), ("has_link", F.contains(F.lower("text"), F.lit("http"))), ("has_number", F.col("text").rlike("[0-9]{6,}")), ("other_language", F.col("lang") != "en")])


@query("validate_reasons", f"WITH {CHECKED} SELECT doc_id, reason FROM chk")
def _(spark, sf):
    return checked(spark, sf).select("doc_id", "reason")


@query("validate_reason_counts", f"WITH {CHECKED} SELECT lang, coalesce(reason, 'kept') AS reason, count(*) AS n FROM chk GROUP BY ALL")
def _(spark, sf):
    return V.reason_counts(checked(spark, sf), ["lang"])


@query("validate_passed", f"WITH {CHECKED} SELECT doc_id FROM chk WHERE reason IS NULL")
def _(spark, sf):
    return V.passed(checked(spark, sf)).select("doc_id")


@query("validate_named_in", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND (contains(lower(text), 'ation') OR contains(lower(text), 'ing'))")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").where(V.names_any(t, ["the"]) & V.names_any(t, ["ation", "ING"])).select("conv_id", "turn")


@query("validate_membership", "SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(lower(p_type), ' '), ['brass', 'small'])")
def _(spark, sf):
    return table(spark, sf, "part").where(V.membership(F.split(F.lower("p_type"), " "), ["brass", "small"])).select("p_partkey")


@query("validate_keyword_match", """WITH k AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 4)) AS k, list_distinct(list_filter(string_split(lower(left(text, length(text) // 2)), ' '), lambda w: length(w) >= 4)) AS h FROM benchmark)
SELECT item_id, len(list_intersect(k, h)) >= greatest(2, round_even(len(k) * 0.5, 0)) AS hit FROM k""")
def _(spark, sf):
    kw = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), " "), lambda w: F.length(w) >= 4))
    half = F.expr("left(text, cast(floor(length(text) / 2) as int))")
    return table(spark, sf, "benchmark").select("item_id", V.keywords_match(kw(F.col("text")), kw(half)).alias("hit"))


OBS = "obs AS (SELECT d.source AS system, d.doc_id // 20 % 5 + 1 AS cutoff, d.lang AS cluster, l.quality AS num, 1 AS den, 1 + d.doc_id % 3 AS weight FROM labels l JOIN documents d USING (doc_id))"
CELLS = f"{OBS}, cell AS (SELECT system, cutoff, sum(weight * num)::DOUBLE / sum(weight * den) AS value FROM obs GROUP BY ALL)"


def observations(spark, sf):
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return labels.select(F.col("source").alias("system"), (F.floor(F.col("doc_id") / 20) % 5 + 1).alias("cutoff"), F.col("lang").alias("cluster"), F.col("quality").alias("num"), F.lit(1).alias("den"), (1 + F.col("doc_id") % 3).alias("weight"))


@query("metric_cells", f"WITH {CELLS} SELECT system, cutoff, round(value, 9) AS value FROM cell")
def _(spark, sf):
    return stats.cells(observations(spark, sf), ["system", "cutoff"]).withColumn("value", F.round("value", 9))


@query("metric_macro_summary", f"WITH {CELLS} SELECT system, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(median(value), 9) AS median, round(min(value), 9) AS low, round(max(value), 9) AS high FROM cell GROUP BY ALL")
def _(spark, sf):
    out = stats.macro(stats.cells(observations(spark, sf), ["system", "cutoff"]), ["system"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "sd", "median", "low", "high")})


@query("metric_paired_differences", f"WITH {CELLS} SELECT a.cutoff, round(a.value - b.value, 9) AS difference FROM cell a JOIN cell b USING (cutoff) WHERE a.system = 'src1' AND b.system = 'src2'")
def _(spark, sf):
    cell = stats.cells(observations(spark, sf), ["system", "cutoff"])
    return stats.paired(cell, ["cutoff"], "system", "src1", "src2").select("cutoff", F.round("difference", 9).alias("difference"))


Z = "1.959963984540054::DOUBLE"


@query("metric_wilson", f"""WITH {OBS}, s AS (SELECT system, sum(num)::BIGINT AS k, count(*)::BIGINT AS n FROM obs GROUP BY ALL)
SELECT system, k, n, round(greatest(k / n + {Z} * {Z} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4 * n * n)), 0) / (1 + {Z} * {Z} / n), 3) AS low,
  round((k / n + {Z} * {Z} / (2 * n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4 * n * n))) / (1 + {Z} * {Z} / n), 3) AS high FROM s""")
def _(spark, sf):
    s = observations(spark, sf).groupBy("system").agg(F.sum("num").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return s.select("system", "k", "n", low.alias("low"), high.alias("high"))


@query("metric_zero_event_bound", f"WITH {OBS} SELECT system, round(1 - pow(0.05, 1.0 / count(*)), 9) AS bound FROM obs GROUP BY ALL")
def _(spark, sf):
    return observations(spark, sf).groupBy("system").agg(F.count(F.lit(1)).alias("n")).select("system", F.round(stats.zero_event_bound(F.col("n")), 9).alias("bound"))


@query("metric_nearest_rank", "WITH a AS (SELECT c_mktsegment AS seg, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY ALL) SELECT seg, v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS p90 FROM a")
def _(spark, sf):
    # a percentile of a segment by its sorted values; percentile_disc would round the other way
    a = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.array_sort(F.collect_list("c_acctbal")).alias("v"))
    return a.select("seg", stats.nearest_rank(F.col("v"), 0.9).alias("p90"))


@query("metric_bootstrap")
def _(spark, sf):
    reps = stats.bootstrap(observations(spark, sf).withColumnRenamed("system", "c"), "c", 500)
    return reps.agg(F.round(F.percentile("value", 0.025), 6).alias("low"), F.round(F.percentile("value", 0.975), 6).alias("high"), F.count(F.lit(1)).alias("replicates"))


@query("metric_sample_per_stratum")
def _(spark, sf):
    return stats.sample_per_stratum(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 5)


@query("metric_confusion", "SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, round(avg(CASE WHEN quality = 1 THEN 1 - toxic END), 9) AS tpr, round(avg(CASE WHEN quality = 0 THEN toxic END), 9) AS tnr FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def _(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(
        F.count_if((q == 1) & (t == 0)).alias("tp"), F.count_if((q == 0) & (t == 0)).alias("fp"), F.count_if((q == 1) & (t == 1)).alias("fn"), F.count_if((q == 0) & (t == 1)).alias("tn"),
        F.round(F.avg(F.when(q == 1, 1 - t)), 9).alias("tpr"), F.round(F.avg(F.when(q == 0, t)), 9).alias("tnr"),
    )


@query("metric_cost_cube", f"WITH {EVENTS}, r AS (SELECT *, user_id % 5 AS run FROM ev) SELECT event_type, vol, run, count(*) AS calls, count(*) FILTER (k % 3 = 0) AS cached, round(sum(value), 4) AS cost FROM r GROUP BY GROUPING SETS ((), (run), (event_type), (vol))")
def _(spark, sf):
    e = log_events(spark, sf).withColumn("run", F.col("user_id") % 5)
    sets = e.groupingSets([[], ["run"], ["event_type"], ["vol"]], "event_type", "vol", "run")
    return sets.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("k") % 3 == 0).alias("cached"), F.round(F.sum("value"), 4).alias("cost"))


@query("metric_final_runs", f"WITH {EVENTS} SELECT user_id, event_type, max(event_id) AS run FROM ev WHERE k % 4 <> 0 GROUP BY ALL")
def _(spark, sf):
    return log_events(spark, sf).where("k % 4 <> 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("run"))


@query("metric_distinct_assertions", "SELECT source, count(*) AS n, count(DISTINCT lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) AS nd FROM documents GROUP BY ALL")
def _(spark, sf):
    folded = F.lower(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(folded).alias("nd"))


@query("metric_page_kind_shares", f"WITH {OBS}, c AS (SELECT cutoff, cluster, count(*) AS n FROM obs GROUP BY ALL), p AS (SELECT cutoff, cluster, n / sum(n) OVER (PARTITION BY cutoff) AS share FROM c) SELECT cluster, round(avg(share), 9) AS share FROM p GROUP BY ALL")
def _(spark, sf):
    from pyspark.sql import Window

    p = observations(spark, sf).groupBy("cutoff", "cluster").agg(F.count(F.lit(1)).alias("n"))
    p = p.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cutoff")))
    return p.groupBy("cluster").agg(F.round(F.avg("share"), 9).alias("share"))


@query("metric_threshold_at_rank", f"WITH {EVENTS}, c AS (SELECT user_id, count(*) AS n FROM ev GROUP BY ALL), a AS (SELECT list_sort(list(n)) AS v FROM c) SELECT v[least(len(v) - 1, floor(0.8 * len(v))::INT) + 1] AS threshold FROM a")
def _(spark, sf):
    c = log_events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    # counts of counts: what meets in one place is the distinct counts, not the users
    from pyspark.sql import Window

    w = c.withColumn("upto", F.sum("m").over(Window.orderBy("n"))).withColumn("all", F.sum("m").over(Window.partitionBy(F.lit(0))))
    return w.where(F.col("upto") > F.least(F.col("all") - 1, F.floor(0.8 * F.col("all")))).agg(F.min("n").alias("threshold"))


@query("metric_missing_volumes", f"WITH {EVENTS}, m AS (SELECT user_id, vol FROM ev GROUP BY ALL HAVING count(*) >= 12) SELECT user_id, vol FROM m WHERE (user_id, vol) NOT IN (SELECT (user_id, vol) FROM ev WHERE event_type = 'purchase' AND k < 20)")
def _(spark, sf):
    e = log_events(spark, sf)
    often = e.groupBy("user_id", "vol").agg(F.count(F.lit(1)).alias("n")).where("n >= 12").select("user_id", "vol")
    return often.join(e.where("event_type = 'purchase' and k < 20").select("user_id", "vol").distinct(), ["user_id", "vol"], "left_anti")


@query("metric_gap_coverage", f"WITH {COLLAPSED} SELECT subject, (max(vol) - min(vol) + 1 - count(*))::BIGINT AS gaps FROM best GROUP BY ALL")
def _(spark, sf):
    from tessera.operators.intervals import arbitrate

    return arbitrate(status_claims(spark, sf)).groupBy("subject").agg((F.max("vol") - F.min("vol") + 1 - F.count(F.lit(1))).alias("gaps"))


@query("metric_label_override", "SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN 1 - quality END, quality) AS quality FROM labels")
def _(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    new = labels.where("doc_id % 10 = 0").select("doc_id", (1 - F.col("quality")).alias("new"))
    return labels.join(new, "doc_id", "left").select("doc_id", F.coalesce("new", "quality").alias("quality"))


@query("metric_grid_argmax", f"WITH {CELLS} SELECT system, arg_max(cutoff, (round(value, 6), -cutoff)) AS setting FROM cell GROUP BY ALL")
def _(spark, sf):
    cell = stats.cells(observations(spark, sf), ["system", "cutoff"])
    return cell.groupBy("system").agg(F.max_by("cutoff", F.struct(F.round("value", 6), -F.col("cutoff"))).alias("setting"))


@query("audit_empty_volumes", f"WITH {PASSAGES} SELECT vol, count(*) AS n, count(*) = 0 AS failed, count(DISTINCT chapter_idx) <= 2 AND sum(n_words) > 20000 AS warned FROM para GROUP BY ALL")
def _(spark, sf):
    n = F.count(F.lit(1))
    return passages(spark, sf).groupBy("vol").agg(n.alias("n"), (n == 0).alias("failed"), ((F.countDistinct("chapter_idx") <= 2) & (F.sum("n_words") > 20000)).alias("warned"))


@query("audit_verbatim_quotes", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def _(spark, sf):
    from tessera.operators.probing import verbatim

    return verbatim(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


@query("audit_dangling_references", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"))
    return V.dangling(line, table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("long").alias("k")), "k").select("l_orderkey", "l_linenumber")


@query("audit_unknown_kinds", f"WITH {EVENTS} SELECT event_type, count(*) AS n FROM ev WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL")
def _(spark, sf):
    known = spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string")
    return V.dangling(log_events(spark, sf), known, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("audit_fence", f"WITH {INTERVALS} SELECT count(*) FILTER (vol_end < vol_start) AS inverted, count(*) FILTER (vol_end IS NULL) AS open, count(*) FILTER ((vol_end IS NULL) <> (superseded_by IS NULL)) AS unlinked FROM iv")
def _(spark, sf):
    return built(spark, sf).agg(F.count_if(F.col("vol_end") < F.col("vol_start")).alias("inverted"), F.count_if(F.col("vol_end").isNull()).alias("open"), F.count_if(F.col("vol_end").isNull() != F.col("superseded_by").isNull()).alias("unlinked"))


@query("audit_distribution", f"WITH {CLAIMS}, b AS (SELECT value, least(floor(confidence * 10)::INT * 10, 90) AS bucket FROM claims) SELECT value, bucket, count(*) AS n FROM b GROUP BY GROUPING SETS ((value), (bucket))")
def _(spark, sf):
    c = status_claims(spark, sf).withColumn("bucket", F.least(F.floor(F.col("confidence") * 10).cast("int") * 10, F.lit(90)))
    return c.groupingSets([["value"], ["bucket"]], "value", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("audit_unsupported_rate", f"WITH {INTERVALS} SELECT value, round(avg(CASE WHEN confidence < 0.3 THEN 1 ELSE 0 END), 9) AS rate, avg(CASE WHEN confidence < 0.3 THEN 1 ELSE 0 END) > 0.15 AS failed FROM iv GROUP BY ALL")
def _(spark, sf):
    rate = F.avg(F.when(F.col("confidence") < 0.3, 1).otherwise(0))
    return built(spark, sf).groupBy("value").agg(F.round(rate, 9).alias("rate"), (rate > 0.15).alias("failed"))


@query("audit_roster_disagreement", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c_nationkey IS NULL AS only_suppliers, s_nationkey IS NULL AS only_customers FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal < 0) FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal < 2000) ON c_nationkey = s_nationkey WHERE c_nationkey IS NULL OR s_nationkey IS NULL")
def _(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal < 0").select("c_nationkey").distinct()
    s = table(spark, sf, "supplier").where("s_acctbal < 2000").select("s_nationkey").distinct()
    both = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").where("c_nationkey is null or s_nationkey is null")
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.col("c_nationkey").isNull().alias("only_suppliers"), F.col("s_nationkey").isNull().alias("only_customers"))


@query("audit_latest_outcome", f"WITH {EVENTS} SELECT event_type, arg_max(CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'ok' END, (ts, event_id)) AS outcome FROM ev GROUP BY ALL")
def _(spark, sf):
    e = log_events(spark, sf).withColumn("o", F.when(F.col("k") % 5 == 0, "failed").otherwise("ok"))
    return e.groupBy("event_type").agg(F.max_by("o", F.struct("ts", "event_id")).alias("outcome"))


@query("audit_merge_flags", "SELECT c_mktsegment AS entity, max(c_nationkey) - min(c_nationkey) >= 2 AS span, count(DISTINCT right(c_name, 1)) >= 2 AS surname FROM customer GROUP BY ALL")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("entity")).agg((F.max("c_nationkey") - F.min("c_nationkey") >= 2).alias("span"), (F.countDistinct(F.right("c_name", F.lit(1))) >= 2).alias("surname"))


@query("audit_retention_funnel", f"""WITH {REL_INTERVALS} SELECT count(*) AS nations, count(s.c_nationkey) AS with_customers, count(v.n) AS with_edges FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9500) s ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT DISTINCT subject AS n FROM riv WHERE vol_end IS NULL AND predicate = 'OPPOSES') v ON v.n = n_name""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    s = table(spark, sf, "customer").where("c_acctbal > 9500").select("c_nationkey").distinct()
    v = edges(spark, sf).where("vol_end is null and predicate = 'OPPOSES'").select(F.col("subject").alias("n")).distinct()
    rows = n.join(s, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(v, F.col("n_name") == F.col("n"), "left")
    return rows.agg(F.count(F.lit(1)).alias("nations"), F.count("c_nationkey").alias("with_customers"), F.count("n").alias("with_edges"))
