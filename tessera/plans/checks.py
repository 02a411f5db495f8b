"""Spans, citations, known-answer scores and other small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import sequences as S
from tessera.operators import spans as P
from tessera.plans.core import INTERVALS, built
from tessera.plans.registry import query
from tessera.sources.tables import EVENTS, PASSAGES, log_events, passages, table


@query("span_overlaps", """WITH c AS (SELECT conv_id, turn, length(text) AS size, (turn // 3)::INT AS grp FROM conversations), u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) - size AS start FROM c),
  k AS (SELECT conv_id, grp, min(turn) AS first, min(start) AS before FROM u GROUP BY ALL)
SELECT k.conv_id, grp AS "group", first, coalesce((SELECT min(u.turn) FROM u WHERE u.conv_id = k.conv_id AND u.turn < k.first AND k.before - u.start <= 400), first) AS overlap_first FROM k""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"), F.floor(F.col("turn") / 3).cast("int").alias("group"))
    return P.overlap_before(c, ["conv_id"], "turn", "size", 400)


@query("span_core_partition", f"WITH {PASSAGES} SELECT chapter_idx, count(*) AS rows, count(DISTINCT seq) AS seqs, count(*) = count(DISTINCT seq) AS exact FROM para GROUP BY ALL")
def _(spark, sf):
    g = S.greedy_groups(passages(spark, sf), ["chapter_idx"], ["seq"], "n_words", 200)
    return g.groupBy("chapter_idx").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("seq").alias("seqs"), (F.count(F.lit(1)) == F.countDistinct("seq")).alias("exact"))


@query("fold_contained_rows", """WITH r AS (SELECT p_brand AS k, p_partkey AS item, list_distinct(string_split(lower(p_type || CASE WHEN p_size % 2 = 0 THEN ' x' ELSE '' END), ' ')) AS m FROM part),
  i AS (SELECT a.k, a.item, arg_max(b.item, (len(b.m), b.item)) AS host FROM r a JOIN r b ON a.k = b.k AND list_has_all(b.m, a.m) AND len(b.m) > len(a.m) GROUP BY ALL)
SELECT r.k, r.item, (SELECT count(*) FROM i WHERE i.k = r.k AND i.host = r.item) AS folded FROM r WHERE (r.k, r.item) NOT IN (SELECT (k, item) FROM i)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    words = F.split(F.lower(F.concat(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, " x").otherwise(""))), " ")
    return P.fold_contained(p.select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("item"), words.alias("m")), ["k"], "item", "m")


@query("dominance_carried", f"""WITH {EVENTS}, c AS (SELECT user_id % 30 AS key, vol, event_type, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY key, vol) AS total, row_number() OVER (PARTITION BY key, vol ORDER BY n DESC, event_type) AS r FROM c)
SELECT key, vol, last_value(CASE WHEN n >= 0.3 * total THEN event_type END IGNORE NULLS) OVER (PARTITION BY key ORDER BY vol ROWS UNBOUNDED PRECEDING) AS event_type FROM t WHERE r = 1""")
def _(spark, sf):
    c = log_events(spark, sf).groupBy((F.col("user_id") % 30).alias("key"), "vol", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return P.dominant(c, "key", "event_type", "n", 0.3)


@query("evidence_context", "SELECT a.conv_id * 1000 + a.turn AS fact_id, b.turn AS seq, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 2 WHERE a.role = 'system'")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    facts = c.where("role = 'system'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("fact_id"), F.col("conv_id").alias("chapter"), F.col("turn").alias("seq"))
    return P.evidence_context(facts, c.select(F.col("conv_id").alias("chapter"), F.col("turn").alias("seq"), "role"), 2).select("fact_id", "seq", "role")


@query("para_id_repair", "SELECT * FROM (VALUES ('v01:c03:p96', 'v01:c03:p0096'), (' v01:c03:p0096', 'v01:c03:p0096'), ('v01:c03:p97', NULL)) AS t(given, id)")
def _(spark, sf):
    given = spark.createDataFrame([("v01:c03:p96",), (" v01:c03:p0096",), ("v01:c03:p97",)], "given string")
    return given.select("given", P.paragraph_id(F.col("given"), F.array(F.lit("v01:c03:p0096"), F.lit("v01:c03:p0001"))).alias("id"))


@query("para_id_parts", f"WITH {PASSAGES} SELECT para_id, substr(para_id, 2, 2)::INT AS vol, substr(para_id, 6, 6)::INT AS chapter FROM para")
def _(spark, sf):
    parts = F.split("para_id", ":")
    return passages(spark, sf).select("para_id", F.substring(parts[0], 2, 9).cast("int").alias("vol"), F.substring(parts[1], 2, 9).cast("int").alias("chapter"))


@query("citation_enforce", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey % 3 = 0))[1:3], '|') AS cited FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("all"), F.collect_list(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))).alias("allowed"))
    cited = P.cited_only(F.col("all"), F.col("allowed"), 3)
    joined = F.array_join(F.transform(cited, lambda x: x.cast("string")), "|")
    return o.select("o_custkey", F.when(F.size(cited) > 0, joined).alias("cited"))


@query("citation_future", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > TIMESTAMP '2000-01-01' AND o_orderdate <= TIMESTAMP '2000-01-01' GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit("2000-01-01").cast("timestamp_ntz")).select("o_orderkey")
    late = table(spark, sf, "lineitem").where(F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("o_orderkey"))
    return late.join(o, "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("prose_sentence_bounds", "WITH c AS (SELECT o_custkey, count(*)::INT AS n FROM orders GROUP BY ALL), l AS (SELECT *, greatest(1, least(2, n)) AS low FROM c) SELECT o_custkey, low, least(8, greatest(low, ceil(n * 1.5)::INT)) AS high FROM l")
def _(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    low, high = P.sentence_bounds(F.col("n"))
    return n.select("o_custkey", low.alias("low"), high.alias("high"))


@query("prompt_known_entities", "SELECT r_name || ' (also: ' || string_agg(n_name, ', ' ORDER BY n_name) || ')' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("a"))
    return rows.select(F.concat("r_name", F.lit(" (also: "), F.array_join("a", ", "), F.lit(")")).alias("line"))


@query("label_aliases_at", f"WITH {INTERVALS} SELECT subject, 'c' || subject || coalesce(' / ' || string_agg(value, ', ' ORDER BY vol_start) FILTER (vol_start <= 3), '') AS label FROM iv GROUP BY subject")
def _(spark, sf):
    r = built(spark, sf).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("vol_start", "value"))).alias("forms"))
    seen = F.transform(F.filter("forms", lambda f: f["vol_start"] <= 3), lambda f: f["value"])
    tail = F.when(F.size(seen) > 0, F.concat(F.lit(" / "), F.array_join(seen, ", "))).otherwise("")
    return r.select("subject", F.concat(F.lit("c"), F.col("subject").cast("string"), tail).alias("label"))


@query("rewrite_usable", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND length(replace(text, 'e', '')) / greatest(length(text), 1) BETWEEN 0.85 AND 0.95")
def _(spark, sf):
    ratio = F.length(F.replace("text", F.lit("e"), F.lit(""))) / F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf, "conversations").where((F.trim("text") != "") & ratio.between(0.85, 0.95)).select("conv_id", "turn")


@query("rewrite_report", "SELECT lang, count(*) AS n, count(*) FILTER (text = lower(text)) AS same, sum(length(text))::BIGINT AS chars, count(*) FILTER (contains(text, '!!')) AS residual FROM documents GROUP BY ALL")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(t == F.lower(t)).alias("same"), F.sum(F.length(t)).alias("chars"), F.count_if(F.contains(t, F.lit("!!"))).alias("residual"))


@query("dialogue_within", "SELECT conv_id, turn, contains(text, '\"') AND strpos(text, '\"') < 200 AS quoted, CASE WHEN starts_with(text, '\"') AND ends_with(text, '\"') AND length(text) > 1 THEN substr(text, 2, length(text) - 2) ELSE text END AS inner_text FROM conversations")
def _(spark, sf):
    t = F.col("text")
    wrapped = t.startswith('"') & t.endswith('"') & (F.length(t) > 1)
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.contains(t, F.lit('"')) & (F.instr(t, '"') < 200)).alias("quoted"), F.when(wrapped, F.expr("substring(text, 2, length(text) - 2)")).otherwise(t).alias("inner_text"))


@query("roster_gold", f"WITH {EVENTS}, g AS (SELECT user_id, user_id % 20 AS gold FROM ev WHERE user_id % 3 <> 1 GROUP BY ALL), p AS (SELECT user_id, max(k) % 20 AS found FROM ev WHERE user_id % 4 <> 2 GROUP BY ALL) SELECT user_id, CASE WHEN found IS NULL THEN 'ABSENT' WHEN found = gold THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g LEFT JOIN p USING (user_id)")
def _(spark, sf):
    e = log_events(spark, sf)
    gold = e.where("user_id % 3 <> 1").select("user_id", (F.col("user_id") % 20).alias("gold")).distinct()
    found = e.where("user_id % 4 <> 2").groupBy("user_id").agg((F.max("k") % 20).alias("found"))
    return gold.join(found, "user_id", "left").select("user_id", F.when(F.col("found").isNull(), "ABSENT").when(F.col("found") == F.col("gold"), "PASS").otherwise("FAIL").alias("verdict"))


@query("pair_siblings", "SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R') - 1 AS siblings FROM lineitem a WHERE l_returnflag = 'R'")
def _(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return r.select("l_orderkey", "l_linenumber", (F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")) - 1).alias("siblings"))


@query("gold_pages", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'mapped-' || p_partkey ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS page FROM part")
def _(spark, sf):
    from tessera.functions.text import slug

    p = table(spark, sf, "part")
    mapped = p.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("mapped-"), F.col("p_partkey").cast("string")).alias("m"))
    return p.select("p_partkey", "p_name").join(mapped, "p_partkey", "left").select("p_partkey", F.coalesce("m", slug(F.col("p_name"))).alias("page"))


@query("screen_audit", "SELECT l.doc_id % 10 AS t, count(*) AS n, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (toxic = 1 AND quality = 0) AS confirmed, count(*) FILTER (md5(text) < '4') AS stale FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.groupBy((F.col("doc_id") % 10).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("confirmed"), F.count_if(F.md5("text") < "4").alias("stale"))


@query("challenge_types", "SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 4 AS kind FROM part")
def _(spark, sf):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, sf, "part").select("p_partkey", (n % 4).alias("kind"))


@query("idf_weighted_overlap", """WITH d AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM conversations), f AS (SELECT w, ln((SELECT count(*) FROM conversations) / count(*)::DOUBLE) AS idf FROM d GROUP BY ALL), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM benchmark),
  s AS (SELECT item_id, conv_id, turn, round(sum(idf), 6) AS score FROM q JOIN d USING (w) JOIN f USING (w) GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn) = 1""")
def _(spark, sf):
    from tessera.operators.retrieval import best_overlap, tokens

    c = table(spark, sf, "conversations")
    d = c.select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.array_distinct(tokens(F.col("text"))).alias("words"))
    q = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    f = d.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(F.lit(float(c.count())) / F.col("df"))).select("w", "idf")
    s = best_overlap(d, q.join(f, "w")).select("item_id", F.col("a").alias("conv_id"), F.col("b").alias("turn"), F.round("score", 6).alias("score"))
    return S.top_k(s, ["item_id"], [F.desc("score"), F.col("conv_id"), F.col("turn")], 1).drop("rank")


@query("config_overlay", "SELECT * FROM (VALUES ('a', '1'), ('b', '9'), ('d', '4')) AS t(k, v)")
def _(spark, sf):
    base = F.create_map(*[F.lit(x) for x in ("a", "1", "b", "2", "c", "3")])
    over = F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit(None).cast("string"), F.lit("d"), F.lit("4"))
    # the overlay's value wins and its null deletes
    merged = F.map_zip_with(base, over, lambda k, a, b: F.when(F.map_contains_key(over, k), b).otherwise(a))
    return spark.range(1).select(F.explode(F.map_filter(merged, lambda k, v: v.isNotNull())).alias("k", "v"))
