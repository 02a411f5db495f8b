"""Entity resolution, decisions, claim construction, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vectorised as U
from tessera.functions.stats import sample_per_stratum
from tessera.operators import construct, resolution
from tessera.plans.core import flat
from tessera.plans.registry import query
from tessera.sources.tables import EVENTS, PASSAGES, log_events, passages, table


def names(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))


@query("resolve_scored_pairs")
def _(spark, sf):
    # a pair of names is scored once, however many ids have them
    return resolution.id_pairs(resolution.scored_pairs(resolution.form_pairs(names(spark, sf)))).select("a", "b", "name_a", "name_b", "type", "ratio", "tier")


@query("resolve_connected", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS a, user_id * 7 % 150 AS b FROM events WHERE event_type = 'signup'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def _(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("a"), (F.col("user_id") * 7 % 150).alias("b")).distinct()
    return resolution.connected(e)


@query("resolve_constrained_merge")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("a"), (F.col("user_id") + 1 + F.col("event_id") % 5).alias("b"), F.col("value").alias("weight"))
    pairs = e.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return resolution.merge_with_cannot_links(pairs, pairs.where("b - a = 3").select("a", "b"))


@query("resolve_canonical_names", r"""WITH c AS (SELECT c_nationkey AS cluster, c_name AS name, c_custkey % 7 AS n, c_custkey % 3 AS first_vol FROM customer),
  b AS (SELECT cluster, struct_extract_at(min((first_vol, -n, -len(string_split(name, ' ')), name)), 4) AS canonical, min(first_vol) AS first_vol, sum(n)::BIGINT AS mentions FROM c GROUP BY ALL)
SELECT cluster, canonical, first_vol, mentions, trim(regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g'), '-') AS entity_id FROM b""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return resolution.canonical_name(c.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 7).alias("n"), (F.col("c_custkey") % 3).alias("first_vol")))


@query("resolve_ambiguous_forms", "WITH f AS (SELECT DISTINCT p_brand AS entity, p_type AS text FROM part), n AS (SELECT text, count(DISTINCT entity) AS k FROM f GROUP BY ALL) SELECT entity, text, k > 1 AS ambiguous FROM f JOIN n USING (text)")
def _(spark, sf):
    return resolution.ambiguous(table(spark, sf, "part").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("text")).distinct())


@query("resolve_name_collisions", "SELECT p_type AS canonical, count(DISTINCT p_partkey) AS ids, count(DISTINCT p_brand) AS types FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1 AND count(DISTINCT p_brand) > 1")
def _(spark, sf):
    return resolution.name_collisions(table(spark, sf, "part").select(F.col("p_type").alias("canonical"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("type")))


@query("resolve_blocking", r"""WITH t AS (SELECT c_custkey AS id, c_mktsegment AS type, unnest(list_distinct(list_filter(regexp_split_to_array(lower('n' || c_nationkey || ' ' || (c_custkey % 400)), '[^\p{L}\p{N}]+'), lambda x: x <> '') || ['p:' || left('n' || c_nationkey || ' ' || (c_custkey % 400), 3)])) AS w FROM customer)
SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.type = b.type AND a.w = b.w AND a.id < b.id GROUP BY ALL""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    n = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(" "), (F.col("c_custkey") % 400).cast("string")).alias("name"), F.col("c_mktsegment").alias("type"))
    return resolution.candidate_pairs(n).select("a", "b")


@query("text_remap", "SELECT c_custkey, 'From ' || CASE n_name WHEN 'NATION_1' THEN 'NATION_2' WHEN 'NATION_2' THEN 'NATION_1' ELSE n_name END || ' to NATION_1x' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("From "), F.col("n_name"), F.lit(" to NATION_1x"))
    return c.select("c_custkey", U.remap(line, {"NATION_1": "NATION_2", "NATION_2": "NATION_1"}).alias("line"))


@query("text_recover_verbatim", "SELECT conv_id, turn, substr(text, 3, 20) AS found FROM conversations WHERE length(text) >= 30 AND NOT regexp_matches(substr(text, 3, 20), '(^\\s|\\s$|[\"''“”‘’«»])')")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("q", F.substring("text", 3, 20)).where(F.length("text") >= 30).where("NOT q rlike '(^\\\\s|\\\\s$|[\"\\'“”‘’«»])'")
    return c.select("conv_id", "turn", U.recovered(F.col("q"), F.col("text")).alias("found"))


@query("text_tolerant_json", "SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", U.parsed(F.concat(F.lit("Reply: ```json\n"), F.col("props"), F.lit("\n``` done"))).alias("value"))


@query("text_similarity_ratio")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.round(U.similarity_of(F.col("text"), F.lower("text")), 6).alias("ratio"))


@query("text_link_mentions", "SELECT c_custkey, '[' || n_name || '](n/' || n_nationkey || ') and ' || n_name AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    targets = [(r["n_name"], f"n/{r['n_nationkey']}") for r in nation.collect()]  # a catalog
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", U.linked(F.concat(F.col("n_name"), F.lit(" and "), F.col("n_name")), targets).alias("line"))


@query("claim_decided", "SELECT event_id, CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'yes' ELSE 'rule' END AS answer FROM events")
def _(spark, sf):
    asks = log_events(spark, sf).select("event_id", "k").withColumn("key", construct.request_key(F.col("k")))
    decisions = asks.where("k % 2 = 0").select("key", F.lit("yes").alias("answer")).distinct()
    return construct.decided(asks, decisions, F.lit("rule")).select("event_id", "answer")


@query("claim_undecided", "SELECT DISTINCT (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT % 2 = 1")
def _(spark, sf):
    asks = log_events(spark, sf).select("k").distinct().withColumn("key", construct.request_key(F.col("k")))
    return construct.undecided(asks, asks.where("k % 2 = 0").select("key")).select("k")


@query("claim_build_reasons", f"""WITH {PASSAGES}, raw AS (SELECT para_id, CASE WHEN seq % 5 = 4 THEN 'OTHER' ELSE 'SAYS' END AS predicate, CASE WHEN seq % 3 = 0 THEN left(text, 15) ELSE 'zzzz qqqq' END AS quote, 0.1 * (1 + chapter_idx % 9) AS confidence FROM para)
SELECT CASE WHEN predicate = 'OTHER' THEN 'unknown_predicate' WHEN quote = 'zzzz qqqq' THEN 'quote_not_verbatim' WHEN confidence < 0.35 THEN 'low_confidence' ELSE 'kept' END AS reason, count(*) AS n FROM raw GROUP BY ALL""")
def _(spark, sf):
    p = passages(spark, sf)
    raw = p.select("para_id", F.lit("s").alias("subject"), F.lit("v").alias("value"), F.when(F.col("seq") % 5 == 4, "OTHER").otherwise("SAYS").alias("predicate"), F.when(F.col("seq") % 3 == 0, F.left("text", F.lit(15))).otherwise("zzzz qqqq").alias("quote"), (0.1 * (1 + F.col("chapter_idx") % 9)).alias("confidence"))
    known = spark.createDataFrame([("SAYS",)], "predicate string")
    out = construct.build_claims(raw, p, known, least=0.35)
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("event_from_scenes", "SELECT printf('ev_v%02dc%02ds%03d', 1 + conv_id % 5, conv_id % 100, turn) AS event_id, role || '|' || 'all' AS participants FROM conversations WHERE trim(text) <> ''")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    scenes = c.select((F.col("conv_id") % 5 + 1).cast("int").alias("vol"), (F.col("conv_id") % 100).alias("chapter_idx"), F.col("turn").alias("span_index"), F.array("role", F.lit("all"), "role").alias("participants"), F.col("text").alias("summary"))
    return flat(construct.scenes_to_events(scenes).select("event_id", "participants"))


@query("sample_kept_then_topped_up")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    kept = docs.where("doc_id % 97 = 0")
    rest = docs.join(kept.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(sample_per_stratum(rest, ["source"], "doc_id", 3))


@query("run_list_newest", f"WITH {EVENTS} SELECT event_id, event_type FROM ev ORDER BY ts DESC, event_id DESC LIMIT 25")
def _(spark, sf):
    return log_events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type").limit(25)


@query("run_log_search", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'tion')")
def _(spark, sf):
    return table(spark, sf, "conversations").where((F.col("role") == "user") & F.contains(F.lower("text"), F.lit("tion"))).select("conv_id", "turn")


@query("run_stage_status", f"WITH {EVENTS} SELECT event_type, max(ts) AS newest, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    return log_events(spark, sf).groupBy("event_type").agg(F.max("ts").cast("timestamp_ntz").alias("newest"), F.count(F.lit(1)).alias("n"))


@query("run_role_routing", "SELECT user_id, arg_min(event_type, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id)) AS route FROM events GROUP BY ALL")
def _(spark, sf):
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct(order, "event_id")).alias("route"))


@query("volume_discovery", "SELECT l_shipdate::DATE AS d, dense_rank() OVER (ORDER BY year(l_shipdate)) AS vol FROM (SELECT DISTINCT l_shipdate FROM lineitem)")
def _(spark, sf):
    days = table(spark, sf, "lineitem").select("l_shipdate").distinct()
    years = days.select(F.year("l_shipdate").alias("y")).distinct().withColumn("vol", F.row_number().over(Window.orderBy("y")))
    return days.withColumn("y", F.year("l_shipdate")).join(F.broadcast(years), "y").select(F.col("l_shipdate").cast("date").alias("d"), "vol")  # a row a year


@query("range_spec", "SELECT unnest([1, 2, 3, 5]) AS v")
def _(spark, sf):
    parts = F.transform(F.split(F.lit("1-3,5,2"), ","), lambda p: F.split(p, "-"))
    spans = F.transform(parts, lambda p: F.sequence(p[0].cast("int"), F.element_at(p, -1).cast("int")))
    return spark.range(1).select(F.explode(F.array_sort(F.array_distinct(F.flatten(spans)))).alias("v"))
