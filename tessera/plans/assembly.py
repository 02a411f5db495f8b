"""The graph build, page assembly, verification, scoring and audits over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import pages as P
from tessera.operators import relations
from tessera.plans.core import INTERVALS, built, flat
from tessera.plans.registry import query
from tessera.plans.relations import predicates
from tessera.sources.tables import CLAIMS, EVENTS, PASSAGES, PRIORITIES, RELATIONS, log_events, passages, priority_claims, relation_claims, status_claims, table

GRAPH = f"""{RELATIONS}, c0 AS (SELECT least(subject, object) AS subject, greatest(subject, object) AS object, predicate, vol, confidence, claim_id FROM rel WHERE subject <> object),
  cc AS (SELECT subject, object, min(predicate) OVER (PARTITION BY subject, object) AS clique, predicate, vol, confidence, claim_id FROM c0),
  cg AS (SELECT subject, object, clique, predicate, vol, max(confidence) AS confidence, min(claim_id) AS first_id, list(claim_id ORDER BY claim_id) AS claim_ids FROM cc GROUP BY ALL),
  cr AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY subject, object, clique, vol) AS n, round(first_value(confidence) OVER w - lead(confidence) OVER w, 6) AS lead_by FROM cg WINDOW w AS (PARTITION BY subject, object, clique, vol ORDER BY confidence DESC, first_id)),
  cw AS (SELECT *, coalesce(max(lead_by) FILTER (place = 1) OVER (PARTITION BY subject, object, clique, vol) < 0.1, false) AS close FROM cr),
  gf AS (SELECT *, CASE WHEN lag(predicate) OVER w IS NOT DISTINCT FROM predicate THEN 0 ELSE 1 END AS fresh FROM cw WHERE place = 1 WINDOW w AS (PARTITION BY subject, object, clique ORDER BY vol)),
  gi AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, object, clique ORDER BY vol) AS island FROM gf),
  gm AS (SELECT subject, object, clique, island, min(predicate) AS predicate, min(vol) AS vol_start, max(confidence) AS confidence, list_sort(flatten(list(claim_ids))) AS claim_ids FROM gi GROUP BY ALL),
  gn AS (SELECT *, 'i_' || substr(sha1(subject || '|' || object || '|' || clique || '|' || predicate || '|' || vol_start), 1, 8) AS interval_id FROM gm),
  graph AS (SELECT *, lead(vol_start) OVER w - 1 AS vol_end, lead(interval_id) OVER w AS superseded_by FROM gn WINDOW w AS (PARTITION BY subject, object, clique ORDER BY island))"""
DOCS = "d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


# the graph build


@query("graph_build", f"WITH {GRAPH} SELECT interval_id, subject, object, clique, predicate, vol_start, vol_end, superseded_by, confidence, array_to_string(claim_ids, '|') AS claim_ids FROM graph")
def _(spark, sf):
    graph, _ = relations.build(relation_claims(spark, sf), predicates(spark))
    return flat(graph.select("interval_id", "subject", "object", "clique", "predicate", "vol_start", "vol_end", "superseded_by", "confidence", "claim_ids"))


@query("graph_build_log", f"WITH {GRAPH} SELECT subject, object, clique, vol, predicate AS dropped, CASE WHEN close THEN 'rule:higher_confidence_fallback' ELSE 'rule:higher_confidence' END AS how FROM cw WHERE n > 1 AND place > 1")
def _(spark, sf):
    return relations.build(relation_claims(spark, sf), predicates(spark))[1]


@query("graph_build_decided", f"""WITH {GRAPH}, dec AS (SELECT subject, object, clique, vol, max(predicate) AS kept FROM cg GROUP BY ALL),
  x AS (SELECT cw.*, kept, max(CASE WHEN close AND kept = predicate THEN 1 ELSE 0 END) OVER (PARTITION BY subject, object, clique, vol) AS named FROM cw JOIN dec USING (subject, object, clique, vol))
SELECT subject, object, clique, vol, predicate AS dropped, CASE WHEN named = 1 THEN 'decision' ELSE 'rule:higher_confidence' END AS how FROM x WHERE n > 1 AND NOT (CASE WHEN named = 1 THEN kept = predicate ELSE place = 1 END)""")
def _(spark, sf):
    claims, catalog = relation_claims(spark, sf), predicates(spark)
    c = relations.canonical_direction(claims, catalog).where("subject <> object")
    slots = relations.cliques(c, relations.conflict_groups(catalog), ["subject", "object"])
    decisions = c.join(slots, ["subject", "object", "predicate"]).groupBy("subject", "object", "clique", "vol").agg(F.max("predicate").alias("kept"))
    return relations.build(claims, catalog, decisions)[1]


@query("catalog_effective", "SELECT p_brand AS predicate FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 40 UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 48) WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice > 1990)")
def _(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "predicate")
    return P.effective_catalog(p.where("p_size <= 40").select("predicate"), add=p.where("p_size > 48").select("predicate"), skip=p.where("p_retailprice > 1990").select("predicate"))


@query("catalog_kind_lookup", "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) THEN 'attribute' WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2) THEN 'relation' WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'trait' END AS kind FROM customer")
def _(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    kinds = [("attribute", nation.where("n_regionkey = 0")), ("relation", nation.where("n_regionkey <= 2")), ("trait", table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))]
    return P.first_kind(table(spark, sf, "customer"), "c_nationkey", kinds).select("c_custkey", "kind")


# windows


@query("window_build", f"""WITH {EVENTS}, e AS (SELECT user_id, event_id AS pos, 30 + event_id % 40 AS tokens, CASE WHEN lag(event_id) OVER w IS NULL OR event_id - lag(event_id) OVER w > 400 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS session FROM e)
SELECT user_id, session::BIGINT AS session, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM s GROUP BY ALL""")
def _(spark, sf):
    e = log_events(spark, sf).select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") % 40 + 30).alias("tokens"))
    return P.position_clusters(e, ["user_id"], "pos", 400).groupBy("user_id", "session").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query("window_shrink", f"""WITH {PASSAGES}, m AS (SELECT *, max(seq) OVER (PARTITION BY chapter_idx) AS last, row_number() OVER (PARTITION BY chapter_idx ORDER BY n_words DESC, seq) AS r FROM para),
  a AS (SELECT chapter_idx, seq AS anchor, n_words AS own FROM m WHERE r = 1),
  lft AS (SELECT p.chapter_idx, p.seq, own + sum(n_words) OVER (PARTITION BY p.chapter_idx ORDER BY p.seq DESC) AS cost, own FROM para p JOIN a USING (chapter_idx) WHERE p.seq BETWEEN anchor - 3 AND anchor - 1),
  lk AS (SELECT chapter_idx, coalesce(sum(CASE WHEN cost <= 120 THEN 1 ELSE 0 END), 0) AS lefts, max(CASE WHEN cost <= 120 THEN cost END) AS used FROM lft GROUP BY ALL),
  rgt AS (SELECT p.chapter_idx, coalesce(used, own) + sum(n_words) OVER (PARTITION BY p.chapter_idx ORDER BY p.seq) AS cost FROM para p JOIN a USING (chapter_idx) LEFT JOIN lk USING (chapter_idx) WHERE p.seq BETWEEN anchor + 1 AND anchor + 3),
  rk AS (SELECT chapter_idx, sum(CASE WHEN cost <= 120 THEN 1 ELSE 0 END) AS rights FROM rgt GROUP BY ALL)
SELECT a.chapter_idx, anchor, coalesce(lefts, 0)::INT AS lefts, coalesce(rights, 0)::INT AS rights FROM a LEFT JOIN lk USING (chapter_idx) LEFT JOIN rk USING (chapter_idx)""")
def _(spark, sf):
    p = passages(spark, sf)
    anchors = p.groupBy("chapter_idx").agg(F.min_by("seq", F.struct(-F.col("n_words"), "seq")).alias("anchor"))
    return P.shrink_context(p.select("chapter_idx", "seq", "n_words"), anchors, ["chapter_idx"], "seq", "n_words", reach=3, budget=120)


# records and duplicates across overlapping spans


@query("scene_records", f"""WITH {EVENTS}, r AS (SELECT user_id, vol, event_type, min((ts, event_id)) AS f FROM ev GROUP BY ALL), n AS (SELECT user_id, vol, string_agg(event_type, '|' ORDER BY f) AS kinds FROM r GROUP BY ALL)
SELECT user_id, vol, round(least(min(value), min(k) / 1000.0), 6) AS confidence, any_value(kinds) AS kinds FROM ev JOIN n USING (user_id, vol) GROUP BY user_id, vol""")
def _(spark, sf):
    return P.span_records(log_events(spark, sf), ["user_id", "vol"], F.least(F.min("value"), F.min("k") / 1000.0), F.struct("ts", "event_id"), "event_type").withColumn("confidence", F.round("confidence", 6)).withColumn("kinds", F.array_join("kinds", "|"))


@query("quote_suppression", f"WITH {PASSAGES} SELECT chapter_idx, para_id, lower(trim(text)) AS quote FROM para QUALIFY row_number() OVER (PARTITION BY chapter_idx, lower(trim(text)) ORDER BY seq) = 1")
def _(spark, sf):
    p = passages(spark, sf).withColumn("quote", F.lower(F.trim("text")))
    return P.first_sight(p, ["chapter_idx", "quote"], ["seq"]).select("chapter_idx", "para_id", "quote")


# pages


@query("page_lead", f"""WITH {INTERVALS}, now AS (SELECT subject, value FROM iv WHERE vol_start <= 4 AND (vol_end IS NULL OR vol_end >= 4))
SELECT c_custkey, concat_ws(' · ', c_name, n_name, value) AS lead FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN now ON subject = c_custkey""")
def _(spark, sf):
    now = built(spark, sf).where("vol_start <= 4 and (vol_end is null or vol_end >= 4)").select(F.col("subject").alias("c_custkey"), "value")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(now, "c_custkey", "left")
    return c.select("c_custkey", P.lead_line("c_name", "n_name", "value").alias("lead"))


@query("page_traits", f"""WITH {PRIORITIES}, t AS (SELECT subject, value, min(vol) AS since, arg_max(claim_id % 5 <> 0, (vol, claim_id)) AS asserted FROM prio WHERE vol <= 4 AND NOT regexp_matches(value, 'NOT SPECIFIED') GROUP BY ALL)
SELECT subject, string_agg(value, '; ' ORDER BY since, value) AS traits FROM t WHERE asserted GROUP BY subject""")
def _(spark, sf):
    p = priority_claims(spark, sf).withColumn("polarity", F.when(F.col("claim_id") % 5 == 0, "denied").otherwise("asserted"))
    return P.trait_lines(p, 4, "NOT SPECIFIED")


@query("page_cited_evidence", f"""WITH {PRIORITIES}, e AS (SELECT subject, qualifier, list(claim_id ORDER BY claim_id) AS ids FROM prio GROUP BY ALL), named AS (SELECT subject, flatten(list(ids)) AS ids FROM e WHERE qualifier IN ('Q1', 'Q3') GROUP BY 1), every AS (SELECT subject, flatten(list(ids)) AS ids FROM e GROUP BY 1)
SELECT every.subject, array_to_string(list_sort(coalesce(named.ids, every.ids)), '|') AS evidence FROM every LEFT JOIN named USING (subject)""")
def _(spark, sf):
    cited = P.cited_or_all(priority_claims(spark, sf), "subject", "qualifier", ["Q1", "Q3"], "claim_id")
    return flat(cited.withColumn("evidence", F.array_sort("evidence")))


@query("page_markdown", f"""WITH {INTERVALS} SELECT subject, '# ' || subject || chr(10) || string_agg('- ' || value || ' (' || vol_start || coalesce('-' || vol_end, '') || ')', chr(10) ORDER BY vol_start, interval_id) AS page FROM iv WHERE vol_start <= 5 GROUP BY subject""")
def _(spark, sf):
    return P.markdown_page(built(spark, sf).where("vol_start <= 5"), "subject", "value")


@query("prompt_chapter_text", f"""WITH {PASSAGES}
SELECT chapter_idx, sha256('## ' || any_value(vol) || chr(10) || string_agg(text, chr(10) ORDER BY seq)) AS digest, count(*) AS n FROM para GROUP BY chapter_idx""")
def _(spark, sf):
    return P.headed_text(passages(spark, sf), "chapter_idx", "vol", "seq").select("chapter_idx", F.sha2("body", 256).alias("digest"), "n")


# verification


@query("verify_fact_set", f"""WITH {INTERVALS}, now AS (SELECT * FROM iv WHERE vol_start <= 4 AND (vol_end IS NULL OR vol_end >= 4))
SELECT interval_id, subject, value, array_to_string(list_slice(claim_ids, 1, 20), '|') AS quotes FROM now""")
def _(spark, sf):
    return flat(P.fact_set(built(spark, sf), 4, 20).select("interval_id", "subject", "value", "quotes"))


@query("verify_chunk_max", f"""WITH {DOCS}, w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d), c AS (SELECT doc_id, unnest(range((len(w) + 99) // 100)) AS i, w FROM w),
  s AS (SELECT doc_id, i, len(list_distinct(list_slice(w, i * 100 + 1, i * 100 + 100))) / len(list_slice(w, i * 100 + 1, i * 100 + 100)) AS score FROM c)
SELECT doc_id, count(*) AS chunks, round(max(score), 6) AS score, max(score) > 0.8 AS supported FROM s GROUP BY doc_id""")
def _(spark, sf):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chunks = P.word_chunks(docs(spark, sf).select("doc_id", words.alias("w")), "w", 100)
    return P.best_chunk(chunks.withColumn("score", F.size(F.array_distinct("chunk")) / F.size("chunk")), "doc_id", 0.8)


@query("verify_intervals", f"""WITH {INTERVALS}, s AS (SELECT c_custkey AS subject, (c_custkey % 10) / 10 AS score FROM customer WHERE c_acctbal >= 0)
SELECT interval_id, CASE WHEN score IS NULL THEN 'unscored' WHEN score > 0.5 THEN 'supported' ELSE 'unsupported' END AS verdict FROM iv LEFT JOIN s USING (subject)""")
def _(spark, sf):
    scores = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 10 / 10).alias("score"))
    return P.verdicts_by_score(built(spark, sf), scores, ["subject"], 0.5).select("interval_id", "verdict")


@query("verify_hypothesis", f"WITH {RELATIONS} SELECT claim_id, CASE WHEN predicate = 'OPPOSES' THEN 'It is not the case that ' ELSE '' END || replace(replace('{{s}} trades with {{o}}.', '{{s}}', subject), '{{o}}', object) AS text FROM rel")
def _(spark, sf):
    r = relation_claims(spark, sf)
    return r.select("claim_id", P.hypothesis(F.lit("{s} trades with {o}."), {"s": F.col("subject"), "o": F.col("object")}, F.col("predicate") == "OPPOSES").alias("text"))


# scoring


@query("score_heading_recall", r"""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS req FROM benchmark), g AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{4,}')))) AS have FROM conversations GROUP BY 1),
  e AS (SELECT item_id, unnest(req) AS w FROM b), h AS (SELECT conv_id, unnest(have) AS w FROM g), n AS (SELECT item_id, conv_id, count(*) AS common FROM e JOIN h USING (w) GROUP BY ALL)
SELECT b.item_id, round(coalesce(max(common) / any_value(len(req)), 0), 6) AS best, coalesce(max(common) / any_value(len(req)), 0) >= 0.3 AS found FROM b LEFT JOIN n USING (item_id) GROUP BY b.item_id""")
def _(spark, sf):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0))
    have = table(spark, sf, "conversations").select("conv_id", F.explode(words(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    return P.heading_recall(table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("req")), have, "item_id", "req", "conv_id", "w", 0.3)


@query("score_fact_precision", """WITH r AS (SELECT p_brand AS k, p_partkey AS fact, list_distinct(string_split(p_type, ' ')) AS req FROM part WHERE p_size = 1), e AS (SELECT p_brand AS k, list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS m FROM part WHERE p_size > 25)
SELECT fact, EXISTS (SELECT 1 FROM e WHERE e.k = r.k AND list_has_all(m, req)) AS violated FROM r""")
def _(spark, sf):
    p = table(spark, sf, "part")
    req = p.where("p_size = 1").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("fact"), F.array_distinct(F.split("p_type", " ")).alias("req"))
    have = p.where("p_size > 25").select(F.col("p_brand").alias("k"), F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("m"))
    return P.negative_facts(req, have, "k", "fact", "req", "m")


@query("score_dangling_citations", f"WITH {CLAIMS} SELECT claim_id FROM claims WHERE claim_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def _(spark, sf):
    return status_claims(spark, sf).select("claim_id").join(table(spark, sf, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("claim_id")), "claim_id", "left_anti")


@query("score_valid_keywords", r"""WITH k AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM benchmark), s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM conversations WHERE turn < 3)
SELECT item_id, w FROM k WHERE w NOT IN (SELECT w FROM s)""")
def _(spark, sf):
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0))
    marks = table(spark, sf, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("w"))
    seen = table(spark, sf, "conversations").where("turn < 3").select(F.explode(words(F.coalesce("text", F.lit("")))).alias("w"))
    return P.unseen(marks, seen, "w")


@query("score_unique_cells", "WITH s AS (SELECT label, vec_id, right(vec_id::VARCHAR, 2) AS part FROM embeddings) SELECT vec_id, label, part FROM s QUALIFY count(*) OVER (PARTITION BY label, part) = 1")
def _(spark, sf):
    cells = table(spark, sf, "embeddings").select("vec_id", "label", F.right(F.col("vec_id").cast("string"), F.lit(2)).alias("part"))
    return P.only_once(cells, ["label", "part"])


@query("score_pattern_misses", "SELECT quality, round(avg((text IS NULL OR NOT regexp_matches(text, '[.!?]$'))::INT), 6) AS missed, count(*) AS n FROM labels LEFT JOIN documents USING (doc_id) GROUP BY quality")
def _(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "left")
    missed = F.coalesce(~F.col("text").rlike("[.!?]$"), F.lit(True)).cast("int")
    return joined.groupBy("quality").agg(F.round(F.avg(missed), 6).alias("missed"), F.count(F.lit(1)).alias("n"))


@query("score_rates_by_kind", "SELECT role, round(avg((length(text) > 200)::INT), 4) AS long, round(avg(CASE WHEN turn > 0 THEN (text LIKE '%?%')::INT END), 4) AS asks, count(*) AS n FROM conversations GROUP BY role")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.round(F.avg((F.length("text") > 200).cast("int")), 4).alias("long"), F.round(F.avg(F.when(F.col("turn") > 0, F.col("text").contains("?").cast("int"))), 4).alias("asks"), F.count(F.lit(1)).alias("n"))


@query("score_miner_split", r"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents), s AS (SELECT lower(w) AS k, count(*) AS n, sum((w <> lower(w))::INT) AS up FROM w GROUP BY 1)
SELECT CASE WHEN n < 3 THEN 'few' WHEN up < 0.75 * n THEN 'ratio' ELSE 'kept' END AS cause, count(*) AS n FROM s GROUP BY 1""")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    return P.miner_split(w, "w", 3, 0.75).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@query("score_inflected_residue", r"""WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM benchmark), w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations)
SELECT name, count(*) AS n FROM w JOIN m ON left(w, 5) = left(name, 5) AND starts_with(w, name) AND w <> name GROUP BY name""")
def _(spark, sf):
    words = lambda t: t.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("w"))
    return P.inflected(words(table(spark, sf, "conversations")), words(table(spark, sf, "benchmark")).select(F.col("w").alias("name")).distinct())


# review packets, logs, snapshots


@query("review_answers", "SELECT event_type, sum((event_type IN ('click', 'view', 'purchase'))::INT)::BIGINT AS valid, sum((event_type NOT IN ('click', 'view', 'purchase'))::INT)::BIGINT AS invalid FROM events GROUP BY event_type")
def _(spark, sf):
    return P.validate_answers(table(spark, sf, "events"), "event_type", ["click", "view", "purchase"]).groupBy("event_type").agg(F.sum(F.col("valid").cast("int")).alias("valid"), F.sum((~F.col("valid")).cast("int")).alias("invalid"))


@query("snapshot_diff", f"""WITH {CLAIMS}, a AS (SELECT subject, max(value) AS v FROM claims WHERE vol <= 3 GROUP BY 1), b AS (SELECT subject, max(value) AS v FROM claims WHERE vol <= 4 GROUP BY 1)
SELECT coalesce(a.subject, b.subject) AS path, CASE WHEN a.subject IS NULL THEN 'added' WHEN b.subject IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.subject = b.subject WHERE a.v IS DISTINCT FROM b.v""")
def _(spark, sf):
    c = status_claims(spark, sf)
    at = lambda t: c.where(F.col("vol") <= t).groupBy(F.col("subject").alias("path")).agg(F.max("value").alias("v"))
    return P.snapshot_diff(at(3), at(4), "path", "v")


@query("derived_values_check", "WITH p AS (SELECT o_orderkey, o_totalprice AS printed FROM orders), r AS (SELECT l_orderkey AS o_orderkey, round(sum(l_extendedprice), 2) AS again FROM lineitem GROUP BY 1) SELECT o_orderkey FROM p JOIN r USING (o_orderkey) WHERE abs(printed - again) > 1000")
def _(spark, sf):
    again = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("again"))
    return table(spark, sf, "orders").join(again, "o_orderkey").where(F.abs(F.col("o_totalprice") - F.col("again")) > 1000).select("o_orderkey")


# audits


@query("audit_gazetteer", f"""WITH {CLAIMS}, f AS (SELECT subject, min(vol) AS first FROM claims GROUP BY 1)
SELECT c_custkey, CASE WHEN f.subject IS NULL THEN 'starved' WHEN 1 + c_nationkey % 5 < first THEN 'form_before_entity' END AS problem FROM customer LEFT JOIN f ON subject = c_custkey WHERE f.subject IS NULL OR 1 + c_nationkey % 5 < first""")
def _(spark, sf):
    first = status_claims(spark, sf).groupBy(F.col("subject").alias("entity")).agg(F.min("vol").alias("first"))
    forms = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), (F.col("c_nationkey") % 5 + 1).alias("form_first"))
    return P.audit_forms(forms, first).withColumnRenamed("entity", "c_custkey")


@query("audit_outline", f"WITH {PASSAGES}, c AS (SELECT chapter_idx, count(*) AS quotes, sum((n_words > 200)::INT) AS long FROM para GROUP BY 1) SELECT chapter_idx, quotes FROM c WHERE quotes > 40 OR long = 0 AND quotes > 10")
def _(spark, sf):
    c = passages(spark, sf).groupBy("chapter_idx").agg(F.count(F.lit(1)).alias("quotes"), F.sum((F.col("n_words") > 200).cast("int")).alias("long"))
    return c.where("quotes > 40 or long = 0 and quotes > 10").select("chapter_idx", "quotes")


@query("audit_eval_regression", "WITH a AS (SELECT label, avg((vec_id % 3 = 0)::INT) AS p FROM embeddings GROUP BY 1), b AS (SELECT label, avg((vec_id % 4 = 0)::INT) AS p FROM embeddings GROUP BY 1) SELECT label, round(b.p - a.p, 6) AS delta FROM a JOIN b USING (label) WHERE b.p < a.p - 0.05")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    rate = lambda n: e.groupBy("label").agg(F.avg((F.col("vec_id") % n == 0).cast("int")).alias("p"))
    return P.regressions(rate(3), rate(4), ["label"], "p", 0.05)


@query("audit_pages", r"SELECT vol, count(*) AS pages, sum((sentences < 2)::INT)::BIGINT AS short, sum((sentences > 40)::INT)::BIGINT AS long FROM (SELECT (doc_id % 5 + 1)::INT AS vol, len(regexp_extract_all(text, '[^.!?][.!?]')) AS sentences FROM documents WHERE text IS NOT NULL) GROUP BY vol")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select((F.col("doc_id") % 5 + 1).cast("int").alias("vol"), F.regexp_count("text", F.lit("[^.!?][.!?]")).alias("sentences"))
    return d.groupBy("vol").agg(F.count(F.lit(1)).alias("pages"), F.sum((F.col("sentences") < 2).cast("int")).alias("short"), F.sum((F.col("sentences") > 40).cast("int")).alias("long"))


# names


@query("name_presence", f"WITH {CLAIMS}, f AS (SELECT subject, min(vol) AS first FROM claims GROUP BY 1) SELECT c_custkey, coalesce(first <= 2, false) OR c_comment_has AS present FROM (SELECT c_custkey, regexp_matches(c_name, '\\b000000[0-4]') AS c_comment_has FROM customer) LEFT JOIN f ON subject = c_custkey")
def _(spark, sf):
    first = status_claims(spark, sf).groupBy(F.col("subject").alias("c_custkey")).agg(F.min("vol").alias("first"))
    c = table(spark, sf, "customer").join(first, "c_custkey", "left")
    return c.select("c_custkey", (F.coalesce(F.col("first") <= 2, F.lit(False)) | F.col("c_name").rlike(r"\b000000[0-4]")).alias("present"))


@query("name_self_and_paratext_drop", f"WITH {RELATIONS} SELECT claim_id FROM rel WHERE subject <> object AND subject NOT IN ('FRANCE', 'GERMANY') AND object NOT IN ('FRANCE', 'GERMANY')")
def _(spark, sf):
    return P.drop_paratext(relation_claims(spark, sf), ["FRANCE", "GERMANY"]).select("claim_id")


@query("name_page_map", """SELECT DISTINCT c_custkey, s_suppkey, how FROM (SELECT c_custkey, s_suppkey, 'number' AS how FROM customer JOIN supplier ON right(c_name, 9) = right(s_name, 9) UNION ALL
  SELECT c_custkey, s_suppkey, 'slug' FROM customer JOIN supplier ON trim(regexp_replace(lower(replace(c_name, 'Customer', 'x')), '[^a-z0-9]+', '-', 'g'), '-') = trim(regexp_replace(lower(replace(s_name, 'Supplier', 'x')), '[^a-z0-9]+', '-', 'g'), '-'))""")
def _(spark, sf):
    from tessera.functions.text import slug

    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    keys = {"number": (F.right("c_name", F.lit(9)), F.right("s_name", F.lit(9))), "slug": (slug(F.replace("c_name", F.lit("Customer"), F.lit("x"))), slug(F.replace("s_name", F.lit("Supplier"), F.lit("x"))))}
    return P.propose_map(c, s, "c_custkey", "s_suppkey", keys)


@query("name_marker_classes", r"""WITH x AS (SELECT unnest(regexp_extract_all(lower(text), '(?:the|of|in|and) [a-z]{4,}')) AS m FROM documents), c AS (SELECT string_split(m, ' ')[2] AS name, string_split(m, ' ')[1] AS marker, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= 2)
SELECT name, count(*) AS classes FROM c GROUP BY name HAVING count(*) >= 2""")
def _(spark, sf):
    return P.names_of_several_markers(table(spark, sf, "documents"), "text", ["the", "of", "in", "and"], "[a-z]{4,}")


@query("text_name_like", f"WITH {PASSAGES} SELECT para_id, NOT regexp_matches(text, '(?i)^(a|an|the)([^\\p{{L}}]|$)') AND len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[A-Z]') AND w <> 'The')) > 0 AS name_like, len(list_filter(list_slice(string_split(text, ' '), 2, 100000), lambda w: regexp_matches(w, '^[A-Z]'))) > 0 AS names_someone FROM para")
def _(spark, sf):
    return passages(spark, sf).select("para_id", P.name_like(F.col("text")).alias("name_like"), P.names_someone(F.col("text")).alias("names_someone"))


@query("text_monologue", r"SELECT page_id, len(regexp_extract_all(html, '<p[^>]*>\s*<em>[^<]*</em>\s*</p>')) AS monologues FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit(r"<p[^>]*>\s*<em>[^<]*</em>\s*</p>")).alias("monologues"))


@query("text_image_strip", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<img[^>]*alt=\"([^\"]*)\"[^>]*>', '\1', 'g'), '<img[^>]*>', '', 'g')) AS digest FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(P.images_to_text(F.col("html"))).alias("digest"))


@query("text_answer_parsing", r"SELECT conv_id, turn, trim(regexp_extract(text, '(?s)^(.*?)[.:!?]', 1), ' \"''') AS answer, regexp_matches(lower(text), '^(no evidence|not stated|unknown)') AS none_given, trim(regexp_replace(text, '(?s)\s*\(.*$', '')) AS label FROM conversations")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", P.answer(F.col("text")).alias("answer"), P.no_evidence(F.col("text")).alias("none_given"), P.before_bracket(F.col("text")).alias("label"))


@query("text_pointer_key", "SELECT page_id, '/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), P.pointer_key(F.col("url"))).alias("pointer"))


@query("text_vocab_lines", "SELECT r_name, string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS lines FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.vocab_lines(n, "r_name", "n_name")


@query("text_markdown_plain", r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`#>]+', '', 'g'), '\s+', ' ', 'g')) AS digest FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(P.plain_markdown(F.col("text"))).alias("digest"))


@query("reader_context", f"""WITH {INTERVALS}, s AS (SELECT subject, interval_id, evidence_count, sum(evidence_count * 40) OVER (PARTITION BY subject ORDER BY vol_start, interval_id) AS tokens, row_number() OVER (PARTITION BY subject ORDER BY vol_start, interval_id) AS r FROM iv WHERE vol_start <= 4)
SELECT subject, interval_id FROM s WHERE tokens <= 100 OR r = 1""")
def _(spark, sf):
    rows = built(spark, sf).where("vol_start <= 4").withColumn("tokens", F.col("evidence_count") * 40)
    return P.within_budget(rows, ["subject"], ["vol_start", "interval_id"], "tokens", 100).select("subject", "interval_id")


@query("cumulative_evidence_on_change", f"""WITH {EVENTS}, u AS (SELECT DISTINCT user_id, vol FROM ev), s AS (SELECT user_id, vol, (SELECT string_agg(x.event_id::VARCHAR, '|' ORDER BY x.event_id) FROM (SELECT event_id FROM ev y WHERE y.user_id = u.user_id AND y.vol <= u.vol ORDER BY k DESC, event_id LIMIT 3) x) AS ids FROM u)
SELECT user_id, vol, ids FROM s QUALIFY ids IS DISTINCT FROM lag(ids) OVER (PARTITION BY user_id ORDER BY vol)""")
def _(spark, sf):
    return P.evidence_on_change(log_events(spark, sf), "user_id", "vol", "k", "event_id", 3)


# extraction, inventories, mentions over the corpus


@query("extract_windows", f"""WITH {EVENTS}, e AS (SELECT user_id, event_id, event_type, value, vol, CASE WHEN lag(event_id) OVER w IS NULL OR event_id - lag(event_id) OVER w > 400 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM e), n AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL),
  c AS (SELECT user_id, session, greatest(2, round_even(3::DOUBLE * count(*) OVER w * sqrt(n) / sum(sqrt(n)) OVER w, 0)) AS cap FROM n WINDOW w AS (PARTITION BY user_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY value DESC, event_id) AS rn FROM s JOIN c USING (user_id, session))
SELECT user_id, event_type, max(value) AS confidence, min(vol) AS first_vol, count(*) AS n FROM r WHERE rn <= cap GROUP BY ALL""")
def _(spark, sf):
    kept = P.extract_windows(log_events(spark, sf), ["user_id"], "event_id", 400, "value", 3.0, 2)
    return kept.groupBy("user_id", "event_type").agg(F.max("value").alias("confidence"), F.min("vol").alias("first_vol"), F.count(F.lit(1)).alias("n"))


@query("score_assertion_inventory", f"""WITH {INTERVALS}, r AS (SELECT subject, value || ' (' || vol_start || coalesce('-' || vol_end, '') || ')' AS text, row_number() OVER (PARTITION BY subject ORDER BY vol_start, interval_id) AS line FROM iv)
SELECT subject, line::INT AS line, subject::VARCHAR AS section, 'bullet' AS kind, text FROM r""")
def _(spark, sf):
    return P.assertions(P.markdown_page(built(spark, sf), "subject", "value"), "subject", "page")


CORPUS_FORMS = "forms AS (SELECT w AS text, min(item_id) AS entity FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM benchmark) GROUP BY w)"


@query("mention_counts_by_volume", f"""WITH {PASSAGES}, {CORPUS_FORMS}, t AS (SELECT vol, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}''’]+')) AS text FROM para)
SELECT entity, vol, count(*) AS n FROM t JOIN forms USING (text) GROUP BY ALL""")
def _(spark, sf):
    from tessera.operators.mentions import find_mentions

    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0)).alias("text"))
    forms = words.groupBy("text").agg(F.min("item_id").alias("entity"))
    rows = passages(spark, sf)
    found = find_mentions(rows, forms).join(rows.select("para_id", "vol"), "para_id")
    return found.groupBy("entity", "vol").agg(F.count(F.lit(1)).alias("n"))


@query("name_appositive_pairs", r"""WITH m AS (SELECT unnest(regexp_extract_all(lower(text), '([a-z]{4,}), ([a-z]{4,}) of')) AS m FROM documents)
SELECT regexp_extract(m, '([a-z]{4,}), ([a-z]{4,}) of', 1) AS a, regexp_extract(m, '([a-z]{4,}), ([a-z]{4,}) of', 2) AS b, count(*) AS n FROM m WHERE a <> b GROUP BY ALL""")
def _(spark, sf):
    return P.appositive_pairs(table(spark, sf, "documents"), "text", "([a-z]{4,}), ([a-z]{4,}) of")


@query("name_core", r"SELECT c_custkey, regexp_replace(list_aggregate(list_filter(string_split(lower(c_name), '#'), lambda w: w <> 'customer'), 'string_agg', ' '), '^0+(.)', '\1') AS core FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", P.name_core(F.col("c_name"), ["customer"]).alias("core"))


@query("name_words_pair_up", """WITH w AS (SELECT p_partkey AS k, list_distinct(string_split(lower(p_type), ' ')) AS w FROM part), p AS (SELECT a.k, list_filter(a.w, lambda x: NOT list_contains(b.w, x)) AS one, list_filter(b.w, lambda x: NOT list_contains(a.w, x)) AS two FROM w a JOIN w b ON b.k = a.k + 1),
  x AS (SELECT k, unnest(one) AS x, two AS o, 1 AS side FROM p UNION ALL SELECT k, unnest(two), one, 2 FROM p), y AS (SELECT k, x, side, unnest(CASE WHEN len(o) = 0 THEN [NULL] ELSE o END) AS y FROM x),
  ok AS (SELECT k, x, side, coalesce(max(((1 - levenshtein(x, y) / greatest(length(x), length(y))) * 100 >= 80)::INT), 0) AS ok FROM y GROUP BY ALL)
SELECT p.k, coalesce(min(ok), 1) = 1 AS pair FROM p LEFT JOIN ok USING (k) GROUP BY p.k""")
def _(spark, sf):
    words = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("w"))
    after = words.select((F.col("k") - 1).alias("k"), F.col("w").alias("v"))
    return words.join(after, "k").select("k", P.words_pair_up(F.col("w"), F.col("v")).alias("pair"))


@query("text_vocatives", f"WITH {PASSAGES} SELECT para_id, len(regexp_extract_all(text, '(?:^|[\"“])[A-Z][a-z]+,')) AS n FROM para")
def _(spark, sf):
    return passages(spark, sf).select("para_id", P.vocatives(F.col("text")).alias("n"))


@query("sink_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    from tessera.operators.lineage import scratch
    from tessera.sources.store import write_json_lines

    rows, path = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), scratch(spark, "lines")
    write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("sink_call_log", "SELECT role AS stage, count(*) AS calls, sum(length(text))::BIGINT AS size FROM conversations GROUP BY role")
def _(spark, sf):
    from tessera.operators.lineage import scratch
    from tessera.sources.store import append

    path, c = scratch(spark, "calls"), table(spark, sf, "conversations")
    for stage in ("user", "assistant", "system", "tool"):
        append(c.where(F.col("role") == stage).select(F.col("role").alias("stage"), "text"), path)
    append(c.where(~F.col("role").isin("user", "assistant", "system", "tool")).select(F.col("role").alias("stage"), "text"), path)
    return spark.read.parquet(path).groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).alias("size"))


@query("sink_site_tree", f"""WITH {RELATIONS}, t AS (SELECT unnest(range(vol, 8)) AS cutoff, * FROM rel), p AS (SELECT cutoff, subject, count(*) AS n, string_agg('- ' || predicate || ' ' || object || ' (' || vol || ') [' || claim_id || ']', chr(10) ORDER BY vol, claim_id) AS lines FROM t GROUP BY ALL)
  SELECT cutoff::INT AS cutoff, lower(replace(subject, ' ', '-')) AS slug, md5('---' || chr(10) || 'title: ' || subject || chr(10) || 'cutoff: ' || cutoff || chr(10) || 'claims: ' || n || chr(10) || '---' || chr(10) || chr(10) || '# ' || subject || chr(10) || chr(10) || lines) AS digest FROM p""")
def _(spark, sf):
    from tessera.operators.lineage import scratch
    from tessera.sources.store import read_tree, write_tree

    rel = relation_claims(spark, sf).where("vol <= 7").withColumn("cutoff", F.explode(F.sequence("vol", F.lit(7))))
    line = F.format_string("- %s %s (%d) [%s]", "predicate", "object", "vol", "claim_id")
    lines = F.array_sort(F.collect_list(F.struct("vol", "claim_id", line.alias("line"))))
    p = rel.groupBy("cutoff", "subject").agg(F.count(F.lit(1)).alias("n"), lines.alias("lines"))
    page = F.concat(P.front_matter({"title": F.col("subject"), "cutoff": F.col("cutoff"), "claims": F.col("n")}), F.lit("\n# "), "subject", F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    path = scratch(spark, "site")
    write_tree(p.select("cutoff", F.lower(F.replace("subject", F.lit(" "), F.lit("-"))).alias("slug"), page.alias("page")), path)
    return read_tree(spark, path).select("cutoff", "slug", F.md5("page").alias("digest"))
