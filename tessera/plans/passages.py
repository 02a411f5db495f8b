"""Pages and documents to passages; scalar text functions; mining and mentions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import mentions as M
from tessera.operators import sequences as S
from tessera.plans.core import flat
from tessera.plans.registry import query
from tessera.sources import epub, html
from tessera.sources.tables import PASSAGES, passages, table

SPLIT = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\x0b\f\r\n]+'), lambda x: x <> '')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("ingest_passages", f"WITH {PASSAGES} SELECT para_id, vol, chapter_idx, seq, n_words, md5(text) AS digest FROM para")
def _(spark, sf):
    return passages(spark, sf).select("para_id", "vol", "chapter_idx", "seq", "n_words", F.md5("text").alias("digest"))


@query("ingest_manifest", f"WITH {PASSAGES} SELECT vol, count(DISTINCT chapter_idx) AS n_chapters, count(*) AS n_paragraphs, sum(n_words)::BIGINT AS n_words FROM para GROUP BY vol")
def _(spark, sf):
    return passages(spark, sf).groupBy("vol").agg(F.countDistinct("chapter_idx").alias("n_chapters"), F.count(F.lit(1)).alias("n_paragraphs"), F.sum("n_words").alias("n_words"))


@query("ingest_corpus_totals", f"WITH {PASSAGES} SELECT vol, count(*) AS n, sum(n_words)::BIGINT AS words FROM para GROUP BY ROLLUP (vol)")
def _(spark, sf):
    return passages(spark, sf).rollup("vol").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))


@query("ingest_prefix_scan", f"WITH {PASSAGES} SELECT para_id, n_words FROM para WHERE vol <= 2")
def _(spark, sf):
    return passages(spark, sf).where("vol <= 2").select("para_id", "n_words")


@query("ingest_lookup_by_id", f"WITH {PASSAGES} SELECT para_id, md5(text) AS digest FROM para WHERE chapter_idx IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, sf):
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chapter_idx")).distinct()
    return passages(spark, sf).join(ids, "chapter_idx", "left_semi").select("para_id", F.md5("text").alias("digest"))


@query("ingest_chapter_documents", f"WITH {PASSAGES} SELECT vol, chapter_idx, md5(string_agg('[' || para_id || '] ' || text, chr(10) ORDER BY seq)) AS digest, count(*) AS n FROM para GROUP BY ALL")
def _(spark, sf):
    rows = passages(spark, sf).groupBy("vol", "chapter_idx").agg(F.array_sort(F.collect_list(F.struct("seq", "para_id", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda p: F.concat(F.lit("["), p["para_id"], F.lit("] "), p["text"])), "\n")
    return rows.select("vol", "chapter_idx", F.md5(joined).alias("digest"), F.size("p").alias("n"))


@query("ingest_heading_tag", r"WITH c AS (SELECT sum(len(regexp_extract_all(lower(html), '<h1[\s>]'))) AS h1, sum(len(regexp_extract_all(lower(html), '<h2[\s>]'))) AS h2, sum(len(regexp_extract_all(lower(html), '<h3[\s>]'))) AS h3 FROM pages) SELECT CASE WHEN h1 >= 2 THEN 'h1' WHEN h2 >= 2 THEN 'h2' WHEN h3 >= 2 THEN 'h3' ELSE 'h1' END AS tag FROM c")
def _(spark, sf):
    return html.heading_tag(table(spark, sf, "pages"))


@query("ingest_metadata", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), 'Untitled') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def _(spark, sf):
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return table(spark, sf, "pages").select("page_id", F.when(title != "", title).otherwise("Untitled").alias("title"), F.when(lang != "", lang).alias("lang"))


@query("ingest_html_paragraphs")
def _(spark, sf):
    return html.paragraphs(table(spark, sf, "pages"))


@query("ingest_html_headings", r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS heading FROM pages WHERE regexp_extract(html, '<h1>(.*?)</h1>', 1) <> ''""")
def _(spark, sf):
    return html.paragraphs(table(spark, sf, "pages")).where("tag = 'h1'").select("page_id", F.col("text").alias("heading"))


@query("ingest_epub_chapters", r"""WITH h AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM pages)
  SELECT 'v' || page_id // 25 || '.epub' AS path, row_number() OVER (PARTITION BY page_id // 25 ORDER BY page_id) AS chapter, title FROM h WHERE title <> ''""")
def _(spark, sf):
    from pyspark.sql import Window

    # books of 25 pages; after each page comes one of its own paragraphs without a heading, then an art plate
    pages = table(spark, sf, "pages").select(F.expr("'v' || page_id div 25").alias("book"), F.posexplode(F.array("html", F.lit("<p>It goes on, and on, for more than ten words, as prose does.</p><img src='a'/>"), F.lit("<img src='b'/><p>A plate.</p>"))).alias("part", "html"), "page_id")
    parts = epub.chapters(epub.containers(pages.withColumn("place", F.col("page_id") * 3 + F.col("part")), "book", "place", "html"))
    found = parts.where("chapter_title IS NOT NULL").select("path", "chapter_idx", F.col("chapter_title").alias("title")).distinct()
    return found.select("path", F.row_number().over(Window.partitionBy("path").orderBy("chapter_idx")).alias("chapter"), "title")


@query("ingest_chapter_kind", """SELECT doc_id, CASE WHEN upper(trim(t)) LIKE 'THE %' THEN 'article' WHEN regexp_matches(t, '^[A-Z ]+$') THEN 'shout' WHEN length(t) < 40 THEN 'short' ELSE 'chapter' END AS kind FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)""")
def _(spark, sf):
    t = F.split_part("text", F.lit("\n"), F.lit(1))
    kind = F.when(F.upper(F.trim(t)).startswith("THE "), "article").when(t.rlike("^[A-Z ]+$"), "shout").when(F.length(t) < 40, "short").otherwise("chapter")
    return docs(spark, sf).select("doc_id", kind.alias("kind"))


@query("ingest_speech_channel", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'machine' WHEN starts_with(trim(text), '\"') THEN 'dialogue' WHEN role = 'user' THEN 'asker' ELSE 'narration' END AS speech FROM conversations")
def _(spark, sf):
    speech = F.when(F.col("role") == "system", "machine").when(F.trim("text").startswith('"'), "dialogue").when(F.col("role") == "user", "asker").otherwise("narration")
    return table(spark, sf, "conversations").select("conv_id", "turn", speech.alias("speech"))


@query("ingest_reading_slice", "WITH s AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part, role FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) - 1 AS place FROM s WHERE part = 1")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("part", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("part = 1")
    return rows.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("place"))


@query("ingest_chapter_labels", "SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN left(text, 20) ELSE 'Untitled ' || sum(CASE WHEN length(text) % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) END AS label FROM conversations")
def _(spark, sf):
    titled = F.length("text") % 3 == 0
    n = F.sum(F.when(titled, 0).otherwise(1)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(titled, F.left("text", F.lit(20))).otherwise(F.concat(F.lit("Untitled "), n.cast("string"))).alias("label"))


@query("text_tidy", r"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '[ \t\x0b\f\r\n]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.tidy(F.col("text"))).alias("digest"))


@query("text_unescape", "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS digest FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.unescape(F.col("html"))).alias("digest"))


@query("text_word_count", f"SELECT doc_id, len({SPLIT.format('text')}) AS n FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("text_slug", "WITH t AS (SELECT doc_id, text AS t FROM documents), s AS (SELECT doc_id, trim(regexp_replace(translate(replace(replace(replace(lower(t), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'àáâäãåçèéêëìíîïñòóôöõùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t) SELECT doc_id, CASE WHEN slug = '' THEN 'entity' ELSE slug END AS slug FROM s")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("text_token_estimates", "SELECT doc_id, greatest(1, length(text) // 4)::INT AS low, ceil(length(text) / 4)::INT AS high FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("low"), T.token_estimate(F.col("text"), round_up=True).alias("high"))


@query("text_sentence_count", r"SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(len(regexp_extract_all(text, '[^.!?]+[.!?]')), 1) END AS n FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", T.sentence_count(F.col("text")).alias("n"))


@query("text_ngrams_kept", f"""WITH p AS (SELECT doc_id, list_transform({SPLIT.format('lower(text)')}, lambda x: x) AS w, len(text) AS n, text FROM documents), q AS (SELECT doc_id, w, {SPLIT.format('lower(left(text, length(text) // 2))')} AS v FROM p),
  g AS (SELECT doc_id, list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, greatest(len(w) - 2, 1)) IF len(w) >= 4]) AS a, list_distinct([array_to_string(v[i:i+3], ' ') FOR i IN range(1, greatest(len(v) - 2, 1)) IF len(v) >= 4]) AS b FROM q)
SELECT doc_id, round(CASE WHEN len(a) < 5 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 9) AS kept FROM g""")
def _(spark, sf):
    half = F.expr("left(text, cast(floor(length(text) / 2) as int))")
    return docs(spark, sf).select("doc_id", F.round(T.ngrams_kept(F.col("text"), half), 9).alias("kept"))


@query("text_keywords", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), lambda w: regexp_replace(w, '''s$', '')), lambda w: length(w) >= 4))), '|') AS words FROM benchmark")
def _(spark, sf):
    return flat(table(spark, sf, "benchmark").select("item_id", T.keywords(F.col("text")).alias("words")))


@query("text_number_fold", "SELECT * FROM (VALUES (1, '25'), (2, '25'), (3, '25'), (4, '25-30'), (5, '3'), (6, 'young'), (7, '40-45'), (8, '17-19-21')) AS t(i, n)")
def _(spark, sf):
    cases = [(1, "25"), (2, "twenty-five"), (3, "twenty-five years old"), (4, "twenty-five to thirty"), (5, "three"), (6, "young"), (7, "forty to forty-five"), (8, "17-19 or 21")]
    return spark.createDataFrame(cases, "i int, t string").select("i", T.number_or_range(F.col("t")).alias("n"))


@query("text_conversation_context", "SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS digest FROM conversations")
def _(spark, sf):
    return S.neighbourhood(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text", 2).select("conv_id", "turn", F.md5("context").alias("digest"))


MINED = rf"{PASSAGES}, found AS (SELECT para_id, vol, unnest(regexp_extract_all(text, '\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+){{0,3}}')) AS surface FROM para)"


@query("mine_candidates", f"""WITH {MINED}, e AS (SELECT surface, para_id FROM (SELECT DISTINCT surface, para_id FROM found) QUALIFY row_number() OVER (PARTITION BY surface ORDER BY para_id) <= 40)
SELECT surface, n, first_vol, vols, evidence FROM (SELECT surface, count(*) AS n, min(vol) AS first_vol, string_agg(DISTINCT vol::VARCHAR, '|' ORDER BY vol::VARCHAR) AS vols FROM found GROUP BY surface) JOIN (SELECT surface, md5(string_agg(para_id, '|' ORDER BY para_id)) AS evidence FROM e GROUP BY surface) USING (surface) WHERE n >= 3""")
def _(spark, sf):
    c = M.mine_candidates(passages(spark, sf)).where("n >= 3")
    return c.select("surface", "n", "first_vol", F.array_join(F.transform("vols", lambda v: v.cast("string")), "|").alias("vols"), F.md5(F.array_join("evidence", "|")).alias("evidence"))


@query("mine_top_candidates", f"WITH {MINED} SELECT surface, count(*) AS n FROM found GROUP BY surface ORDER BY n DESC, surface LIMIT 50")
def _(spark, sf):
    return M.mine_candidates(passages(spark, sf)).orderBy(F.desc("n"), "surface").select("surface", "n").limit(50)


@query("mine_capitalisation", rf"""WITH {MINED}, s AS (SELECT surface FROM found WHERE NOT contains(surface, ' ') GROUP BY surface HAVING count(*) >= 3),
  w AS (SELECT vol, w, lower(w) AS key, count(*) AS n FROM (SELECT vol, unnest(regexp_extract_all(text, '\p{{L}}+')) AS w FROM para) GROUP BY ALL),
  r AS (SELECT surface, vol, sum(CASE WHEN w = surface THEN n ELSE 0 END) / sum(n) AS ratio FROM w JOIN s ON key = lower(surface) GROUP BY ALL)
SELECT surface, round(max(ratio), 9) AS ratio FROM r GROUP BY surface HAVING max(ratio) >= 0.75""")
def _(spark, sf):
    p = passages(spark, sf)
    s = M.mine_candidates(p).where("n >= 3 and instr(surface, ' ') = 0").select("surface")
    return M.usually_capitalised(p, s).select("surface", F.round("ratio", 9).alias("ratio"))


FORMS = "forms AS (SELECT DISTINCT n_name AS text, n_nationkey AS entity FROM nation)"


def spoken(spark, sf):
    """Short texts in which nations are named: comments about orders."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").cast("string").alias("para_id"), F.concat(F.col("c_name"), F.lit(" of "), F.col("n_name"), F.lit(" met NATION_1, not xNATION_2.")).alias("text"))


@query("mention_scan", "SELECT c_custkey::VARCHAR AS para_id, n_nationkey AS entity, n_name AS surface, (length(c_name) + 4)::INT AS start, (length(c_name) + 4 + length(n_name))::INT AS \"end\" FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey::VARCHAR, 1, 'NATION_1', (length(c_name) + 9 + length(n_name))::INT, (length(c_name) + 17 + length(n_name))::INT FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    forms = table(spark, sf, "nation").select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("entity"))
    return M.find_mentions(spoken(spark, sf), forms)


@query("mention_resolve", f"""WITH {FORMS}, t AS (SELECT DISTINCT 'the ' || n_name AS text FROM nation UNION SELECT n_name FROM nation UNION SELECT 'nobody') SELECT text, (SELECT entity FROM forms WHERE forms.text = replace(t.text, 'the ', '')) AS entity FROM t""")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    forms = nation.select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("entity"))
    texts = nation.select(F.concat(F.lit("the "), F.col("n_name")).alias("text")).union(nation.select("n_name")).union(nation.limit(1).select(F.lit("nobody")))
    return M.resolve(texts, forms)


@query("mention_owned_forms", "SELECT p_brand AS text, min(p_size) AS entity FROM part GROUP BY ALL")
def _(spark, sf):
    forms = table(spark, sf, "part").select(F.col("p_brand").alias("text"), F.col("p_size").alias("entity")).distinct()
    return M.owned_forms(forms)


@query("mention_votes", """WITH v AS (SELECT user_id % 40 AS key, CASE WHEN event_type IN ('view', 'click', 'error', 'purchase') AND user_id % 40 < 30 THEN 'main' ELSE event_type END AS entity, count(*) AS votes FROM events GROUP BY ALL),
  w AS (SELECT *, sum(votes) OVER (PARTITION BY key) AS total FROM v) SELECT key, entity, votes FROM w WHERE votes >= 2 * (total - votes)""")
def _(spark, sf):
    key = F.col("user_id") % 40
    main = F.col("event_type").isin("view", "click", "error", "purchase") & (key < 30)
    return M.votes(table(spark, sf, "events").select(key.alias("key"), F.when(main, "main").otherwise(F.col("event_type")).alias("entity")), "key", "entity")
