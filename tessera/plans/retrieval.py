"""BM25, cosine, fusion, budgets, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import sequences as S
from tessera.plans.registry import query
from tessera.sources.tables import table

BM25 = """dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS len FROM documents),
  q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM benchmark), tf AS (SELECT term, doc_id, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
  st AS (SELECT count(*) AS n, avg(len) AS mean FROM dl),
  score AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st JOIN q USING (term) GROUP BY ALL)"""
RANKED = f"{BM25}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM score)"
COS = """cs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


def searched(spark, sf, top):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.ranked(R.bm25(table(spark, sf, "documents").select("doc_id", "text"), queries, top=top), top)


def near(spark, sf, top):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vector"))
    return R.nearest_of_label(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), e, top)


@query("retr_bm25_topk", f"WITH {RANKED} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 20")
def _(spark, sf):
    return searched(spark, sf, 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("retr_cosine_same_label", f"WITH {COS} SELECT query_id, doc_id, round(score, 6) AS score FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10")
def _(spark, sf):
    return R.ranked(near(spark, sf, 10), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("retr_rank_fusion", f"""WITH {RANKED}, two AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM (SELECT query_id, doc_id, abs(doc_id - 10 * query_id) AS score FROM ranked WHERE rank <= 200))
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 200 UNION ALL SELECT query_id, doc_id, rank FROM two WHERE rank <= 50) GROUP BY ALL""")
def _(spark, sf):
    one = searched(spark, sf, 200)
    two = R.ranked(one.select("query_id", "doc_id", (-F.abs(F.col("doc_id") - 10 * F.col("query_id"))).cast("double").alias("score")), 50)
    return R.fuse([one, two]).withColumn("score", F.round("score", 9))


@query("retr_fill_budget", f"""WITH RECURSIVE {RANKED}, n AS (SELECT query_id, doc_id, rank, n_chars // 4 AS size FROM ranked JOIN documents USING (doc_id) WHERE rank <= 30),
  g AS (SELECT *, CASE WHEN size <= 2000 THEN size ELSE 0 END AS used, size <= 2000 AS taken FROM n WHERE rank = 1 UNION ALL
        SELECT n.*, g.used + CASE WHEN g.used + n.size <= 2000 THEN n.size ELSE 0 END, g.used + n.size <= 2000 FROM g JOIN n ON n.query_id = g.query_id AND n.rank = g.rank + 1)
SELECT query_id, doc_id, rank FROM g WHERE taken""")
def _(spark, sf):
    top = searched(spark, sf, 30).select("query_id", "doc_id", "rank").join(table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("size")), "doc_id")
    out = S.fill_skipping(top, ["query_id"], [F.col("rank")], "size", 2000, "doc_id")
    return out.where("taken").select("query_id", "doc_id", "rank")


@query("retr_leader_clusters")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 64).alias("k"), "vec_id", "embedding")
    return R.leaders(e, ["k"], "vec_id", "embedding", 0.2)


@query("retr_word_overlap", """WITH d AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM conversations), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS w FROM benchmark),
  n AS (SELECT item_id, conv_id, turn, count(*) AS shared FROM d JOIN q USING (w) GROUP BY ALL) SELECT item_id, conv_id, turn, shared FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, conv_id, turn) <= 3""")
def _(spark, sf):
    words = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(R.tokens(F.col("text")))).alias("w"))
    pairs = words(table(spark, sf, "conversations"), "conv_id", "turn").join(words(table(spark, sf, "benchmark"), "item_id"), "w")
    shared = pairs.groupBy("item_id", "conv_id", "turn").agg(F.count(F.lit(1)).alias("shared"))
    return S.top_k(shared, ["item_id"], [F.desc("shared"), F.col("conv_id"), F.col("turn")], 3).drop("rank")


@query("retr_facet_queries", "SELECT n_name || ' ' || r_name AS facet FROM nation CROSS JOIN region")
def _(spark, sf):
    # a catalog of facets times a cast: both configuration
    facets = [r["r_name"] for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]
    return table(spark, sf, "nation").select(F.explode(F.array(*[F.concat(F.col("n_name"), F.lit(f" {f}")) for f in facets])).alias("facet"))
