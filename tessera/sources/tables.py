"""Readers of the base tables and the neutral views over them.

Each view also has its SQL, for the oracles: a named common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-valued claim an order: the status of its customer in that year."""
    orders = table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_totalprice").alias("top"))
    return orders.join(F.broadcast(top)).select(  # one row
        F.col("o_custkey").alias("subject"), F.lit("STATUS").alias("predicate"), F.col("o_orderstatus").alias("value"),
        (F.year("o_orderdate") - 1994).alias("vol"), F.col("o_orderkey").alias("claim_id"),
        F.round(F.col("o_totalprice") / F.col("top"), 6).alias("confidence"),
    )


def priority_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multi-valued claim an order: a priority its customer has asked for."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("subject"), F.lit("PRIORITY").alias("predicate"), F.col("o_orderpriority").alias("value"),
        (F.year("o_orderdate") - 1994).alias("vol"), F.col("o_orderkey").alias("claim_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"))).alias("qualifier"),
        F.round(F.col("o_totalprice") / 1e6, 6).alias("confidence"),
    )


def relation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between nations by year: a pair opposes or trades, and may be said to do both."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    nation = table(spark, sf_dir, "nation")
    joined = line.join(orders, "l_orderkey").join(customer, "c_custkey").join(supplier, "l_suppkey")
    joined = joined.join(nation.select(F.col("n_nationkey").alias("sn"), F.col("n_name").alias("subject")), "sn").join(nation.select(F.col("n_nationkey").alias("cn"), F.col("n_name").alias("object")), "cn")
    keys = ["subject", "object", "predicate", "vol"]
    rows = joined.select("subject", "object", F.when(F.col("l_returnflag") == "R", "OPPOSES").otherwise("TRADES_WITH").alias("predicate"), (F.year("l_shipdate") - 1994).alias("vol"), F.round(F.col("l_discount") * 100).cast("long").alias("percent"))
    # in whole millionths, so that the mean doesn't depend on the order of its terms
    claims = rows.groupBy(*keys).agg(F.expr("((sum(percent) * 10000) div count(1)) / 1e6D").alias("confidence"), F.count(F.lit(1)).alias("n_evidence"))
    return claims.withColumn("claim_id", F.concat(F.lit("r_"), F.substring(F.sha1(F.concat_ws("|", "subject", "object", "predicate", "vol")), 1, 10)))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in periods of six days; the participants are the user and the user after."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", (F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 6) + 1).cast("int").alias("vol"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold a word, in five volumes of chapters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    rows = docs.select(
        F.format_string("v%02d:c%06d:p%04d", (F.col("doc_id") % 5 + 1).cast("int"), F.col("doc_id"), F.col("seq")).alias("para_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("vol"),
        F.col("doc_id").alias("chapter_idx"), "seq", "text", "lang", "source", word_count(F.col("text")).alias("n_words"),
    )
    return rows.where("n_words > 0")


CLAIMS = """claims AS (SELECT o_custkey AS subject, 'STATUS' AS predicate, o_orderstatus AS value, (year(o_orderdate) - 1994)::INT AS vol,
  o_orderkey AS claim_id, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS confidence FROM orders)"""
PRIORITIES = """prio AS (SELECT o_custkey AS subject, 'PRIORITY' AS predicate, o_orderpriority AS value, (year(o_orderdate) - 1994)::INT AS vol,
  o_orderkey AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Q' || quarter(o_orderdate) END AS qualifier, round(o_totalprice / 1e6, 6) AS confidence FROM orders)"""
RELATIONS = """rel AS (SELECT *, 'r_' || substr(sha1(subject || '|' || object || '|' || predicate || '|' || vol), 1, 10) AS claim_id FROM (
  SELECT a.n_name AS subject, b.n_name AS object, CASE WHEN l_returnflag = 'R' THEN 'OPPOSES' ELSE 'TRADES_WITH' END AS predicate,
    (year(l_shipdate) - 1994)::INT AS vol, (sum(round(l_discount * 100)::BIGINT)::BIGINT * 10000 // count(*)) / 1e6 AS confidence, count(*) AS n_evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY ALL))"""
EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value, (date_diff('day', DATE '2024-01-01', ts::DATE) // 6 + 1)::INT AS vol,
  (props->>'$.k')::INT AS k FROM events)"""
PASSAGES = r"""para AS (SELECT * FROM (SELECT printf('v%02d:c%06d:p%04d', doc_id % 5 + 1, doc_id, seq) AS para_id, (doc_id % 5 + 1)::INT AS vol, doc_id AS chapter_idx, seq::INT AS seq,
    text, lang, source, len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[ \t\x0b\f\r]+'), lambda x: x <> ''))::INT AS n_words
  FROM (SELECT doc_id, lang, source, unnest(l) AS text, unnest(range(len(l))) AS seq FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)))
  WHERE n_words > 0)"""
