"""Events, sessions, caps and packing; their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.operators import intervals
from tessera.operators import sequences as S
from tessera.plans.core import COLLAPSED
from tessera.plans.registry import query
from tessera.sources.tables import EVENTS, PASSAGES, log_events, passages, status_claims
from tessera.streaming import twins

CAST = f"{EVENTS}, cast_ AS (SELECT *, [user_id, user_id + 1, k + 1000] AS participants FROM ev)"


def casted(spark, sf):
    e = log_events(spark, sf)
    return e.withColumn("participants", F.array(F.col("user_id"), F.col("user_id") + 1, F.col("k").cast("long") + 1000))


@query("event_at", f"WITH {EVENTS} SELECT event_id, user_id, event_type, vol FROM ev WHERE vol <= 3")
def _(spark, sf):
    return E.events_at(log_events(spark, sf), 3).select("event_id", "user_id", "event_type", "vol")


@query("event_in_volume", f"WITH {EVENTS} SELECT event_type, count(*) AS n FROM ev WHERE vol = 2 GROUP BY ALL")
def _(spark, sf):
    return log_events(spark, sf).where("vol = 2").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_of_participant", f"WITH {CAST} SELECT event_id, vol FROM cast_ WHERE vol <= 3 AND list_contains(participants, 7)")
def _(spark, sf):
    return E.events_of(casted(spark, sf), 7, 3).select("event_id", "vol")


@query("event_shared", f"WITH {CAST} SELECT event_id FROM cast_ WHERE vol <= 4 AND list_contains(participants, 7) AND list_contains(participants, 8)")
def _(spark, sf):
    return E.shared_events(casted(spark, sf), 7, 8, 4).select("event_id")


@query("event_group_k_of", f"WITH {CAST} SELECT event_id FROM cast_ WHERE vol <= 4 AND len(list_intersect(participants, [7, 8, 9, 1003])) >= 2")
def _(spark, sf):
    return E.group_events(casted(spark, sf), [7, 8, 9, 1003], 4, 2).select("event_id")


@query("event_shared_pairs", f"WITH {CAST}, x AS (SELECT DISTINCT event_id, unnest(participants) AS p FROM cast_ WHERE vol <= 3) SELECT a.p AS a, b.p AS b, count(*) AS n FROM x a JOIN x b USING (event_id) WHERE a.p < b.p GROUP BY ALL")
def _(spark, sf):
    return E.co_presence(casted(spark, sf), 3)


@query("event_located", f"WITH {EVENTS} SELECT event_id FROM ev WHERE vol <= 4 AND k = 5")
def _(spark, sf):
    return E.events_at(log_events(spark, sf), 4).where("k = 5").select("event_id")


@query("event_claims_build", f"WITH {CAST} SELECT event_id, 'participant' AS kind, unnest(range(3))::INT AS place, unnest(participants) AS text FROM cast_ UNION ALL SELECT event_id, 'pair', unnest(range(2))::INT, unnest([user_id, k]) FROM cast_")
def _(spark, sf):
    rows = casted(spark, sf).withColumn("pair", F.array(F.col("user_id"), F.col("k").cast("long")))
    return E.event_claims(rows, {"participants": "participant", "pair": "pair"}).select("event_id", "kind", "place", "text")


@query("event_claims_of", f"WITH {EVENTS} SELECT e.event_id, c.event_id AS claim, c.event_type FROM ev e JOIN ev c ON c.user_id = e.user_id AND c.vol = e.vol WHERE e.event_type = 'purchase' AND c.event_type = 'error' AND e.vol <= 2")
def _(spark, sf):
    e = log_events(spark, sf).where("vol <= 2")
    claims = e.where("event_type = 'error'").select("user_id", "vol", F.col("event_id").alias("claim"), "event_type")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "vol").join(claims, ["user_id", "vol"]).select("event_id", "claim", "event_type")


@query("event_participants_top", f"WITH {CAST}, x AS (SELECT unnest(participants) AS p FROM cast_) SELECT p, count(*) AS n FROM x GROUP BY p ORDER BY n DESC, p LIMIT 20")
def _(spark, sf):
    return casted(spark, sf).select(F.explode("participants").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p").limit(20)


@query("event_counts_by_entity", f"WITH {EVENTS}, c AS (SELECT user_id, vol, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, vol, n, round(n / (max(n) OVER ()), 4) AS importance FROM c")
def _(spark, sf):
    counts = log_events(spark, sf).groupBy("user_id", "vol").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.greatest(F.max("n"), F.lit(1)).alias("top"))
    return counts.join(F.broadcast(top)).select("user_id", "vol", "n", F.round(F.col("n") / F.col("top"), 4).alias("importance"))


SESSIONS = f"{EVENTS}, s0 AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 21600 THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s0)"


@query("session_by_gap", f"WITH {SESSIONS} SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s1 GROUP BY ALL")
def _(spark, sf):
    e = S.gap_sessions(log_events(spark, sf), ["user_id"], F.unix_micros("ts") / 1e6, 21600, "event_id")
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("session_window_batch", f"WITH {SESSIONS} SELECT user_id, count(DISTINCT session) AS sessions FROM s1 GROUP BY ALL")
def _(spark, sf):
    e = log_events(spark, sf)
    return e.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("session_context_bounds", f"""WITH {EVENTS}, b AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM ev)
SELECT event_id, min(event_id) OVER w AS lo, max(event_id) OVER w AS hi FROM b WINDOW w AS (PARTITION BY user_id, stretch ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)""")
def _(spark, sf):
    return S.context_bounds(log_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2, 3, "event_id").select("event_id", "lo", "hi")


@query("session_window_caps", f"WITH {EVENTS}, c AS (SELECT user_id, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, n, greatest(3, round_even(40 * count(*) OVER () * sqrt(n) / sum(sqrt(n)) OVER (), 0)::INT) AS cap FROM c")
def _(spark, sf):
    counts = log_events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return S.sqrt_caps(counts, 40, 3)


@query("pack_greedy", f"""WITH RECURSIVE {PASSAGES}, n AS (SELECT chapter_idx, seq, n_words, row_number() OVER (PARTITION BY chapter_idx ORDER BY seq) AS i FROM para),
  g AS (SELECT chapter_idx, seq, n_words, i, n_words AS used, 0 AS grp FROM n WHERE i = 1 UNION ALL
        SELECT n.chapter_idx, n.seq, n.n_words, n.i, CASE WHEN g.used + n.n_words > 200 THEN n.n_words ELSE g.used + n.n_words END, CASE WHEN g.used + n.n_words > 200 THEN g.grp + 1 ELSE g.grp END
        FROM g JOIN n ON n.chapter_idx = g.chapter_idx AND n.i = g.i + 1)
SELECT chapter_idx, seq, n_words, grp AS "group" FROM g""")
def _(spark, sf):
    return S.greedy_groups(passages(spark, sf), ["chapter_idx"], ["seq"], "n_words", 200)


@query("pack_chunk_sizes", f"""WITH RECURSIVE {PASSAGES}, n AS (SELECT chapter_idx, n_words, row_number() OVER (PARTITION BY chapter_idx ORDER BY seq) AS i FROM para),
  g AS (SELECT chapter_idx, n_words, i, n_words AS used, 0 AS grp FROM n WHERE i = 1 UNION ALL
        SELECT n.chapter_idx, n.n_words, n.i, CASE WHEN g.used + n.n_words > 400 THEN n.n_words ELSE g.used + n.n_words END, CASE WHEN g.used + n.n_words > 400 THEN g.grp + 1 ELSE g.grp END
        FROM g JOIN n ON n.chapter_idx = g.chapter_idx AND n.i = g.i + 1)
SELECT chapter_idx, grp AS "group", sum(n_words)::BIGINT AS words, count(*) AS passages FROM g GROUP BY ALL""")
def _(spark, sf):
    g = S.greedy_groups(passages(spark, sf), ["chapter_idx"], ["seq"], "n_words", 400)
    return g.groupBy("chapter_idx", "group").agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("passages"))


@query("pack_fill_skipping", f"""WITH RECURSIVE {EVENTS}, n AS (SELECT user_id, event_id, k + 1 AS size, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev),
  g AS (SELECT *, CASE WHEN size <= 60 THEN size ELSE 0 END AS used, size <= 60 AS taken FROM n WHERE rank = 1 UNION ALL
        SELECT n.*, g.used + CASE WHEN g.used + n.size <= 60 THEN n.size ELSE 0 END, g.used + n.size <= 60 FROM g JOIN n ON n.user_id = g.user_id AND n.rank = g.rank + 1)
SELECT user_id, rank, event_id, size::BIGINT AS size, taken FROM g""")
def _(spark, sf):
    rows = log_events(spark, sf).withColumn("size", F.col("k") + 1)
    return S.fill_skipping(rows, ["user_id"], [F.desc("value"), F.col("event_id")], "size", 60, "event_id")


@query("topk_in_budget", f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, k + 1 AS size, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev),
  s AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY rank) AS running FROM r WHERE rank <= 10) SELECT user_id, event_id, rank, running::BIGINT AS running FROM s WHERE rank = 1 OR running <= 50""")
def _(spark, sf):
    rows = log_events(spark, sf).withColumn("size", F.col("k") + 1)
    return S.top_k_in_budget(rows, ["user_id"], [F.desc("value"), F.col("event_id")], "size", 10, 50).select("user_id", "event_id", "rank", F.col("running").cast("long").alias("running"))


@query("topk_densest_resorted", f"WITH {EVENTS}, c AS (SELECT user_id, vol, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, vol, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, vol) <= 2")
def _(spark, sf):
    c = log_events(spark, sf).groupBy("user_id", "vol").agg(F.count(F.lit(1)).alias("n"))
    return S.top_k(c, ["user_id"], [F.desc("n"), F.col("vol")], 2).select("user_id", "vol", "n").orderBy("user_id", "vol")


@query("seq_carry_forward", f"WITH {EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM ev")
def _(spark, sf):
    e = log_events(spark, sf).withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.carry_forward(e, ["user_id"], ["ts", "event_id"], "s", "signup").select("event_id", "signup")


@query("seq_volume_ranges", f"""WITH {EVENTS}, d AS (SELECT DISTINCT user_id, vol FROM ev WHERE event_type = 'error'), i AS (SELECT user_id, vol, vol - row_number() OVER (PARTITION BY user_id ORDER BY vol) AS island FROM d),
  s AS (SELECT user_id, min(vol) AS lo, max(vol) AS hi FROM i GROUP BY user_id, island) SELECT user_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS ranges FROM s GROUP BY ALL""")
def _(spark, sf):
    return S.ranges_as_text(log_events(spark, sf).where("event_type = 'error'"), ["user_id"], "vol")


@query("seq_next_step", f"WITH {EVENTS}, d AS (SELECT DISTINCT user_id, vol FROM ev) SELECT user_id, vol, lead(vol) OVER (PARTITION BY user_id ORDER BY vol) AS next_vol FROM d")
def _(spark, sf):
    from pyspark.sql import Window

    d = log_events(spark, sf).select("user_id", "vol").distinct()
    return d.withColumn("next_vol", F.lead("vol").over(Window.partitionBy("user_id").orderBy("vol")))


@query("stream_counts_by_window", f"WITH {EVENTS} SELECT time_bucket(INTERVAL 6 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    # the whole input is one micro-batch, so nothing is late; complete mode gives every window
    stream = _stream(spark, sf)
    counts = twins.counts_by_window(stream.select("ts", "event_type", "value"))
    return twins.run_to_end(counts, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_sessions", f"WITH {SESSIONS} SELECT user_id, count(DISTINCT session) AS sessions FROM s1 GROUP BY ALL")
def _(spark, sf):
    out = twins.run_to_end(twins.sessions(_stream(spark, sf), "6 hours 1 microsecond"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("stream_supersession", f"""WITH {COLLAPSED}, f AS (SELECT *, CASE WHEN lag(norm) OVER w IS NOT DISTINCT FROM norm THEN 0 ELSE 1 END AS fresh FROM best WINDOW w AS (PARTITION BY subject ORDER BY vol)), k AS (SELECT * FROM f WHERE fresh = 1),
  l AS (SELECT subject, predicate, value, vol AS vol_start, lead(vol) OVER (PARTITION BY subject ORDER BY vol) - 1 AS vol_end FROM k) SELECT * FROM l WHERE vol_end IS NOT NULL""")
def _(spark, sf):
    from tessera.operators.lineage import scratch

    path = scratch(spark, "claims")
    intervals.arbitrate(status_claims(spark, sf)).select("subject", "predicate", "vol", "value").write.parquet(path)
    stream = spark.readStream.schema("subject long, predicate string, vol int, value string").parquet(path)
    return twins.run_to_end(twins.superseded(stream))


@query("stream_changed_states", f"""WITH {EVENTS}, u AS (SELECT user_id, vol, max(event_type) AS state FROM ev GROUP BY ALL)
  SELECT user_id, vol, state FROM u QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY vol)""")
def _(spark, sf):
    from tessera.operators.lineage import scratch

    states = log_events(spark, sf).groupBy("user_id", "vol").agg(F.max("event_type").alias("state"))
    path = scratch(spark, "states")
    states.write.parquet(path)
    return twins.run_to_end(twins.changed_states(spark.readStream.schema(states.schema).parquet(path), ["user_id"], "state"))


@query("stream_late_evidence", f"WITH {EVENTS} SELECT event_id, vol, CASE WHEN vol <= 2 AND event_id % 7 = 0 THEN value * 2 ELSE value END AS value FROM ev")
def _(spark, sf):
    from tessera.operators.lineage import scratch

    # two steps over one cursor: the volumes, then late corrections of the first two
    inbox, path, cursor = (scratch(spark, n) for n in ("inbox", "evidence", "cursor"))
    rows = log_events(spark, sf).select("event_id", "value", F.lit(1).alias("version"), "vol")
    late = rows.where("vol <= 2 AND event_id % 7 = 0").withColumns({"value": F.col("value") * 2, "version": F.lit(2)})
    for step in (rows, late):
        step.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        twins.upserts(stream, path, cursor, "vol", ["event_id"], "version").start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).select("event_id", "vol", "value")


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
