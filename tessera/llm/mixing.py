"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Targets are a water level over the sources' weights; what a source gives is
drawn in a fixed random order of its documents; each draw gets the training
position at which its source's schedule has demanded that many words; the mix
is range-sorted by position.

Cases.  A null text has size 0 and gives nothing; null is a source like any
other, the last in order; a null id draws its place from the empty text;
repeated rows are drawn one by one; a source without words has target 0; an
empty table gives an empty result.  Only the columns named are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import WORD, n_words, table, written

WEIGHTS = (5, 2, 1)
#: Relative weight of a source at evenly spaced knots of training time, straight
#: lines between; the schedules repeat as the weights do.  Only the shape counts.
SCHEDULES = ((3.0, 2.0, 1.0), (1.0, 1.0, 1.0), (1.0, 2.0, 3.0))
#: Rows of a source and bucket that one window may hold, roughly.
BUCKET_ROWS = 4000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> with rank, weight and target.

    Targets share `share` of all words by weight but stop at `most` times a
    source's words, the excess going to the others by weight until none is
    above.  That is min(cap, level * weight): with the sources in order of
    cap / weight, the level is that of the first one it doesn't fill.
    """
    by_name, every = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy(F.lit(0))
    df = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    df = df.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (share * F.sum("source_size").over(every) - before) / left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return df.withColumn("target", F.round(F.least("cap", F.coalesce(level * F.col("weight"), "cap")), 6)).select("source", "source_size", "rank", "weight", "target")


def when_demanded(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """Training time, 0 to 1, at which a source's schedule has demanded this share of its words."""
    out = F.lit(None).cast("double")
    for s, knots in enumerate(schedules):
        h = 1.0 / (len(knots) - 1)
        areas = [h * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        total, done, at = sum(areas), 0.0, F.lit(1.0)
        for i in reversed(range(len(areas))):
            a, b, done = knots[i] / total, knots[i + 1] / total, sum(areas[:i]) / total
            rest = F.greatest(share - done, F.lit(0.0))
            at = F.when(share <= sum(areas[: i + 1]) / total, i * h + 2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) / h * rest, F.lit(0.0))))).otherwise(at)
        out = F.when(rank % len(schedules) == s, F.least(at, F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of docs: id, size, source_size, target, taken, taken_again, position, position_again.

    taken counts all words that the mix takes of the document and taken_again
    those of later draws; the positions are those of the first and second draw.
    keep: those working columns with rank and the amounts, in no order.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    slim = written(slim, "sizes")
    sources = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most)), "targets")
    rows = slim.join(sources, slim["source"].eqNullSafe(sources["source"])).drop(slim["source"])

    # running sums within a source, though one source may hold most rows: by two
    # hex digits of the key at a time, every window holds 256 sums at most
    levels = max(1, math.ceil(math.log(max(1, slim.count() / BUCKET_ROWS), 256)))
    offsets = None
    for level in range(1, levels + 1):
        own = rows.groupBy("rank", F.substring("key", 1, 2 * level).alias("bucket")).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("rank", F.substring("bucket", 1, 2 * level - 2)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = own.select("rank", "bucket", before.alias("offset"))
        if offsets is not None:
            above = offsets.select("rank", F.col("bucket").alias("above"), F.col("offset").alias("more"))
            own = own.withColumn("above", F.substring("bucket", 1, 2 * level - 2)).join(above, ["rank", "above"]).select("rank", "bucket", (F.col("offset") + F.col("more")).alias("offset"))
        offsets = own
    rows = rows.withColumn("bucket", F.substring("key", 1, 2 * levels)).join(offsets, ["rank", "bucket"])
    within = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.col("offset") + F.sum("size").over(within) - F.col("size"))

    def drawn(n: int) -> Column:
        return F.least(F.col("size"), F.greatest(F.floor(F.col("target") - n * F.col("source_size") - F.col("start")), F.lit(0))).cast("long")

    draws = [drawn(n) for n in range(most)]
    taken = sum(draws[1:], draws[0])

    def position(n: int) -> Column:
        at = when_demanded((n * F.col("source_size") + F.col("start")) / F.col("target"), F.col("rank"))
        return F.when(drawn(n) > 0, F.round(at, 9))

    amounts = ["size", "source_size", "target", taken.alias("taken"), (taken - draws[0]).alias("taken_again")]
    if keep:
        return rows.select(*keep, "rank", *amounts)
    return rows.select(
        F.col("id").alias(id_col), *amounts, position(0).alias("position"), (position(1) if most > 1 else F.lit(None).cast("double")).alias("position_again"),
    ).orderBy(F.col("position").asc_nulls_last(), id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of docs that the mix draws, once for each draw of at least half of the document, range-sorted by position.

    Of a source, the n-th draw takes the documents up to a cut-off key, so a
    row decides by itself, and rows of one id alike.  Positions follow from the
    source's words before each of 256 ranges of keys and are interpolated
    within a range.  Texts move once, in the range sort.
    """
    plan = written(mix(docs, weights, share, most, id_col, text_col, source_col, keep=("source", "key", "start")), "plan")
    drawn = [F.col("taken") - F.col("taken_again"), F.col("taken_again")][:most]
    cuts = [F.max(F.when((d > 0) & (2 * d >= F.col("size")), F.col("key"))).alias(f"cut_{i}") for i, d in enumerate(drawn)]
    sources = plan.groupBy("source").agg(F.first("rank").alias("rank"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), *cuts)
    ranges = plan.groupBy("source", F.substring("key", 1, 2).alias("range")).agg(F.min("start").alias("from"), F.sum("size").alias("words"))
    same = ranges["source"].eqNullSafe(sources["source"])
    known = written(ranges.join(sources, same).select(ranges["source"], "range", "from", "words", "rank", "source_size", "target", *[f"cut_{i}" for i in range(len(cuts))]), "ranges")
    own = "_".join(docs.columns)  # no column of docs has a name that ends so
    known = known.select([F.col(c).alias(f"{c}_{own}") for c in known.columns])
    mine = lambda c: F.col(f"{c}_{own}")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    into = F.conv(F.substring(key, 3, 8), 16, 10).cast("double") / float(1 << 32)
    near = mine("from") + into * mine("words")
    words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    at = [F.when((key <= mine(f"cut_{i}")) & words, when_demanded((i * mine("source_size") + near) / mine("target"), mine("rank"))) for i in range(len(cuts))]
    met = docs.join(known, F.col(source_col).eqNullSafe(mine("source")) & (F.substring(key, 1, 2) == mine("range")))
    place = f"place_{own}"
    rows = met.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.filter(F.array(*at), lambda x: x.isNotNull())).alias(place))
    return rows.repartitionByRange(place, id_col).sortWithinPartitions(place, id_col).select(docs.columns)


def op7_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_when(share: str) -> str:
    arms = []
    for s, knots in enumerate(SCHEDULES):
        h = 1.0 / (len(knots) - 1)
        areas = [h * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        total = sum(areas)
        for i in range(len(areas)):
            a, b, done = knots[i] / total, knots[i + 1] / total, sum(areas[:i]) / total
            rest = f"greatest({share} - {done!r}::DOUBLE, 0::DOUBLE)"
            slope = 2 * (b - a) / h
            arms.append(f"WHEN rank % {len(SCHEDULES)} = {s} AND {share} <= {sum(areas[: i + 1]) / total!r}::DOUBLE THEN least({i * h!r}::DOUBLE + 2 * {rest} / ({a!r}::DOUBLE + sqrt(greatest({a * a!r}::DOUBLE + {slope!r}::DOUBLE * {rest}, 0::DOUBLE))), 1::DOUBLE)")
    return "CASE " + " ".join(arms) + " ELSE 1::DOUBLE END"


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, [5::DOUBLE, 2, 1][rank % 3 + 1] AS weight, 2::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS ratio,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
t AS (SELECT *, round(least(cap, coalesce((SELECT level FROM l AS x WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) * weight, cap)), 6) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
        sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(size, greatest(floor(target - start), 0))::BIGINT AS one,
        least(size, greatest(floor(target - source_size - start), 0))::BIGINT AS two FROM c)
SELECT doc_id, size, source_size, target, one + two AS taken, two AS taken_again,
  CASE WHEN one > 0 THEN round({_sql_when("(start / target)")}, 9) END AS position,
  CASE WHEN two > 0 THEN round({_sql_when("((source_size + start) / target)")}, 9) END AS position_again
FROM k
"""
