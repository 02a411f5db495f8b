"""Finding texts within texts, by a join on rare words before the exact test."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Short needles that one scan looks for; more of them take several scans.
SHORT = 100_000


def _words(text: str):
    return F.array_distinct(F.filter(F.split(F.col(text), r"[ \t\x0B\f\r\n]+"), lambda w: w != ""))


def verbatim(needles: DataFrame, hay: DataFrame, needle_id: str = "item_id", hay_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(needle_id, hay_id) where the needle's text is part of the hay's.

    A hay that holds a needle holds each of the needle's inner words as a word,
    so candidates come from an equality join on the inner word that the fewest
    texts have.  Needles of under three words have no such word: an automaton of
    at most SHORT of them scans all texts, and the next ones take another scan.
    A null text has no part and is none; the empty needle is part of every text.
    """
    n = needles.select(needle_id, F.col(text).alias("needle")).where("needle is not null")
    words = F.split("needle", r"[ \t\x0B\f\r\n]+")
    inner = n.withColumn("inner", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    h = hay.select(hay_id, F.col(text).alias("hay"))
    tokens = h.select(hay_id, F.explode(_words("hay")).alias("w"))
    asked = inner.select(needle_id, F.explode("inner").alias("w")).distinct()
    counts = tokens.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.join(counts, "w", "left").withColumn("r", F.row_number().over(Window.partitionBy(needle_id).orderBy(F.coalesce("df", F.lit(0)), "w"))).where("r = 1").select(needle_id, "w")
    pairs = tokens.join(rarest, "w").select(needle_id, hay_id)
    found = pairs.join(h, hay_id).join(n, needle_id).where(F.contains("hay", "needle")).select(needle_id, hay_id)
    short = inner.where(F.size("inner") == 0).select(needle_id, "needle")
    return found.unionByName(short_found(short, h, needle_id, hay_id))


def short_found(short: DataFrame, hay: DataFrame, needle_id: str, hay_id: str) -> DataFrame:
    """(needle_id, hay_id) for short(needle_id, needle) within hay(hay_id, hay)."""
    texts = short.select("needle").distinct()
    n = texts.count()
    parts = 1 if n <= SHORT else 2 * -(-n // SHORT)
    hits = None
    for part in range(parts):
        some = texts.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == part)
        wanted = [r.needle for r in some.collect()]  # about SHORT at most
        found = hay.where("hay is not null").mapInArrow(_scan(wanted), f"{hay_id} {hay.schema[hay_id].dataType.simpleString()}, needle string")
        hits = found if hits is None else hits.unionAll(found)
    return hits.join(short, "needle").select(needle_id, hay_id)


def _scan(wanted: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        scan = ahocorasick.Automaton()
        for w in wanted:
            if w:
                scan.add_word(w, w)
        if len(scan):
            scan.make_automaton()
        everywhere = {w for w in wanted if not w}
        for b in batches:
            rows = [(i, w) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in everywhere | ({w for _, w in scan.iter(text)} if len(scan) else set())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], names=[b.schema.field(0).name, "needle"])

    return run


def page_leaks(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Which pages hold facts from after their cutoff.

    facts(page, fact_id, vol, words) against pages(page, cutoff, words), words being
    distinct: supported is whether the page has all words of the fact, lexical
    whether it has one; a fact without words is neither.
    """
    later = facts.withColumnRenamed("words", "asked").join(pages, "page").where(F.col("vol") > F.col("cutoff"))
    shared = F.size(F.array_intersect("asked", "words"))
    return later.select("page", "cutoff", "fact_id", ((shared == F.size("asked")) & (shared > 0)).alias("supported"), (shared > 0).alias("lexical"))


def map_faults(renames: DataFrame, texts: DataFrame) -> DataFrame:
    """(fault, name, n) of renames(original, replacement) and the rewritten texts(words).

    collision: a replacement that is an original too; duplicate: one that stands for
    several originals; leftover: an original that the texts still hold, n times.
    """
    r = renames.select("original", "replacement").where("original is not null and replacement is not null").distinct()
    targets = r.groupBy(F.col("replacement").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    collision = targets.join(r.select(F.col("original").alias("name")).distinct(), "name", "left_semi").select(F.lit("collision").alias("fault"), "name", "n")
    duplicate = targets.where("n > 1").select(F.lit("duplicate").alias("fault"), "name", "n")
    words = texts.select(F.explode("words").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    leftover = words.join(r.select(F.col("original").alias("name")).distinct(), "name", "left_semi").select(F.lit("leftover").alias("fault"), "name", "n")
    return collision.unionByName(duplicate).unionByName(leftover)
