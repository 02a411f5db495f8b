"""Mining surface forms and finding their mentions.

The dictionary of forms is broadcast only while its size is within MOST_FORMS;
beyond that the same scan is an equality join on the stretches of text that
begin and end at word boundaries and are as long as some form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST_FORMS = 200_000


def in_word(c: str) -> bool:
    return c.isalnum() or c in "'’"


def capitalised_runs(text: Column) -> Column:
    """Maximal runs of up to four capitalised words with one space between."""
    return F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+){0,3}"), 0)


def mine_candidates(passages: DataFrame, evidence: int = 40) -> DataFrame:
    """(surface, n, first_vol, vols, evidence): what looks like a name, and the first passages that hold it.

    The passages of a surface are cut to the first few while they are grouped,
    so a very common surface gathers no long list.
    """
    found = passages.select("para_id", "vol", F.explode(capitalised_runs(F.col("text"))).alias("surface"))
    totals = found.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.min("vol").alias("first_vol"), F.array_sort(F.collect_set("vol")).alias("vols"))
    order = Window.partitionBy("surface").orderBy("para_id")
    first = found.select("surface", "para_id").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= evidence)
    first = first.groupBy("surface").agg(F.array_sort(F.collect_list("para_id")).alias("evidence"))
    return totals.join(first, "surface")


def usually_capitalised(passages: DataFrame, surfaces: DataFrame, least: float = 0.75) -> DataFrame:
    """Single-word surfaces that some volume writes with a capital in that share of cases."""
    words = passages.select("vol", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("w")).groupBy("vol", "w").agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("key", F.lower("w"))
    wanted = surfaces.select("surface", F.lower("surface").alias("key"))
    share = words.join(wanted, "key").groupBy("surface", "vol").agg(F.sum(F.when(F.col("w") == F.col("surface"), F.col("n")).otherwise(0)).alias("exact"), F.sum("n").alias("any"))
    return share.groupBy("surface").agg(F.max(F.col("exact") / F.col("any")).alias("ratio")).where(F.col("ratio") >= least)


def owned_forms(forms: DataFrame) -> DataFrame:
    """Each text's first claimant by entity."""
    return forms.withColumn("rn", F.row_number().over(Window.partitionBy("text").orderBy("entity"))).where("rn = 1").drop("rn")


def find_mentions(passages: DataFrame, forms: DataFrame) -> DataFrame:
    """(para_id, entity, surface, start, end): leftmost-longest mentions of forms(text, entity) on word boundaries, not overlapping.

    A text of several entities is that of the first in order.
    """
    forms = owned_forms(forms.select("text", "entity").where("text <> ''"))
    if forms.limit(MOST_FORMS + 1).count() > MOST_FORMS:
        return _joined_mentions(passages, forms)
    entries = [(r["text"], r["entity"]) for r in forms.collect()]
    kind = forms.schema["entity"].dataType.simpleString()
    entity_type = to_arrow_type(forms.schema["entity"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        scan = ahocorasick.Automaton()
        for text, entity in entries:
            scan.add_word(text, (text, entity))
        if entries:
            scan.make_automaton()
        for b in batches:
            out = []
            for para_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = []
                for last, (form, entity) in scan.iter(text) if entries and text else ():
                    start, end = last + 1 - len(form), last + 1
                    if not (start and in_word(text[start - 1]) or end < len(text) and in_word(text[end])):
                        hits.append((start, -end, form, entity))
                done = 0
                for start, end, form, entity in sorted(hits, key=lambda h: h[:2]):
                    if start >= done:
                        out.append((para_id, entity, form, start, done := -end))
            types = [pa.string(), entity_type, pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["para_id", "entity", "surface", "start", "end"])

    return passages.select("para_id", "text").mapInArrow(run, f"para_id string, entity {kind}, surface string, start int, end int")


def _joined_mentions(passages: DataFrame, forms: DataFrame) -> DataFrame:
    """The scan by an equality join; what it tells tasks is the forms' lengths."""
    lengths = sorted(r[0] for r in forms.select(F.length("text")).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, found = [], [], []
            for para_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                ends = {i for i in range(1, len(text) + 1) if i == len(text) or not in_word(text[i])}
                for i in range(len(text)):
                    if not i or not in_word(text[i - 1]):
                        for n in lengths:
                            if i + n in ends:
                                ids.append(para_id), starts.append(i), found.append(text[i : i + n])
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(found, pa.string())], ["para_id", "start", "text"])

    hits = passages.select("para_id", "text").mapInArrow(run, "para_id string, start int, text string").join(forms, "text")
    items = hits.groupBy("para_id").agg(F.array_sort(F.collect_list(F.struct("start", (-(F.col("start") + F.length("text"))).alias("neg_end"), F.col("text").alias("surface"), "entity"))).alias("hits"))
    start = F.struct(F.lit(0).alias("done"), F.filter("hits", lambda h: F.lit(False)).alias("kept"))
    kept = F.aggregate("hits", start, lambda a, h: F.when(h["start"] >= a["done"], F.struct((-h["neg_end"]).alias("done"), F.concat(a["kept"], F.array(h)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    out = items.select("para_id", F.explode(kept).alias("h"))
    return out.select("para_id", "h.entity", "h.surface", "h.start", (-F.col("h.neg_end")).alias("end"))


def resolve(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """(text, entity): the one entity that a text names, or null.

    An exact form wins if it is one entity's; else the longest form whose words
    contain the text's or are contained in them; a tie of entities is null.
    Candidates share a word with the text, so this is an equality join.
    """
    t = texts.select("text").distinct().withColumn("tw", F.array_distinct(F.split("text", " ")))
    f = forms.select(F.col("text").alias("form"), "entity").withColumn("fw", F.array_distinct(F.split("form", " ")))
    exact = t.join(f, F.col("text") == F.col("form")).groupBy("text").agg(F.min("entity").alias("exact"), F.countDistinct("entity").alias("n"))
    exact = exact.select("text", F.when(F.col("n") == 1, F.col("exact")).alias("exact"))
    pairs = t.withColumn("w", F.explode("tw")).join(f.withColumn("w", F.explode("fw")), "w").select("text", "tw", "form", "fw", "entity").distinct()
    inside = (F.size(F.array_except("tw", "fw")) == 0) | (F.size(F.array_except("fw", "tw")) == 0)
    best = pairs.where(inside).withColumn("r", F.rank().over(Window.partitionBy("text").orderBy(F.desc(F.length("form"))))).where("r = 1")
    best = best.groupBy("text").agg(F.min("entity").alias("best"), F.countDistinct("entity").alias("n")).select("text", F.when(F.col("n") == 1, F.col("best")).alias("best"))
    return t.select("text").join(exact, "text", "left").join(best, "text", "left").select("text", F.coalesce("exact", "best").alias("entity"))


def votes(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """The entity of each key that has at least twice the votes of all others."""
    v = rows.groupBy(key, entity).agg(F.count(F.lit(1)).alias("votes"))
    return v.withColumn("total", F.sum("votes").over(Window.partitionBy(key))).where("votes >= 2 * (total - votes)").drop("total")
