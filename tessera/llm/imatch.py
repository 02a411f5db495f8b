"""I-Match fingerprints, in DataFrame operations only.

Terms whose inverse document frequency lies in a band form the lexicon; each
of several random subsets of the lexicon gives one hash of a text's distinct
terms in it, sorted; the fingerprint is the list of these.  WIDE subsets hold
three quarters of the lexicon each, and every term is in all of them but one:
no term of the band goes unheard, so texts with equal fingerprints have the
same terms in the band.  The other, narrow subsets hold one term in 128: their
hashes outlast larger edits, as a wide one changes with almost any.  A subset
of which the text has no term gives a dash, and a text without any term in the
band is known by its digest alone.

The band bounds the lexicon: a term is in it only if it is in one of RARE
documents at least, so there are at most RARE times the mean number of distinct
terms of a document, whatever the number of documents.  That is what is
broadcast.

The next document is found without a global sort: ids fall in ranges between
approximate quantiles, one window a range, and the first document of each range
also stands at the end of the range before it.

Cases.  A null text is the empty text; null ids come after all others, in the
order of their texts; of repeated ids, the order of the texts decides, so a
repeated row may be its own next; after the last document comes the first; an
empty table gives an empty result.  Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import table, written

#: The band: in one of RARE documents at least, in two of five at most.
RARE, COMMON = 500, (2, 5)
#: Lexicon subsets: of the first WIDE each leaves out the terms whose SHA-256 begins with its quarter of hex digits,
#: the k-th of the rest has the terms whose SHA-256 has one of CHOSEN as its k-th byte, one in 128.
SUBSETS, WIDE, CHOSEN = 32, 4, ("00", "80")
RANGE_ROWS, MAX_RANGES = 512, 8192
_MOST = (1 << 63) - 1


def terms(text: Column) -> Column:
    """Distinct lower-cased terms."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(term, mask): terms of the band; bit k of mask for subset k."""
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").count()
    band = counts.where((F.col("count") * RARE >= n) & (F.col("count") * COMMON[1] <= n * COMMON[0]))
    band = written(band.select("term", F.sha2("term", 256).alias("sha")), "band")  # so that nothing below runs on terms outside the band

    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def more(mask: Column, k: Column) -> Column:
        return F.when(F.substring("sha", 2 * k + 1, F.lit(2)).isin(*CHOSEN), mask.bitwiseOR(bit(k))).otherwise(mask)

    quarter = F.floor((F.instr(F.lit("0123456789abcdef"), F.substring("sha", 1, 1)) - 1) / (16 // WIDE)).cast("int")
    wide = F.lit((1 << WIDE) - 1).cast("long") - bit(quarter)
    return band.select("term", F.aggregate(F.sequence(F.lit(WIDE), F.lit(SUBSETS - 1)), wide, more).alias("mask"))


def hashes(found: Column) -> Column:
    """found, sorted (term, mask) structs -> a hash or a dash for each subset."""

    def of(among: Column, first: int, last: int) -> Column:
        def one(k: Column) -> Column:
            mine = F.filter(among, lambda t: F.getbit(t["mask"], k) == 1)
            return F.when(F.size(mine) == 0, F.lit("-")).otherwise(F.substring(F.md5(F.array_join(F.transform(mine, lambda t: t["term"]), " ")), 1, 8))

        return F.transform(F.sequence(F.lit(first), F.lit(last)), one)

    # most terms are in no narrow subset
    narrow = F.array(F.filter(found, lambda t: t["mask"] >= 1 << WIDE))
    return F.concat(of(found, 0, WIDE - 1), F.flatten(F.transform(narrow, lambda among: of(among, WIDE, SUBSETS - 1))))


def fingerprint(parts: Column, digest: Column) -> Column:
    return F.when(F.exists(parts, lambda p: p != "-"), F.array_join(parts, ".")).otherwise(F.concat(F.lit("="), digest))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of which either text has a term; of two texts without any, whether they are equal."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y"))
    either = F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.filter(either, lambda p: p["x"] == p["y"])
    plain = a.startswith("=") | b.startswith("=")
    return F.when(plain, (a == b).cast("double")).otherwise(F.size(same) / F.size(either))


def _constant(values: list[int]) -> Column:
    """An array constant that the optimiser folds, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """docs(id, text) -> (range, place, wrap, extra, id, text, next_text), the extra rows being those that stand for the next range."""
    key = F.coalesce(F.col("id"), F.lit(_MOST))
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1:
        cut = docs.select(F.percentile_approx(key, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(20 * ranges))).first()[0] or []
        bounds = sorted(set(cut))
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    padded = _constant(bounds + [_MOST] * (2 * steps[0] - 1 - len(bounds)))
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.element_at(padded, at + s) <= key, at + s).otherwise(at))
    ranged = docs.select("id", "text", key.alias("key"), F.least(place, F.lit(len(bounds))).alias("range"))
    # one number for each range: at most MAX_RANGES of them
    heads = dict(ranged.groupBy("range").agg(F.min("key")).collect())
    used = sorted(heads)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    head = F.element_at(_constant([heads.get(r, -1) for r in range(len(bounds) + 1)]), F.col("range") + 1)
    prior = F.element_at(_constant([before.get(r, 0) for r in range(len(bounds) + 1)]), F.col("range") + 1).cast("int")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("wrap"), F.lit(0).alias("extra"))
    ahead = F.struct(prior.alias("range"), (F.col("range") == F.lit(used[0] if used else 0)).cast("int").alias("wrap"), F.lit(1).alias("extra"))
    rows = ranged.withColumn("at", F.explode(F.when(F.col("key") == head, F.array(own, ahead)).otherwise(F.array(own))))
    rows = rows.select("id", "text", "key", "at.range", "at.wrap", "at.extra")
    order = Window.partitionBy("range").orderBy("wrap", "extra", "key", "text")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs."""
    n = docs.count()
    words = lexicon(docs, n, text_col)
    # a term that every text has, in no subset, so that no text is lost in the join
    words = words.unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("mask")))
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), n)
    size = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(coalesce(next_text, ''), 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("range", "place", "extra", "id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    empty = F.array(F.lit(""))
    # what a row keeps goes with its empty term, so that the other terms are slim
    kept = F.struct("id", "n_chars", F.md5("text").alias("digest"), F.sha2("edited", 256).alias("edited_sha256"), F.md5("edited").alias("edited_digest"))
    first = F.struct(F.lit(0).alias("which"), F.concat(terms(F.col("text")), empty).alias("terms"), kept.alias("kept"))
    second = F.struct(F.lit(1).alias("which"), F.when(F.col("extra") == 0, terms(F.col("edited"))).otherwise(F.array().cast("array<string>")).alias("terms"), F.lit(None).alias("kept"))
    rows = rows.select("range", "place", "extra", F.explode(F.array(first, second)).alias("part"))
    rows = rows.select("range", "place", "extra", F.col("part.which").alias("which"), F.col("part.kept").alias("kept"), F.explode("part.terms").alias("term"))
    rows = rows.withColumn("kept", F.when(F.col("term") == "", F.col("kept"))).join(F.broadcast(words), "term")
    found = F.array_sort(F.collect_list(F.when((F.col("which") == 0) & (F.col("mask") != 0), F.struct("term", "mask"))))
    found_edited = F.array_sort(F.collect_list(F.when((F.col("which") == 1) & (F.col("mask") != 0), F.struct("term", "mask"))))
    prints = rows.groupBy("range", "place", "extra").agg(F.max("kept").alias("kept"), found.alias("found"), found_edited.alias("found_edited")).select("range", "place", "extra", "kept.*", "found", "found_edited")
    prints = prints.withColumn("fingerprint", fingerprint(hashes(F.col("found")), F.col("digest"))).withColumn("edited_fingerprint", fingerprint(hashes(F.col("found_edited")), F.col("edited_digest"))).drop("found", "found_edited")
    prints = prints.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))).where("extra = 0")
    return prints.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )


def op10_imatch(spark, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER w AS place, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, length(text) AS n, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM o),
t AS (SELECT place, 0 AS which, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS term FROM e
      UNION ALL
      SELECT place, 1, unnest(list_distinct(list_filter(regexp_split_to_array(lower(edited), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) FROM e),
b AS (SELECT term FROM t WHERE which = 0 GROUP BY term HAVING count(*) * {RARE} >= (SELECT count(*) FROM d) AND count(*) * {COMMON[1]} <= (SELECT count(*) FROM d) * {COMMON[0]}),
m AS (SELECT term, k FROM b, range({SUBSETS}) AS r(k) WHERE CASE WHEN k < {WIDE} THEN (instr('0123456789abcdef', substr(sha256(term), 1, 1)) - 1) // {16 // WIDE} <> k ELSE substr(sha256(term), 2 * k::INT + 1, 2) IN {CHOSEN} END),
h AS (SELECT place, which, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS part FROM t JOIN m USING (term) GROUP BY place, which, k),
a AS (SELECT e.place, w.which, r.k, h.part FROM e CROSS JOIN (VALUES (0), (1)) AS w(which) CROSS JOIN range({SUBSETS}) AS r(k) LEFT JOIN h ON h.place = e.place AND h.which = w.which AND h.k = r.k),
f AS (SELECT place, which, count(part) AS parts, string_agg(coalesce(part, '-'), '.' ORDER BY k) AS joined FROM a GROUP BY place, which),
p AS (SELECT e.*, CASE WHEN x.parts > 0 THEN x.joined ELSE '=' || md5(text) END AS fingerprint, CASE WHEN y.parts > 0 THEN y.joined ELSE '=' || md5(edited) END AS edited_fingerprint
      FROM e JOIN f AS x ON x.place = e.place AND x.which = 0 JOIN f AS y ON y.place = e.place AND y.which = 1),
q AS (SELECT p.*, z.fingerprint AS next FROM p JOIN p AS z ON z.place = p.place % (SELECT count(*) FROM d) + 1)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN starts_with(fingerprint, '=') OR starts_with(edited_fingerprint, '=') THEN (fingerprint = edited_fingerprint)::INT::DOUBLE ELSE
    len(list_filter(list_zip(string_split(fingerprint, '.'), string_split(edited_fingerprint, '.')), lambda z: z[1] <> '-' AND z[1] = z[2]))::DOUBLE
    / len(list_filter(list_zip(string_split(fingerprint, '.'), string_split(edited_fingerprint, '.')), lambda z: z[1] <> '-' OR z[2] <> '-')) END AS near_edited,
  CASE WHEN starts_with(fingerprint, '=') OR starts_with(next, '=') THEN (fingerprint = next)::INT::DOUBLE ELSE
    len(list_filter(list_zip(string_split(fingerprint, '.'), string_split(next, '.')), lambda z: z[1] <> '-' AND z[1] = z[2]))::DOUBLE
    / len(list_filter(list_zip(string_split(fingerprint, '.'), string_split(next, '.')), lambda z: z[1] <> '-' OR z[2] <> '-')) END AS near_next
FROM q
"""
