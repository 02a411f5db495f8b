"""Windows, records, pages, verification, scoring and review: the steps between a graph and what is read of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# catalogs


def effective_catalog(base: DataFrame, add: DataFrame, skip: DataFrame, key: str = "predicate") -> DataFrame:
    """The base rows and the added ones, each key once, without the skipped keys."""
    return base.unionByName(add).dropDuplicates([key]).join(skip.select(key).distinct(), key, "left_anti")


def first_kind(rows: DataFrame, key: str, kinds: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with kind: the first of the catalogs, in order of precedence, that holds the key; null if none does."""
    marked = None
    for i, (kind, catalog) in enumerate(kinds):
        one = catalog.select(key).distinct().withColumn("found", F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind")))
        marked = one if marked is None else marked.unionAll(one)
    best = marked.groupBy(key).agg(F.min("found").alias("found")).select(key, F.col("found.kind").alias("kind"))
    return rows.join(best, key, "left")


# windows


def position_clusters(rows: DataFrame, keys: list[str], pos: str, gap: int) -> DataFrame:
    """rows with session: a new one where the position before is more than gap away."""
    order = Window.partitionBy(*keys).orderBy(pos)
    fresh = F.when(F.col(pos) - F.lag(pos).over(order) <= gap, 0).otherwise(1)
    return rows.withColumn("fresh_", fresh).withColumn("session", F.sum("fresh_").over(order)).drop("fresh_")


def shrink_context(rows: DataFrame, anchors: DataFrame, keys: list[str], pos: str, cost: str, reach: int, budget: int) -> DataFrame:
    """(keys, anchor, lefts, rights): how many rows of context fit the budget; what is trimmed first is on the right.

    The anchor always stays; context comes from its nearest rows, up to reach
    on each side, left first.
    """
    near = rows.join(anchors, keys).withColumn("off", F.col(pos) - F.col("anchor")).where(F.abs("off") <= reach)
    costs = F.map_from_entries(F.collect_list(F.struct("off", cost)))
    g = near.groupBy(*keys, "anchor").agg(costs.alias("c"))

    def side(sign: int, used: Column) -> Column:
        offs = F.array(*[F.lit(sign * i) for i in range(1, reach + 1)])
        start = F.struct(used.cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def step(a: Column, o: Column) -> Column:
            own = F.try_element_at("c", o)
            fits = a["open"] & (a["used"] + own <= budget)
            return F.when(own.isNull(), a).otherwise(F.struct(F.when(fits, a["used"] + own).otherwise(a["used"]).cast("long").alias("used"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("open")))

        return F.aggregate(offs, start, step)

    g = g.withColumn("l", side(-1, F.element_at("c", F.lit(0)))).withColumn("r", side(1, F.col("l.used")))
    return g.select(*keys, "anchor", F.col("l.n").alias("lefts"), F.col("r.n").alias("rights"))


# records


def span_records(rows: DataFrame, keys: list[str], confidence: Column, order: Column, item: str) -> DataFrame:
    """One record a span: a confidence over its rows and its distinct items in order of first sight."""
    first = rows.groupBy(*keys, item).agg(F.min(order).alias("at_"))
    items = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", item))), lambda x: x[item]).alias("kinds"))
    return rows.groupBy(*keys).agg(confidence.alias("confidence")).join(items, keys)


def first_sight(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: what overlapping spans repeat is dropped."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


# pages


def lead_line(*columns: str) -> Column:
    return F.concat_ws(" · ", *columns)


def trait_lines(claims: DataFrame, cutoff: int, exclude: str) -> DataFrame:
    """(subject, traits): values seen by the cutoff whose latest claim asserts them, without those that match exclude."""
    seen = claims.where((F.col("vol") <= cutoff) & ~F.col("value").rlike(exclude))
    t = seen.groupBy("subject", "value").agg(F.min("vol").alias("since"), F.max_by("polarity", F.struct("vol", "claim_id")).alias("polarity")).where("polarity = 'asserted'")
    return t.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("since", "value"))), lambda x: x["value"]), "; ").alias("traits"))


def cited_or_all(rows: DataFrame, key: str, label: str, named: list[str], item: str) -> DataFrame:
    """(key, evidence): the items under the named labels, or all of them where a key has none of these."""
    mine = F.collect_list(F.when(F.col(label).isin(named), F.col(item)))
    return rows.groupBy(key).agg(mine.alias("own"), F.collect_list(item).alias("every")).select(key, F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every")).alias("evidence"))


def markdown_page(intervals: DataFrame, key: str, value: str) -> DataFrame:
    """(key, page): a heading and one line an interval, in order."""
    span = F.concat(F.col("vol_start").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("vol_end").cast("string")), F.lit("")))
    line = F.concat(F.lit("- "), F.col(value), F.lit(" ("), span, F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("vol_start", "interval_id", line.alias("line")))), lambda x: x["line"])
    return intervals.groupBy(key).agg(lines.alias("lines")).select(key, F.concat(F.lit("# "), F.col(key).cast("string"), F.lit("\n"), F.array_join("lines", "\n")).alias("page"))


def headed_text(rows: DataFrame, key: str, chapter: str, seq: str) -> DataFrame:
    """(key, body, n): the texts in order, a heading before each chapter's first."""
    order = Window.partitionBy(key).orderBy(chapter, seq)
    fresh = ~F.col(chapter).eqNullSafe(F.lag(chapter).over(order))
    line = F.when(fresh, F.concat(F.lit("## "), F.col(chapter).cast("string"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    lines = rows.withColumn("line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(chapter, seq, "line"))).alias("lines"))
    return lines.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"), F.size("lines").cast("long").alias("n"))


# verification


def fact_set(intervals: DataFrame, cutoff: int, quotes: int) -> DataFrame:
    """The current intervals, each once, with its first quotes.

    Two intervals are one if they agree in id, subject, predicate, value and start:
    the id is 32 bits of a hash, which different ones may have in common.
    """
    now = intervals.where((F.col("vol_start") <= cutoff) & (F.col("vol_end").isNull() | (F.col("vol_end") >= cutoff)))
    keys = [c for c in ("interval_id", "subject", "object", "predicate", "value", "vol_start") if c in now.columns]
    return now.dropDuplicates(keys).withColumn("quotes", F.slice("claim_ids", 1, quotes))


def word_chunks(rows: DataFrame, words: str, size: int) -> DataFrame:
    """rows with chunk: its words, so many at a time."""
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))
    some = rows.where(F.size(words) > 0).withColumn("at_", F.explode(starts))
    return some.withColumn("chunk", F.slice(F.col(words), F.col("at_") + 1, F.lit(size))).drop("at_", words)


def best_chunk(chunks: DataFrame, key: str, least: float) -> DataFrame:
    """(key, chunks, score, supported): the best chunk speaks for the text."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.max("score").alias("top")).select(key, "chunks", F.round("top", 6).alias("score"), (F.col("top") > least).alias("supported"))


def verdicts_by_score(rows: DataFrame, scores: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """rows with verdict: a table of scores decides, above the threshold is supported."""
    return rows.join(scores, keys, "left").withColumn("verdict", F.when(F.col("score").isNull(), "unscored").when(F.col("score") > threshold, "supported").otherwise("unsupported"))


def hypothesis(template: Column, values: dict[str, Column], denied: Column) -> Column:
    """The template with its names filled in, denied ones under a prefix."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return F.concat(F.when(denied, "It is not the case that ").otherwise(""), template)


# scoring


def heading_recall(items: DataFrame, have: DataFrame, item: str, words: str, group: str, word: str, least: float) -> DataFrame:
    """(item, best, found): the largest share of its words that one group has; an equality join on words."""
    n = items.select(item, F.size(words).alias("n"))
    both = items.select(item, F.explode(words).alias(word)).join(have, word).groupBy(item, group).agg(F.count(F.lit(1)).alias("both"))
    best = n.join(both.groupBy(item).agg(F.max("both").alias("both")), item, "left").withColumn("share", F.coalesce(F.col("both") / F.col("n"), F.lit(0.0)))
    return best.select(item, F.round("share", 6).alias("best"), (F.col("share") >= least).alias("found"))


def negative_facts(facts: DataFrame, entries: DataFrame, key: str, fact: str, required: str, words: str) -> DataFrame:
    """(fact, violated): whether one entry of the key has all required words; met on the fact's words, so no pair is made without one in common."""
    e = entries.select(key, F.col(words).alias("m")).distinct().withColumn("entry", F.monotonically_increasing_id())
    words_of = e.select(key, "entry", F.explode("m").alias("w"))
    need = facts.select(key, fact, F.size(required).alias("n"), F.explode(required).alias("w"))
    full = need.join(words_of, [key, "w"]).groupBy(fact, "entry", "n").agg(F.count(F.lit(1)).alias("got")).where("got = n").select(fact).distinct()
    return facts.select(fact).join(full.withColumn("violated", F.lit(True)), fact, "left").select(fact, F.coalesce("violated", F.lit(False)).alias("violated"))


def unseen(marks: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return marks.join(seen.select(key).distinct(), key, "left_anti")


def only_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    once = rows.groupBy(*keys).count().where("count = 1").select(*keys)
    return rows.join(once, keys, "left_semi")


def miner_split(words: DataFrame, word: str, least: int, ratio: float) -> DataFrame:
    """(key, n, cause): why a word is no candidate: too few mentions, or too seldom capitalised."""
    s = words.groupBy(F.lower(word).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(word) != F.lower(word)).cast("int")).alias("up"))
    return s.select("key", "n", F.when(F.col("n") < least, "few").when(F.col("up") < ratio * F.col("n"), "ratio").otherwise("kept").alias("cause"))


def inflected(words: DataFrame, names: DataFrame) -> DataFrame:
    """(name, n): words that go on after a name of five letters or more; they meet on the first five."""
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("head", F.left("w", F.lit(5)))
    met = counted.join(names.withColumn("head", F.left("name", F.lit(5))), "head").where(F.col("w").startswith(F.col("name")) & (F.col("w") != F.col("name")))
    return met.groupBy("name").agg(F.sum("n").alias("n"))


def regressions(before: DataFrame, after: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """(keys, delta) where the value fell by more than that."""
    j = before.select(*keys, F.col(value).alias("a")).join(after.select(*keys, F.col(value).alias("b")), keys)
    return j.where(F.col("b") < F.col("a") - most).select(*keys, F.round(F.col("b") - F.col("a"), 6).alias("delta"))


# review, snapshots, audits


def validate_answers(rows: DataFrame, answer: str, allowed: list[str]) -> DataFrame:
    return rows.withColumn("valid", F.coalesce(F.col(answer).isin(allowed), F.lit(False)))


def snapshot_diff(before: DataFrame, after: DataFrame, path: str, value: str) -> DataFrame:
    """(path, change) of two flattened snapshots: added, removed or changed."""
    a, b = before.select(path, F.col(value).alias("a"), F.lit(1).alias("in_a")), after.select(path, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    j = a.join(b, path, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(path, F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("changed").alias("change"))


def audit_forms(forms: DataFrame, first: DataFrame) -> DataFrame:
    """(entity, problem): entities that nothing mentions, forms older than their entity."""
    j = forms.join(first, "entity", "left")
    return j.select("entity", F.when(F.col("first").isNull(), "starved").when(F.col("form_first") < F.col("first"), "form_before_entity").alias("problem")).where("problem is not null")


# names and text


def drop_paratext(claims: DataFrame, names: list[str]) -> DataFrame:
    return claims.where((F.col("subject") != F.col("object")) & ~F.col("subject").isin(names) & ~F.col("object").isin(names))


def propose_map(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(left_id, right_id, how): candidates that agree on one of the keys, one equality join a key."""
    out = None
    for how, (a, b) in keys.items():
        one = left.select(left_id, a.alias("k")).join(right.select(right_id, b.alias("k")), "k").select(left_id, right_id, F.lit(how).alias("how"))
        out = one if out is None else out.unionAll(one)
    return out.distinct()


def names_of_several_markers(rows: DataFrame, text: str, markers: list[str], name: str, least: int = 2) -> DataFrame:
    """(name, classes): names that follow two or more of the markers, each so often at least."""
    found = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"(?:{'|'.join(markers)}) {name}"), 0)).alias("m"))
    parts = found.select(F.split("m", " ").alias("p")).select(F.element_at("p", 2).alias("name"), F.element_at("p", 1).alias("marker"))
    often = parts.groupBy("name", "marker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.groupBy("name").agg(F.count(F.lit(1)).alias("classes")).where("classes >= 2")


def name_like(text: Column) -> Column:
    """No article in front, and a capitalised word other than The."""
    return ~text.rlike(r"(?i)^(a|an|the)([^\p{L}]|$)") & F.exists(F.split(text, " "), lambda w: w.rlike("^[A-Z]") & (w != "The"))


def names_someone(text: Column) -> Column:
    """A capitalised word beyond the first."""
    return F.exists(F.slice(F.split(text, " "), 2, 100_000), lambda w: w.rlike("^[A-Z]"))


def images_to_text(html: Column) -> Column:
    """Images as their alternative text; those without go."""
    return F.regexp_replace(F.regexp_replace(html, '<img[^>]*alt="([^"]*)"[^>]*>', "$1"), "<img[^>]*>", "")


def answer(text: Column) -> Column:
    """What stands before the first stop, without quotes around it."""
    return F.btrim(F.regexp_extract(text, "(?s)^(.*?)[.:!?]", 1), F.lit(" \"'"))


def no_evidence(text: Column) -> Column:
    return F.lower(text).rlike("^(no evidence|not stated|unknown)")


def before_bracket(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)\s*\(.*$", ""))


def pointer_key(text: Column) -> Column:
    """A JSON pointer's token."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def vocab_lines(rows: DataFrame, key: str, item: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.lit("- "), x)), "\n").alias("lines"))


def plain_markdown(text: Column) -> Column:
    """Links as their text, marks gone, white space single."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[*_`#>]+", ""), r"\s+", " ")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows in order while their running cost fits; the first always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).withColumn("sum_", F.sum(cost).over(w)).where((F.col("sum_") <= budget) | (F.col("rn_") == 1)).drop("rn_", "sum_")


def evidence_on_change(rows: DataFrame, key: str, vol: str, weight: str, item: str, most: int) -> DataFrame:
    """(key, vol, ids): the heaviest items up to each period, shown only where they differ from the period before.

    Of a period only its own heaviest can be among the heaviest so far, so each
    period brings that many rows at most to the running list.
    """
    best = rows.withColumn("rn_", F.row_number().over(Window.partitionBy(key, vol).orderBy(F.desc(weight), item))).where(F.col("rn_") <= most)
    own = best.groupBy(key, vol).agg(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(item).alias("i"))).alias("own"))
    upto = own.withColumn("all", F.flatten(F.collect_list("own").over(Window.partitionBy(key).orderBy(vol))))
    ids = F.array_join(F.transform(F.array_sort(F.transform(F.slice(F.array_sort("all"), 1, most), lambda x: x["i"])), lambda i: i.cast("string")), "|")
    shown = upto.select(key, vol, ids.alias("ids"))
    before = F.lag("ids").over(Window.partitionBy(key).orderBy(vol))
    return shown.withColumn("before", before).where(~F.col("ids").eqNullSafe(F.col("before"))).drop("before")


# extraction


def window_caps(windows: DataFrame, keys: list[str], n: str, each: float, floor: int) -> DataFrame:
    """windows with cap: a pool of `each` a window, shared by the square roots of their rows; never under the floor."""
    w = Window.partitionBy(*keys)
    share = F.bround(F.lit(each) * F.count(F.lit(1)).over(w) * F.sqrt(n) / F.sum(F.sqrt(n)).over(w))
    return windows.withColumn("cap", F.greatest(F.lit(floor), share.cast("int")))


def extract_windows(rows: DataFrame, keys: list[str], pos: str, gap: int, score: str, each: float, floor: int) -> DataFrame:
    """The best rows of every window of close positions, as many as the window's cap."""
    clustered = position_clusters(rows, keys, pos, gap)
    windows = window_caps(clustered.groupBy(*keys, "session").agg(F.count(F.lit(1)).alias("n")), keys, "n", each, floor)
    ranked = clustered.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys, "session").orderBy(F.desc(score), pos)))
    return ranked.join(windows.select(*keys, "session", "cap"), [*keys, "session"]).where("rn_ <= cap").drop("rn_", "cap")


def assertions(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, line, section, kind, text): what a Markdown page states, line by line, under its last heading."""
    lines = pages.select(key, F.posexplode(F.split(page, "\n")).alias("line", "raw"))
    heading = F.when(F.col("raw").rlike("^#+ "), F.regexp_replace("raw", "^#+ ", ""))
    lines = lines.withColumn("section", F.last(heading, True).over(Window.partitionBy(key).orderBy("line")))
    stated = lines.where((F.trim("raw") != "") & ~F.col("raw").rlike("^#+ "))
    bullet = F.col("raw").rlike("^[-*] ")
    return stated.select(key, "line", "section", F.when(bullet, "bullet").otherwise("prose").alias("kind"), F.regexp_replace("raw", "^[-*] ", "").alias("text"))


# more on names


def appositive_pairs(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """(a, b, n): the first two groups of every match of the pattern, as proposals of a pair."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)
    found = rows.select(F.explode(whole).alias("m"))
    return found.groupBy(F.regexp_extract("m", pattern, 1).alias("a"), F.regexp_extract("m", pattern, 2).alias("b")).agg(F.count(F.lit(1)).alias("n")).where("a <> b")


def name_core(text: Column, titles: list[str]) -> Column:
    """Lower-case words without titles and leading zeros, sorted."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(titles))
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.regexp_replace(w, "^0+(?=.)", ""))), " ")


def words_pair_up(a: Column, b: Column, least: float = 80) -> Column:
    """Whether every word that only one side has is that similar to one that only the other has; false if only one side has any."""
    near = lambda x, y: (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))) * 100 >= least
    covers = lambda p, q: F.forall(F.array_except(p, q), lambda x: F.exists(F.array_except(q, p), lambda y: near(x, y)))
    return covers(a, b) & covers(b, a)


def vocatives(text: Column) -> Column:
    """Capitalised words that open a line or a quotation and stand before a comma."""
    return F.regexp_count(text, F.lit("(?:^|[\"“])[A-Z][a-z]+,"))


def front_matter(fields: dict[str, Column]) -> Column:
    """The block that opens a page: a line for each field."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n")) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"))
