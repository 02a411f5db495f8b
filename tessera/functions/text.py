"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words and what they count.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}


def words(text: Column) -> Column:
    """White-space separated words; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\x0B\f\r\n]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tidy(text: Column) -> Column:
    """Non-breaking spaces to spaces, runs of white space to one, ends trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"[ \t\x0B\f\r\n]+", " "))


def fold(text: Column) -> Column:
    """tidy, in lower case: the form in which values and qualifiers are compared."""
    return F.lower(tidy(text))


def unescape(text: Column) -> Column:
    """The named entities of running text, the ampersand last."""
    out = text
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def slug(text: Column) -> Column:
    """Latin letters without accents, lower case, other runs to a dash; 'entity' for nothing."""
    plain = F.translate(F.lower(text), "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    plain = F.replace(F.replace(F.replace(plain, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    out = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(out) > 0, out).otherwise(F.lit("entity"))


def short_hash(prefix: str, *parts: Column, length: int = 8) -> Column:
    """prefix and the first hex digits of the SHA-1 of the parts joined by bars; null parts are empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, length))


def number_or_range(text: Column) -> Column:
    """Digits of the numbers in the text, number words included, several of them joined by dashes; the folded text itself without any."""
    tokens = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    keys = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, v)])

    def step(acc: Column, w: Column) -> Column:
        digits = F.when(w.rlike("^[0-9]+$"), w.cast("int"))
        value = F.coalesce(digits, F.try_element_at(keys, w))
        joins = acc["open"] & value.isNotNull() & (value < 10) & digits.isNull()
        last = F.element_at(acc["found"], -1)
        grown = F.when(joins, F.concat(F.slice(acc["found"], 1, F.size(acc["found"]) - 1), F.array(last + value))).when(value.isNotNull(), F.concat(acc["found"], F.array(value))).otherwise(acc["found"])
        opens = ~joins & value.isNotNull() & digits.isNull() & (value >= 20)
        return F.struct(grown.alias("found"), F.coalesce(opens, F.lit(False)).alias("open"))

    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(False).alias("open"))
    found = F.aggregate(tokens, start, lambda a, w: F.when(w == "", a).otherwise(step(a, w)), lambda a: a["found"])
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x.cast("string")), "-")).otherwise(fold(text))


def token_estimate(text: Column, round_up: bool = False) -> Column:
    """About four characters a token: at least one, or rounded up."""
    return F.ceil(F.length(text) / 4).cast("int") if round_up else F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s) != "")


def sentence_count(text: Column) -> Column:
    """Runs that end in a stop; at least one if there is any text."""
    return F.when(F.trim(text) == "", F.lit(0)).otherwise(F.greatest(F.regexp_count(text, F.lit(r"[^.!?][.!?]")), F.lit(1)))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, though use names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens."""

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def ngrams_kept(before: Column, after: Column, n: int = 4, least: int = 5) -> Column:
    """Share of the distinct n-grams before that are there after; 0 if there are fewer than least before."""
    a, b = ngrams(words(F.lower(before)), n), ngrams(words(F.lower(after)), n)
    both = F.struct(a.alias("a"), b.alias("b"))
    return bound(both, lambda x: F.when(F.size(x["a"]) < least, F.lit(0.0)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["a"])))


def keywords(text: Column, least: int = 4) -> Column:
    """Distinct lower-case words of some length, sorted, a final 's dropped."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+(?:'[a-z]+)?"), 0), lambda w: F.regexp_replace(w, "'s$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) >= least)))
