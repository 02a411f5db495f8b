"""One document of each group of near copies: those whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Every link is decided on the exact sets.  Candidates come in three steps, and
a pair already in one group is not looked at again:

1. SimHash fingerprints of the shingles, linked by BK-trees within RADIUS bits:
   every text against the first of its SimHash component.
2. MinHash bands: at similarity 0.8 a pair shares none of BANDS bands of ROWS
   minima with probability (1 - 0.8 ** 6) ** 64, under 4e-9.  Of texts that share a
   band, all pairs are compared up to GROUP texts; of more, each with the first
   and with the one before.
3. Of the larger bands' texts that the links so far leave in several groups,
   all pairs across groups, dealt out as pairs of chunks of bounded size.

A text's set of shingles moves once for each pair of steps 1 and 2; these are
linear in the texts.

Cases.  A null or word-less text has no shingle: all of these are one group;
fewer words than a shingle: the whole sequence is the one shingle; texts that
differ only in case of A-Z or in white space are copies; a row without an id
can't be named by any decision and stays; rows that share an id but not the
text are decided apart; of repeated rows one stays; an empty table gives an
empty result.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.runtime import lower_words, written
from tessera.llm.simhash import RENAME, fingerprint, in_chunks, link_codes, shards_of, signed

RADIUS = 4
BANDS, ROWS = 64, 6
#: Texts of one band of which all pairs are compared.
GROUP = 16
#: Pairs that meet one copy of their second text's set, and texts of a chunk in step 3.
MOST = 1024
#: Words whose hashes a task keeps at hand.
KNOWN_WORDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_PERMUTATIONS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], size: int, known: WordHashes) -> np.ndarray:
    """Hashes of all runs of size words; of the whole sequence if it is shorter."""
    n = len(words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(n, size)
    if not n:
        return h
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * _P + h[i : n - size + 1 + i]
    return mix(out + np.uint64(size))


def bands(distinct: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS minima each, over as many random orders of the shingles."""
    least = np.full(len(_PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(distinct), 512):
        np.minimum(least, (distinct[lo : lo + 512, None] * _PERMUTATIONS).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(out * _P + column)
    return out


def text_node(text: Column) -> Column:
    """A number for each text, the same for texts of the same lower-cased words."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.regexp_replace(F.regexp_replace(plain, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+", " "))


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """texts(node, text) -> (node, code, name, bands): once a task for each node that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for b in batches:
            nodes, codes, rows = [], [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1)):
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                h = shingles(lower_words(text.as_py()), words, known)
                nodes.append(node)
                codes.append(fingerprint(h))
                rows.append(bands(np.unique(h)).view(np.int64))
            names = [signed(c * RENAME % (1 << 64)) for c in codes]
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(map(signed, codes), pa.int64()), pa.array(names, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["node", "code", "name", "bands"])

    return written(texts.mapInArrow(run, "node long, code long, name long, bands array<long>"), "sketches")


def simhash_pairs(drawn: DataFrame) -> DataFrame:
    """(a, b): every text but the first of a SimHash component, and that first one."""
    codes = drawn.select("code", F.col("name").alias("node"), F.lit(0).alias("f")).distinct()
    found = components(link_codes(codes, RADIUS)).select(F.col("node").alias("name"), "root")
    placed = written(drawn.select("node", "name").distinct().join(found, "name", "left").select("node", F.coalesce("root", "name").alias("root")), "placed")
    firsts = placed.groupBy("root").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return placed.join(firsts, "root").where("node <> b").select(F.col("node").alias("a"), "b")


def band_pairs(drawn: DataFrame) -> DataFrame:
    """(a, b, large): candidates of the bands, a > b; large: the pair joins a text to the first of a band of more than GROUP texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, large = [], [], []
        band, members, first, last = None, [], None, None  # members: None once the band is large

        def close() -> None:
            for i, x in enumerate(members or ()):
                for y in members[:i]:
                    a.append(x), b.append(y), large.append(False)

        for batch in batches:
            bs, ns = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            alone = np.ones(len(bs), bool)  # bands of one row between two others, nearly all
            alone[:1], alone[-1:] = False, False
            alone[1:-1] &= (bs[1:-1] != bs[:-2]) & (bs[1:-1] != bs[2:])
            for x, node in zip(bs[~alone].tolist(), ns[~alone].tolist()):
                if x != band:
                    close()
                    band, members, first, last = x, [node], node, node
                    continue
                if node == last:
                    continue
                if members is not None and len(members) < GROUP:
                    members.append(node)
                else:
                    if members is not None:
                        for before, y in zip(members, members[1:]):
                            a.append(y), b.append(first), large.append(True)
                            if before != first:
                                a.append(y), b.append(before), large.append(False)
                        members = None
                    a.append(node), b.append(first), large.append(True)
                    a.append(node), b.append(last), large.append(False)
                last = node
            if len(a) > 100_000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(large, pa.bool_())], ["a", "b", "large"])
                a.clear(), b.clear(), large.clear()
        close()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(large, pa.bool_())], ["a", "b", "large"])

    rows = drawn.select(F.explode("bands").alias("band"), "node").repartition("band").sortWithinPartitions("band", "node")
    return written(rows.mapInArrow(run, "a long, b long, large boolean").groupBy("a", "b").agg(F.max("large").alias("large")), "pairs")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float, most: int = MOST) -> DataFrame:
    """pairs(a, b) whose sets(node, size, shingles) are that similar; a set meets at most so many pairs in one place."""
    pairs = written(pairs.select("a", "b").distinct(), "asked")
    hot = pairs.groupBy("b").count().where(F.col("count") > most).select("b", F.ceil(F.col("count") / most).alias("copies"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("copies")), F.lit(0)).alias("copy"))
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("shingles").alias("set_a"))
    right = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "b").join(hot, "b", "left")
    right = right.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("copy"), F.col("size").alias("size_b"), F.col("shingles").alias("set_b"))
    sizes = sets.select(F.col("node").alias("b"), F.col("size").alias("near"))
    dealt = dealt.join(sizes, "b").join(left, "a").where(F.least("size_a", "near") >= similarity * F.greatest("size_a", "near") - 1e-9)
    met = dealt.join(right, ["b", "copy"])
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(both >= similarity * (F.col("size_a") + F.col("size_b") - both) - 1e-9).select("a", "b")


def across(labels: list[int], sets: list[frozenset], similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels that join every two of that similarity; a pair already joined isn't compared."""
    first: dict[int, int] = {}
    root = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lo = 0
    for at, i in enumerate(order):
        n = len(sets[i])
        while len(sets[order[lo]]) < similarity * n - 1e-9:
            lo += 1
        for j in order[lo:at]:
            if find(i) != find(j):
                both = len(sets[i] & sets[j])
                if both >= similarity * (n + len(sets[j]) - both) - 1e-9:
                    root[find(i)] = find(j)
                    links.append((i, j))
    return links


def rest_links(pairs: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float, most: int = MOST) -> DataFrame:
    """Links that the larger bands' texts still lack: all pairs of a connected set of such bands that lie in several groups."""
    held = components(pairs.where("large").select("a", "b")).withColumnRenamed("root", "cell")
    held = written(held.join(groups, "node", "left").select("node", "cell", F.coalesce("root", "node").alias("label")), "held")
    mixed = held.groupBy("cell").agg((F.min("label") < F.max("label")).alias("mixed")).where("mixed").select("cell")
    rest = held.join(mixed, "cell", "left_semi").join(sets, "node").select("node", "cell", "label", "shingles")
    keys = ["cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards_of(batches, keys):
            node, label = (np.concatenate([r[c].to_numpy() for r in rows]).tolist() for c in ("node", "label"))
            links = across(label, [frozenset(s) for r in rows for s in r["shingles"].to_pylist()], similarity)
            yield pa.record_batch([pa.array([node[i] for i, _ in links], pa.int64()), pa.array([node[j] for _, j in links], pa.int64())], ["a", "b"])

    return in_chunks(rest, ["cell"], most).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def near_copy_groups(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """texts(node, text) -> (node, root) of every node that has a near copy other than itself."""
    drawn = sketches(texts, words)
    first, found = written(simhash_pairs(drawn), "first"), band_pairs(drawn)
    met = first.select("a", "b").unionAll(found.select("a", "b"))
    involved = met.select(F.col("a").alias("node")).unionAll(met.select(F.col("b").alias("node"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for b in batches:
            nodes, rows = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1)):
                if node not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    rows.append(np.unique(shingles(lower_words(text.as_py()), words, known)).view(np.int64))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["node", "shingles"])

    sets = texts.join(involved, "node", "left_semi").mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.any_value("shingles").alias("shingles"))
    sets = written(sets.select("node", F.size("shingles").alias("size"), "shingles"), "sets")
    links = written(similar(first, sets, similarity), "links")
    groups = components(links)
    a, b = (groups.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = found.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = written(links.unionAll(similar(apart, sets, similarity)), "links")
    groups = components(links)
    more = written(rest_links(found, groups, sets, similarity), "rest")
    return groups if more.isEmpty() else components(links.unionAll(more))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group of near copies or of chains of these: that with the smallest id."""
    own = "_".join(docs.columns)  # no column of docs has a name that ends so
    node, copies = f"node_{own}", f"copies_{own}"
    marked = docs.withColumn(node, text_node(F.col(text_col)))
    named = marked.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(node).alias("node"), F.col(text_col).alias("text"))
    rows = written(named.select("id", "node").groupBy("id", "node").count(), "rows")
    groups = near_copy_groups(named.select("node", "text"), words, similarity)
    texts = rows.groupBy("node").agg(F.min("id").alias("id"))
    rooted = texts.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "node")).alias("kept"))
    kept = rooted.select("kept.*").join(rows, ["id", "node"])
    kept = written(kept.select(F.col("id").alias(f"id_{own}"), F.col("node").alias(f"of_{own}"), F.col("count").alias(copies)), "kept")
    stays = marked.join(kept, (F.col(id_col) == F.col(f"id_{own}")) & (F.col(node) == F.col(f"of_{own}")))
    once = stays.where(F.col(copies) == 1).select(docs.columns)
    # of a repeated row one stays; aggregated before the shuffle, however often it is repeated
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = stays.where(F.col(copies) > 1).groupBy(id_col, node).agg(F.min_by(whole, F.to_json(whole)).alias(node + "_")).select(f"`{node}_`.*")
    return once.unionAll(again).unionAll(docs.where(F.col(id_col).isNull()))
