"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over pigeonhole shards, components.

Cases.  A null or word-less text has fingerprint zero, which links like any
other; fewer words than a shingle: the whole sequence is the one shingle; a
null id keeps its row and its fingerprint but never names a component (a
component of null ids only has a null component_id); repeated rows and equal
texts get the same fingerprint, so the same component; an empty table gives an
empty result.  Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.runtime import lower_words, table, written

SEED = 42
#: Odd, so that multiplying by it modulo 2**64 only renames the fingerprints; the names come in random order.
RENAME = 0x9E3779B97F4A7C15
#: A shard with more codes than this is cut in chunks, and each pair of chunks becomes a shard.
SHARD_CODES = 8192
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of size words, space-joined; of the whole sequence if it is shorter."""
    n = len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if n else [], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[: n - size]]
    return np.frombuffer(b"".join([digest(line[s:e], seed) for s, e in zip(starts, ends[size - 1 :])]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; no hash: 0."""
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    # eight bits at a time, each in a byte lane of its own: 255 rows can't overflow a lane
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    rows, counts = padded.reshape(-1, 255), np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts.reshape(64) * 2 > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code, node): the fingerprint as a signed long, and its name in random order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(shingle_hashes(lower_words(t.as_py()), words)) for t in batch.column(1)]
            nodes = [signed(c * RENAME % (1 << 64)) for c in codes]
            yield pa.record_batch([batch.column(0), pa.array(map(signed, codes), pa.int64()), pa.array(nodes, pa.int64())], ["id", "code", "node"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, code long, node long")


class BKTree:
    """A BK-tree that also keeps the components of its codes.

    A child hangs from its parent under their integer Hamming distance; a
    search with distance d to a node follows only edges from d - radius to
    d + radius.  A subtree all in the searched code's own component is skipped:
    it can add no link.
    """

    def __init__(self, radius: int) -> None:
        self.radius, self.codes, self.children, self.root, self.mixed = radius, [], [], [], []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def within(self, code: int) -> list[int]:
        """Every node within the radius."""
        out, stack = [], [0] if self.codes else []
        while stack:
            j = stack.pop()
            d = (self.codes[j] ^ code).bit_count()
            if d <= self.radius:
                out.append(j)
            stack += [c for e, c in self.children[j].items() if d - self.radius <= e <= d + self.radius]
        return out

    def add(self, code: int) -> None:
        """Insert a new code and join the components that it links."""
        i, r, codes, children, root = len(self.codes), self.radius, self.codes, self.children, self.root
        codes.append(code)
        children.append({})
        root.append(i)
        self.mixed.append(False)
        if not i:
            return
        stack, mine = [0], i
        while stack:
            j = stack.pop()
            if not self.mixed[j] and self.find(j) == mine:
                continue
            d = (codes[j] ^ code).bit_count()
            if d <= r and (other := self.find(j)) != mine:
                mine, other = min(mine, other), max(mine, other)
                root[other] = mine
            for e, c in children[j].items():
                if d - r <= e <= d + r:
                    stack.append(c)
        j = 0
        while True:
            if self.find(j) != mine:
                self.mixed[j] = True
            d = (codes[j] ^ code).bit_count()
            if (c := children[j].get(d)) is None:
                children[j][d] = i
                return
            j = c


def forest(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (index, index of the component's first code) that join all that the radius joins."""
    tree = BKTree(radius)
    for code in codes:
        tree.add(code)
    return [(i, r) for i in range(len(codes)) if (r := tree.find(i)) != i]


def blocks(n_codes: int, radius: int) -> list[tuple[int, list[int]]]:
    """Tables of a pigeonhole scheme: for each, its bits as a mask.

    m blocks of the 64 bits, of which at most radius differ: some m - radius
    agree entirely, and there is one table for each choice of these.  m is the
    least that leaves 64 random codes to a shard; every m finds every pair.
    """
    for m in range(radius + 1, 2 * radius + 1):
        edges = [round(64 * i / m) for i in range(m + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        tables = [sum(parts[i] for i in chosen) for chosen in combinations(range(m), m - radius)]
        if n_codes / 2 ** min(t.bit_count() for t in tables) <= 64:
            break
    return tables


def in_chunks(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows(..., node, keys) with columns i and j: a group of up to most rows is the one shard (0, 0).

    A larger group is cut in chunks by node, and each pair of chunks i <= j
    becomes a shard, so that every two rows meet in a shard of bounded size.
    """
    large = rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    mine = F.pmod(F.col("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, mine).alias("i"), F.greatest(c, mine).alias("j")))
    joined = rows.join(large, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return joined.withColumn("p", F.explode(pairs)).select(*rows.columns, "p.i", "p.j")


def shards_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The slices of each run of rows with equal integer keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cut = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
            key = tuple(int(c[lo]) for c in columns)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def link_codes(codes: DataFrame, radius: int, shard_codes: int = SHARD_CODES) -> DataFrame:
    """codes(code, node, f), distinct -> edges(a, b) between nodes that join what the radius joins.

    f numbers the fingerprints of a node; only codes of one number link.  A code goes to one shard of each table, so the work is linear in codes as
    long as shards are small; the tree of a shard is built in the task that
    gets its codes.  A shard beyond shard_codes is dealt out as pairs of chunks.
    """
    masks = blocks(codes.groupBy("f").count().agg(F.max("count")).first()[0] or 0, radius)
    keyed = codes.withColumn("key", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in enumerate(masks)])))
    keyed = keyed.select("code", "node", (F.col("key.t") + F.col("f") * len(masks)).alias("t"), "key.k")
    keyed = in_chunks(keyed, ["t", "k"], shard_codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for held in shards_of(batches, keys):
            if sum(x.num_rows for x in held) > 1:
                code, node = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("code", "node"))
                links = forest(code.view(np.uint64).tolist(), radius)
                a.append(node[[i for i, _ in links]])
                b.append(node[[r for _, r in links]])
        none = np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    keys = ["t", "k", "i", "j"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys, "code").mapInArrow(run, "a long, b long")


def group(prints: DataFrame, radius: int) -> DataFrame:
    """prints(id, code, node) -> (id, code, component_id)."""
    codes = written(prints.groupBy("code", "node").agg(F.min("id").alias("first_id")), "codes")
    found = components(link_codes(codes.select("code", "node", F.lit(0).alias("f")), radius))
    rooted = codes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(names, "root").select("code", "component_id"), "named")
    return prints.join(named, "code").select("id", "code", "component_id")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Bit i of the fingerprint is the majority of bit i over the XXH64 of all
    word shingles; fingerprints at radius or fewer differing bits link, and
    component_id is the smallest id reachable over links.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    return group(prints, radius).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)
