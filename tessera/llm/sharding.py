"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Law: rows.  The capacities add up to the number of rows and differ by one at
most, so every shard ends exactly full.  A text's hash is its place on the
ring: equal texts stand together and stay together unless their shard is full;
what overflows continues clockwise to the next virtual node whose shard has
room.  Each shard first keeps what falls on its own arcs, so only the overflow
moves.

Cases.  A null text has no bytes (size 8, crc32 0) and a place of its own; a
null id is placed by its text; repeated rows are placed one by one; an empty
table gives an empty result.  Only the columns named are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import table, written

#: The ring has this many cells; a virtual node stands at the end of one.
CELL_BITS = 16


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Cells with a virtual node, ascending, and the shard of each (the smallest shard where two meet)."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            at.setdefault(xxhash.xxh64_intdigest(f"{s}/{v}") >> (64 - CELL_BITS), s)
    where = sorted(at)
    return where, [at[c] for c in where]


def segments(cells: dict[int, int], shards: int, virtual_nodes: int) -> list[tuple[int, int, int]]:
    """Counts by cell -> (first rank, shard, first slot), ascending, over the ranks of keys in ring order."""
    total = sum(cells.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    where, owner = ring(shards, virtual_nodes)
    runs: list[list[int]] = []  # of each stretch of cells with one owner: first rank, rows, virtual node
    rank = 0
    for cell in sorted(cells):
        v = bisect_left(where, cell) % len(where)
        if runs and runs[-1][2] == v:
            runs[-1][1] += cells[cell]
        else:
            runs.append([rank, cells[cell], v])
        rank += cells[cell]
    out: list[tuple[int, int, int]] = []

    def place(first: int, rows: int, shard: int) -> None:
        out.append((first, shard, used[shard]))
        used[shard] += rows
        free[shard] -= rows

    over = []
    for first, rows, v in runs:
        if own := min(rows, free[owner[v]]):
            place(first, own, owner[v])
        if rows > own:
            over.append((first + own, rows - own, v))
    onward = list(range(len(where)))  # the next virtual node, clockwise, that may have room

    def next_free(v: int) -> int:
        seen = []
        while not free[owner[v]]:
            seen.append(v)
            v = onward[v] if onward[v] != v else (v + 1) % len(where)
        for x in seen:
            onward[x] = v
        return v

    for first, rows, v in over:
        while rows:
            v = next_free(v)
            now = min(rows, free[owner[v]])
            place(first, now, owner[v])
            first, rows = first + now, rows - now
    return sorted(out)


def ring_shards(docs: DataFrame, shards: int = 24, virtual_nodes: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text_col).alias("h"), F.xxhash64(id_col).alias("tie"))
    slim = slim.withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS))
    order = ["cell", "h", "tie", "id"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            rank = np.arange(n, n := n + b.num_rows)
            yield pa.record_batch([b["id"], b["size"], b["crc"], b["cell"], pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)], ["id", "size", "crc", "cell", "part", "rank"])

    kind = slim.schema["id"].dataType.simpleString()
    # one range sort of narrow rows; the ties among equal texts are cut by id, so no text makes a hot partition
    ranked = slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"id {kind}, size long, crc long, cell long, part int, rank long")
    ranked = written(ranked, "ring")
    parts = dict(ranked.groupBy("part").count().collect())  # a number for each partition and each of the 65,536 cells
    cells = dict(ranked.groupBy("cell").count().collect())
    offset, seen = {}, 0
    for p in sorted(parts):
        offset[p], seen = seen, seen + parts[p]
    plan = np.array(segments(cells, shards, virtual_nodes) or [(0, 0, 0)], np.int64).T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, slot = plan
        for b in batches:
            part = b["part"].to_numpy()
            rank = b["rank"].to_numpy() + np.array([offset[p] for p in part.tolist()], np.int64)
            at = np.searchsorted(first, rank, side="right") - 1
            yield pa.record_batch([b["id"], b["size"], b["crc"], pa.array(shard[at].astype(np.int32)), pa.array(slot[at] + rank - first[at])], ["id", "size", "crc", "shard", "slot"])

    placed = ranked.select("id", "size", "crc", "part", "rank").mapInArrow(place, f"id {kind}, size long, crc long, shard int, slot long")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ring_shards(spark, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"), shards=24)
