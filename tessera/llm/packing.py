"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt to packing groups of bounded size by a hash of the id, so
every group has its share of each source; a group is packed by best-fit
decreasing: the open bins stand in order of the room they have left, a piece
goes to the tightest bin that can take it, and the search moves on to the next
larger room while the bin's bitmaps show a conflict.  A bin takes at most
max_per_source documents of a source and one of a duplicate cluster.

Cases.  A null or word-less text has no piece and appears in no bin; a text
above the capacity is cut in full pieces and a rest, none of it is lost; a null
source is a source like any other; a null id is packed as id 0 is, under its
null id; repeated rows and equal texts are one duplicate cluster, so they never
share a bin; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import n_words, table, written

CAPACITY = 4096
MAX_PER_SOURCE = 4
#: Documents of a packing group, about; a group is packed in one task.
GROUP_DOCS = 8192


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, max_per_source: int) -> list[int]:
    """pieces (size, source, cluster), sizes 1 to capacity, in packing order -> the bin of each.

    Sources and clusters are numbered from 0.  A bin's source bitmap has
    max_per_source bits for each source, filled from the lowest.
    """
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending: ties go to the older bin
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        last, mine = 1 << (source * max_per_source + max_per_source - 1), 1 << cluster
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms):
            room, b = rooms[at]
            if not (sources[b] & last or clusters[b] & mine):
                del rooms[at]
                break
            at += 1
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        first = 1 << (source * max_per_source)
        while sources[b] & first:
            first <<= 1
        sources[b] |= first
        clusters[b] |= mine
        if room > size:
            insort(rooms, (room - size, b))
        out.append(b)
    return out


def pack_group(ids: list, sizes: list[int], sources: list, clusters: list, capacity: int, max_per_source: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (document's index, piece, first word, words, bin) of one group, bins numbered from 0."""
    number = {c: i for i, c in enumerate(sorted(set(clusters)))}
    named = {s: i for i, s in enumerate(sorted(set(sources), key=lambda s: (s is None, s or "")))}
    pieces = []
    for i, size in enumerate(sizes):
        for p in range(-(-size // capacity)):
            pieces.append((min(capacity, size - p * capacity), i, p))
    pieces.sort(key=lambda x: (-x[0], ids[x[1]] is None, ids[x[1]] or 0, x[1], x[2]))
    bins = best_fit([(size, named[sources[i]], number[clusters[i]]) for size, i, _ in pieces], capacity, max_per_source)
    return [(i, p, p * capacity, size, b) for (size, i, p), b in zip(pieces, bins)]


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, piece, first_word, n_words, bin, bin_offset): every word of docs in exactly one bin."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.sha2(F.lower(text), 256).alias("cluster"))
    slim = written(slim.where("size > 0"), "pieces")
    groups = max(1, round(slim.count() / group_docs))
    # by the row, not the text: copies spread over the groups, so no group is hot
    slim = slim.withColumn("grp", F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(0)), F.lit(7)), F.lit(groups)).cast("int"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def packed(rows: list[dict], grp: int) -> Iterator[pa.RecordBatch]:
            col = lambda k: [x for b in rows for x in b[k]]
            ids, sizes, sources, clusters = col("id"), col("size"), col("source"), col("cluster")
            used: dict[int, int] = {}
            out = []
            for i, p, first, size, b in pack_group(ids, sizes, sources, clusters, capacity, max_per_source):
                out.append((ids[i], sources[i], p, first, size, f"{grp:08d}-{b:06d}", used.get(b, 0)))
                used[b] = used.get(b, 0) + size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        types = [None, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        names = ["id", "source", "piece", "first_word", "n_words", "bin", "bin_offset"]
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            types[0] = b.schema.field("id").type
            grp = b["grp"].to_numpy()
            cuts = [0, *((grp[1:] != grp[:-1]).nonzero()[0] + 1).tolist(), len(grp)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and last != grp[lo]:
                    yield from packed(held, last)
                    held = []
                last = int(grp[lo])
                held.append(b.slice(lo, hi - lo).to_pydict())
        if held:
            yield from packed(held, last)

    order = ["grp", "id", "source", "size", "cluster"]
    schema = f"id {kind}, source string, piece int, first_word long, n_words long, bin string, bin_offset long"
    return slim.repartition("grp").sortWithinPartitions(*order).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
