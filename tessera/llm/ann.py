"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is stored as the signs of its rotated residual from a centroid,
with two correction scalars.  From the packed bits a scan estimates inner
products and bounds their error; only vectors whose upper bound reaches the
query's running threshold are reranked on the original vectors in double
precision.  Centroids, rotation, thresholds to start from and the number of
lists to probe are fitted on a bounded sample; every row is indexed.

Queries are sent to the lists that they probe; a task holds a chunk of a list
and takes its queries a batch at a time.

Cases.  Vectors that are null, all zero, or hold null or non-finite components
take no part, nor do rows without an id and vectors of another length than the
most frequent one (of equally frequent lengths, the longest); rows that share
the query's id are not its candidates; repeated ids are one
candidate and one query; ties go to the smaller id; an empty table gives an empty result.
Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import table, written

SAMPLE = 4096
MAX_LISTS = 1024
#: Rows of a list that one task holds at a time; pairs of a query and a row that are estimated at a time.
CHUNK, BLOCK = 32_768, 1 << 21
#: Bits to which a query's components are rounded for the estimate.
LEVELS = 6
#: Share of pairs that may reach their query's floor above which they are reranked by one matrix product.
DENSE = 0.05
#: Share of the sample's true neighbours that the probed lists must hold.
COVER = 0.995
#: Standard deviations of the estimate's error that the bound allows for.
BOUND = 2.6
SEED = 5
NAMES = ["list", "chunk", "kind", "id", "code", "norm", "fit", "x"]


def fit_index(x: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sample [rows, d], size of the table -> centroids, rotation, lists to probe."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    lists = int(np.clip(round(n**0.5 / 2), 1, min(MAX_LISTS, max(1, len(x) // 8))))
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(8):
        owner = nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(owner, minlength=lists)
        np.add.at(sums, owner, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    owner = nearest(x, centroids)
    probe = x[:256]
    s = probe @ x.T
    s[np.arange(len(probe)), np.arange(len(probe))] = -np.inf
    top = np.argsort(-s, axis=1)[:, : min(k, max(1, len(x) - 1))]
    rank = np.argsort(np.argsort(-(probe @ centroids.T), axis=1), axis=1)
    ranks = np.take_along_axis(rank, owner[top], axis=1).ravel()
    return centroids, rotation, int(min(lists, np.quantile(ranks, COVER, method="higher") + 1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def encode(x: np.ndarray, centroids: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """list, packed sign bits, residual norm, inner product of the code with the unit residual."""
    owner = nearest(x, centroids)
    r = (x - centroids[owner]) @ rotation
    norm = np.linalg.norm(r, axis=1)
    fit = np.abs(r).sum(axis=1) / np.where(norm > 0, norm, 1) / r.shape[1] ** 0.5
    return owner, np.packbits(r > 0, axis=1), norm, np.where(norm > 0, fit, 1.0)


def best_of(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) triples, each query's k best, ties to the smaller id; an id counts once."""
    order = np.lexsort((ids, -score, i))
    i, ids, score = i[order], ids[order], score[order]
    pair = np.lexsort((np.arange(len(i)), ids, i))
    again = np.zeros(len(i), bool)
    again[pair[1:]] = (i[pair[1:]] == i[pair[:-1]]) & (ids[pair[1:]] == ids[pair[:-1]])
    i, ids, score = i[~again], ids[~again], score[~again]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], ids[top], score[top]


class Shard:
    """Rows of one list: packed codes as 64-bit words, correction scalars, original vectors."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray, norm: np.ndarray, fit: np.ndarray, x: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> None:
        self.ids, self.norm, self.x, self.centroid, self.rotation = ids, norm, x, centroid, rotation
        d = x.shape[1]
        self.words = packed_words(bits)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64).astype(np.float32)
        self.scale = norm / (fit * d**0.5)
        self.spread = norm * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / max(1, d - 1) ** 0.5
        self.repeats = int(np.unique(ids, return_counts=True)[1].max(initial=1))

    def estimate(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products [queries, rows] and their upper bounds.

        A rotated query is rounded to LEVELS-bit steps and kept as bit planes, so
        that the sum of its components where a code has ones is a sum of counts
        of common bits.
        """
        d, n = q.shape[1], len(self.ids)
        turned = q @ self.rotation
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << LEVELS) - 1), 1e-300)
        rounded = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        common = np.zeros((len(q), n), np.uint16)
        for level in range(LEVELS):
            plane = packed_words(np.packbits(rounded >> level & 1, axis=1))
            for w in range(plane.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & self.words[None, :, w]).astype(np.uint16) << np.uint16(level)
        within = low[:, None] * self.ones + step[:, None] * common
        estimate = (2 * within - turned.sum(axis=1)[:, None]) * self.scale + (q @ self.centroid)[:, None]
        length = np.linalg.norm(q, axis=1)[:, None]
        rounding = 3 * step[:, None] * (d / 6) ** 0.5 * self.scale
        return estimate, estimate + BOUND * length * self.spread + rounding + 1e-6 * length * (self.norm + 1)

    def search(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of each query's k best rows with a score of its floor or more."""
        may = self.estimate(q)[1] >= floor[:, None]
        may &= ids[:, None] != self.ids[None, :]
        if may.mean() > DENSE:  # so many to rerank that one product is cheaper than gathering them
            exact = np.where(may, q @ self.x.T, -np.inf)
            least, most = floor.copy(), k * self.repeats
            if exact.shape[1] > most:
                least = np.maximum(least, np.partition(exact, exact.shape[1] - most, axis=1)[:, exact.shape[1] - most])
            may = exact >= (least - 1e-9 * (np.abs(np.where(np.isfinite(least), least, 0)) + 1))[:, None]
            may &= np.isfinite(exact)
        i, j = np.nonzero(may)
        found = []
        for lo in range(0, len(i), 200_000):
            a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
            score = np.einsum("ij,ij->i", q[a], self.x[b])
            good = score >= floor[a]
            found.append((a[good], self.ids[b[good]], score[good]))
        return best_of(*map(np.concatenate, zip(*found)), k) if found else (i, self.ids[j], np.zeros(0))


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def sound(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row where queries holds, its k nearest other rows."""
    spark = vectors.sparkSession
    out_schema = f"query_id long, rank int, {id_col} long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double")).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & sound(F.col("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    d, n = sizes["d"], sizes["count"]
    rows = rows.where(F.size("x") == d)
    matrix = lambda column: np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, d)
    sample = rows.select("id", "x").orderBy(F.xxhash64("id", F.lit(SEED)), "id", "x").limit(SAMPLE).toArrow()
    sample_ids, sample_x = sample["id"].to_numpy(), matrix(sample["x"])
    centroids, rotation, probes = fit_index(sample_x, n, k)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["x"])
            owner, bits, norm, fit = encode(x, centroids, rotation)
            code = pa.array([r.tobytes() for r in bits], pa.binary())
            yield pa.record_batch([b["id"], b["asks"], pa.array(owner.astype(np.int32)), code, pa.array(norm), pa.array(fit), b["x"]], ["id", "asks", "list", "code", "norm", "fit", "x"])

    indexed = written(rows.mapInArrow(index, "id long, asks boolean, list int, code binary, norm double, fit double, x array<double>"), "index")
    # one number for each of the lists
    chunks = {r["list"]: -(-r["count"] // CHUNK) for r in indexed.groupBy("list").count().collect()}
    asking = written(indexed.where("asks").groupBy("id").agg(F.min("x").alias("x")), "queries")

    def in_sample(ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k best of the sample, and a floor: no answer lies below the last of these."""
        found, floor = [], np.full(len(ids), -np.inf)
        for lo in range(0, len(ids), 512):
            s = q[lo : lo + 512] @ sample_x.T
            s[ids[lo : lo + 512, None] == sample_ids] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            i, j = np.repeat(np.arange(lo, lo + len(s)), top.shape[1]), top.ravel()
            other = ids[i] != sample_ids[j]
            i, j = i[other], j[other]
            found.append(best_of(i, sample_ids[j], np.einsum("ij,ij->i", q[i], sample_x[j]), k))
        i, got, score = map(np.concatenate, zip(*found)) if found else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        full = np.flatnonzero(np.bincount(i, minlength=len(ids)) == k)
        np.minimum.at(low := np.full(len(ids), np.inf), i, score)
        floor[full] = low[full] - 1e-9 * (np.abs(low[full]) + 1)
        return i, got, score, floor

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["id"].to_numpy()
            i, got, score, _ = in_sample(ids, matrix(b["x"]))
            yield pa.record_batch([pa.array(ids[i]), pa.array(got), pa.array(score)], ["query_id", "id", "score"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, q = b["id"].to_numpy(), matrix(b["x"])
            floor = in_sample(ids, q)[3]
            near = np.argpartition(-(q @ centroids.T), probes - 1, axis=1)[:, :probes]
            for lst, of in sorted(chunks.items()):
                mine = np.flatnonzero((near == lst).any(axis=1))
                for chunk in range(of if len(mine) else 0):
                    same = lambda v: pa.array(np.full(len(mine), v, np.int32))  # noqa: B023, E731
                    yield pa.record_batch([same(lst), same(chunk), same(1), pa.array(ids[mine]), pa.nulls(len(mine), pa.binary()), pa.array(floor[mine]), pa.nulls(len(mine), pa.float64()), b["x"].take(pa.array(mine))], NAMES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b[c].to_numpy() for c in ("list", "chunk", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part, (lst, chunk, kind) = b.slice(lo, hi - lo), place[lo].tolist()
                if (lst, chunk) != key:
                    key, held, shard = (lst, chunk), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if shard is None:
                    col = lambda c: np.concatenate([h[c].to_numpy() for h in held])  # noqa: B023, E731
                    bits = np.frombuffer(b"".join(v for h in held for v in h["code"].to_pylist()), np.uint8).reshape(sum(h.num_rows for h in held), -1)
                    shard = Shard(col("id"), bits, col("norm"), col("fit"), np.concatenate([matrix(h["x"]) for h in held]), centroids[lst], rotation)
                ids, q, floor = part["id"].to_numpy(), matrix(part["x"]), part["norm"].to_numpy()
                step = max(16, BLOCK // len(shard.ids))
                for at in range(0, len(ids), step):
                    i, found, score = shard.search(ids[at : at + step], q[at : at + step], floor[at : at + step], k)
                    yield pa.record_batch([pa.array(ids[at + i]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    number = F.element_at(F.create_map(*[F.lit(v) for x in chunks.items() for v in x]), F.col("list"))
    stored = indexed.select("list", F.pmod(F.xxhash64("id", "x"), number).cast("int").alias("chunk"), F.lit(0).alias("kind"), "id", "code", "norm", "fit", "x")
    asked = asking.mapInArrow(route, "list int, chunk int, kind int, id long, code binary, norm double, fit double, x array<double>")
    place = ["list", "chunk"]
    # rows of a chunk come first, then its queries, a batch of which is in memory at a time
    met = stored.unionAll(asked).repartition(*place).sortWithinPartitions(*place, "kind", "id")
    triples = "query_id long, id long, score double"
    found = met.mapInArrow(search, triples).unionAll(asking.mapInArrow(seeds, triples))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_rotated_codes(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
