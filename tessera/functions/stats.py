"""Statistics of rates and cells as column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of k of n, rounded to three places; (0, 0) for none."""
    p = k / n
    middle, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    bound = lambda x: F.when(n > 0, F.round(x / scale, 3)).otherwise(0.0)
    return bound(F.greatest(middle - half, F.lit(0.0))), bound(middle + half)


def zero_event_bound(n: Column) -> Column:
    """The rate that would leave no event in n with a chance of 5 %."""
    return 1 - F.pow(F.lit(0.05), 1.0 / n)


def nearest_rank(values: Column, q: float) -> Column:
    """Of a sorted array, the element at round(q * (n - 1)), halves to even."""
    return F.element_at(values, (F.bround(q * (F.size(values) - 1)) + 1).cast("int"))


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted ratio of a cell: sum of weight times num over sum of weight times den."""
    return rows.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("num")) / F.sum(F.col("weight") * F.col("den"))).alias("value"))


def macro(cell: DataFrame, keys: list[str]) -> DataFrame:
    """The unweighted mean over cutoffs of a cell's ratios, never pooled."""
    return cell.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


def paired(cell: DataFrame, keys: list[str], system: str, a: str, b: str) -> DataFrame:
    """Differences of two systems on the cells that both have."""
    one = cell.where(F.col(system) == a).select(*keys, F.col("value").alias("va"))
    two = cell.where(F.col(system) == b).select(*keys, F.col("value").alias("vb"))
    return one.join(two, keys).withColumn("difference", F.col("va") - F.col("vb"))


def bootstrap(rows: DataFrame, cluster: str, replicates: int, seed: int = 1) -> DataFrame:
    """(rep, value): the pooled ratio of each of many resamples of clusters with replacement.

    A cluster is drawn in a replicate a Poisson number of times, from a hash of
    seed, replicate and cluster, so no row is drawn centrally and reruns agree.
    Clusters are summed first: what is repeated is one row a cluster.
    """
    sums = rows.groupBy(cluster).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    reps = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", cluster), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # inverse of the Poisson(1) distribution function up to 7 draws
    cdf, p = [], 2.718281828459045**-1
    for k in range(7):
        cdf.append((cdf[-1] if cdf else 0.0) + p)
        p /= k + 1
    draws = sum((F.when(u > c, 1).otherwise(0) for c in cdf[1:]), F.when(u > cdf[0], 1).otherwise(0))
    reps = reps.withColumn("draws", draws)
    return reps.groupBy("rep").agg((F.sum(F.col("draws") * F.col("num")) / F.sum(F.col("draws") * F.col("den"))).alias("value"))


def sample_per_stratum(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """A sample without replacement of n rows a stratum, by a hash of the key: reruns agree."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("rn_", F.row_number().over(order)).where(F.col("rn_") <= n).drop("rn_")


def pass_rates(scores: DataFrame, unit: list[str], by: list[str], columns: list[str], least: float = 0.5) -> DataFrame:
    """Of each by, the share of units whose every score is least or more, for each column and for all; a null score is none."""
    worst = scores.groupBy(*by, *unit).agg(*[F.min(c).alias(c) for c in columns])
    ok = {c: F.coalesce(F.col(c) >= least, F.lit(False)) for c in columns}
    every = F.lit(True)
    for c in columns:
        every = every & ok[c]
    rates = [F.round(F.avg(v.cast("int")), 4).alias(c) for c, v in ok.items()]
    return worst.groupBy(*by).agg(*rates, F.round(F.avg(every.cast("int")), 4).alias("both"), F.count(F.lit(1)).alias("n"))
