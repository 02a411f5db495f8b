"""Ordered operators: gaps and islands, sessions, caps, greedy packing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(rows: DataFrame, keys: list[str], position: Column, gap: float, tie: str) -> DataFrame:
    """rows with session, numbered from 0 within keys: a new one starts where the gap to the row before is larger."""
    order = Window.partitionBy(*keys).orderBy("pos_", tie)
    rows = rows.withColumn("pos_", position)
    new = F.when(F.col("pos_") - F.lag("pos_").over(order) > gap, 1).otherwise(0)
    return rows.withColumn("new_", new).withColumn("session", F.sum("new_").over(order)).drop("new_", "pos_")


def context_bounds(rows: DataFrame, keys: list[str], order_by: list[str], breaks: Column, before: int, after: int, value: str) -> DataFrame:
    """rows with lo and hi, the value of the furthest rows within reach that no break divides from this one."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    rows = rows.withColumn("break_", F.when(breaks, 1).otherwise(0)).withColumn("stretch", F.sum("break_").over(order))
    near = Window.partitionBy(*keys, "stretch").orderBy(*order_by).rowsBetween(-before, after)
    return rows.withColumn("lo", F.min(value).over(near)).withColumn("hi", F.max(value).over(near)).drop("break_", "stretch")


def neighbourhood(rows: DataFrame, keys: list[str], order_by: list[str], value: str, radius: int, sep: str = " ") -> DataFrame:
    """rows with context: the values of the rows around, joined in order."""
    near = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(-radius, radius)
    return rows.withColumn("context", F.array_join(F.collect_list(value).over(near), sep))


def sqrt_caps(counts: DataFrame, base: int, floor: int, n: str = "n") -> DataFrame:
    """counts with cap: the pool of base a row, dealt in proportion to the square root of n, at least floor; halves to even."""
    total = counts.agg(F.sum(F.sqrt(n)).alias("roots_"), F.count(F.lit(1)).alias("rows_"))
    dealt = counts.join(F.broadcast(total))  # one row
    return dealt.withColumn("cap", F.greatest(F.lit(floor), F.bround(base * F.col("rows_") * F.sqrt(n) / F.col("roots_")).cast("int"))).drop("roots_", "rows_")


def greedy_groups(rows: DataFrame, keys: list[str], order_by: list[str], size: str, budget: int) -> DataFrame:
    """rows with group: in order, a group is closed when the next row would exceed the budget; one row always fits.

    A key's sizes are folded as one array, so a key must be a bounded unit such
    as a chapter or a document.
    """
    items = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(size).cast("long").alias("size_")))).alias("items_"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        closes = (F.size(acc["out"]) > 0) & (acc["used"] + x["size_"] > budget)
        group = acc["group"] + closes.cast("int")
        return F.struct(F.when(closes, x["size_"]).otherwise(acc["used"] + x["size_"]).alias("used"), group.alias("group"), F.concat(acc["out"], F.array(group)).alias("out"))

    groups = items.withColumn("groups_", F.aggregate("items_", start, step, lambda a: a["out"]))
    flat = groups.select(*keys, F.explode(F.arrays_zip("items_", "groups_")).alias("z"))
    return flat.select(*keys, *[F.col(f"z.items_.{c}").alias(c) for c in order_by], F.col("z.items_.size_").alias(size), F.col("z.groups_").alias("group"))


def fill_skipping(rows: DataFrame, keys: list[str], order_by: list[Column], size: str, budget: int, item: str) -> DataFrame:
    """rows with taken: in order, whatever still fits is taken and what doesn't is skipped."""
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    items = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank_", F.col(size).cast("long").alias("size_"), F.col(item).alias("item_")))).alias("items_"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size_"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["size_"]).otherwise(0)).alias("used"), F.concat(acc["out"], F.array(fits)).alias("out"))

    out = items.withColumn("taken_", F.aggregate("items_", start, step, lambda a: a["out"]))
    flat = out.select(*keys, F.explode(F.arrays_zip("items_", "taken_")).alias("z"))
    return flat.select(*keys, F.col("z.items_.rank_").alias("rank"), F.col("z.items_.item_").alias(item), F.col("z.items_.size_").alias(size), F.col("z.taken_").alias("taken"))


def top_k_in_budget(rows: DataFrame, keys: list[str], order_by: list[Column], size: str, k: int, budget: int) -> DataFrame:
    """The first k in order while their running size keeps within the budget; the first always."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("running", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rank") == 1) | (F.col("running") <= budget))


def top_k(rows: DataFrame, keys: list[str], order_by: list[Column], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def carry_forward(rows: DataFrame, keys: list[str], order_by: list[str], value: str, out: str) -> DataFrame:
    """The last value that isn't null, up to this row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)))


def ranges_as_text(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct integers of a key as text: '1-3, 5'."""
    distinct = rows.select(*keys, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    spans = distinct.withColumn("island_", island).groupBy(*keys, "island_").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    spans = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", label.alias("label")))).alias("spans"))
    return spans.select(*keys, F.array_join(F.transform("spans", lambda s: s["label"]), ", ").alias("ranges"))
