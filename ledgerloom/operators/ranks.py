"""Dense ids, global ranks and exact quantiles without a window over one partition.

Rows are range-partitioned and sorted, counted by partition, and numbered within their partition from the partition's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import materialize


def with_offsets(df: DataFrame, order: list, amount: str | None, out: str) -> DataFrame:
    """df with `out`: the sum of `amount` (None: rows) over all earlier rows in the order of the columns `order`."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts)
    one = F.col(amount) if amount else F.lit(1)
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__part").agg(F.sum(one).alias("__n"))  # one row a partition
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    numbered = parts.withColumn("__in", F.coalesce(F.sum(one).over(inside), F.lit(0)))
    return numbered.join(F.broadcast(sums), "__part").withColumn(out, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def dense_ids(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """df with `out` numbering its rows from 0 in the order of the columns, which should identify rows."""
    return with_offsets(df, list(order), None, out).withColumn(out, F.col(out).cast("long"))


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """One row for each distinct value of the column: n rows have it, before rows have a smaller one."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return with_offsets(counts, [column], "n", "before")


def percentile_rank(df: DataFrame, column: str, out: str, total: int) -> DataFrame:
    """df with `out`: the average 0-based rank over ties divided by total - 1; 0.5 for a single row."""
    ranks = value_ranks(df, column).withColumnRenamed(column, "__v")
    if total > 1:
        rank = (F.col("before") + (F.col("n") - 1) / 2) / (total - 1)
    else:
        rank = F.lit(0.5)
    return df.join(ranks, F.col(column).eqNullSafe(F.col("__v"))).withColumn(out, rank).drop("__v", "n", "before")


def percentile_ranks(df: DataFrame, columns: list[str], total: int, key: str = "idx") -> DataFrame:
    """key and p_{column} for several columns, as percentile_rank() of each, in one sort of all columns' values."""
    long = df.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x"))
    long = long.select(key, "x.c", "x.v")
    counts = with_offsets(long.groupBy("c", "v").agg(F.count("*").alias("n")), ["c", "v"], "n", "before")
    smaller = F.col("before") - F.col("c") * total  # each column has total rows
    rank = (smaller + (F.col("n") - 1) / 2) / (total - 1) if total > 1 else F.lit(0.5)
    x = long.join(counts.select("c", "v", rank.alias("p")), ["c", "v"])
    return x.groupBy(key).agg(*(F.max(F.when(F.col("c") == i, F.col("p"))).alias(f"p_{c}") for i, c in enumerate(columns)))


def cumulative_share(df: DataFrame, column: str, out: str, total: int) -> DataFrame:
    """df with `out`: the share of rows with a value of at most the row's."""
    ranks = value_ranks(df, column).withColumnRenamed(column, "__v")
    share = (F.col("before") + F.col("n")) / total
    return df.join(ranks, F.col(column) == F.col("__v")).withColumn(out, share).drop("__v", "n", "before")


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact q-quantile with linear interpolation; None without rows."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile is from 0 to 1")
    ranks = materialize(value_ranks(df.where(F.col(column).isNotNull()), column))
    total = ranks.agg(F.sum("n")).first()[0]
    if not total:
        return None
    at = q * (total - 1)
    low = int(at)
    near = ranks.where((F.col("before") <= low + 1) & (F.col("before") + F.col("n") > low)).collect()  # two values at most
    value = {k: next((float(r[column]) for r in near if r["before"] <= k < r["before"] + r["n"]), None) for k in (low, low + 1)}
    a, b, t = value[low], value[low + 1], at - low
    return a if t == 0 or b is None else a + (b - a) * t
