"""Raw tables from CSV or Parquet, and result tables to Parquet, CSV and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import GuardError, resolve_column

# fixed values: the raw files' names
FILES = ("background_nodes.csv", "background_edges.csv", "connected_components.csv", "nodes.csv", "edges.csv")


def missing_files(spark: SparkSession, folder: str, names: Sequence[str] = FILES) -> list[str]:
    """Names that aren't in the folder, in any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in names if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, n))]


def require_files(spark: SparkSession, folder: str, names: Sequence[str] = FILES) -> None:
    if gone := missing_files(spark, folder, names):
        raise FileNotFoundError(f"missing in {folder}: {gone}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types are inferred without a schema."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """row_id, id, label: trimmed, in file order; raises on repeated or empty ids."""
    x = read_csv(spark, path)
    a, b = resolve_column(x.columns, "ccId", 0), resolve_column(x.columns, "ccLabel", 1)
    x = x.select(F.monotonically_increasing_id().alias("row_id"), F.trim(F.col(a).cast("string")).alias("id"), F.trim(F.col(b).cast("string")).alias("label"))
    if not x.where("id is null or id = '' or label is null").isEmpty():
        raise GuardError("rows without an id or a label")
    if twice := [r["id"] for r in x.groupBy("id").count().where("count > 1").limit(5).collect()]:
        raise GuardError(f"repeated ids: {twice}")
    return x


def write_split(splits: DataFrame, path: str) -> None:
    """One folder a split, and a one-row JSON manifest with counts."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/split")
    splits.groupBy("split").count().coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_discovered(groups: DataFrame, path: str) -> None:
    """The discovered groups and their scores in the schemas of the labelled tables (label -1)."""
    groups.select("ccId", "ccLabel", "n_members", "member_idx").write.mode("overwrite").parquet(f"{path}/subgraphs")
    groups.select("ccId", F.col("border_score").alias("score"), F.lit(-1).cast("long").alias("label"), "split").write.mode("overwrite").parquet(f"{path}/scores")
