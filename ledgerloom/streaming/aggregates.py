"""Degrees and edge sums kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degree(edges: DataFrame) -> DataFrame:
    """idx, in_degree, out_degree, weight of a stream of edges (src, dst, weight): run with output mode update or complete."""
    end = F.explode(F.array(F.struct(F.col("src").alias("idx"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("idx"), F.lit(0).alias("o")))).alias("e")
    return edges.select(end, "weight").groupBy("e.idx").agg(
        F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum("weight").alias("weight")
    )


def windowed_flow(events: DataFrame, time: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """start, idx, n, weight by event-time window, closed once the watermark has passed (append mode)."""
    x = events.withWatermark(time, late).groupBy(F.window(time, width), "idx").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return x.select(F.col("window.start").alias("start"), "idx", "n", "weight")
