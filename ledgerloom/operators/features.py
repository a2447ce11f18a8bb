"""Node features: degrees, edge aggregates, flow concentration, timing, path role, and their assembly.

Every function takes nodes (idx) and edges (src, dst, weight, ts, ...) and returns one row a node; where a feature has no value,
it is `empty`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.ranks import percentile_ranks

STATS = ("sum", "mean", "max", "std")
SIDES = {"out": "src", "in": "dst"}
#: Into how many slices of time a node's events are split.
SLICES = 64


def _fill(nodes: DataFrame, found: DataFrame, empty: float, keep: Sequence[str] = ()) -> DataFrame:
    """found for every node; nulls become `empty` but for the columns keep, where they become 0."""
    x = nodes.select("idx").join(found, "idx", "left")
    fill = {c: (0 if c in keep else empty) for c in x.columns if c != "idx"}
    return x.select("idx", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in fill.items()))


def degree(nodes: DataFrame, edges: DataFrame, empty: float = 0.0) -> DataFrame:
    """idx, in_degree, out_degree, total_degree, in_out_ratio; parallel edges and self-loops count each."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("idx"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("idx"), F.lit(0).alias("o")))).alias("e"))
    count = ends.groupBy("e.idx").agg(F.sum(1 - F.col("e.o")).alias("in_degree"), F.sum("e.o").alias("out_degree"))
    x = _fill(nodes, count, empty, ("in_degree", "out_degree"))
    ratio = F.when(F.col("out_degree") > 0, F.col("in_degree") / F.col("out_degree")).otherwise(F.lit(empty))
    return x.withColumn("total_degree", F.col("in_degree") + F.col("out_degree")).withColumn("in_out_ratio", ratio)


def aggregate_columns(features: Sequence[str], sides: Sequence[str] = ("out", "in"), stats: Sequence[str] = STATS) -> list[str]:
    return [f"{d}_{f}_{s}" for d in sides for f in features for s in stats]


def edge_aggs(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], sides: Sequence[str] = ("out", "in"), stats: Sequence[str] = STATS, empty: float = 0.0
) -> DataFrame:
    """idx and {side}_{feature}_{stat} over the node's outgoing and incoming edges (std: of the population)."""
    make = {"sum": F.sum, "mean": F.avg, "max": F.max, "std": F.stddev_pop}
    if unknown := set(stats) - set(make):
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    x = nodes.select("idx")
    for d in sides:
        aggs = [make[s](F.col(f).cast("double")).alias(f"{d}_{f}_{s}") for f in features for s in stats]
        x = x.join(edges.groupBy(F.col(SIDES[d]).alias("idx")).agg(*aggs), "idx", "left")
    return x.select("idx", *(F.coalesce(c, F.lit(empty)).alias(c) for c in aggregate_columns(features, sides, stats)))


def counterparty_flow(edges: DataFrame, side: str = "out") -> DataFrame:
    """idx, other, w: flow between a node and each counterparty, parallel edges added up."""
    a, b = ("src", "dst") if side == "out" else ("dst", "src")
    return edges.groupBy(F.col(a).alias("idx"), F.col(b).alias("other")).agg(F.sum(F.col("weight").cast("double")).alias("w"))


def _ranked_sums(flow: DataFrame) -> DataFrame:
    """idx with s, q, m, rw, n: sum, sum of squares, maximum, sum of rank times w, and count of the node's w.

    Rows are sorted in range partitions, so that a hub's counterparties are spread over many tasks; each part of a node then gives one
    row, and its ranks are moved by the counts of the node's earlier parts.
    """
    order = ("idx", "w", "other")
    rows = flow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition
    parts = rows.select("idx", "w", F.shiftright("at", 33).alias("part"), place.alias("place")).groupBy("idx", "part").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.max("w").alias("m"),
        F.sum(F.col("place") * F.col("w")).alias("pw"), F.min("place").alias("first"), F.count("*").alias("n"),
    )
    earlier = Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rank = F.col("pw") + (F.col("before") + 1 - F.col("first")) * F.col("s")
    return parts.groupBy("idx").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("m"), F.sum(rank).alias("rw"), F.sum("n").alias("n"))


def flow_concentration(nodes: DataFrame, edges: DataFrame, empty: float = 0.0) -> DataFrame:
    """idx and {side}_gini, {side}_hhi, {side}_max_share of flow over counterparties; `empty` without flow."""
    x = nodes.select("idx")
    for side in SIDES:
        g = _ranked_sums(counterparty_flow(edges, side))
        gini = (2 * F.col("rw") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))
        some = F.col("s") > 0
        g = g.select(
            "idx",
            F.when(some, F.least(F.greatest(gini, F.lit(0.0)), F.lit(1.0))).alias(f"{side}_gini"),
            F.when(some, F.col("q") / (F.col("s") * F.col("s"))).alias(f"{side}_hhi"),
            F.when(some, F.col("m") / F.col("s")).alias(f"{side}_max_share"),
        )
        x = x.join(g, "idx", "left")
    return x.select("idx", *(F.coalesce(c, F.lit(empty)).alias(c) for c in x.columns[1:]))


def node_events(edges: DataFrame) -> DataFrame:
    """idx, ts: an event for each end of each edge (two for a self-loop)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("idx"), F.col("ts").cast("double").alias("ts"))


def temporal(nodes: DataFrame, edges: DataFrame, empty: float = 0.0, slices: int = SLICES) -> DataFrame:
    """idx, activity_span, burstiness: (std - mean) / (std + mean) of the gaps between a node's events.

    Equal times of a node are counted first, and gaps are taken within slices of the whole time span, so that a hub's events are spread
    over tasks; the moments of a node's slices (at most slices + 1 rows) are then joined with the gaps between slices.
    """
    ends = F.broadcast(edges.agg(F.min(F.col("ts").cast("double")).alias("t0"), F.max(F.col("ts").cast("double")).alias("t1")))  # one row
    times = node_events(edges).where("ts is not null").groupBy("idx", "ts").agg(F.count("*").alias("c"))
    share = F.try_divide((F.col("ts") - F.col("t0")) * slices, F.col("t1") - F.col("t0"))
    times = times.crossJoin(ends).select("idx", "ts", "c", F.when(F.col("ts") < F.col("t1"), F.floor(share)).otherwise(slices).alias("slice"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("idx", "slice").orderBy("ts"))
    x = times.withColumn("gap", gap).groupBy("idx", "slice").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.sum(F.col("c") - 1).alias("ties"),
        F.count("gap").alias("n"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("var"),
    )
    node = Window.partitionBy("idx")
    x = x.withColumn("step", F.col("lo") - F.lag("hi").over(node.orderBy("slice")))
    count = F.sum(F.col("n") + F.col("ties") + F.col("step").isNotNull().cast("int")).over(node)
    x = x.withColumn("gaps", count).withColumn("m", F.try_divide(F.max("hi").over(node) - F.min("lo").over(node), F.col("gaps")))
    square = lambda c: (c - F.col("m")) * (c - F.col("m"))
    off = F.col("n") * (F.col("var") + square(F.col("mean"))) + F.col("ties") * square(F.lit(0.0)) + F.coalesce(square(F.col("step")), F.lit(0.0))
    g = x.groupBy("idx").agg((F.max("hi") - F.min("lo")).alias("activity_span"), F.max("m").alias("m"), F.sqrt(F.try_divide(F.sum(off), F.max("gaps"))).alias("s"))
    burst = F.when(F.col("s") + F.col("m") > 0, (F.col("s") - F.col("m")) / (F.col("s") + F.col("m")))
    return _fill(nodes, g.select("idx", "activity_span", burst.alias("burstiness")), empty)


def throughput(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, throughput: the weight of all edges at a node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("idx"), F.col("weight").cast("double").alias("w"))
    return _fill(nodes, ends.groupBy("idx").agg(F.sum("w").alias("throughput")), 0.0)


def path_role(channels: DataFrame) -> DataFrame:
    """channels (idx, in_degree, out_degree, size, throughput) with percentile ranks and endpoint_score, source_score and
    source_sink_axis."""
    names = ["in_degree", "out_degree", "size", "throughput"]
    x = percentile_ranks(channels, names, channels.count())
    i, o, s, t = (F.col(f"p_{c}") for c in ("in_degree", "out_degree", "size", "throughput"))
    return x.select("idx", ((i + s + t) / 3).alias("endpoint_score"), ((o + s + t) / 3).alias("source_score"), (i - o).alias("source_sink_axis"))


def cluster_features(nodes: DataFrame, edges: DataFrame, features: Sequence[str], blocks: Sequence[DataFrame] = (), empty: float = 0.0) -> DataFrame:
    """One row a node with every feature block; nodes: idx, size; blocks: further tables by idx."""
    deg = degree(nodes, edges, empty)
    flow = throughput(nodes, edges)
    role = path_role(deg.join(flow, "idx").join(nodes.select("idx", "size"), "idx"))
    x = deg
    for block in (flow, flow_concentration(nodes, edges, empty), temporal(nodes, edges, empty), edge_aggs(nodes, edges, features, empty=empty), role, *blocks):
        x = x.join(block, "idx", "left")
    return x


def rounded(c: str | Column, digits: int = 6) -> Column:
    """For comparisons between engines; -0.0 becomes 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
