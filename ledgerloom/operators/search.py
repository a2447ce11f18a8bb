"""Graph search: bounded breadth-first sweeps, two-sided reachability, carving, exit paths, borders, sampling.

Sweeps are loops of joins whose state is written out at every level, for all groups at once: a row holds the bits of up to 64 groups that have reached
a node, so that groups share the join with the edges; a node that was not reached has no row. Directions: forward follows src to dst, backward dst to src.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.ingest import node_group
from ledgerloom.operators.ranks import dense_ids, quantile
from ledgerloom.runtime import discard, materialize

MAX_HOPS = 6
ENDPOINT_QUANTILE = 0.999


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst: distinct edges without self-loops."""
    return edges.where("src <> dst").select("src", "dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """a, b in both directions: distinct, without self-loops."""
    both = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
    return both.select("e.a", "e.b").distinct()


def hubs(edges: DataFrame, above: int) -> DataFrame:
    """idx of nodes with more than `above` edge ends."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("idx"))
    return ends.groupBy("idx").agg(F.count("*").alias("d")).where(F.col("d") > above).select("idx")


def bfs(
    edges: DataFrame, seeds: DataFrame, max_hops: int = MAX_HOPS, backward: bool = False, cap: int | None = None, hub: DataFrame | None = None,
    needs: DataFrame | None = None,
) -> DataFrame:
    """grp, idx, hop within max_hops of each group's seeds (grp, idx; without grp all are one group).

    cap: of a level's new nodes only the cap lowest ids of a group are kept; the others may be found again later. Nodes of hub
    are reached but not passed, seeds excepted. needs (idx, hop): the hops that a node still needs; a node isn't entered with fewer left, nor
    without a row. This leaves out no node on a path of max_hops to where needs is 0, as long as neither caps nor hubs stop the sweep.
    """
    if max_hops < 0:
        raise ValueError("max_hops is from 0")
    if "grp" in seeds.columns:
        seeds = materialize(seeds.select(F.col("grp").cast("long").alias("grp"), F.col("idx").cast("long").alias("idx")).distinct())
        groups = materialize(dense_ids(seeds.select("grp").distinct(), "grp", out="g"))
    else:
        seeds = seeds.select(F.lit(0).cast("long").alias("grp"), F.col("idx").cast("long").alias("idx")).distinct()
        groups = edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("grp"), F.col("id").alias("g"))
    step = adjacency(edges).select(*((F.col("dst").alias("a"), F.col("src").alias("b")) if backward else (F.col("src").alias("a"), F.col("dst").alias("b"))))
    if needs is not None:
        step = step.join(needs.select(F.col("idx").alias("b"), F.col("hop").alias("need")), "b")
    step = materialize(step)
    if cap is not None:
        return _capped(step, seeds, max_hops, cap, hub, needs is not None)
    bits = F.bit_or(F.expr("shiftleft(1L, int(g % 64))"))
    new = seeds.join(groups, "grp").groupBy(F.expr("g div 64").alias("word"), "idx").agg(bits.alias("bits"))
    new = seen = materialize(new)
    levels = new.withColumn("hop", F.lit(0))
    for hop in range(1, max_hops + 1):
        at = new if hub is None or hop == 1 else new.join(hub.select("idx"), "idx", "left_anti")
        ways = step if needs is None else step.where(F.col("need") + hop <= max_hops)
        got = at.join(ways, F.col("idx") == F.col("a")).groupBy("word", F.col("b").alias("idx")).agg(F.bit_or("bits").alias("bits"))
        old = seen.withColumnRenamed("bits", "old")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new = materialize(got.join(old, ["word", "idx"], "left").select("word", "idx", fresh.alias("bits")).where("bits <> 0"))
        if new.isEmpty():
            break
        levels = levels.union(new.withColumn("hop", F.lit(hop)))
        if hop < max_hops:
            seen = materialize(seen.union(new).groupBy("word", "idx").agg(F.bit_or("bits").alias("bits")))
    each = levels.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.getbit("bits", F.col("bit")) == 1)
    return each.withColumn("g", F.col("word") * 64 + F.col("bit")).join(groups, "g").select("grp", "idx", "hop")


def _capped(step: DataFrame, seeds: DataFrame, max_hops: int, cap: int, hub: DataFrame | None, needed: bool) -> DataFrame:
    """bfs() with a cap on a group's new nodes, a row for each group and node."""
    seen = materialize(seeds.withColumn("hop", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("idx"))
    for hop in range(1, max_hops + 1):
        at = seen.where(F.col("hop") == hop - 1)
        if hub is not None and hop > 1:
            at = at.join(hub.select("idx"), "idx", "left_anti")
        ways = step.where(F.col("need") + hop <= max_hops) if needed else step
        new = at.join(ways, F.col("idx") == F.col("a")).select("grp", F.col("b").alias("idx")).distinct().join(seen, ["grp", "idx"], "left_anti")
        new = new.withColumn("__r", place).where(F.col("__r") <= cap).drop("__r")
        grown = materialize(seen.union(new.select("grp", "idx", F.lit(hop).alias("hop"))))
        more = grown.where(F.col("hop") == hop).isEmpty()
        discard(seen)
        seen = grown
        if more:
            break
    return seen


def reachability(edges: DataFrame, sources: DataFrame, endpoints: DataFrame, max_hops: int = MAX_HOPS, cap: int | None = None, hub: DataFrame | None = None) -> DataFrame:
    """grp, idx, fwd, back: hops from the group's sources and to the nearest endpoint, where both sweeps reach the node."""
    fwd = bfs(edges, sources, max_hops, False, cap, hub).withColumnRenamed("hop", "fwd")
    back = bfs(edges, endpoints, max_hops, True, cap, hub).select("idx", F.col("hop").alias("back"))
    return fwd.join(back, "idx").select("grp", "idx", "fwd", "back")


def survivors(reach: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """The rows of reachability() on paths of at most max_hops."""
    return reach.where(F.col("fwd") + F.col("back") <= max_hops)


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, new_src, new_dst: edges within the nodes, with ids from 0 in the order of idx."""
    ids = dense_ids(nodes.select("idx").distinct(), "idx", out="n")
    x = adjacency(edges).join(ids.select(F.col("idx").alias("src"), F.col("n").alias("new_src")), "src")
    return x.join(ids.select(F.col("idx").alias("dst"), F.col("n").alias("new_dst")), "dst").select("src", "dst", "new_src", "new_dst")


def carve(edges: DataFrame, candidates: DataFrame, endpoints: DataFrame, max_hops: int = MAX_HOPS, cap: int | None = None, hub: DataFrame | None = None) -> DataFrame:
    """candidate, idx: for every candidate (idx) the nodes on paths of at most max_hops to an endpoint, endpoints left out."""
    seeds = candidates.select(F.col("idx").alias("grp"), "idx").distinct()
    if cap is None and hub is None:
        back = materialize(bfs(edges, endpoints, max_hops, True).select("idx", "hop"))
        fwd = bfs(edges, seeds, max_hops, needs=back).withColumnRenamed("hop", "fwd")
        x = survivors(fwd.join(back.withColumnRenamed("hop", "back"), "idx"), max_hops)
    else:
        x = survivors(reachability(edges, seeds, endpoints, max_hops, cap, hub), max_hops)
    return x.join(endpoints.select("idx"), "idx", "left_anti").select(F.col("grp").alias("candidate"), "idx")


def endpoints(scores: DataFrame, column: str = "endpoint_score", q: float = ENDPOINT_QUANTILE) -> DataFrame:
    """idx of the nodes whose score is at least its q-quantile."""
    return scores.where(F.col(column) >= F.lit(quantile(scores, column, q))).select("idx")


def exit_paths(edges: DataFrame, members: DataFrame, ends: DataFrame, max_hops: int = MAX_HOPS, cap: int | None = None, hub: DataFrame | None = None) -> DataFrame:
    """pos, path: a shortest path from each group's closest member to an endpoint; empty without one. Ties: the smallest id."""
    back = materialize(bfs(edges, ends, max_hops, True, cap, hub).select("idx", "hop"))
    first = members.join(back, "idx").groupBy("pos").agg(F.min(F.struct("hop", "idx")).alias("at"))
    path = first.select("pos", F.col("at.idx").alias("idx"), F.col("at.hop").alias("hop"), F.array("at.idx").alias("path"))
    step, done = adjacency(edges), []
    for _ in range(max_hops):
        done.append(path.where("hop = 0").select("pos", "path"))
        nxt = path.where("hop > 0").join(step, F.col("idx") == F.col("src")).join(back.toDF("dst", "to_hop"), "dst").where("to_hop = hop - 1")
        path = materialize(
            nxt.groupBy("pos", "path", "hop").agg(F.min("dst").alias("idx")).select("pos", "idx", (F.col("hop") - 1).alias("hop"), F.concat("path", F.array("idx")).alias("path"))
        )
    done.append(path.where("hop = 0").select("pos", "path"))
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return members.select("pos").distinct().join(found, "pos", "left").select("pos", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


def border_sets(edges: DataFrame, members: DataFrame) -> DataFrame:
    """pos, role, idx: distinct outside nodes that send to (sender) or receive from (receiver) a group."""
    group = node_group(members)
    x = edges.select("src", "dst").distinct()
    x = x.join(group.toDF("src", "a"), "src", "left").join(group.toDF("dst", "b"), "dst", "left").where(~F.col("a").eqNullSafe(F.col("b")))
    sides = F.array(F.struct(F.col("b").alias("pos"), F.lit("sender").alias("role"), F.col("src").alias("idx")), F.struct(F.col("a").alias("pos"), F.lit("receiver").alias("role"), F.col("dst").alias("idx")))
    return x.select(F.explode(sides).alias("s")).select("s.*").where("pos is not null").distinct()


def seeded(seed: int, *columns: str) -> Column:
    """A pseudo-random order that any engine can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def border_sets_capped(border: DataFrame, cap: int = 64, seed: int = 0) -> DataFrame:
    """border_sets() with at most cap nodes a group and role, in a seeded order."""
    place = F.row_number().over(Window.partitionBy("pos", "role").orderBy(seeded(seed, "idx"), "idx"))
    return border.withColumn("r", place).where(F.col("r") <= cap).drop("r")


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """pos and the edges whose ends are in the same group."""
    group = node_group(members)
    return edges.join(group.toDF("src", "pos"), "src").join(group.toDF("dst", "other"), "dst").where("pos = other").drop("other")


def neighbor_sample(edges: DataFrame, seeds: DataFrame, fanout: Sequence[int] = (15, 10), seed: int = 0) -> DataFrame:
    """hop, src, dst: for each hop at most fanout[hop] in-neighbours of every frontier node, in a seeded order; the next frontier is
    the nodes not seen before."""
    step, frontier = adjacency(edges), seeds.select("idx").distinct()
    seen, out = frontier, None
    for hop, most in enumerate(fanout):
        place = F.row_number().over(Window.partitionBy("dst").orderBy(seeded(seed + hop, "src", "dst"), "src"))
        got = step.join(frontier.toDF("dst"), "dst").withColumn("r", place).where(F.col("r") <= most)
        got = materialize(got.select(F.lit(hop + 1).alias("hop"), "src", "dst"))
        out = got if out is None else out.union(got)
        frontier = materialize(got.select(F.col("src").alias("idx")).distinct().join(seen, "idx", "left_anti"))
        seen = seen.union(frontier)
    return out


def seed_batches(seeds: DataFrame, size: int = 512, seed: int = 0) -> DataFrame:
    """batch, idx: the distinct seeds in a seeded order, in batches."""
    x = seeds.select("idx").distinct().withColumn("h", seeded(seed, "idx"))
    return dense_ids(x, "h", "idx", out="r").select(F.expr(f"r div {size}").alias("batch"), "idx")


def ego_neighbor_conv(features: DataFrame, edges: DataFrame, w_ego: np.ndarray, w_neigh: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """idx, x: W_ego x + W_neigh mean(x of in-neighbours), for features (idx, x array); no neighbours count as a zero mean."""
    width = w_ego.shape[1]
    vec = features.select("idx", *(F.col("x")[j].alias(f"x{j}") for j in range(width)))
    near = adjacency(edges).join(vec.withColumnRenamed("idx", "src"), "src")
    mean = near.groupBy(F.col("dst").alias("idx")).agg(*(F.avg(f"x{j}").alias(f"m{j}") for j in range(width)))
    both = vec.join(mean, "idx", "left")

    def out(i: int) -> Column:
        total = F.lit(float(bias[i]) if bias is not None else 0.0)
        for j in range(width):
            total = total + F.lit(float(w_ego[i, j])) * F.col(f"x{j}") + F.lit(float(w_neigh[i, j])) * F.coalesce(f"m{j}", F.lit(0.0))
        return total

    return both.select("idx", F.array(*(out(i) for i in range(w_ego.shape[0]))).alias("x"))


def encode(features: DataFrame, edges: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray]], normalize: bool = False) -> DataFrame:
    """Stacked ego_neighbor_conv() with ReLU between layers and, if asked, vectors of unit length at the end."""
    x = features
    for i, (a, b) in enumerate(layers):
        x = ego_neighbor_conv(x, edges, a, b)
        if i + 1 < len(layers):
            x = materialize(x.select("idx", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))).alias("x")))
    if normalize:
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        x = x.select("idx", F.transform("x", lambda v: F.try_divide(v, F.greatest(size, F.lit(1e-12)))).alias("x"))
    return x
