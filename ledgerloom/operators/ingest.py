"""Raw tables to graph tables: ids, remapped edges, labelled groups, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import dense_ids

SUSPICIOUS, LICIT = "suspicious", "licit"


class GuardError(ValueError):
    """Data that break a stated condition."""


def resolve_column(columns: Sequence[str], preferred: str, position: int | None = None) -> str:
    """The column called preferred in any case, else the one at the position."""
    for c in columns:
        if c.lower() == preferred.lower():
            return c
    if position is not None and 0 <= position < len(columns):
        return columns[position]
    raise ValueError(f"no column {preferred!r} among {list(columns)}")


def id_map(nodes: DataFrame, column: str = "orig_id", strict: bool = False) -> DataFrame:
    """idx, orig_id: ids from 0 in the order of orig_id. Repeated ids raise if strict, else count once."""
    ids = nodes.select(F.col(column).alias("orig_id")).where("orig_id is not null")
    if strict and not ids.groupBy("orig_id").count().where("count > 1").isEmpty():
        raise GuardError("repeated node ids")
    return dense_ids(ids.distinct(), "orig_id").select("idx", "orig_id")


def id_bijection(nodes: DataFrame, column: str = "orig_id") -> DataFrame:
    """n_rows, n_ids, is_bijection."""
    x = nodes.agg(F.count("*").alias("n_rows"), F.countDistinct(column).alias("n_ids"))
    return x.withColumn("is_bijection", F.col("n_rows") == F.col("n_ids"))


def remap_nodes(nodes: DataFrame, ids: DataFrame, column: str = "orig_id") -> DataFrame:
    """nodes' columns with idx in place of the original id."""
    return nodes.withColumnRenamed(column, "orig_id").join(ids, "orig_id").drop("orig_id")


def remap_edges(edges: DataFrame, ids: DataFrame, a: str = "clId1", b: str = "clId2") -> DataFrame:
    """src, dst and the other columns of edges whose ends are both known."""
    from_, to = ids.select(F.col("idx").alias("src"), F.col("orig_id").alias(a)), ids.select(F.col("idx").alias("dst"), F.col("orig_id").alias(b))
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.join(from_, a).join(to, b).select("src", "dst", *rest)


def dangling_edges(edges: DataFrame, ids: DataFrame, a: str = "clId1", b: str = "clId2") -> DataFrame:
    """n_edges, n_dangling: edges with an unknown end."""
    known = ids.select("orig_id", F.lit(1).alias("k"))
    x = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    x = x.join(known.toDF("a", "ka"), "a", "left").join(known.toDF("b", "kb"), "b", "left")
    return x.agg(F.count("*").alias("n_edges"), F.count_if(F.col("ka").isNull() | F.col("kb").isNull()).alias("n_dangling"))


def subgraphs(membership: DataFrame, components: DataFrame, ids: DataFrame) -> DataFrame:
    """pos, ccId, ccLabel, n_members, member_idx: groups with a known member, numbered in the order of ccId."""
    x = membership.join(ids, membership["clId"] == ids["orig_id"]).join(components, "ccId")
    x = x.groupBy("ccId", "ccLabel").agg(F.count("*").alias("n_members"), F.sort_array(F.collect_list("idx")).alias("member_idx"))
    return dense_ids(x, "ccId", out="pos").select("pos", "ccId", "ccLabel", "n_members", "member_idx")


def orphan_counts(membership: DataFrame, components: DataFrame, ids: DataFrame) -> DataFrame:
    """n_rows, n_unknown_nodes, n_unknown_groups of the membership table."""
    known, group = ids.select("orig_id", F.lit(1).alias("k")), components.select("ccId", F.lit(1).alias("g"))
    x = membership.join(known, membership["clId"] == known["orig_id"], "left").join(group, "ccId", "left")
    return x.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("k").isNull()).alias("n_unknown_nodes"),
        F.count_if(F.col("g").isNull()).alias("n_unknown_groups"),
    )


def membership_explode(groups: DataFrame) -> DataFrame:
    """pos, ccId, ccLabel, idx: one row a member."""
    return groups.select("pos", "ccId", "ccLabel", F.explode("member_idx").alias("idx"))


def node_group(members: DataFrame) -> DataFrame:
    """idx, pos: a node's group; the later group where several hold it."""
    return members.groupBy("idx").agg(F.max("pos").alias("pos"))


def base_rate(components: DataFrame) -> DataFrame:
    """n_groups, n_suspicious, n_licit, rate of suspicious groups."""
    x = components.agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col("ccLabel") == SUSPICIOUS).alias("n_suspicious"),
        F.count_if(F.col("ccLabel") == LICIT).alias("n_licit"),
    )
    return x.withColumn("rate", F.try_divide("n_suspicious", "n_groups"))


def finite_guard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_bad: null, NaN or infinite values of each column."""
    def bad(c: str):
        d = F.col(c).cast("double")
        return F.count_if(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")))

    x = df.agg(*(bad(c).alias(c) for c in columns))
    return x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in columns))).alias("x")).select("x.*")


def assert_finite(df: DataFrame, columns: Sequence[str]) -> None:
    found = {r["column"]: r["n_bad"] for r in finite_guard(df, columns).where("n_bad > 0").collect()}
    if found:
        raise GuardError(f"values that aren't finite: {found}")


def contiguous_idx(df: DataFrame) -> DataFrame:
    """n_rows, lo, hi, n_ids, is_contiguous: whether idx holds 0 to n - 1, each once."""
    x = df.agg(F.count("*").alias("n_rows"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("idx").alias("n_ids"))
    fine = (F.col("n_ids") == F.col("n_rows")) & (F.col("n_rows") == F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)))
    return x.withColumn("is_contiguous", fine & (F.coalesce("lo", F.lit(0)) == 0))


def graph_validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_out_of_range, n_self_loops, n_negative_weights."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    outside = ~F.col("src").between(0, F.col("n_nodes") - 1) | ~F.col("dst").between(0, F.col("n_nodes") - 1)
    return edges.crossJoin(F.broadcast(n)).agg(  # n is one row
        F.max("n_nodes").alias("n_nodes"),
        F.count("*").alias("n_edges"),
        F.count_if(outside).alias("n_out_of_range"),
        F.count_if(F.col("src") == F.col("dst")).alias("n_self_loops"),
        F.count_if(F.col("weight") < 0).alias("n_negative_weights"),
    )


def edge_columns(edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """src, dst and the named edge columns, found in any case."""
    return edges.select("src", "dst", *(F.col(resolve_column(edges.columns, c)).alias(c) for c in columns))
