"""The graph view over the driver tables, as ingested tables.

Nodes are customers and suppliers, edges the line items joined with their orders (a returned item flows from supplier to customer,
any other from customer to supplier), links the pairs of customers with consecutive orders, groups the customers of one nation and market segment;
a group is suspicious if its mean balance is in the lowest tenth. Ingested once a session and directory, into the shared folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import ingest, labels, search
from ledgerloom.operators.ranks import dense_ids
from ledgerloom.runtime import materialize

FEATURES = ("weight", "quantity", "discount", "tax")
ENDPOINT_SHARE = 0.98


class GraphView:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def raw_nodes(self) -> DataFrame:
        c = self.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("orig_id"), F.col("c_acctbal").alias("size"))
        return c.union(self.table("supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_acctbal"))

    @property
    def raw_edges(self) -> DataFrame:
        x = self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        c, s, back = F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_returnflag") == "R"
        return x.select(
            F.when(back, s).otherwise(c).alias("clId1"), F.when(back, c).otherwise(s).alias("clId2"), F.col("l_extendedprice").alias("weight"),
            F.datediff("l_shipdate", F.lit("1995-01-01")).cast("double").alias("ts"), F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        )

    @property
    def raw_members(self) -> DataFrame:
        group = F.concat(F.col("c_nationkey").cast("string"), F.lit(":"), "c_mktsegment")
        return self.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("clId"), group.alias("ccId"), "c_acctbal")

    @cached_property
    def components(self) -> DataFrame:
        """row_id, ccId, ccLabel."""
        g = self.raw_members.groupBy("ccId").agg((F.round(F.sum("c_acctbal"), 2) / F.count("*")).alias("mean"))
        n = F.broadcast(g.agg(F.count("*").alias("n")))  # one row
        x = dense_ids(g, "mean", "ccId", out="row_id").crossJoin(n)
        label = F.when(F.col("row_id") < F.ceil(F.col("n") / 10), ingest.SUSPICIOUS).otherwise(ingest.LICIT)
        return materialize(x.select("row_id", "ccId", label.alias("ccLabel")))

    @cached_property
    def ids(self) -> DataFrame:
        return materialize(ingest.id_map(self.raw_nodes))

    @cached_property
    def nodes(self) -> DataFrame:
        """idx, size."""
        return materialize(ingest.remap_nodes(self.raw_nodes, self.ids))

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst, weight, ts, quantity, discount, tax."""
        return materialize(ingest.remap_edges(self.raw_edges, self.ids))

    @cached_property
    def links(self) -> DataFrame:
        """src, dst: customers of consecutive orders of a month, a link for each pair of orders."""
        month = Window.partitionBy(F.date_trunc("month", "o_orderdate")).orderBy("o_orderdate", "o_orderkey")
        x = self.table("orders").select("o_custkey", F.lead("o_custkey").over(month).alias("n")).where("n is not null")
        x = x.select(F.concat(F.lit("c"), "o_custkey").alias("clId1"), F.concat(F.lit("c"), "n").alias("clId2"))
        return materialize(ingest.remap_edges(x, self.ids))

    @cached_property
    def paths(self) -> DataFrame:
        """src, dst: all edges and links, each pair once. Trade alone has paths between customers and suppliers only, and suppliers are
        hubs; links join customers."""
        return materialize(search.adjacency(self.edges.select("src", "dst").union(self.links.select("src", "dst"))))

    @cached_property
    def groups(self) -> DataFrame:
        """pos, ccId, ccLabel, n_members, member_idx."""
        return materialize(ingest.subgraphs(self.raw_members.drop("c_acctbal"), self.components.drop("row_id"), self.ids))

    @property
    def members(self) -> DataFrame:
        return ingest.membership_explode(self.groups)

    @cached_property
    def splits(self) -> DataFrame:
        return materialize(labels.split_stratified(self.components.select(F.col("ccId").alias("id"), F.col("ccLabel").alias("label"))))

    @property
    def suspects(self) -> DataFrame:
        return self.members.where(F.col("ccLabel") == ingest.SUSPICIOUS).select("idx").distinct()

    @cached_property
    def ends(self) -> DataFrame:
        """The endpoints of path search: the nodes of the largest balances."""
        return materialize(search.endpoints(self.nodes, "size", ENDPOINT_SHARE))

    @property
    def scores(self) -> DataFrame:
        """idx, score: the balance stands in for a model's score."""
        return self.nodes.select("idx", F.col("size").alias("score"))

    @property
    def signal(self) -> DataFrame:
        """idx, signal in 0 to 1, from the id alone."""
        return self.nodes.select("idx", (F.conv(F.substring(F.md5(F.col("idx").cast("string")), 1, 4), 16, 10).cast("double") / 65536).alias("signal"))


_views: dict[tuple[str, str], GraphView] = {}


def view(spark: SparkSession, sf_dir: str) -> GraphView:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        _views[key] = GraphView(spark, sf_dir)
    return _views[key]
