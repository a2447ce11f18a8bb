"""Labels, splits, neighbourhood label fractions and leakage guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.ingest import LICIT, SUSPICIOUS, GuardError, node_group
from ledgerloom.operators.ranks import dense_ids
from ledgerloom.operators.search import undirected
from ledgerloom.runtime import materialize

HUB_CAP = 100


def node_labels(members: DataFrame, splits: DataFrame) -> DataFrame:
    """idx, pos, label, is_test of labelled nodes (the later group where several hold a node; other labels count as licit)."""
    group = members.select("pos", "ccId", "ccLabel").distinct().join(splits.select(F.col("id").alias("ccId"), "split"), "ccId", "left")
    label = F.when(F.col("ccLabel") == SUSPICIOUS, SUSPICIOUS).otherwise(LICIT)
    group = group.select("pos", label.alias("label"), (F.coalesce("split", F.lit("")) == "test").alias("is_test"))
    return node_group(members).join(group, "pos").select("idx", "pos", "label", "is_test")


def labeled_members(members: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """idx of the members of licit or suspicious groups in the split."""
    return _members(members, splits, split, (LICIT, SUSPICIOUS))


def positive_members(members: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """idx of the members of suspicious groups in the split."""
    return _members(members, splits, split, (SUSPICIOUS,))


def _members(members: DataFrame, splits: DataFrame, split: str, labels: Sequence[str]) -> DataFrame:
    ids = splits.where(F.col("split") == split).select(F.col("id").alias("ccId"))
    return members.where(F.col("ccLabel").isin(*labels)).join(ids, "ccId", "left_semi").select("idx").distinct()


def known_members(members: DataFrame, splits: DataFrame | None = None, split: str | None = None) -> DataFrame:
    """idx of all group members, of one split if both splits and split are given."""
    x = members
    if splits is not None and split is not None:
        x = x.join(splits.where(F.col("split") == split).select(F.col("id").alias("ccId")), "ccId", "left_semi")
    return x.select("idx").distinct()


def two_hop(edges: DataFrame, hub_cap: int | None = HUB_CAP) -> DataFrame:
    """a, b at distance exactly two (both directions). Nodes of more than hub_cap neighbours are left out, as ends and middles."""
    return _two_hop(materialize(undirected(edges)), hub_cap)


def _two_hop(near: DataFrame, hub_cap: int | None) -> DataFrame:
    inner = near
    if hub_cap is not None:
        small = materialize(near.groupBy("a").agg(F.count("*").alias("d")).where(F.col("d") <= hub_cap).select("a"))
        inner = materialize(near.join(small, "a", "left_semi").join(small.toDF("b"), "b", "left_semi").select("a", "b"))
    far = inner.select("a", F.col("b").alias("m")).join(inner.select(F.col("a").alias("m"), "b"), "m").where("a <> b").select("a", "b").distinct()
    return far.join(near, ["a", "b"], "left_anti")


def neighborhood(nodes: DataFrame, edges: DataFrame, labels: DataFrame, hops: Sequence[int] = (1, 2), hub_cap: int | None = HUB_CAP, empty: float = 0.0) -> DataFrame:
    """idx and hop{h}_frac_suspicious, _licit, _unknown: label shares among the neighbours at distance h.

    Labels of test groups and of the node's own group count as unknown. Nodes without neighbours get `empty` in all three.
    """
    x = nodes.select("idx")
    own = labels.select(F.col("idx").alias("a"), F.col("pos").alias("own"))
    seen = labels.select(F.col("idx").alias("b"), "pos", "label", "is_test")
    near = materialize(undirected(edges))
    for h in hops:
        if h not in (1, 2):
            raise ValueError("hops are 1 and 2")
        pairs = near if h == 1 else _two_hop(near, hub_cap)
        joined = pairs.join(own, "a", "left").join(seen, "b", "left")
        counts = F.col("label").isNotNull() & ~F.col("is_test") & ~F.col("own").eqNullSafe(F.col("pos"))
        share = [F.count_if(counts & (F.col("label") == v)) / F.count("*") for v in (SUSPICIOUS, LICIT)]
        g = joined.groupBy(F.col("a").alias("idx")).agg(*(s.alias(n) for s, n in zip(share, ("s", "l"), strict=True)))
        unknown = F.least(F.greatest(1 - F.col("s") - F.col("l"), F.lit(0.0)), F.lit(1.0))
        g = g.select("idx", F.col("s").alias(f"hop{h}_frac_suspicious"), F.col("l").alias(f"hop{h}_frac_licit"), unknown.alias(f"hop{h}_frac_unknown"))
        x = x.join(g, "idx", "left")
    return x.select("idx", *(F.coalesce(c, F.lit(empty)).alias(c) for c in x.columns[1:]))


def _shuffled(seed: int, c: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c)))


def _assign(x: DataFrame, ratios: Sequence[float]) -> DataFrame:
    _, val, test = ratios
    n_val, n_test = F.floor(F.col("n") * F.lit(val)), F.floor(F.col("n") * F.lit(test))
    kind = F.when(F.col("r") < n_val, "val").when(F.col("r") < n_val + n_test, "test").otherwise("train")
    return x.select("id", "label", kind.alias("split"))


def split_stratified(groups: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """id, label, split: each label's groups in a seeded order; the floor of each share to val and test, the rest to train."""
    parts = [split_random(groups.where(F.col("label") == r["label"]), ratios, seed) for r in groups.select("label").distinct().orderBy("label").collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def split_random(groups: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """id, label, split in one seeded order over all groups."""
    if len(ratios) != 3 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("three ratios that add up to 1")
    x = groups.select("id", "label").withColumn("h", _shuffled(seed, "id"))
    n = F.broadcast(groups.agg(F.count("*").alias("n")))  # one row
    return _assign(dense_ids(x, "h", "id", out="r").crossJoin(n), ratios)


def split_round_robin(groups: DataFrame) -> DataFrame:
    """id, label, split by place in the order of row_id: of each ten 8 train, then val, then test."""
    place = (F.col("r") + 1) % 10
    kind = F.when(place <= 7, "train").when(place == 8, "val").otherwise("test")
    return dense_ids(groups, "row_id", out="r").select("id", "label", kind.alias("split"))


def split_counts(splits: DataFrame) -> DataFrame:
    """split, n, n_positive, n_negative, rate."""
    yes = F.col("label") == SUSPICIOUS
    x = splits.groupBy("split").agg(F.count("*").alias("n"), F.count_if(yes).alias("n_positive"), F.count_if(~yes).alias("n_negative"))
    return x.withColumn("rate", F.col("n_positive") / F.col("n"))


def split_hash(splits: DataFrame) -> DataFrame:
    """sha256 of the sorted lines 'id tab split': a digest of one row a group (a label table, not graph data)."""
    lines = F.sort_array(F.collect_list(F.concat("id", F.lit("\t"), "split", F.lit("\n"))))
    return splits.agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256"))


def splits_disjoint(splits: DataFrame) -> DataFrame:
    """split_a, split_b, n_shared of ids that are in two splits."""
    a, b = splits.select("id", F.col("split").alias("split_a")), splits.select("id", F.col("split").alias("split_b"))
    return a.join(b, "id").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.countDistinct("id").alias("n_shared"))


def verify_split(splits: DataFrame) -> None:
    """Raise unless ids are in one split each and every split has a positive group."""
    if not splits_disjoint(splits).isEmpty():
        raise GuardError("a group is in two splits")
    counts = {r["split"]: r["n_positive"] for r in split_counts(splits).collect()}
    if missing := [s for s in ("train", "val", "test") if not counts.get(s)]:
        raise GuardError(f"no positive group in {missing}")


def membership_fingerprint(table: DataFrame, members: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, is_fingerprint: whether a column is constant within every group and differs between any two (of two or more)."""
    x = table.join(node_group(members), "idx")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")
    g = x.select("pos", values).groupBy("x.column", "pos").agg(F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
    g = g.groupBy("column").agg(F.bool_and(F.col("lo") == F.col("hi")).alias("flat"), F.countDistinct("lo").alias("values"), F.count("*").alias("n"))
    return g.select("column", (F.col("flat") & (F.col("values") == F.col("n")) & (F.col("n") >= 2)).alias("is_fingerprint"))


def test_labels_masked(exposure: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n_test, n_exposed: nodes of test groups, and those with a nonzero exposure column."""
    shown = F.greatest(*(F.abs(F.col(c)) for c in columns), F.lit(0.0)) > 0
    x = labels.where("is_test").join(exposure, "idx", "left")
    return x.agg(F.count("*").alias("n_test"), F.count_if(shown).alias("n_exposed"))
