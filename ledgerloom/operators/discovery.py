"""The discovery funnel: score gate, reachability gate, typology gate, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import SUSPICIOUS
from ledgerloom.operators.ranks import cumulative_share, dense_ids, quantile
from ledgerloom.operators.search import MAX_HOPS, bfs, carve
from ledgerloom.runtime import materialize


def score_gate(scores: DataFrame, q: float = 0.9) -> DataFrame:
    """The rows of scores (idx, score) at or above the q-quantile."""
    return scores.where(F.col("score") >= F.lit(quantile(scores, "score", q)))


def score_pct(scores: DataFrame) -> DataFrame:
    """scores with score_pct: the share of rows with at most this score."""
    return cumulative_share(scores, "score", "score_pct", scores.count())


def gate1(scores: DataFrame, known: DataFrame, q: float = 0.9, top_k: int | None = 1000) -> DataFrame:
    """The score gate without known members; the top_k by score, ties to the smaller id."""
    x = score_gate(scores, q).join(known.select("idx"), "idx", "left_anti")
    return x.orderBy(F.desc("score"), "idx").limit(top_k) if top_k is not None else x


def typology_signal(features: DataFrame) -> DataFrame:
    """idx, signal: the source-sink axis."""
    return features.select("idx", F.col("source_sink_axis").alias("signal"))


def discover(
    scores: DataFrame, edges: DataFrame, ends: DataFrame, signal: DataFrame, q: float = 0.9, max_hops: int = MAX_HOPS, threshold: float = 0.0, cap: int | None = None, hub: DataFrame | None = None
) -> DataFrame:
    """rank, idx, score, score_pct, hops, signal of nodes above the score gate that reach an endpoint and whose signal is at
    least the threshold."""
    back = bfs(edges, ends, max_hops, True, cap, hub).select("idx", F.col("hop").alias("hops"))
    x = score_gate(score_pct(scores), q).join(back, "idx").join(signal, "idx").where(F.col("signal") >= threshold)
    x = dense_ids(x.withColumn("__s", -F.col("score")), "__s", "idx", out="rank").drop("__s")
    return x.select((F.col("rank") + 1).alias("rank"), "idx", "score", "score_pct", "hops", "signal")


def discover_background(
    scores: DataFrame, edges: DataFrame, ends: DataFrame, signal: DataFrame, known: DataFrame, border_score: DataFrame | None = None,
    q: float = 0.9, top_k: int | None = 1000, max_hops: int = MAX_HOPS, threshold: float = 0.0, cap: int | None = None, hub: DataFrame | None = None,
) -> DataFrame:
    """rank, ccId, ccLabel, split, candidate, score, border_score, n_members, member_idx of discovered groups.

    Candidates pass the score gate, have a path to an endpoint, and a signal of at least the threshold. border_score (candidate,
    border_score) is the rescoring of the carved groups; without it the candidate's own score.
    """
    cand = materialize(gate1(scores, known, q, top_k).select("idx", "score"))
    groups = carve(edges, cand, ends, max_hops, cap, hub).groupBy("candidate")
    groups = groups.agg(F.count("*").alias("n_members"), F.sort_array(F.collect_list("idx")).alias("member_idx"))
    x = groups.join(cand.withColumnRenamed("idx", "candidate"), "candidate")
    x = x.join(signal.where(F.col("signal") >= threshold).select(F.col("idx").alias("candidate")), "candidate", "left_semi")
    if border_score is None:
        x = x.withColumn("border_score", F.col("score"))
    else:
        x = x.join(border_score, "candidate")
    x = dense_ids(x.withColumn("__s", -F.col("border_score")), "__s", "candidate", out="rank").drop("__s")
    return x.select(
        (F.col("rank") + 1).alias("rank"), F.concat(F.lit("bg"), F.col("candidate")).alias("ccId"), F.lit("unknown").alias("ccLabel"),
        F.lit("discovered").alias("split"), "candidate", "score", "border_score", "n_members", "member_idx",
    )


def recovery_targets(members: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """id, idx: members of the suspicious groups of a split."""
    x = members.where(F.col("ccLabel") == SUSPICIOUS)
    ids = splits.where(F.col("split") == split).select(F.col("id").alias("ccId"))
    return x.join(ids, "ccId", "left_semi").select(F.col("pos").alias("id"), "idx")
