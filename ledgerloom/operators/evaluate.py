"""Metrics of ranked and thresholded scores, recovery against chance, positive-unlabelled risk and class prior."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import value_ranks, with_offsets
from ledgerloom.runtime import materialize


def pr_auc(scores: DataFrame) -> DataFrame:
    """average_precision of scores (score, label 0 or 1): the sum over distinct scores, descending, of recall gained times
    precision. Raises without a positive."""
    total, positive = scores.agg(F.count("*"), F.sum("label")).first()
    if not positive:
        raise ValueError("average precision needs a positive label")
    ranks = value_ranks(scores.select("score"), "score").select("score", (F.lit(total) - F.col("before")).alias("predicted"))
    hits = scores.groupBy("score").agg(F.sum("label").alias("tp"))
    yes = value_ranks(scores.where("label = 1").select("score"), "score").select("score", (F.lit(positive) - F.col("before")).alias("found"))
    x = ranks.join(hits, "score").join(yes, "score")
    return x.agg(F.sum(F.col("tp") / F.lit(positive) * F.col("found") / F.col("predicted")).alias("average_precision"))


def pu_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n, n_positive, n_predicted, f1, recall, lee_liu of score >= threshold against label; 0 where undefined."""
    yes, hit = F.col("score") >= threshold, F.col("label") == 1
    x = scores.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_positive"), F.count_if(yes).alias("n_predicted"), F.count_if(yes & hit).alias("tp")
    )
    recall = F.coalesce(F.try_divide("tp", "n_positive"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_positive") + F.col("n_predicted")), F.lit(0.0))
    lee_liu = F.coalesce(F.try_divide(recall * recall * F.col("n"), F.col("n_predicted")), F.lit(0.0))
    return x.select("n", "n_positive", "n_predicted", f1.alias("f1"), recall.alias("recall"), lee_liu.alias("lee_liu"))


def recovery(discovered: DataFrame, targets: DataFrame, n_nodes: int) -> DataFrame:
    """n_targets, n_recovered, rate, baseline, lift, union_size for discovered and targets (set id and idx, one row a member).

    A target is recovered if a discovered set holds one of its members. baseline: the mean chance that a random set as large as the union of
    the discovered ones holds a member of the target. Ids outside 0 to n_nodes - 1 don't count. targets may have null idx for empty sets.
    """
    inside = F.col("idx").between(0, n_nodes - 1)
    union = materialize(discovered.where(inside).select("idx").distinct())
    drawn = union.count()
    hit = targets.where(inside).join(union, "idx", "left_semi").select("id").distinct().withColumn("hit", F.lit(1))
    size = targets.groupBy("id").agg(F.countDistinct(F.when(inside, F.col("idx"))).alias("m"))
    miss = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.col("m") - 1, F.lit(0))), F.lit(1.0),
        lambda p, i: p * F.greatest(F.lit(float(n_nodes - drawn)) - i, F.lit(0.0)) / (F.lit(float(n_nodes)) - i),
    )
    chance = F.when(F.col("m") <= 0, 0.0).when(F.col("m") > n_nodes - drawn, 1.0).otherwise(1 - miss)
    x = size.join(hit, "id", "left").agg(
        F.count("*").alias("n_targets"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_recovered"),
        F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("rate"), F.coalesce(F.avg(chance), F.lit(0.0)).alias("baseline"),
    )
    lift = F.when(F.col("baseline") > 0, F.col("rate") / F.col("baseline")).when(F.col("rate") > 0, float("inf")).otherwise(0.0)
    return x.withColumn("lift", lift).withColumn("union_size", F.lit(drawn))


def sigmoid_loss(z: Column, positive: bool) -> Column:
    return 1 / (1 + F.exp(z if positive else -z))


def nnpu_risk(scores: DataFrame, prior: float, beta: float = 0.0, gamma: float = 1.0, loss: Callable[[Column, bool], Column] = sigmoid_loss) -> DataFrame:
    """positive_risk, negative_risk, clamped, upu_risk, nnpu_risk, surrogate for scores (z, is_positive)."""
    if not 0 < prior < 1:
        raise ValueError("the prior is between 0 and 1")
    p, z = F.col("is_positive"), F.col("z").cast("double")
    x = scores.agg(
        F.avg(F.when(p, loss(z, True))).alias("pp"), F.avg(F.when(p, loss(z, False))).alias("pn"), F.avg(F.when(~p, loss(z, False))).alias("un")
    )
    x = x.select((F.lit(prior) * F.col("pp")).alias("positive_risk"), (F.col("un") - F.lit(prior) * F.col("pn")).alias("negative_risk"))
    pos, neg = F.col("positive_risk"), F.col("negative_risk")
    clamped = neg < -beta
    return x.select(
        "*", clamped.alias("clamped"), (pos + neg).alias("upu_risk"), (pos + F.greatest(neg, F.lit(-float(beta)))).alias("nnpu_risk"),
        F.when(clamped, -F.lit(gamma) * neg).otherwise(pos + neg).alias("surrogate"),
    )


def _medians(values: DataFrame) -> DataFrame:
    """part, f, median of values (part, f, v, n: n rows have the value v), by one global order of all values."""
    ranks = materialize(with_offsets(values.select("part", "f", "v", "n"), ["part", "f", "v"], "n", "before"))
    group = ranks.groupBy("part", "f").agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    x = ranks.join(F.broadcast(group), ["part", "f"]).withColumn("before", F.col("before") - F.col("start"))  # a row for each part and feature
    at = lambda k: F.max(F.when((F.col("before") <= k) & (F.col("before") + F.col("n") > k), F.col("v")))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    return x.groupBy("part", "f").agg(at(low).alias("a"), at(high).alias("b")).select("part", "f", ((F.col("a") + F.col("b")) / 2).alias("median"))


def tice_prior(table: DataFrame, features: Sequence[str], delta: float = 0.0, max_depth: int = 4, min_subset: int = 5) -> DataFrame:
    """prior, label_frequency, labeled_fraction, n_labeled, n_total, n_subdomains for table (features, labeled boolean).

    Subdomains: from the whole domain down, each is halved at the median of the feature whose half is richest in labelled rows; the
    label frequency is the largest labelled share of a subdomain, less a confidence term if delta > 0.
    """
    if not 0 <= delta < 1:
        raise ValueError("delta is from 0 to below 1")
    yes = F.col("labeled").cast("int")
    rows = materialize(table.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)), yes.alias("yes"), F.lit(0).alias("part")))
    n, labeled = rows.agg(F.count("*"), F.coalesce(F.sum("yes"), F.lit(0))).first()
    if not labeled:
        raise ValueError("no labelled row")
    found, open_parts = [(n, labeled)], {0: (n, labeled)}
    for depth in range(max_depth):
        open_parts = {k: v for k, v in open_parts.items() if v[0] >= 2 * min_subset}
        if not open_parts or not features:
            break
        rows = rows.where(F.col("part").isin(*open_parts))
        cells = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("v")) for i in range(len(features))))
        long = rows.select("part", "yes", F.explode(cells).alias("c")).groupBy("part", "c.f", "c.v").agg(F.count("*").alias("n"), F.sum("yes").alias("y"))
        middle = _medians(long.where("v is not null"))
        below = materialize(long.join(F.broadcast(middle), ["part", "f"]).groupBy("part", "f").agg(  # at most 2^depth parts by features
            F.first("median").alias("median"), F.sum(F.when(F.col("v") <= F.col("median"), F.col("n"))).alias("n"), F.sum(F.when(F.col("v") <= F.col("median"), F.col("y"))).alias("y")
        ))
        cut: dict[int, tuple[float, int, float]] = {}
        for r in below.orderBy("part", "f").collect():
            size, total = open_parts[r["part"]]
            low, low_yes = r["n"] or 0, r["y"] or 0
            if low < min_subset or low > size - min_subset:
                continue
            best = max(low_yes / low, (total - low_yes) / (size - low))
            if r["part"] not in cut or best > cut[r["part"]][0]:
                cut[r["part"]] = (best, r["f"], r["median"])
        if not cut:
            break
        side, new = F.lit(None).cast("int"), {}
        for k, (_, f, t) in cut.items():
            here = F.col("part") == k
            side = F.when(here & (F.col(f"f{f}") <= t), 2 * k + 1).when(here & (F.col(f"f{f}") > t), 2 * k + 2).otherwise(side)
        rows = materialize(rows.withColumn("part", side).where("part is not null"))
        for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("yes").alias("y")).collect():
            new[r["part"]] = (r["n"], r["y"])
        found += new.values()
        open_parts = new
    share = labeled / n
    best_c = share
    for size, yes in found:
        if size >= min_subset:
            best_c = max(best_c, yes / size - (math.sqrt(math.log(1 / delta) / (2 * size)) if delta > 0 else 0))
    frequency = max(best_c, 1e-12)
    row = (min(1.0, share / frequency), frequency, share, labeled, n, len(found))
    schema = "prior double, label_frequency double, labeled_fraction double, n_labeled long, n_total long, n_subdomains int"
    return table.sparkSession.createDataFrame([row], schema)


def prior_grid(spark: SparkSession, lo: float = 1e-5, hi: float = 0.1, num: int = 5, include: float | None = None) -> DataFrame:
    """prior: num log-spaced values from lo to hi, and include, each once."""
    if not 0 < lo < hi < 1 or num < 2 or (include is not None and not 0 < include < 1):
        raise ValueError("0 < lo < hi < 1, two points or more, include between 0 and 1")
    step = (math.log10(hi) - math.log10(lo)) / (num - 1)
    x = spark.range(num).select(F.pow(F.lit(10.0), F.lit(math.log10(lo)) + F.col("id") * step).alias("prior"))
    if include is not None:
        x = x.union(spark.range(1).select(F.lit(float(include))))
    return x.distinct()
