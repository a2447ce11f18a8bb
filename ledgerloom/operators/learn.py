"""Set pooling, standardising, and models over nodes and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import SUSPICIOUS, GuardError
from ledgerloom.operators.labels import labeled_members, positive_members
from ledgerloom.runtime import prepare_python

POOLS = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "sum": F.sum}
SMALL_STD = 1e-6


def moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: {c}_mean and {c}_std (population; below 1e-6: 1) of each column."""
    x = rows.agg(*(f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    return x.select(*(F.when(F.col(c) < SMALL_STD, 1.0).otherwise(F.col(c)).alias(c) if c.endswith("_std") else F.col(c) for c in x.columns))


def standardize(rows: DataFrame, columns: Sequence[str], by: DataFrame | None = None) -> DataFrame:
    """rows with the columns as z-scores under by, a row of moments() (their own by default)."""
    m = F.broadcast(by if by is not None else moments(rows, columns))  # one row
    x = rows.crossJoin(m)
    z = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}
    return x.select(*(z[c].alias(c) if c in z else F.col(c) for c in rows.columns))


def fit_standardizer(features: DataFrame, members: DataFrame, border: DataFrame, columns: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """moments() over the distinct inside and border nodes of the groups (pos; all by default)."""
    x = members.select("pos", "idx").union(border.select("pos", "idx"))
    if groups is not None:
        x = x.join(groups.select("pos"), "pos", "left_semi")
    return moments(features.join(x.select("idx").distinct(), "idx", "left_semi"), columns)


def class_weights(rows: DataFrame) -> DataFrame:
    """rows (label 0 or 1) with weight: negatives over positives for a positive, else 1."""
    ratio = rows.agg((F.count_if(F.col("label") == 0) / F.nullif(F.count_if(F.col("label") == 1), F.lit(0))).alias("__r"))
    x = rows.crossJoin(F.broadcast(ratio))  # one row
    return x.withColumn("weight", F.when(F.col("label") == 1, F.coalesce("__r", F.lit(1.0))).otherwise(1.0)).drop("__r")


def subgraph_pool(members: DataFrame, features: DataFrame, columns: Sequence[str], pools: Sequence[str] = ("mean", "max", "min", "std", "sum")) -> DataFrame:
    """pos and {pool}__{column} of the members' features; 0 for groups without members."""
    g = members.join(features.select("idx", *columns), "idx").groupBy("pos")
    g = g.agg(*(POOLS[p](F.col(c).cast("double")).alias(f"{p}__{c}") for p in pools for c in columns))
    x = members.select("pos").distinct().join(g, "pos", "left")
    return x.select("pos", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in g.columns[1:]))


def set_batch(members: DataFrame, border: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pos, role (internal, sender, receiver), idx and features: the sets that describe each group."""
    rows = members.select("pos", F.lit("internal").alias("role"), "idx").union(border.select("pos", "role", "idx")).distinct()
    return rows.join(features.select("idx", *columns), "idx").select("pos", "role", "idx", *columns)


def segment_pool(groups: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pos and sum__, mean__, max__ of each column over the group's rows; 0 for groups without rows."""
    g = rows.groupBy("pos").agg(*(POOLS[p](F.col(c).cast("double")).alias(f"{p}__{c}") for p in ("sum", "mean", "max") for c in columns))
    x = groups.select("pos").distinct().join(g, "pos", "left")
    return x.select("pos", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in g.columns[1:]))


def mil_max_pool(members: DataFrame, scores: DataFrame, empty: float = 0.0) -> DataFrame:
    """pos, score: the largest finite member score, else `empty`."""
    s = F.col("score").cast("double")
    fine = scores.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")))
    g = members.join(fine.select("idx", "score"), "idx").groupBy("pos").agg(F.max("score").alias("score"))
    return members.select("pos").distinct().join(g, "pos", "left").select("pos", F.coalesce("score", F.lit(empty)).alias("score"))


class TreeScorer:
    """Boosted trees over named columns; it refuses tables without exactly the columns that it was fitted on."""

    def __init__(self, columns: Sequence[str], max_iter: int = 50, max_depth: int = 5, step: float = 0.1, seed: int = 0):
        self.columns = list(columns)
        self.make = lambda: GBTClassifier(
            featuresCol="__x", labelCol="label", weightCol="weight", maxIter=max_iter, maxDepth=max_depth, stepSize=step, minInstancesPerNode=20, seed=seed
        )
        self.model: GBTClassificationModel | None = None

    def _vectors(self, rows: DataFrame) -> DataFrame:
        if missing := [c for c in self.columns if c not in rows.columns]:
            raise GuardError(f"columns missing: {missing}")
        return VectorAssembler(inputCols=self.columns, outputCol="__x").transform(rows)

    def fit(self, rows: DataFrame) -> TreeScorer:
        """rows: the columns and label (0 or 1); both labels are needed."""
        self.model = self.make().fit(self._vectors(class_weights(rows)))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with score, the probability of label 1."""
        if self.model is None:
            raise GuardError("the model isn't fitted")
        x = self.model.transform(self._vectors(rows))
        return x.withColumn("score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def pooled_rows(members: DataFrame, features: DataFrame, splits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pos, ccId, label, split and pooled features of each group; a group without a split has ''."""
    group = members.select("pos", "ccId", "ccLabel").distinct()
    ids = splits.select(F.col("id").alias("ccId"), "split")
    x = subgraph_pool(members, features, columns).join(group, "pos").join(ids, "ccId", "left")
    return x.withColumn("label", (F.col("ccLabel") == SUSPICIOUS).cast("int")).withColumn("split", F.coalesce("split", F.lit(""))).drop("ccLabel")


def node_rows(members: DataFrame, features: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """idx, label and features of the labelled members of a split."""
    yes = positive_members(members, splits, split).withColumn("label", F.lit(1))
    x = labeled_members(members, splits, split).join(yes, "idx", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return x.join(features, "idx")


class DeepSets:
    """Permutation-invariant scorer of sets: rho(pool(phi(x))) of senders and receivers, joined with pooled insides, and a linear head.

    Training runs on the driver over pooled arrays of the labelled groups (a label table, thousands of groups); scoring broadcasts
    the weights and runs by group in Spark.
    """

    ROLES = ("sender", "receiver", "internal")

    def __init__(self, columns: Sequence[str], hidden: int = 16, seed: int = 0, rate: float = 0.01, epochs: int = 200):
        self.columns, self.hidden, self.seed, self.rate, self.epochs = list(columns), hidden, seed, rate, epochs
        r, d, h = np.random.default_rng(seed), len(self.columns), hidden
        self.w = {f"phi_{k}": r.standard_normal((d, h)) / np.sqrt(max(1, d)) for k in self.ROLES}
        self.w |= {f"bias_{k}": np.zeros(h) for k in self.ROLES}
        self.w |= {"rho": r.standard_normal((9 * h, h)) / np.sqrt(9 * h), "rho_bias": np.zeros(h), "out": r.standard_normal(h) / np.sqrt(h), "out_bias": np.zeros(1)}

    def _forward(self, sets: dict[str, tuple[np.ndarray, np.ndarray]], n: int):
        keep, pooled = {}, []
        for k in self.ROLES:
            x, seg = sets[k]
            z = np.maximum(x @ self.w[f"phi_{k}"] + self.w[f"bias_{k}"], 0)
            total, count = np.zeros((n, self.hidden)), np.bincount(seg, minlength=n)[:, None]
            np.add.at(total, seg, z)
            top = np.zeros((n, self.hidden))
            np.maximum.at(top, seg, z)
            mean = total / np.maximum(count, 1)
            pooled += [np.log1p(total), mean, top]
            keep[k] = (x, seg, z, total, count, top)
        p = np.concatenate(pooled, axis=1)
        a = np.maximum(p @ self.w["rho"] + self.w["rho_bias"], 0)
        return a @ self.w["out"] + self.w["out_bias"][0], p, a, keep

    def _gradients(self, sets, y, weight) -> tuple[float, dict[str, np.ndarray]]:
        n = len(y)
        z, p, a, keep = self._forward(sets, n)
        s = 1 / (1 + np.exp(-z))
        loss = float(-(weight * (y * np.log(s + 1e-12) + (1 - y) * np.log(1 - s + 1e-12))).sum() / weight.sum())
        dz = weight * (s - y) / weight.sum()
        g = {"out": a.T @ dz, "out_bias": np.array([dz.sum()])}
        da = np.outer(dz, self.w["out"]) * (a > 0)
        g["rho"], g["rho_bias"] = p.T @ da, da.sum(axis=0)
        dp = da @ self.w["rho"].T
        h = self.hidden
        for i, k in enumerate(self.ROLES):
            x, seg, act, total, count, top = keep[k]
            d_sum, d_mean, d_top = (dp[:, (3 * i + j) * h : (3 * i + j + 1) * h] for j in range(3))
            d = (d_sum / (1 + total) + d_mean / np.maximum(count, 1))[seg] + d_top[seg] * (act == top[seg])
            d *= act > 0
            g[f"phi_{k}"], g[f"bias_{k}"] = x.T @ d, d.sum(axis=0)
        return loss, g

    def _sets(self, rows: pd.DataFrame, pos: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for k in self.ROLES:
            part = rows[rows["role"] == k]
            out[k] = part[self.columns].to_numpy(dtype=float).reshape(len(part), len(self.columns)), np.searchsorted(pos, part["pos"].to_numpy())
        return out

    def fit(self, rows: DataFrame, labels: DataFrame) -> DeepSets:
        """rows: set_batch() of labelled groups; labels: pos, label. Adam on weighted cross-entropy, full batch."""
        y = labels.select("pos", "label").toPandas().drop_duplicates("pos").sort_values("pos")
        pos, target = y["pos"].to_numpy(), y["label"].to_numpy(dtype=float)
        if not 0 < target.sum() < len(target):
            raise GuardError("both labels are needed")
        data = rows.join(labels.select("pos"), "pos", "left_semi").toPandas()
        sets = self._sets(data, pos)
        weight = np.where(target == 1, (len(target) - target.sum()) / target.sum(), 1.0)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        self.losses = []
        for t in range(1, self.epochs + 1):
            loss, g = self._gradients(sets, target, weight)
            self.losses.append(loss)
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.w[k] = self.w[k] - self.rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """pos, score for the groups of set_batch() rows."""
        prepare_python(rows.sparkSession)
        held = rows.sparkSession.sparkContext.broadcast((self.w, self.columns, self.hidden))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            w, columns, hidden = held.value
            model = DeepSets(columns, hidden)
            model.w = w
            pos = np.unique(pdf["pos"].to_numpy())
            z, *_ = model._forward(model._sets(pdf, pos), len(pos))
            return pd.DataFrame({"pos": pos, "score": 1 / (1 + np.exp(-z))})

        return rows.groupBy("pos").applyInPandas(run, "pos long, score double")


def best_of(make: Callable[[int], DeepSets], seeds: Sequence[int], fit: Callable[[DeepSets], DeepSets], judge: Callable[[DeepSets], float]) -> DeepSets:
    """The restart that judges best (validation average precision), the first of equals."""
    models: Iterator[DeepSets] = (fit(make(s)) for s in seeds)
    return max(((judge(m), -i, m) for i, m in enumerate(models)), key=lambda x: x[:2])[2]
