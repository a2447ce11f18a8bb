"""A node scorer of stacked ego/neighbour convolutions and a linear head, trained on positive and unlabelled nodes.

Training draws seeds and their sampled neighbourhoods in Spark and runs in numpy on the driver: the sample is bounded by
seeds x (1 + fanout + fanout x fanout) nodes, whatever the graph's size. Scoring runs over the whole graph in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.evaluate import tice_prior
from ledgerloom.operators.ingest import GuardError
from ledgerloom.operators.search import encode, neighbor_sample
from ledgerloom.runtime import materialize

#: Unlabelled rows, drawn by hash, from which the prior is estimated.
PRIOR_ROWS = 200_000


def drawn(rows: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """About `most` of the rows (idx), chosen by hash; all of them if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def estimate_prior(features: DataFrame, positives: DataFrame, columns: Sequence[str], most: int = PRIOR_ROWS, seed: int = 0, **options) -> DataFrame:
    """tice_prior() over all positives (idx) and a bounded draw of the other rows of features (idx, columns)."""
    yes = positives.select("idx").distinct().withColumn("labeled", F.lit(True))
    rest = features.join(yes, "idx", "left_anti")
    some = drawn(rest, most, seed).withColumn("labeled", F.lit(False))
    return tice_prior(materialize(features.join(yes, "idx").unionByName(some).select("labeled", *columns)), columns, **options)


class GraphScorer:
    """sigmoid(w . z + b) of z, the encoder's output; hidden: the width after each convolution."""

    def __init__(self, width: int, hidden: Sequence[int] = (64, 32), fanout: Sequence[int] = (15, 10), seed: int = 0, rate: float = 0.01,
                 epochs: int = 50, batch: int = 512, seeds: int = 4096, beta: float = 0.0, gamma: float = 1.0):
        if len(fanout) != len(hidden):
            raise ValueError("a fanout for each convolution")
        self.width, self.fanout, self.seed, self.rate, self.epochs = width, tuple(fanout), seed, rate, epochs
        self.batch, self.seeds, self.beta, self.gamma = batch, seeds, beta, gamma
        r, sizes = np.random.default_rng(seed), [width, *hidden]
        self.layers = [
            tuple(r.standard_normal((b, a)) / np.sqrt(2 * a) for _ in range(2)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)
        ]
        self.head, self.bias = r.standard_normal(hidden[-1]) / np.sqrt(hidden[-1]), np.zeros(1)
        self.losses: list[float] = []

    def _check(self, features: DataFrame) -> None:
        other = features.select(F.size("x").alias("n")).where(F.col("n") != self.width).first()
        if other is not None:
            raise GuardError(f"vectors of {other['n']} components, the model has {self.width}")

    @staticmethod
    def _mean(x: np.ndarray, src: np.ndarray, dst: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        np.add.at(out, dst, x[src])
        return out / count

    def _forward(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray):
        count = np.maximum(np.bincount(dst, minlength=len(x)), 1)[:, None]
        keep = []
        for i, (ego, near) in enumerate(self.layers):
            m = self._mean(x, src, dst, count)
            z = x @ ego.T + m @ near.T
            keep.append((x, m, z))
            x = np.maximum(z, 0) if i + 1 < len(self.layers) else z
        return x @ self.head + self.bias[0], x, keep, count

    def _gradients(self, x, src, dst, rows, yes, prior) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of the weights in the order of _weights(); rows: the batch's nodes, yes: which are positive."""
        out, top, keep, count = self._forward(x, src, dst)
        s = 1 / (1 + np.exp(-np.clip(out[rows], -60, 60)))
        slope, p, u = s * (1 - s), yes, ~yes
        positive = prior * (1 - s[p]).mean()
        negative = s[u].mean() - prior * s[p].mean()
        d_pos, d_neg = np.zeros(len(rows)), np.zeros(len(rows))
        d_pos[p] = -prior * slope[p] / p.sum()
        d_neg[u] = slope[u] / u.sum()
        d_neg[p] = -prior * slope[p] / p.sum()
        clamped = negative < -self.beta
        d = np.zeros(len(x))
        np.add.at(d, rows, -self.gamma * d_neg if clamped else d_pos + d_neg)
        grads = [top.T @ d, np.array([d.sum()])]
        dz = np.outer(d, self.head)
        below = []
        for i in range(len(self.layers) - 1, -1, -1):
            (ego, near), (h, m, _) = self.layers[i], keep[i]
            below.append((dz.T @ h, dz.T @ m))
            if i:
                dm = dz @ near / count
                dh = dz @ ego
                np.add.at(dh, src, dm[dst])
                dz = dh * (keep[i - 1][2] > 0)
        for pair in reversed(below):
            grads += pair
        return float(positive + max(negative, -self.beta)), grads

    def _weights(self) -> list[np.ndarray]:
        return [self.head, self.bias, *(w for pair in self.layers for w in pair)]

    def _sample(self, features: DataFrame, edges: DataFrame, positives: DataFrame):
        """x, src, dst of the seeds' sampled neighbourhoods, and the places of positive and other seeds."""
        known = features.select("idx")
        yes = drawn(positives.select("idx").distinct().join(known, "idx", "left_semi"), self.seeds // 2, self.seed)
        no = drawn(known.join(positives.select("idx"), "idx", "left_anti"), self.seeds // 2, self.seed)
        seeds = materialize(yes.withColumn("yes", F.lit(True)).union(no.withColumn("yes", F.lit(False))))
        got = materialize(neighbor_sample(edges, seeds.select("idx"), self.fanout, self.seed).select("src", "dst").distinct())
        nodes = seeds.select("idx").union(got.select("src")).union(got.select("dst")).distinct()
        table = features.join(nodes, "idx").toPandas().drop_duplicates("idx").sort_values("idx")
        idx, x = table["idx"].to_numpy(), np.array(table["x"].tolist(), dtype=float).reshape(len(table), self.width)
        pairs, chosen = got.toPandas(), seeds.toPandas().sort_values("idx")
        here = pairs["src"].isin(idx) & pairs["dst"].isin(idx)
        src, dst = (np.searchsorted(idx, pairs.loc[here, c].to_numpy()) for c in ("src", "dst"))
        place, is_yes = np.searchsorted(idx, chosen["idx"].to_numpy()), chosen["yes"].to_numpy(dtype=bool)
        return x, src, dst, place[is_yes], place[~is_yes]

    def fit(self, features: DataFrame, edges: DataFrame, positives: DataFrame, prior: float) -> GraphScorer:
        """features: idx, x; edges: src, dst; positives: idx; prior: the share of positives among the other nodes. Adam, in batches that hold
        positive and other seeds in the proportion of the draw."""
        if not 0 < prior < 1:
            raise ValueError("the prior is between 0 and 1")
        self._check(features)
        x, src, dst, yes, no = self._sample(features, edges, positives)
        if not len(yes) or not len(no):
            raise GuardError("positive and other nodes are needed")
        r = np.random.default_rng(self.seed)
        weights = self._weights()
        m, v = ([np.zeros_like(w) for w in weights] for _ in range(2))
        parts, t = max(1, -(-(len(yes) + len(no)) // self.batch)), 0
        for _ in range(self.epochs):
            total = 0.0
            for p, u in zip(np.array_split(r.permutation(yes), parts), np.array_split(r.permutation(no), parts), strict=True):
                if not len(p) or not len(u):
                    continue
                rows = np.concatenate([p, u])
                loss, grads = self._gradients(x, src, dst, rows, np.arange(len(rows)) < len(p), prior)
                total, t = total + loss, t + 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g**2
                    weights[i] -= self.rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            self.losses.append(total / parts)
        return self

    def score(self, features: DataFrame, edges: DataFrame) -> DataFrame:
        """idx, score of every row of features, over all its neighbours."""
        self._check(features)
        z = encode(features.select("idx", "x"), edges, self.layers)
        out = F.lit(float(self.bias[0]))
        for i, w in enumerate(self.head):
            out = out + F.lit(float(w)) * F.col("x")[i]
        return z.select("idx", (1 / (1 + F.exp(-out))).alias("score"))
