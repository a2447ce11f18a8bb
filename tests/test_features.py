import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features, ingest, labels
from ledgerloom.operators.ranks import cumulative_share, dense_ids, percentile_rank, quantile


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "idx")


def edges(spark, rows):
    rows = [(*r, *(1.0, 0.0)[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame(rows, "src long, dst long, weight double, ts double")


def table(df, *columns):
    return {r["idx"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_degree(spark):
    got = features.degree(nodes(spark, 6), edges(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 1), (1, 4)]), empty=-1.0)
    want = {0: (1, 2, 0.5), 1: (2, 2, 1.0), 2: (2, 1, 2.0), 3: (0, 1, 0.0), 4: (1, 0, -1.0), 5: (0, 0, -1.0)}
    assert table(got, "in_degree", "out_degree", "in_out_ratio") == want


def test_degree_counts_loops_and_parallels(spark):
    got = table(features.degree(nodes(spark, 2), edges(spark, [(0, 0), (0, 1), (0, 1)])), "in_degree", "out_degree", "total_degree")
    assert got == {0: (1, 3, 4), 1: (2, 0, 2)}


def test_edge_aggs(spark):
    e = spark.createDataFrame([(0, 1, 10.0, 1.0), (0, 2, 20.0, 2.0), (1, 2, 30.0, 3.0), (2, 0, 40.0, 4.0)], "src long, dst long, a double, b double")
    got = features.edge_aggs(nodes(spark, 4), e, ["a", "b"])
    assert got.columns[1:] == features.aggregate_columns(["a", "b"])
    assert table(got, "out_a_sum", "out_a_mean", "out_a_max", "out_a_std") == {0: (30, 15, 20, 5), 1: (30, 30, 30, 0), 2: (40, 40, 40, 0), 3: (0, 0, 0, 0)}
    assert table(got, "in_a_sum", "in_a_std") == {0: (40, 0), 1: (10, 0), 2: (50, 5), 3: (0, 0)}
    with pytest.raises(ValueError):
        features.edge_aggs(nodes(spark, 1), e, ["a"], stats=("median",))


def test_flow_concentration(spark):
    rows = [(0, 1, 1.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 2.0), (4, 5, 7.0), (6, 1, 97.0), (6, 2, 1.0), (6, 3, 1.0), (6, 7, 1.0)]
    x = features.flow_concentration(nodes(spark, 8), edges(spark, rows), empty=-1.0)
    out = table(x, "out_gini", "out_hhi", "out_max_share")
    assert out[0] == pytest.approx((0, 1 / 3, 1 / 3)) and out[4] == pytest.approx((0, 1, 1)) and out[6] == pytest.approx((0.72, 0.9412, 0.97)) and out[5] == (-1, -1, -1)
    into = table(x, "in_gini", "in_hhi", "in_max_share")
    assert into[1][0] == pytest.approx(95 / 198) and into[1][2] == pytest.approx(97 / 99) and into[2] == pytest.approx((1 / 6, 5 / 9, 2 / 3))


def test_temporal(spark):
    times = {0: [0, 5, 10, 15], 1: [0, 0, 2], 2: [0, 1, 10], 3: [7], 4: [3, 8], 6: [0] * 5 + [9]}
    rows = [(n, 20 + i, 1.0, float(t)) for n, ts in times.items() for i, t in enumerate(ts)] + [(7, 30, 1.0, 2.0), (31, 7, 1.0, 8.0)]
    got = table(features.temporal(nodes(spark, 42), edges(spark, rows), empty=-9.0), "activity_span", "burstiness")
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 6, 7)] == [15, 2, 10, 0, 5, 9, 6]
    assert got[0][1] == -1 and got[1][1] == pytest.approx(0) and got[2][1] == pytest.approx(-1 / 9) and got[3][1] == -9 and got[4][1] == -1
    assert got[6][1] == pytest.approx(1 / 3) and got[5] == (-9, -9)


def test_path_role(spark):
    rows = [(i, a, b, c, 10.0 * d) for i, (a, b, c, d) in enumerate(zip([100, 50, 10, 5, 1], [1, 5, 10, 50, 100], [1000, 500, 100, 50, 10], [1000, 500, 100, 50, 10], strict=True))]
    x = spark.createDataFrame(rows, "idx long, in_degree long, out_degree long, size long, throughput double")
    got = table(features.path_role(x), "endpoint_score", "source_sink_axis")
    assert [got[i] for i in range(5)] == [pytest.approx(v) for v in [(1, 1), (0.75, 0.5), (0.5, 0), (0.25, -0.5), (0, -1)]]


def test_percentile_ties(spark):
    x = spark.createDataFrame([(0, 10), (1, 10), (2, 20)], "idx long, v long")
    assert table(percentile_rank(x, "v", "p", 3), "p") == {0: (0.25,), 1: (0.25,), 2: (1.0,)}
    assert table(percentile_rank(x.limit(1), "v", "p", 1), "p") == {0: (0.5,)}
    assert table(cumulative_share(x, "v", "p", 3), "p") == {0: (pytest.approx(2 / 3),), 1: (pytest.approx(2 / 3),), 2: (1.0,)}


@pytest.mark.parametrize("q", [0, 0.1, 0.5, 0.8, 0.95, 1])
def test_quantile(spark, q):
    import numpy as np

    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    assert quantile(spark.createDataFrame([(x,) for x in v], "v double"), "v", q) == pytest.approx(np.quantile(v, q))


def test_dense_ids(spark):
    got = dense_ids(spark.createDataFrame([(f"k{i:04d}",) for i in range(999, -1, -1)], "k string"), "k").collect()
    assert all(r["k"] == f"k{r['idx']:04d}" for r in got) and len(got) == 1000


LABELED = [(0, "licit", [0, 1]), (1, "suspicious", [2, 3]), (2, "suspicious", [4])]


def members(spark, rows):
    g = spark.createDataFrame([(p, f"g{p}", lab, m) for p, lab, m in rows], "pos long, ccId string, ccLabel string, member_idx array<long>")
    return ingest.membership_explode(g)


def splits(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, split string")


def test_neighborhood(spark):
    m = members(spark, LABELED)
    s = splits(spark, [("g0", "licit", "train"), ("g1", "suspicious", "train"), ("g2", "suspicious", "test")])
    lab = labels.node_labels(m, s)
    e = edges(spark, [(0, 1), (0, 2), (0, 5), (2, 3), (2, 4)])
    x = labels.neighborhood(nodes(spark, 6), e, lab, empty=-1.0)
    one = table(x, "hop1_frac_suspicious", "hop1_frac_licit", "hop1_frac_unknown")
    assert one[0] == pytest.approx((1 / 3, 0, 2 / 3)) and one[2] == pytest.approx((0, 1 / 3, 2 / 3)) and one[5] == pytest.approx((0, 1, 0)) and one[4] == pytest.approx((1, 0, 0))
    two = table(x, "hop2_frac_suspicious", "hop2_frac_unknown")
    assert two[0] == pytest.approx((0.5, 0.5))


def test_hub_cap(spark):
    m = members(spark, [(0, "licit", [1, 2]), (1, "suspicious", [3, 4])])
    lab = labels.node_labels(m, splits(spark, [("g0", "licit", "train"), ("g1", "suspicious", "train")]))
    star = edges(spark, [(0, i) for i in range(1, 5)])
    free = table(labels.neighborhood(nodes(spark, 5), star, lab, hub_cap=None, empty=-1.0), "hop1_frac_licit", "hop2_frac_suspicious")
    capped = table(labels.neighborhood(nodes(spark, 5), star, lab, hub_cap=3, empty=-1.0), "hop1_frac_licit", "hop2_frac_suspicious")
    assert free[1][1] > 0 and all(v[1] == -1 for v in capped.values()) and {k: v[0] for k, v in free.items()} == {k: v[0] for k, v in capped.items()}
    with pytest.raises(ValueError):
        labels.neighborhood(nodes(spark, 5), star, lab, hops=(3,))


def test_fractions_sum_to_one(spark):
    import random

    r = random.Random(1)
    e = edges(spark, [(r.randrange(40), r.randrange(40)) for _ in range(150)])
    lab = labels.node_labels(members(spark, [(0, "licit", list(range(10))), (1, "suspicious", list(range(10, 20)))]), splits(spark, [("g0", "licit", "val")]))
    x = labels.neighborhood(nodes(spark, 40), e, lab, hub_cap=None, empty=0.0)
    for h in (1, 2):
        total = F.col(f"hop{h}_frac_suspicious") + F.col(f"hop{h}_frac_licit") + F.col(f"hop{h}_frac_unknown")
        assert x.where((total > 0) & (F.abs(total - 1) > 1e-9)).isEmpty()


def test_cluster_features_has_a_row_a_node(spark):
    n = nodes(spark, 5).withColumn("size", F.col("idx").cast("double"))
    x = features.cluster_features(n, edges(spark, [(0, 1, 2.0, 1.0), (1, 2, 3.0, 4.0)]), ["weight"])
    assert x.count() == 5 and ingest.contiguous_idx(x).first()["is_contiguous"]
    ingest.assert_finite(x, [c for c in x.columns if c != "idx"])
    with pytest.raises(ingest.GuardError):
        ingest.assert_finite(x.withColumn("bad", F.lit(math.nan)), ["bad"])


def test_a_hub_is_split_over_tasks(spark):
    """A node with a third of all rows: counterparties and events in several partitions, the same values as by numpy."""
    r = np.random.default_rng(3)
    n = 900
    src = np.where(np.arange(n) % 3 == 0, 0, r.integers(1, 40, n))
    rows = [(int(a), int(b), float(w), float(t)) for a, b, w, t in zip(src, r.integers(1, 200, n), r.integers(1, 50, n), np.round(r.exponential(30, n), 1))]
    edges, nodes = spark.createDataFrame(rows, "src long, dst long, weight double, ts double"), spark.range(201).toDF("idx")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        flow = {x["idx"]: x for x in features.flow_concentration(nodes, edges).collect()}
        when = {x["idx"]: x for x in features.temporal(nodes, edges).collect()}
        one = {x["idx"]: x for x in features.temporal(nodes, edges, slices=1).collect()}
    finally:
        spark.conf.unset(key)
    for idx in range(201):
        for side, a, b in (("out", 0, 1), ("in", 1, 0)):
            to = {}
            for x in rows:
                if x[a] == idx:
                    to[x[b]] = to.get(x[b], 0) + x[2]
            w, k = np.sort(np.array(list(to.values()))), len(to)
            gini = ((2 * np.arange(1, k + 1) - k - 1) * w).sum() / (k * w.sum()) if k else 0
            assert flow[idx][f"{side}_gini"] == pytest.approx(gini, abs=1e-9)
            assert flow[idx][f"{side}_max_share"] == pytest.approx(w.max() / w.sum() if k else 0)
        t = np.sort([x[3] for x in rows for e in x[:2] if e == idx])
        gap = np.diff(t)
        burst = (gap.std() - gap.mean()) / (gap.std() + gap.mean()) if len(gap) and gap.std() + gap.mean() > 0 else 0
        for got in (when[idx], one[idx]):
            assert got["activity_span"] == pytest.approx(t[-1] - t[0] if len(t) else 0)
            assert got["burstiness"] == pytest.approx(burst, abs=1e-6)
