import itertools
import random

import numpy as np
import pytest

from ledgerloom.operators import discovery, evaluate, search

from .test_features import edges, members


def ids(spark, rows, name="idx"):
    return spark.createDataFrame([(r,) for r in rows], f"{name} long")


def hops(df):
    return {r["idx"]: r["hop"] for r in df.collect()}


CHAIN = [(0, 1), (1, 2), (2, 3)]


def test_horizon_and_direction(spark):
    e = edges(spark, CHAIN)
    for k, reach in ((3, {0, 1, 2, 3}), (2, set())):
        r = search.reachability(e, ids(spark, [0]), ids(spark, [3]), k)
        assert {x["idx"] for x in search.survivors(r, k).collect()} == reach
    assert hops(search.bfs(e, ids(spark, [3]), 6, backward=True)) == {3: 0, 2: 1, 1: 2, 0: 3}


def test_cap_keeps_the_lowest(spark):
    assert hops(search.bfs(edges(spark, [(0, i) for i in range(1, 5)]), ids(spark, [0]), 6, cap=2)) == {0: 0, 1: 1, 2: 1}


def test_capped_node_is_found_later(spark):
    assert hops(search.bfs(edges(spark, [(0, 1), (0, 5), (1, 5)]), ids(spark, [0]), 6, cap=1)) == {0: 0, 1: 1, 5: 2}


def test_hubs_stop(spark):
    e = edges(spark, CHAIN)
    assert hops(search.bfs(e, ids(spark, [3]), 6, backward=True, hub=ids(spark, [2]))) == {3: 0, 2: 1}
    assert hops(search.bfs(edges(spark, CHAIN[:2]), ids(spark, [0]), 6, hub=ids(spark, [0]))) == {0: 0, 1: 1, 2: 2}
    got = search.survivors(search.reachability(e, ids(spark, [0]), ids(spark, [3]), 6, hub=ids(spark, [2])))
    assert [r["idx"] for r in got.collect()] == [2]
    assert [r["idx"] for r in search.hubs(edges(spark, [(0, 1), (0, 2), (3, 0)]), 2).collect()] == [0]


def test_survivors_and_induced(spark):
    r = search.survivors(search.reachability(edges(spark, [(0, 1), (1, 2), (1, 3)]), ids(spark, [0]), ids(spark, [2])))
    assert {x["idx"] for x in r.collect()} == {0, 1, 2}
    got = search.induced_subgraph(edges(spark, [(10, 11), (11, 12), (11, 13), (11, 11)]), ids(spark, [10, 11, 12]))
    assert sorted(map(tuple, got.collect())) == [(10, 11, 0, 1), (11, 12, 1, 2)]
    r = search.survivors(search.reachability(edges(spark, [(0, 1), (1, 4), (0, 2), (2, 3), (3, 4)]), ids(spark, [0]), ids(spark, [4]), 2), 2)
    assert {x["idx"] for x in r.collect()} == {0, 1, 4}


def test_carve(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (1, 4)])
    for k, want in ((6, {(0, 0), (0, 1), (0, 2), (1, 1), (1, 2)}), (2, {(1, 1), (1, 2)})):
        assert {tuple(r) for r in search.carve(e, ids(spark, [0, 1]), ids(spark, [3]), k).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(25), r.randrange(25)) for _ in range(45)}
    start = r.sample(range(25), 3)
    level, seen = set(start), dict.fromkeys(start, 0)
    for h in range(1, 5):
        level = {b for a, b in pairs if a in level and b not in seen}
        seen |= dict.fromkeys(level, h)
    assert hops(search.bfs(edges(spark, sorted(pairs)), ids(spark, start), 4)) == seen


def test_exit_paths(spark):
    m = members(spark, [(0, "licit", [0]), (1, "licit", [4])])
    for k, want in ((6, {0: [0, 1, 2, 3], 1: []}), (2, {0: [], 1: []})):
        assert {r["pos"]: r["path"] for r in search.exit_paths(edges(spark, [*CHAIN, (4, 5)]), m, ids(spark, [3]), k).collect()} == want


def test_endpoints(spark):
    x = spark.createDataFrame([(i, float(i)) for i in range(10)], "idx long, endpoint_score double")
    assert {r["idx"] for r in search.endpoints(x, q=0.8).collect()} == {8, 9}


def test_borders(spark):
    m = members(spark, [(0, "licit", [0, 1])])
    got = search.border_sets(edges(spark, [(2, 0), (1, 3), (0, 1)]), m)
    assert {tuple(r) for r in got.collect()} == {(0, "sender", 2), (0, "receiver", 3)}
    star = search.border_sets(edges(spark, [(i, 0) for i in range(5, 205)]), m)
    assert search.border_sets_capped(star, 32).count() == 32
    x = search.internal_edges(edges(spark, [(0, 1, 5.0), (1, 2, 6.0), (2, 3, 7.0)]), members(spark, [(0, "licit", [0, 1]), (1, "licit", [2, 3])]))
    assert sorted((r["pos"], r["src"], r["dst"]) for r in x.collect()) == [(0, 0, 1), (1, 2, 3)]


def test_sampling(spark):
    e = edges(spark, [(i, 0) for i in range(1, 30)] + [(100 + i, i) for i in range(1, 30)])
    got = search.neighbor_sample(e, ids(spark, [0]), (5, 2)).collect()
    first = {r["src"] for r in got if r["hop"] == 1}
    assert len(first) == 5 and {r["dst"] for r in got if r["hop"] == 2} == first
    b = search.seed_batches(ids(spark, [*range(10), 3]), 4).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [2, 4, 4]


def test_convolution(spark):
    x = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "idx long, x array<double>")
    eye = np.eye(2)
    got = {r["idx"]: r["x"] for r in search.ego_neighbor_conv(x, edges(spark, [(0, 2), (1, 2), (2, 2)]), eye, 10 * eye).collect()}
    assert got == {0: [1, 2], 1: [3, 4], 2: [25, 36]}
    out = search.encode(x, edges(spark, [(0, 2)]), [(eye, eye), (-eye, eye)], normalize=True).collect()
    assert all(abs(sum(v * v for v in r["x"]) - 1) < 1e-9 for r in out)


def scored(spark, scores):
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "idx long, score double")


def signals(spark, values):
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(values)], "idx long, signal double")


def test_discover(spark):
    e = edges(spark, [(0, 7), (3, 6), (6, 7), (2, 4), (4, 7)])
    s, t = scored(spark, [0.9, 0.85, 0.8, 0.95, 0.1, 0.2, 0.15, 0]), signals(spark, [0.9, 0.9, 0.1, 0.8, 0, 0, 0, 0])
    rank = lambda **k: [r["idx"] for r in discovery.discover(s, e, ids(spark, [7]), t, threshold=0.5, **k).orderBy("rank").collect()]
    assert rank(q=0.5) == [3, 0] and rank(q=0.5, max_hops=1) == [0] and rank(q=0.99) == [3]


def test_discover_background(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 9), (3, 4), (4, 9), (5, 6), (6, 9)])
    s = scored(spark, [0.9 if i in (0, 3, 5, 7) else 0.0 for i in range(10)])
    t = signals(spark, [1 if i == 0 else 0 for i in range(10)])
    known = ids(spark, [5, 6])
    assert discovery.gate1(s, known, 0.7).count() == 3
    got = discovery.discover_background(s, e, ids(spark, [9]), t, known, q=0.7, threshold=0.5).collect()
    assert [(r["ccId"], r["member_idx"], r["ccLabel"], r["split"]) for r in got] == [("bg0", [0, 1, 2], "unknown", "discovered")]


def sets(spark, groups):
    return spark.createDataFrame([(g, i) for g, m in enumerate(groups) for i in (m or [None])], "id long, idx long")


def test_recovery(spark):
    r = evaluate.recovery(sets(spark, [[0, 1, 2], [2, 3]]), sets(spark, [[3, 4], [5, 6], [0]]), 10).first()
    assert (r["n_targets"], r["n_recovered"], r["union_size"]) == (3, 2, 4) and r["rate"] == pytest.approx(2 / 3)
    assert r["baseline"] == pytest.approx((2 / 3 + 2 / 3 + 0.4) / 3)
    assert evaluate.recovery(sets(spark, [[0, 1, 2, 3]]), sets(spark, [[0, 4]]), 5).first()["baseline"] == 1.0
    r = evaluate.recovery(sets(spark, [[0, 99]]), sets(spark, [[], [77]]), 5).first()
    assert (r["union_size"], r["rate"], r["baseline"], r["lift"]) == (1, 0.0, 0.0, 0.0)


def ap(scores, labels):
    total, out, tp, n = sum(labels), 0.0, 0, 0
    for _, g in itertools.groupby(sorted(zip(scores, labels, strict=True), reverse=True), key=lambda x: x[0]):
        g = list(g)
        n += len(g)
        hit = sum(x[1] for x in g)
        tp += hit
        out += hit / total * tp / n
    return out


def ranked(spark, scores, labels):
    return spark.createDataFrame(list(zip(map(float, scores), labels, strict=True)), "score double, label int")


def test_average_precision(spark):
    get = lambda s, y: evaluate.pr_auc(ranked(spark, s, y)).first()[0]
    assert get([0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0]) == pytest.approx(5 / 6) and get([1, 1, 1, 1], [1, 0, 1, 0]) == pytest.approx(0.5)
    r = random.Random(5)
    s, y = [r.randrange(12) / 10 for _ in range(80)], [r.randrange(2) for _ in range(80)]
    assert get(s, y) == pytest.approx(ap(s, y))
    with pytest.raises(ValueError):
        get([0.1], [0])


def test_thresholded(spark):
    r = evaluate.pu_metrics(ranked(spark, [1, 0, 1, 1, 0], [1, 0, 1, 0, 1])).first()
    assert (r["f1"], r["recall"], r["lee_liu"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(20 / 27))
    r = evaluate.pu_metrics(ranked(spark, [0, 0], [0, 0])).first()
    assert (r["f1"], r["recall"], r["lee_liu"]) == (0, 0, 0)


def risk(spark, pos, unl, prior, **k):
    x = spark.createDataFrame([(float(z), True) for z in pos] + [(float(z), False) for z in unl], "z double, is_positive boolean")
    return evaluate.nnpu_risk(x, prior, **k).first()


def test_nnpu(spark):
    s = lambda z: 1 / (1 + np.exp(-np.asarray(z, float)))
    r = risk(spark, [2, 3], [-2, -1, 0, 1], 0.3)
    pos, neg = 0.3 * s([-2, -3]).mean(), s([-2, -1, 0, 1]).mean() - 0.3 * s([2, 3]).mean()
    assert not r["clamped"] and r["nnpu_risk"] == pytest.approx(pos + neg) == pytest.approx(r["surrogate"])
    r = risk(spark, [8, 9], [-8, -9], 0.5)
    assert r["clamped"] and r["nnpu_risk"] == pytest.approx(r["positive_risk"]) and r["surrogate"] == pytest.approx(-r["negative_risk"])
    assert risk(spark, [8, 9], [-8, -9], 0.5, beta=0.1)["nnpu_risk"] == pytest.approx(r["positive_risk"] - 0.1)
    with pytest.raises(ValueError):
        risk(spark, [1], [1], 1.0)


def test_tice(spark):
    r = random.Random(2)
    rows = [(x, x > 0.8 and r.random() < 0.5) for x in (r.random() for _ in range(600))]
    t = evaluate.tice_prior(spark.createDataFrame(rows, "x double, labeled boolean"), ["x"], max_depth=3).first()
    assert 0.15 < t["prior"] < 0.35 and t["n_total"] == 600
    with pytest.raises(ValueError):
        evaluate.tice_prior(spark.createDataFrame([(1.0, False)], "x double, labeled boolean"), ["x"])


def halved(rows, depth, least):
    """Size and labelled rows of every subdomain, for rows (features, labeled)."""
    out = [(len(rows), sum(y for *_, y in rows))]
    if not depth or len(rows) < 2 * least:
        return out
    best = None
    for f in range(len(rows[0]) - 1):
        t = float(np.quantile([r[f] for r in rows], 0.5))
        low, high = [r for r in rows if r[f] <= t], [r for r in rows if r[f] > t]
        if len(low) < least or len(high) < least:
            continue
        for side in (low, high):
            share = sum(y for *_, y in side) / len(side)
            if best is None or share > best[0]:
                best = share, low, high
    for side in best[1:] if best else ():
        out += halved(side, depth - 1, least)
    return out


def test_tice_against_brute_force(spark):
    r = random.Random(8)
    rows = [(round(x, 2), y, x > 0.7 and y < 3 and r.random() < 0.6) for x, y in ((r.random(), float(r.randrange(6))) for _ in range(150))]
    t = evaluate.tice_prior(spark.createDataFrame(rows, "a double, b double, labeled boolean"), ["a", "b"]).first()
    want = halved(rows, 4, 5)
    best = max(y / n for n, y in want)
    assert t["n_subdomains"] == len(want) and t["label_frequency"] == pytest.approx(best)
    assert t["prior"] == pytest.approx(min(1, sum(y for *_, y in rows) / 150 / best))


def test_hubs_against_brute_force(spark):
    r = random.Random(11)
    pairs = {(r.randrange(20), r.randrange(20)) for _ in range(60)}
    hub, start = {3, 4, 5}, {0, 3}
    level, seen = set(start), dict.fromkeys(start, 0)
    for h in range(1, 7):
        level = {b for a, b in pairs if a in level and (h == 1 or a not in hub) and b not in seen}
        seen |= dict.fromkeys(level, h)
    assert hops(search.bfs(edges(spark, sorted(pairs)), ids(spark, start), 6, hub=ids(spark, hub))) == seen


def test_prior_grid(spark):
    assert sorted(r[0] for r in evaluate.prior_grid(spark, include=0.5).collect()) == pytest.approx([1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 0.5])
