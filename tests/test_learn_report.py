import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import verdicts
from ledgerloom.operators import gnn, ingest, learn, report, search
from ledgerloom.streaming import aggregates

from .test_features import edges, members, splits


def test_pools(spark):
    m = members(spark, [(0, "licit", [0, 1]), (1, "licit", [2])])
    x = spark.createDataFrame([(0, 1.0), (1, 3.0)], "idx long, f double")
    got = {r["pos"]: (r["mean__f"], r["max__f"], r["min__f"], r["std__f"], r["sum__f"]) for r in learn.subgraph_pool(m, x, ["f"]).collect()}
    assert got == {0: (2, 3, 1, 1, 4), 1: (0, 0, 0, 0, 0)}
    s = spark.createDataFrame([(0, 0.1), (1, 0.9), (2, float("nan"))], "idx long, score double")
    assert {r["pos"]: r["score"] for r in learn.mil_max_pool(m, s).collect()} == {0: 0.9, 1: 0.0}


def test_standardize(spark):
    x = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in learn.standardize(x, ["a", "b"]).collect()] == [(-1, 0), (1, 0)]
    w = learn.class_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")).groupBy("label").agg(F.max("weight"))
    assert dict(map(tuple, w.collect())) == {1: 3.0, 0: 1.0}


@pytest.fixture(scope="module")
def separable(spark):
    """60 groups of two members with two senders each, shifted by the label."""
    r, feats, e, groups, split = np.random.default_rng(0), [], [], [], []
    for k in range(60):
        y = k % 2
        a, b, s, t = range(4 * k, 4 * k + 4)
        groups.append((k, "suspicious" if y else "licit", [a, b]))
        e += [(s, a), (t, b), (a, b)]
        split.append((f"g{k}", groups[-1][1], "train" if k % 10 < 6 else "test"))
        feats += [(n, *(float(v) for v in r.standard_normal(2) + (3 if y else -3) * (n in (s, t)))) for n in (a, b, s, t)]
    return members(spark, groups), edges(spark, e), spark.createDataFrame(feats, "idx long, f0 double, f1 double"), splits(spark, split)


def test_deep_sets(spark, separable):
    m, e, x, s = separable
    rows = learn.set_batch(m, search.border_sets(e, m), x, ["f0", "f1"])
    y = m.select("pos", "ccId", (F.col("ccLabel") == "suspicious").cast("int").alias("label")).distinct().join(s.select(F.col("id").alias("ccId"), "split"), "ccId")
    fit = lambda k: k.fit(rows, y.where("split = 'train'"))
    judge = lambda k: -k.losses[-1]
    model = learn.best_of(lambda seed: learn.DeepSets(["f0", "f1"], hidden=6, seed=seed, epochs=80), [0, 1], fit, judge)
    assert model.losses[-1] < 0.2 < model.losses[0]
    got = model.score(rows).join(y.where("split = 'test'"), "pos").groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    by = {r["label"]: r for r in got}
    assert by[1]["lo"] > by[0]["hi"]


def test_deep_sets_gradients():
    """Against finite differences."""
    r = np.random.default_rng(3)
    m = learn.DeepSets(["a", "b"], hidden=4, seed=1)
    sets = {k: (r.standard_normal((9, 2)), np.sort(r.integers(0, 4, 9))) for k in m.ROLES}
    y, w = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])
    _, g = m._gradients(sets, y, w)
    for k in m.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m.w[k][at]
        loss = []
        for d in (1e-6, -1e-6):
            m.w[k][at] = old + d
            loss.append(m._gradients(sets, y, w)[0])
        m.w[k][at] = old
        assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-3, abs=1e-7)


def test_trees(spark, separable):
    m, e, x, s = separable
    border = search.border_sets(e, m).select("pos", F.lit("g").alias("ccId"), F.lit("licit").alias("ccLabel"), "idx")
    pooled = learn.subgraph_pool(border, x, ["f0"]).join(m.select("pos", "ccId", "ccLabel").distinct(), "pos").join(s.select(F.col("id").alias("ccId"), "split"), "ccId")
    pooled = pooled.withColumn("label", (F.col("ccLabel") == "suspicious").cast("int"))
    model = learn.TreeScorer(["mean__f0", "max__f0"], max_iter=5, max_depth=2)
    with pytest.raises(ingest.GuardError):
        model.score(pooled)
    model.make = lambda make=model.make: make().setMinInstancesPerNode(1)
    got = model.fit(pooled.where("split = 'train'")).score(pooled.where("split = 'test'"))
    assert got.where("(score > 0.5) <> (label = 1)").isEmpty()
    with pytest.raises(ingest.GuardError):
        model.score(pooled.drop("max__f0"))


def graph(spark, rows):
    g = spark.createDataFrame([(p, a, b) for p, e in enumerate(rows) for a, b in e], "pos long, src long, dst long")
    n = g.select("pos", F.explode(F.array("src", "dst")).alias("idx")).distinct()
    return g, n


def test_typology(spark):
    rows = [[(0, 1), (1, 2), (2, 3)], [(1, 0), (2, 0), (3, 0)], [(0, 1), (0, 2), (0, 3)], [(1, 0), (2, 0), (0, 3), (0, 4)]]
    s = report.structural_signals(*graph(spark, rows))
    names = ["peeling_chain", "consolidation", "layering_smurfing", "nested_service"]
    assert [r["structural"] for r in report.typology(s).orderBy("pos").collect()] == names
    got = [(r["typology"], r["confidence"]) for r in report.typology_heuristic(s).orderBy("pos").collect()]
    assert got == list(zip(names, [0.7, 0.75, 0.75, 0.8], strict=True))
    claims = spark.createDataFrame([(0, "a", None), (1, "a", "a"), (2, "a", "b")], "pos long, claimed string, structural string")
    for override, last in ((True, "b"), (False, "a")):
        got = [(r["agrees"], r["flagged"], r["final"]) for r in report.typology_validate(claims, override).orderBy("pos").collect()]
        assert got == [(True, False, "a"), (True, False, "a"), (False, True, last)]


def test_leads(spark):
    s = spark.createDataFrame([(0, "a", 0.9), (1, "b", 0.1), (2, "c", 0.5)], "pos long, ccId string, score double")
    got = report.rank_leads(s).collect()
    assert [r["ccId"] for r in got] == ["a", "c", "b"] and got[0]["percentile"] == 1.0
    m = members(spark, [(0, "licit", [0, 1])])
    nodes, inner = report.lead_graph(edges(spark, [(6, 0), (1, 7), (0, 1), (8, 2), (4, 5)]), m)
    assert {r["idx"]: r["role"] for r in nodes.collect()} == {0: "internal", 1: "internal", 6: "sender", 7: "receiver"}
    assert {(r["src"], r["dst"]) for r in inner.collect()} == {(6, 0), (1, 7), (0, 1)}
    y = {(r["idx"], r["x"]): r["y"] for r in report.lead_layout(nodes).collect()}
    assert y == {(0, 0.0): 1, (1, 0.0): -1, (6, -1.0): 0, (7, 1.0): 0}
    assert report.local_exit_path(nodes, inner).first()["path"] == [0, 1, 7]
    r = report.lead_stats(nodes, inner).first()
    assert tuple(r) == (0, 2, 1, 1, 3, 1, 1)


def test_local_exit_path_of_any_length(spark):
    nodes = spark.createDataFrame([(0, i, "internal") for i in range(9)] + [(0, 9, "receiver"), (1, 20, "internal"), (2, 30, "internal"), (2, 31, "receiver")], "pos long, idx long, role string")
    chain = [(0, i, i + 1) for i in range(9)] + [(0, 5, 2), (0, 0, 4), (1, 20, 20), (2, 31, 30)]
    graph = spark.createDataFrame(chain, "pos long, src long, dst long")
    got = {r["pos"]: r["path"] for r in report.local_exit_path(nodes, graph).collect()}
    assert got == {0: [0, 4, 5, 6, 7, 8, 9], 1: [], 2: []}
    assert {r["pos"]: r["path"] for r in report.local_exit_path(nodes, graph, 5).collect()}[0] == []


@pytest.fixture(scope="module")
def chains(spark):
    """Chains of five nodes; the nodes of every other chain are shifted."""
    r = np.random.default_rng(1)
    x = [(5 * c + i, [float(v) for v in r.standard_normal(2) + (3 if c % 2 else -3)]) for c in range(12) for i in range(5)]
    e = [(5 * c + i, 5 * c + i + 1) for c in range(12) for i in range(4)]
    return spark.createDataFrame(x, "idx long, x array<double>"), edges(spark, e)


def test_graph_scorer(spark, chains):
    x, e = chains
    known = spark.createDataFrame([(n,) for c in (1, 3, 5) for n in range(5 * c, 5 * c + 5)], "idx long")
    model = gnn.GraphScorer(2, hidden=(8, 4), epochs=60, batch=32, seed=2).fit(x, e, known, 0.5)
    assert model.losses[-1] < model.losses[0]
    score = {r["idx"]: r["score"] for r in model.score(x, e).collect()}
    assert len(score) == 60
    unseen = (7, 9, 11)
    assert min(score[5 * c + i] for c in unseen for i in range(5)) > max(score[5 * c + i] for c in range(0, 12, 2) for i in range(5))
    with pytest.raises(ingest.GuardError):
        model.score(spark.createDataFrame([(0, [1.0])], "idx long, x array<double>"), e)
    with pytest.raises(ingest.GuardError):
        gnn.GraphScorer(2).fit(x, e, known.where("idx < 0"), 0.5)


@pytest.mark.parametrize("gamma", [1.0, 0.5])
@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_graph_scorer_gradients(gamma, shift):
    """Against finite differences, with the risk as it is and clamped."""
    r = np.random.default_rng(4)
    m = gnn.GraphScorer(3, hidden=(5, 4), seed=3, gamma=gamma)
    x, src, dst = r.standard_normal((9, 3)), r.integers(0, 9, 14), r.integers(0, 9, 14)
    rows, yes, prior = np.arange(6), np.array([1, 1, 0, 0, 0, 0], dtype=bool), 0.6
    m.bias[0] = -shift
    m.head *= 1 + shift

    def risk():
        s = 1 / (1 + np.exp(-m._forward(x, src, dst)[0][rows]))
        pos, neg = prior * (1 - s[yes]).mean(), s[~yes].mean() - prior * s[yes].mean()
        return -gamma * neg if neg < 0 else pos + neg

    _, grads = m._gradients(x, src, dst, rows, yes, prior)
    for w, g in zip(m._weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, values = w[at], []
        for d in (1e-6, -1e-6):
            w[at] = old + d
            values.append(risk())
        w[at] = old
        assert g[at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-3, abs=1e-8)


def test_prior_of_a_bounded_draw(spark):
    x = spark.range(3000).selectExpr("id as idx", "id / 3000D as f")
    yes = x.where("f > 0.8 and idx % 2 = 0").select("idx")
    whole, part = (gnn.estimate_prior(x, yes, ["f"], most=n).first() for n in (5000, 1000))
    assert whole["n_total"] == 3000 and 900 < part["n_total"] - part["n_labeled"] < 1100 and part["n_labeled"] == whole["n_labeled"] == yes.count()
    assert 0.15 < whole["prior"] < 0.25


def test_bins_and_ids(spark):
    x = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 5.0, 1.0), (0, 2, 10.0, 1.0)], "pos long, idx long, a double, b double")
    assert [(r["a"], r["b"]) for r in report.bin_features(x, ["a", "b"]).orderBy("idx").collect()] == [(0, 0), (5, 0), (9, 0)]
    g = spark.createDataFrame([(3, "17"), (4, "bg1")], "pos long, ccId string")
    assert [r["subgraph_id"] for r in report.subgraph_int_id(g).orderBy("pos").collect()] == [17, 4]


DOC = {
    "subgraph_id": 5, "pu_score": 0.12345678, "nodes": [{"id": i, "role": "internal", "bins": [i]} for i in (3, 1, 2, 4)],
    "edges": [{"s": 1, "t": 2}, {"s": 2, "t": 3, "weight": 9}, {"s": 3, "t": 4}], "exit_paths": [[3, 4]], "stats": {"n": 4, "z": -0.0},
}


def test_encoding():
    text = report.encode_document(DOC)
    x = json.loads(text)
    assert text == report.encode_document(DOC) and x["pu_score"] == 0.123457 and not x["truncated"] and [n["id"] for n in x["nodes"]] == [1, 2, 3, 4]
    last = len(text)
    for budget in range(len(text) - 1, 150, -25):
        try:
            cut = report.encode_document(DOC, budget)
        except ValueError:
            break
        x = json.loads(cut)
        assert len(cut) <= min(budget, last + 1) and x["truncated"]
        assert {3, 4} <= {n["id"] for n in x["nodes"]} or x["n_nodes"] < 2
        last = len(cut)
    with pytest.raises(ValueError):
        report.encode_document(DOC, 10)


def test_documents_and_cards(spark):
    m = members(spark, [(0, "suspicious", [0, 1])])
    e = edges(spark, [(6, 0), (1, 7), (0, 1), (7, 8)])
    nodes, g = report.lead_graph(e, m)
    leads = report.rank_leads(spark.createDataFrame([(0, "x", 0.5)], "pos long, ccId string, score double"))
    paths = search.exit_paths(e, m, spark.createDataFrame([(8,)], "idx long"))
    bins = nodes.select("pos", "idx", F.lit(1).alias("f"))
    docs = report.candidate_docs(leads, nodes, g, bins, ["f"], paths)
    r = docs.first()
    assert {n["id"]: n["role"] for n in r["nodes"]}[8] == "endpoint" and r["exit_paths"] == [[1, 7, 8]] and len(r["edges"]) == 4
    x = json.loads(report.serialize(docs).first()["json"])
    assert x["n_nodes"] == 5 and x["exit_paths"] == [[1, 7, 8]]
    card = report.cards(docs, leads).first()["card"]
    assert "# Suspicious group 0" in card and "- 1 -> 7 -> 8" in card and all(c in card for c in report.CAVEATS)


def test_verdicts(spark):
    good = '{"typology": "a", "confidence": "1.7", "rationale": "r", "evidence": ["x", "y"]}'
    rows = [f"```json\n{good}\n```", f"Here: {good} done", good.replace('["x", "y"]', '"one"'), good.replace('"rationale"', '"other"'), good.replace('"1.7"', '"high"'), "none", None]
    got = [r["v"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(verdicts.verdict(F.col("t")).alias("v")).collect()]
    assert [tuple(v) if v else None for v in got] == [("a", 1.0, "r", ["x", "y"])] * 2 + [("a", 1.0, "r", ["one"])] + [None] * 4
    blocks = spark.range(1).select(verdicts.message_text(F.expr("array(named_struct('text', 'a'), named_struct('text', cast(null as string)), named_struct('text', 'b'))")))
    assert blocks.first()[0] == "ab"


def test_streaming_degree(spark, tmp_path):
    from ledgerloom.operators import features

    e = edges(spark, [(0, 1, 2.0), (0, 2, 3.0), (1, 1, 1.0)])
    e.select("src", "dst", "weight").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long, weight double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = aggregates.streaming_degree(stream).writeStream.format("memory").queryName("deg").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["idx"]: (r["in_degree"], r["out_degree"]) for r in spark.table("deg").collect()}
    want = {r["idx"]: (r["in_degree"], r["out_degree"]) for r in features.degree(spark.range(3).toDF("idx"), e).collect()}
    assert got == want
