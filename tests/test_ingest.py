import pytest

from ledgerloom.operators import ingest, labels
from ledgerloom.sources import raw


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.createDataFrame([(f"n{i:04d}", float(i * 100)) for i in range(49, -1, -1)], "orig_id string, f0 double")
    edges = [(f"n{i:04d}", f"n{(i + 1) % 50:04d}") for i in range(50)] + [("n0000", "n0010"), ("n0005", "n0020"), ("n0007", "n0030"), ("n0001", "missing")]
    comps = spark.createDataFrame([("S0", "suspicious"), ("S1", "suspicious"), ("L0", "licit"), ("L1", "licit"), ("L2", "licit")], "ccId string, ccLabel string")
    members = [("n0000", "S0"), ("n0001", "S0"), ("n0002", "S0"), ("n0010", "S1"), ("n0011", "S1"), ("n0020", "L0"), ("n0021", "L0"), ("gone", "L1"), ("n0030", "nogroup")]
    return nodes, spark.createDataFrame(edges, "clId1 string, clId2 string"), comps, spark.createDataFrame(members, "clId string, ccId string")


def test_ids_and_remap(spark, tables):
    nodes, edges, comps, members = tables
    ids = ingest.id_map(nodes)
    assert {r["orig_id"]: r["idx"] for r in ids.collect()} == {f"n{i:04d}": i for i in range(50)}
    assert all(r["f0"] == 100 * r["idx"] for r in ingest.remap_nodes(nodes, ids).collect())
    assert ingest.remap_edges(edges, ids).count() == 53
    assert tuple(ingest.dangling_edges(edges, ids).first()) == (54, 1)
    got = ingest.subgraphs(members, comps, ids).collect()
    assert {(r["pos"], r["ccId"]): r["member_idx"] for r in got} == {(0, "L0"): [20, 21], (1, "S0"): [0, 1, 2], (2, "S1"): [10, 11]}
    assert tuple(ingest.orphan_counts(members, comps, ids).first()) == (9, 1, 1)
    assert tuple(ingest.base_rate(comps).first()) == (5, 2, 3, 0.4)
    assert ingest.id_bijection(nodes).first()["is_bijection"] and not ingest.id_bijection(nodes.union(nodes)).first()["is_bijection"]
    with pytest.raises(ingest.GuardError):
        ingest.id_map(nodes.union(nodes), strict=True)


def test_overlap_takes_the_later_group(spark):
    m = spark.createDataFrame([(0, 5), (2, 5), (1, 6)], "pos long, idx long")
    assert {r["idx"]: r["pos"] for r in ingest.node_group(m).collect()} == {5: 2, 6: 1}


def test_resolve_column():
    assert ingest.resolve_column(["A", "clid"], "clId") == "clid" and ingest.resolve_column(["A", "B"], "x", 1) == "B"
    with pytest.raises(ValueError):
        ingest.resolve_column(["A"], "x", 3)


def test_validate(spark):
    n, e = spark.range(3).toDF("idx"), spark.createDataFrame([(0, 1, 1.0), (2, 2, -1.0), (0, 9, 1.0)], "src long, dst long, weight double")
    assert tuple(ingest.graph_validate(n, e).first()) == (3, 3, 1, 1, 1)


def test_components_file(spark, tmp_path):
    p = tmp_path / "connected_components.csv"
    p.write_text("ccId,ccLabel\n b , licit\na,suspicious\n")
    got = raw.read_components(spark, f"file://{p}").orderBy("row_id").collect()
    assert [(r["id"], r["label"]) for r in got] == [("b", "licit"), ("a", "suspicious")]
    assert raw.missing_files(spark, f"file://{tmp_path}", ["connected_components.csv", "no.csv"]) == ["no.csv"]
    with pytest.raises(FileNotFoundError):
        raw.require_files(spark, f"file://{tmp_path}")
    p.write_text("ccId,ccLabel\na,licit\na,licit\n")
    with pytest.raises(ingest.GuardError):
        raw.read_components(spark, f"file://{p}")


def groups(spark, n, positives):
    return spark.createDataFrame([(i, f"cc{i:06d}", "suspicious" if i * positives % n < positives else "licit") for i in range(n)], "row_id long, id string, label string")


def test_round_robin(spark):
    got = {r["split"]: r["n"] for r in labels.split_counts(labels.split_round_robin(groups(spark, 1000, 30))).collect()}
    assert got == {"train": 800, "val": 100, "test": 100}


def test_stratified(spark):
    x = labels.split_stratified(groups(spark, 1000, 30))
    counts = {r["split"]: (r["n"], r["n_positive"]) for r in labels.split_counts(x).collect()}
    assert counts == {"train": (800, 24), "val": (100, 3), "test": (100, 3)}
    labels.verify_split(x)
    a, b = (labels.split_hash(labels.split_stratified(groups(spark, 100, 30), seed=s)).first()[0] for s in (0, 1))
    assert a != b and a == labels.split_hash(labels.split_stratified(groups(spark, 100, 30))).first()[0]
    with pytest.raises(ingest.GuardError):
        labels.verify_split(x.union(x.where("split = 'test'").replace("test", "val", "split")))
    with pytest.raises(ingest.GuardError):
        labels.verify_split(labels.split_stratified(groups(spark, 100, 3)))


def test_fingerprint(spark):
    m = spark.createDataFrame([(i // 2, i) for i in range(6)], "pos long, idx long")
    x = spark.createDataFrame([(i, float(i), 1.0, float(i // 2)) for i in range(6)], "idx long, varying double, flat double, group double")
    got = {r["column"]: r["is_fingerprint"] for r in labels.membership_fingerprint(x, m, ["varying", "flat", "group"]).collect()}
    assert got == {"varying": False, "flat": False, "group": True}


def test_masked(spark):
    lab = spark.createDataFrame([(4, 2, "suspicious", True), (0, 0, "licit", False)], "idx long, pos long, label string, is_test boolean")
    for shown, want in ((0.0, (1, 0)), (0.5, (1, 1))):
        x = spark.createDataFrame([(4, shown), (0, 1.0)], "idx long, e double")
        assert tuple(labels.test_labels_masked(x, lab, ["e"]).first()) == want
