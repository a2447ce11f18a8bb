import numpy as np

from ledgerloom.llm import ann

from .helpers import small


def brute(ids, x, k=20):
    out = {}
    for i, a in enumerate(ids):
        if a % 20 == 0:
            s = x @ x[i]
            rest = [j for j in range(len(ids)) if j != i]
            out[a] = sorted(rest, key=lambda j: (-s[j], ids[j]))[:k], s
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 700)
    monkeypatch.setattr(ann, "QUERIES", 40)
    r = np.random.default_rng(2)
    x = (r.standard_normal((2000, 48)) + 2 * r.standard_normal((5, 48))[r.integers(0, 5, 2000)]).astype(np.float32)
    got = ann.nearest(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()
    want = brute(np.arange(2000), x.astype(float))
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append(g)
    assert set(by) == set(want)
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda g: g["rank"])
        assert [g["rank"] for g in rows] == list(range(1, 21))
        top, s = want[q]
        assert all(abs(g["score"] - s[g["vec_id"]]) < 1e-9 for g in rows)
        assert all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:], strict=False))
        hits += len({g["vec_id"] for g in rows} & set(top))
    assert hits / (20 * len(by)) >= 0.95


def test_small_table(spark):
    table = small(spark, "embeddings")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    want = brute(ids, x)
    found = {}
    for g in ann.nearest(table).collect():
        found.setdefault(g["query_id"], set()).add(g["vec_id"])
    assert np.mean([len(found[q] & {ids[j] for j in top}) / len(top) for q, (top, _) in want.items()]) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (1, [0.5, 0.5], 1), (40, None, 1)]
    got = ann.nearest(vectors(spark, rows)).collect()
    by = {(g["query_id"], g["rank"]): g["vec_id"] for g in got}
    assert by == {(0, 1): 20, (0, 2): 1, (0, 3): 2, (20, 1): 0, (20, 2): 1, (20, 3): 2}
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert ann.nearest(vectors(spark, [(20, [1.0], 0)])).count() == 0


def test_equal_vectors_give_the_smallest_ids(spark):
    got = ann.nearest(vectors(spark, [(i, [0.6, 0.8], 0) for i in range(1, 300)])).collect()
    assert sorted(g["vec_id"] for g in got if g["query_id"] == 20) == [*range(1, 20), 21]
