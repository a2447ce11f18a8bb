import itertools
import random

import pytest

from ledgerloom.llm import forest
from ledgerloom.llm.components import connected_components

from .helpers import documents, jaccard, prose, shingles, small, words


def brute(rows):
    """(links, class) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    seq = [tuple(words(t)) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if sets[a] and (seq[a] == seq[b] or jaccard(sets[a], sets[b]) >= 0.8):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return links, [min(groups[find(i)]) for i in range(n)]


def compare(spark, rows):
    got = {r["doc_id"]: r for r in forest.join_documents(documents(spark, rows)).collect()}
    links, classes = brute(rows)
    assert {i: got[i]["n_links"] for i, _ in rows} == {i: n for (i, _), n in zip(rows, links, strict=True)}
    assert {i: got[i]["class_id"] for i, _ in rows} == {i: c for (i, _), c in zip(rows, classes, strict=True)}


def edited(text, edits, seed):
    r = random.Random(seed)
    w = text.split()
    for i in r.sample(range(len(w)), edits):
        w[i] = f"zz{seed}x{i}"
    return " ".join(w)


def test_small_table(spark):
    compare(spark, [(r["doc_id"], r["text"]) for r in small(spark, "documents").collect()])


def test_near_copies_in_blocks(spark, monkeypatch):
    base = prose(1, 150)
    rows = [(i, edited(base, i % 5, i)) for i in range(60)] + [(100 + i, prose(50 + i, 120)) for i in range(40)]
    rows += [(200 + i, base) for i in range(20)]
    monkeypatch.setattr(forest, "BLOCK", 16)
    compare(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (5, "One, two!"), (None, "one two"), (6, prose(9, 60_000)), (7, "x" * 200_000)]
    got = forest.join_documents(documents(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["class_id"] == by[5]["class_id"] == by[None]["class_id"] == 4 and by[4]["n_copies"] == 4 and by[4]["n_links"] == 3
    assert all(by[i]["n_links"] == 0 and by[i]["class_id"] == i for i in (1, 2, 3, 6, 7))


def test_empty(spark):
    assert forest.join_documents(documents(spark, [])).count() == 0
    assert forest.one_of_each(documents(spark, [])).count() == 0


def test_one_of_each(spark):
    base = prose(2, 100)
    rows = [(5, base), (3, edited(base, 1, 8)), (3, edited(base, 1, 8)), (9, prose(3, 100)), (None, base), (10, None)]
    docs = documents(spark, rows, clash=True)
    got = forest.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["10", "3", "9", "None"]


def test_depth_meets_recall():
    d = forest.search_depth()
    assert 1 - (1 - 0.8**d) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** forest.TREES


@pytest.mark.parametrize("n", [2, 40, 300])
def test_components_of_chains(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(10_000, 10_001), (10_001, 10_000), (5, 5)] + [(20_000 + i, 20_000) for i in range(1, 50)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in got}
    assert len(root) == len(got)
    assert all(root[i] == 0 for i in range(n + 1)) and root[10_001] == 10_000 and all(root[20_000 + i] == 20_000 for i in range(50))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_candidates_among_a_large_family(spark):
    """One prefix in all trees, 2,500 sketches: each node's only near one is anywhere in node order."""
    r = random.Random(3)
    n = 1250
    sketch = [(r.getrandbits(64) - 2**63, r.getrandbits(64) - 2**63) for _ in range(n)]
    ids = r.sample(range(1, 10**6), 2 * n)
    rows = [(ids[i], [7] * forest.TREES, *sketch[i % n]) for i in range(2 * n)]
    links = forest.candidate_links(spark.createDataFrame(rows, "node long, labels array<long>, s0 long, s1 long")).collect()
    assert {(x["b"], x["a"]) for x in links} == {tuple(sorted((ids[i], ids[i + n]))) for i in range(n)}
