import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import sharding

from .helpers import documents, prose, small


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in by)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    return {s: sum(r["size"] for r in part) for s, part in by.items()}


def test_differencing_classic():
    got = sharding.differencing(np.array([8, 7, 6, 5, 4]), 2)
    sums = sorted(np.bincount(got, weights=[8, 7, 6, 5, 4]))
    assert sums == [14, 16]


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 3), (5, 40), (300, 7), (1000, 40), (10, 1)])
def test_differencing_places_everything(n, k):
    sizes = np.sort(np.random.default_rng(n).integers(1, 1000, n))[::-1]
    got = sharding.differencing(sizes, k)
    assert len(got) == n and (n == 0 or (0 <= got.min() and got.max() < k))
    if n >= 20 * k:
        sums = np.bincount(got, weights=sizes, minlength=k)
        assert sums.max() - sums.min() <= sizes.min() + 20


def test_differencing_beats_greedy():
    r = np.random.default_rng(1)
    sizes = np.sort(r.integers(1000, 100000, 400))[::-1]
    sums = np.bincount(sharding.differencing(sizes, 10), weights=sizes, minlength=10)
    greedy = np.zeros(10)
    for s in sizes:
        greedy[greedy.argmin()] += s
    assert sums.max() - sums.min() < greedy.max() - greedy.min()


def test_documents(spark):
    docs = small(spark, "documents")
    rows = sharding.shard_documents(docs, 8).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sums = check(rows, 8)
    assert len(rows) == len(text) and max(sums.values()) <= 1.02 * min(sums.values())
    at = {}
    for r in rows:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert at.setdefault(t, r["shard"]) == r["shard"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, None), (4, "x" * 100_000), (5, "é")]
    got = sharding.shard_documents(documents(spark, rows, clash=True), 3).collect()
    check(got, 3)
    size = sorted((r["doc_id"] or 0, r["size"]) for r in got)
    assert size == sorted([(1, 16), (2, 16), (3, 17), (3, 17), (0, 17), (0, 16), (4, 100_016), (5, 18)])
    assert len({r["shard"] for r in got if r["size"] == 17}) == 1 and len({r["shard"] for r in got if r["size"] == 16}) == 1


def test_empty(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_rounds(spark, monkeypatch):
    for name, value in (("HEAVY", 200), ("CHANGE", 100), ("CHUNK", 300), ("BUNDLES", 20)):
        monkeypatch.setattr(sharding, name, value)
    r = random.Random(3)
    sizes = [(i, r.randint(20, 400) if i % 50 else 5000) for i in range(4000)]
    groups = spark.createDataFrame(sizes, "item long, bytes long")
    got = {x["item"]: x["shard"] for x in sharding.assign_groups(groups, 10, final=500).collect()}
    assert set(got) == {i for i, _ in sizes}
    sums = np.zeros(10)
    for i, s in sizes:
        sums[got[i]] += s
    assert sums.max() - sums.min() <= 200


def test_hot_group_is_whole(spark):
    rows = [(i, "same text " * 30) for i in range(200)] + [(1000 + i, prose(i, 40)) for i in range(300)]
    got = sharding.shard_documents(documents(spark, rows), 4).collect()
    sums = check(got, 4)
    hot = {r["shard"] for r in got if r["doc_id"] < 1000}
    rest = [v for s, v in sums.items() if s not in hot]
    assert len(hot) == 1 and max(rest) - min(rest) < 300
