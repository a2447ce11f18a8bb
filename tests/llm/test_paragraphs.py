import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import paragraphs, textscan
from ledgerloom.llm.components import connected_components, local_components

from .helpers import documents, jaccard, prose, shingles, small, words


def found(spark, rows, **k):
    return paragraphs.repeated_passages(documents(spark, rows, **k)).collect()


def planted(n=120):
    """Passages of 60 words inside the lines of 30 documents, three documents each."""
    rows = []
    for i in range(n):
        w = prose(i, 150).split()
        if i < 30:
            at = 20 + 3 * i
            w = w[:at] + prose(1000 + i // 3, 60).split() + w[at:]
        rows.append((i, " ".join(w)))
    return rows


def test_planted_passages(spark):
    """A passage of 60 words nearly always holds a paragraph of its own; documents without one are never reported."""
    got = found(spark, planted())
    docs = {r["doc_id"] for r in got}
    assert docs <= set(range(30)) and len(docs) >= 28
    assert all(r["first_doc_id"] // 3 == r["doc_id"] // 3 and r["removed"] == (r["first_doc_id"] != r["doc_id"]) for r in got)


def test_spans_are_in_the_passage(spark):
    rows = planted(60)
    text = dict(rows)
    for r in found(spark, rows):
        span = words(text[r["doc_id"]][r["start"] : r["end"]])
        passage = set(words(prose(1000 + r["doc_id"] // 3, 60)))
        assert len(span) == r["n_words"] >= 16 and sum(w not in passage for w in span) <= 0.1 * len(span)


def test_documents_that_share_51_words(spark):
    docs = {r["doc_id"]: r["text"] for r in small(spark, "documents").collect()}
    holders = {}
    for i, t in docs.items():
        w = words(t)
        for j in range(len(w) - 50):
            holders.setdefault(tuple(w[j : j + 51]), set()).add(i)
    must = set().union(*(v for v in holders.values() if len(v) > 1))
    got = {r["doc_id"] for r in paragraphs.repeated_passages(small(spark, "documents")).collect()}
    assert len(must - got) <= 0.03 * len(must)


def test_near_paragraphs(spark):
    base = [prose(i, 30) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, "lead " + t + " tail") for i, t in enumerate(base)]
    assert len({r["doc_id"] for r in found(spark, rows) if r["removed"] and r["doc_id"] >= 100}) >= 34


def test_odd_rows(spark):
    same = prose(7, 80)
    rows = [(1, None), (2, ""), (3, same), (3, same), (None, same), (4, prose(8, 50) + "\n" + same), (5, "on he " * 30_000), (6, "é " + same.upper()), (7, "a b c")]
    got = found(spark, rows, clash=True)
    assert {r["doc_id"] for r in got} == {3, 4, 6, None}
    assert all(r["removed"] == (r["doc_id"] != 3) for r in got)
    assert paragraphs.repeated_passages(documents(spark, [])).count() == 0


def test_removal(spark):
    rows = planted(30)
    got = {r["doc_id"]: r["text"] for r in paragraphs.remove_passages(documents(spark, rows)).collect()}
    gone = {}
    for r in found(spark, rows):
        if r["removed"]:
            gone[r["doc_id"]] = gone.get(r["doc_id"], 0) + r["end"] - r["start"]
    assert {i: len(t) - len(got[i]) for i, t in rows} == {i: gone.get(i, 0) for i, _ in rows}


def test_repeating_text_is_cut(spark):
    units = paragraphs.paragraphs(documents(spark, [(1, "is on " * 500)]))
    assert units.agg(F.max("n_words")).first()[0] <= paragraphs.MAX_PARAGRAPH


@pytest.mark.parametrize("recall", [0.9, 0.95, 0.99])
def test_bands_meet_recall(recall):
    b, r = paragraphs.bands(0.8, recall)
    assert 1 - (1 - 0.8**r) ** b >= recall


def uncut(text):
    w = textscan.Words([text])
    return len(paragraphs.cut(w, np.zeros(len(w.hash), dtype=bool))[0]) == 1


def test_pairs_that_share_a_common_phrase(spark):
    """All paragraphs hold the same 12 words, which most band keys are made of; each is similar to one other only."""
    phrase, rows = prose(5000, 12), []
    for seed in itertools.count():
        a = prose(6000 + seed, 3) + " " + phrase + " " + prose(9000 + seed, 3)
        b = a.replace(".", "") + " " + prose(12_000 + seed, 1)
        if uncut(a) and uncut(b):
            rows += [(len(rows), a), (len(rows) + 1, b)]
        if len(rows) == 120:
            break
    pairs = {r["first_doc_id"] // 2 for r in found(spark, rows) if r["removed"] and r["doc_id"] // 2 == r["first_doc_id"] // 2}
    assert len(pairs) >= 54


def test_similar_nodes_against_all_pairs(spark):
    phrase, texts = prose(1, 9).split(), []
    for i in range(60):
        w = prose(100 + i, i % 4).split() + phrase + prose(200 + i, 2 + i % 29).split()
        texts += [" ".join(w), " ".join([*w, "tail"]), " ".join(w[1:]), " ".join([*w[:-1], "other", "end"])]
    sets = [shingles(t) for t in texts]
    close = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    want = local_components(*np.array(close).T)
    got = connected_components(paragraphs.similar_nodes(spark.createDataFrame(list(enumerate(texts)), "node long, t string"))).collect()
    assert {r["node"]: r["root"] for r in got} == dict(zip(*(x.tolist() for x in want), strict=True))


@pytest.mark.parametrize("per", [1, 3, 4, 5, 7, 8])
def test_passages_in_short_lines(spark, per):
    def lay(seed, n):
        w = prose(seed, n).split()
        return "\n".join(" ".join(w[i : i + per]) for i in range(0, n, per))

    rows = [(i, "\n".join([lay(300 + i, 40), lay(800 + i // 2, 56), lay(600 + i, 40)])) for i in range(40)]
    assert len({r["doc_id"] for r in found(spark, rows)}) >= 38


def holding(seed, passage, before=40, after=40):
    return " ".join([prose(20_000 + seed, before), passage, prose(30_000 + seed, after)])


def whole(spark, rows, **k):
    return paragraphs.repeated_passages(documents(spark, rows, **k), whole_words=paragraphs.WHOLE_WORDS).collect()


@pytest.mark.parametrize("n", [51, 60, 90])
def test_whole_passages_are_reported(spark, n):
    """Passages of 51 words and more are found by the equal words beside their paragraphs, at any place in the document."""
    rows = [(i, holding(i, prose(40_000 + i // 2, n), i % 7 * 10, i % 5 * 10)) for i in range(120)]
    got = whole(spark, rows)
    assert len({r["doc_id"] for r in got}) >= 114
    assert all(paragraphs.WHOLE_WORDS <= r["shared_words"] <= n + 8 for r in got)


def test_shorter_passages_are_left_alone(spark):
    rows = [(i, holding(i, prose(40_000 + i // 2, 36))) for i in range(60)]
    assert len({r["doc_id"] for r in found(spark, rows)}) >= 30 and whole(spark, rows) == []


def test_partner_inside_a_longer_run(spark):
    """One holder of a passage has repeated text right behind it, so that its run goes on there; the other's ends with the passage."""
    rows = []
    for i in range(40):
        passage, more = prose(50_000 + i, 52), prose(51_000 + i, 60)
        rows += [(3 * i, holding(3 * i, passage)), (3 * i + 1, holding(3 * i + 1, passage + "\n" + more)), (3 * i + 2, holding(3 * i + 2, more))]
    got = {r["doc_id"] for r in whole(spark, rows)}
    assert all(sum(x % 3 == k for x in got) >= 37 for k in range(3))


def test_documents_that_share_fewer_words_are_left_alone(spark):
    """Against all windows of the small table: documents without a shared window of 44 words are hardly ever reported."""
    holders = {}
    for r in small(spark, "documents").collect():
        w = words(r["text"])
        for j in range(len(w) - 43):
            holders.setdefault(tuple(w[j : j + 44]), set()).add(r["doc_id"])
    share = set().union(*(v for v in holders.values() if len(v) > 1))
    got = {r["doc_id"] for r in paragraphs.repeated_passages(small(spark, "documents"), whole_words=paragraphs.WHOLE_WORDS).collect()}
    assert len(got - share) <= 0.02 * small(spark, "documents").count()


def test_whole_passages_in_odd_rows(spark):
    same = prose(7, 80)
    rows = [(1, None), (2, ""), (3, same), (3, same), (3, None), (None, same), (4, "é İ " + prose(8, 50) + " " + same), (5, "on he " * 30_000), (6, "é " + same.upper()), (7, "a b c")]
    got = whole(spark, rows, clash=True)
    assert {r["doc_id"] for r in got} == {3, 4, 6, None}
    assert whole(spark, [(1, None)]) == whole(spark, []) == []


def test_pairs_of_a_batch_against_sets():
    """Empty texts, short ones, repeated shingles and near copies, at two thresholds."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 14))) for _ in range(300)]
    other = [t if i % 3 == 0 else t.replace("w1", "w9", 1) if i % 3 == 1 else texts[i - 1] for i, t in enumerate(texts)]
    pdf = pd.DataFrame({"a": range(300), "b": range(300), "ta": texts, "tb": other})

    def sets(text):
        return set(textscan.shingles((w := textscan.Words([text])).hash, w.bounds, paragraphs.N)[0].tolist())

    for threshold in (0.3, 0.8):
        got = next(paragraphs._jaccard(threshold)(iter([pdf])))["ok"].tolist()
        both = [(sets(x), sets(y)) for x, y in zip(texts, other, strict=True)]
        assert got == [len(x & y) >= threshold * len(x | y) - 1e-9 for x, y in both]
