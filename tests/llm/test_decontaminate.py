import hashlib
import re

import pytest

from ledgerloom.llm import decontaminate

from .helpers import documents, duck, prose, same_rows, small

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []


def brute(rows, items):
    wins = {}
    for item, text in items:
        w = plain(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, ids = plain(text), set(), set()
        for k, who in wins.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit.update(range(i, i + len(k)))
                    ids |= who
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


FIELDS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_small_table_in_sql(spark):
    got = decontaminate.scan_documents(small(spark, "documents"), small(spark, "benchmark")).drop("spans")
    same_rows(got, duck().execute(decontaminate.ORACLE))


@pytest.mark.parametrize("block", [512 << 10, 60])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    long = prose(5, 30)
    items = [(1, long), (10, long), (2, "Short ITEM here"), (3, None), (4, "..."), (5, "a a a"), (7, prose(6, 12))]
    rows = [(1, f"x {long} y"), (2, " ".join(long.split()[3:14])), (3, "short, item HERE! short item"), (4, "a a a a"), (5, prose(7, 50)), (6, None), (7, ""),
            (8, " ".join(long.split()[:9])), (8, f"Éa {prose(6, 12)}\n{long}"), (None, "short item here"), (9, "z " * 100_000 + long), (11, "ashort item here")]
    got = decontaminate.scan_documents(documents(spark, rows, clash=True), bench(spark, items)).collect()
    assert sorted(map(repr, (tuple(r[f] for f in FIELDS) for r in got))) == sorted(map(repr, brute(rows, items)))
    text = dict(rows)
    spans = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in got}
    assert spans[1] == [long.rstrip(".")] and spans[3] == ["short, item HERE! short item"[:16]] and spans[5] == []


def test_empty_tables(spark):
    assert decontaminate.scan_documents(documents(spark, []), bench(spark, [(1, "a")])).count() == 0
    got = decontaminate.scan_documents(documents(spark, [(1, "a b")]), bench(spark, [])).first()
    assert (got["n_words"], got["n_hit"], got["contaminated"]) == (2, 0, False)


def test_clean_documents(spark):
    docs = documents(spark, [(1, "keep this"), (2, "the short item here"), (None, None)], clash=True)
    got = decontaminate.clean_documents(docs, bench(spark, [(1, "short item here")]))
    assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "None"]
