import zlib

from ledgerloom.llm import langid

from .helpers import documents, small

WORDS = {"aa": "alba arta anda", "bb": "boko bulo bimo", "cc": "cex cyx cix"}


def rows(n=60):
    return [(i, f"{WORDS[k]} {WORDS[k]}. {i}", k) for i in range(n) for k in [sorted(WORDS)[i % 3]]]


def test_held_out_accuracy(spark):
    docs = small(spark, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 20


def test_learns_only_from_the_rest(spark):
    """Held-out rows, and only they, carry a language of their own: it must never be predicted."""
    data = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else k) for i, t, k in rows(90)]
    got = langid.identify(documents(spark, data)).collect()
    assert {r["lang_pred"] for r in got} == set(WORDS)


def test_odd_rows(spark):
    data = rows() + [(100, None, "aa"), (101, "", "aa"), (102, "123 ...", "aa"), (None, "boko bulo", None), (103, "alba " * 150_000, None), (104, "cex cyx", "cc"), (104, "cex cyx", "cc")]
    got = langid.identify(documents(spark, data, clash=True)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(data)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (100, 101, 102))
    assert by[None]["lang_pred"] == "bb" and by[None]["held_out"] is False and by[103]["lang_pred"] == "aa"


def test_nothing_to_learn(spark):
    got = langid.identify(documents(spark, [(1, "words", None)])).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    assert langid.identify(documents(spark, [])).count() == 0


def test_known_language_keeps_columns(spark):
    docs = documents(spark, rows() + [(200, "...", "aa"), (201, None, "aa")], clash=True)
    got = langid.known_language(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == set(range(60))


def test_pieces_of_a_long_text_add_up(monkeypatch):
    import numpy as np

    text = "alba arta " * 1000
    whole = np.bincount(np.concatenate(list(langid._pieces(text))), minlength=langid.DIM)
    monkeypatch.setattr(langid, "PIECE", 1000)
    parts = np.bincount(np.concatenate(list(langid._pieces(text))), minlength=langid.DIM)
    assert np.abs(whole - parts).sum() <= 8 * 10
