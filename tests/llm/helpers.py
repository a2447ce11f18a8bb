"""Small tables, DuckDB and brute-force versions for the tests of the llm operators."""

import re

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that operators use or return.
CLASH = "shard string, size int, item string, key string, node string, root string, rank int, score string, slot int, spans string, id string, lang_pred string"
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def documents(spark, rows, clash=False):
    """rows: (doc_id, text) or (doc_id, text, lang) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "src1")[len(r) - 2 :], len(r[1] or "")) for r in rows]
    if clash:
        extra = CLASH.split(", ")
        full = [(*r, *(7 if x.endswith("int") else "x" for x in extra)) for r in full]
        return spark.createDataFrame(full, f"{SCHEMA}, {CLASH}")
    return spark.createDataFrame(full, SCHEMA)


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def duck(**tables):
    """A connection with the small tables, some of them replaced by data frames."""
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        if t in tables:
            c.register(t, tables[t])
        else:
            c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows_of(cursor):
    names = [d[0] for d in cursor.description]
    return names, [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


def same_rows(df, cursor):
    names, want = rows_of(cursor)
    assert sorted(df.columns) == sorted(names)
    got = [{k: r[k] for k in names} for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def words(text):
    return _WORD.findall((text or "").lower())


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def prose(seed, n, vocab=4000):
    """n words in sentences, much alike for no two seeds."""
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
        out.append(w + ("." if i % 11 == 10 else ""))
    return " ".join(out)
