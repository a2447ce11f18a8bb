import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.llm import linededup

from .helpers import SCHEMA, documents, duck, prose, same_rows, small


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    lines = sorted((d, i, ln.lower().strip(" ")) for d, t in rows if d is not None and t for i, ln in enumerate(t.split("\n")))
    gone, seen = {}, []
    for d, i, ln in lines:
        if not ln:
            continue
        w = ln.split(" ")
        if any(ln == o or (min(len(w), len(v)) >= linededup.MIN_WORDS and distance(w, v) <= 1) for o, v in seen):
            gone.setdefault(d, set()).add(i)
        seen.append((ln, w))
    return {d: "\n".join(ln for i, ln in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in rows if t is not None}


def test_small_table_in_sql(spark):
    same_rows(linededup.dedup_lines(small(spark, "documents")), duck().execute(linededup.ORACLE))


def test_brute_force(spark):
    r = random.Random(4)
    base = [prose(i, 12) for i in range(12)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(5):
            w = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["new"], [w[k], w[k]]])
            lines.append(" ".join(w))
        rows.append((d, "\n".join([*lines, "", "short line"])))
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_within_one_edit(spark):
    pool = [list(p) for n in range(4) for p in itertools.product("ab", repeat=n)]
    pairs = [(a, b) for a in pool for b in pool]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", linededup.within_one_edit(F.col("a"), F.col("b")).alias("ok")).collect():
        assert r["ok"] == (distance(r["a"], r["b"]) <= 1), r


def test_odd_rows(spark):
    line = prose(1, 20)
    rows = [(1, None), (2, ""), (3, f"{line}\n\n{line}"), (3, f"{line}\n\n{line}"), (None, line), (4, line.upper()), (5, "w " * 60_000), (6, "\n\n")]
    got = linededup.dedup_lines(documents(spark, rows, clash=True)).collect()
    text = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got}
    assert len(got) == len(rows)
    assert text[1] == (None, 0, 0) and text[2] == ("", 1, 0) and text[3] == (f"{line}\n", 3, 1) and text[None] == (line, 1, 0)
    assert text[4] == ("", 1, 1) and text[5][2] == 0 and text[6] == ("\n\n", 3, 0)
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_sql_of_odd_rows(spark):
    rows = [(1, prose(1, 9)), (2, prose(1, 9) + " more"), (3, "a\nA \na"), (4, prose(2, 7) + "\n" + prose(2, 8))]
    frame = pd.DataFrame([(*r, "en", "s", 1) for r in rows], columns=[c.split()[0] for c in SCHEMA.split(", ")])
    same_rows(linededup.dedup_lines(documents(spark, rows)), duck(documents=frame).execute(linededup.ORACLE))
