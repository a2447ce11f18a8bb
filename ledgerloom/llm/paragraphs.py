"""Substring dedup by paragraph MinHash banding.

Passages that repeat are often set inside longer lines, so paragraphs are cut by content: at the ends of lines of MIN_PARAGRAPH words or more
(shorter lines that follow each other are one text, like verse, lists or tables), and before each word whose hash
(with the word before it) is the least of the REACH words on either side. The cuts inside a passage depend on the passage alone, so
a copy of it anywhere yields the same paragraphs of REACH + 1 or more words, about 11 on average. Text that repeats itself word for word
has no such least word; there a cut follows every MAX_PARAGRAPH words.

Each paragraph has a MinHash over its N-word shingles; bands() tunes number and width of bands to the target recall. Paragraphs with a
common band key are compared with the smallest paragraph of the key by exact Jaccard similarity; where some of a key's paragraphs aren't
similar to it, all its paragraphs are joined with each other by similar_nodes(). Links are clustered by components.
Clusters across documents keep their earliest paragraph; adjacent repeated paragraphs of a document make up a run of MIN_WORDS words or more. Cutting
leaves the ends of a passage in paragraphs that differ, so runs under WHOLE_WORDS words are extended by the equal words that another holder of
the run's first or last paragraph has beside it; what then has WHOLE_WORDS words is reported.

Equal paragraphs are one node throughout: only counts and the smallest node of a key are gathered, never a key's members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import textscan
from ledgerloom.llm.components import connected_components
from ledgerloom.runtime import discard, materialize, prepare_python

N = 5
THRESHOLD = 0.8
#: Smaller: more, shorter paragraphs. With 5, simulated passages of 51 random words are missed 6 times in 1,000 (with 6, 27 times; with 8, 140).
REACH = 5
#: Words from which a paragraph takes part, and from which a run of repeated paragraphs counts.
MIN_PARAGRAPH, MIN_WORDS = 6, 16
#: Equal words beside a run are counted in steps of STEP; with WHOLE_WORDS no passage of 51 equal words falls short of it by the steps.
STEP = 2
WHOLE_WORDS = 51 - 2 * (STEP - 1)
MAX_PARAGRAPH = 48
#: Lines of fewer words, and runs of short lines, aren't cut into pieces under MIN_PARAGRAPH words.
LONG = 40
RECALL = 0.95


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 16) -> tuple[int, int]:
    """(bands, rows a band): the fewest minima that find a pair at the threshold with the target recall."""
    fits = [(b * r, b, r) for b in range(1, most + 1) for r in range(1, 9) if 1 - (1 - threshold**r) ** b >= recall]
    _, b, r = min(fits)
    return b, r


BANDS, ROWS = bands()
_MUL = np.random.default_rng(43).integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut(w: textscan.Words, newline: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each paragraph, and the paragraph range of each text. newline: whether a line starts before a word."""
    n = len(w.hash)
    bounds = w.bounds
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    b = np.empty(n, np.uint64)
    if n:
        b[0] = w.hash[0]
        b[1:] = textscan.mix(w.hash[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[1:])
    least = np.ones(n, dtype=bool)
    for d in range(1, min(REACH, n - 1) + 1):
        same = text_of[d:] == text_of[:-d]
        least[d:] &= ~same | (b[d:] < b[:-d])
        least[:-d] &= ~same | (b[:-d] < b[d:])
    line = np.flatnonzero(first[:n] | newline)
    long = np.diff(np.append(line, n)) >= MIN_PARAGRAPH
    edge = first.copy()
    edge[line[long]] = True
    edge[line[1:][long[:-1]]] = True  # a run of shorter lines is one part
    at = np.flatnonzero(edge[:n])
    size = np.diff(np.append(at, n))
    into = np.arange(n) - np.repeat(at, size)
    part = np.repeat(size, size)
    whole = (part < LONG) & (np.minimum(into, part - into) < MIN_PARAGRAPH)
    start = np.flatnonzero(edge[:n] | (least & ~whole))
    more = (np.diff(np.append(start, n)) - 1) // MAX_PARAGRAPH
    if more.any():
        nth = np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        start = np.repeat(start, more + 1) + nth * MAX_PARAGRAPH
    return start, np.searchsorted(start, bounds)


def _char_offsets(w: textscan.Words, i: int, text: str | None, offsets: np.ndarray) -> np.ndarray:
    """Character offsets for byte offsets in text i of w."""
    if not text or text.isascii():
        return offsets
    raw = np.frombuffer(w.raw[i], np.uint8)
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in textscan.in_runs(texts):
            w = textscan.Words(texts[a:b])
            if not len(w.hash):
                continue
            newline = np.zeros(len(w.hash), dtype=bool)
            for i, raw in enumerate(w.raw):
                lo, hi = w.bounds[i], w.bounds[i + 1]
                if hi - lo > 1:
                    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
                    line = np.searchsorted(at, w.start[lo:hi])
                    newline[lo + 1 : hi] = line[1:] != line[:-1]
            start, by_text = cut(w, newline)
            limit = np.append(start, len(w.hash))
            count = np.diff(limit)
            node = textscan.sequence_hash(w.hash, limit)
            x, bounds = textscan.shingles(w.hash, limit, N)
            keys = np.zeros((BANDS, len(start)), np.uint64)
            for k in range(BANDS * ROWS):
                low = np.minimum.reduceat(x * _MUL[k], bounds[:-1])
                keys[k // ROWS] = textscan.mix(keys[k // ROWS] + low + np.uint64(1 + k // ROWS))
            text_of = np.repeat(np.arange(b - a), np.diff(by_text))
            use = count >= MIN_PARAGRAPH
            rank = np.cumsum(use) - use
            number = rank - rank[by_text[:-1][text_of]]
            begin, end = w.start[start], w.end[limit[1:] - 1]
            for i in np.flatnonzero([len(r) for r in w.raw]):
                p = slice(by_text[i], by_text[i + 1])
                begin[p], end[p] = _char_offsets(w, i, texts[a + i], begin[p]), _char_offsets(w, i, texts[a + i], end[p])
            at = np.flatnonzero(use)
            who = pa.array(text_of[at] + a)
            cols = [batch.column(0).take(who), batch.column(1).take(who)]
            cols += [pa.array(v[at].astype(np.int32)) for v in (number, begin, end, start - w.bounds[text_of], count)]
            cols += [pa.array(node[at])] + [pa.array(k[at].view(np.int64)) for k in keys]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])


def text_key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, key, number, start, end, word (the first word's place), n_words, node, b0, b1, ... of the paragraphs of docs (doc_id, text)."""
    prepare_python(docs.sparkSession)
    names = ["doc_id", "key", "number", "start", "end", "word", "n_words", "node", *(f"b{k}" for k in range(BANDS))]
    kinds = ["long", "long", "int", "int", "int", "int", "int", *["long"] * (1 + BANDS)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(_paragraphs, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names)


def _distinct(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes as (text, hash), in this order."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((x, text))
    text, x = text[order], x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (x[1:] != x[:-1])
    return text[new], x[new]


def _jaccard(threshold: float):
    def sets(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        w = textscan.Words(texts.tolist())
        return _distinct(*textscan.shingles(w.hash, w.bounds, N))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            (i, x), (j, y) = sets(pdf["ta"]), sets(pdf["tb"])
            each = np.append(i, j)
            every = np.bincount(each, minlength=len(pdf))
            union = np.bincount(_distinct(np.append(x, y)[np.argsort(each, kind="stable")], np.append(0, np.cumsum(every)))[0], minlength=len(pdf))
            yield pdf[["a", "b"]].assign(ok=every - union >= threshold * union - 1e-9)

    return run


def _shingle_sets(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        w = textscan.Words(pdf["t"].tolist())
        x, bounds = textscan.shingles(w.hash, w.bounds, N)
        sets = [np.unique(x[i:j]).view(np.int64) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pd.DataFrame({"node": pdf["node"], "x": sets})


def _similar(x: str, y: str, threshold: float) -> Column:
    both = F.size(F.array_intersect(x, y))
    return both >= threshold * (F.size(x) + F.size(y) - both) - 1e-9


def similar_nodes(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that connect all similar nodes of texts (node, t), by an exact prefix join.

    A node of s shingles and one of t share o = threshold * (s + t) / (1 + threshold) or more, so that the s - o + 1 rarest of the one and the
    t - o + 1 rarest of the other have one in common. The nodes of a key (s, t, shingle) are compared with its smallest; those that aren't
    similar to it are compared with all nodes of the key.
    """
    sets = materialize(texts.select("node", "t").mapInPandas(_shingle_sets, "node long, x array<long>"))
    each = materialize(sets.select("node", F.explode("x").alias("h")), free=True)
    count = materialize(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), free=True)
    rare = each.join(count, "h", "left").groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "h"))).alias("r"))
    sizes = rare.withColumn("s", F.size("r"))
    other = F.sequence(F.ceil(threshold * F.col("s") - 1e-9).cast("int"), F.floor(F.col("s") / threshold + 1e-9).cast("int"))
    sizes = sizes.select("node", "r", "s", F.explode(other).alias("t"))
    least = F.ceil(threshold / (1 + threshold) * (F.col("s") + F.col("t")) - 1e-9).cast("int")
    keys = sizes.select("node", "s", "t", F.explode(F.slice("r", F.lit(1), F.greatest(F.lit(1), F.col("s") - least + 1))).alias("e")).where("e.c > 1")
    keys = keys.select("node", "s", "t", F.xxhash64(F.least("s", "t"), F.greatest("s", "t"), "e.h").alias("g"))
    keys = materialize(keys, free=True)
    for done in (each, count):
        discard(done)
    both = "min(node) <> max(node) and min(s) <= min(t) and max(s) >= max(t)"  # nodes of either size
    low = keys.groupBy("g").agg(F.min("node").alias("low"), F.expr(both).alias("both")).where("both").select("g", "low")
    low = materialize(low, free=True)
    keys = materialize(keys.join(low, "g"), free=True)
    star = materialize(keys.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), free=True)
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    linked = materialize(star.join(x, "a").join(y, "b").where(_similar("x", "y", threshold)).select("a", "b"))
    left = keys.where("node <> low").join(linked.toDF("node", "low"), ["node", "low"], "left_anti")
    left = materialize(left.select("g", "s", "t", F.col("node").alias("a")), free=True)
    right = materialize(keys.where("node <> low").select("g", F.col("t").alias("s"), F.col("s").alias("t"), F.col("node").alias("b")), free=True)
    pairs = left.join(right, ["g", "s", "t"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.distinct(), free=True)
    return linked.union(pairs.join(x, "a").join(y, "b").where(_similar("x", "y", threshold)).select("a", "b"))


def _close(units: DataFrame, band: str, place: Column) -> DataFrame:
    """node, low, p, q, at of the paragraphs whose band key other paragraphs have: low is the key's smallest node, p and q the node's
    smallest and largest document, at its place in p. Bands are joined one after another, so that one band's shuffles are on disk at a time."""
    key = F.col(band).alias("k")
    shared = units.groupBy(key).agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = materialize(shared.where("low <> high").select("k", "low"), free=True)
    close = units.select("node", "key", place.alias("at"), key).join(shared, "k").groupBy("node", "low")
    return materialize(close.agg(F.min("key").alias("p"), F.max("key").alias("q"), F.min_by("at", "key").alias("at")), free=True)


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key, side, pos, n: a hash of the n words before (side 0, pos: start) or after (side 1, pos: end) each paragraph and of its cluster, for
    n up to the words that its cluster needs there."""
    for batch in batches:
        keys, texts, held = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
        for a, b in textscan.in_runs(texts):
            w = textscan.Words(texts[a:b])
            word = np.append(w.hash, np.uint64(0))
            count = held.slice(a, b - a).value_lengths().to_numpy()
            spot = held.slice(a, b - a).flatten()
            at = np.repeat(np.arange(b - a), count)
            first = np.append(w.start, 0)
            for i in np.flatnonzero(count):
                p = slice(w.bounds[i], w.bounds[i + 1])
                first[p] = _char_offsets(w, i, texts[a + i], w.start[p])
            root = spot.field("root").to_numpy().view(np.uint64)
            for side, edge in ((0, "start"), (1, "end")):
                need = spot.field("after" if side else "before").to_numpy()
                use = np.flatnonzero(need)
                need = need[use]
                pos, text = spot.field(edge).to_numpy()[use], at[use]
                lo, hi = w.bounds[text], w.bounds[text + 1]
                place = np.array([x + np.searchsorted(first[x:y], z) for x, y, z in zip(lo, hi, pos, strict=True)], dtype=np.int64)
                h = textscan.mix(root[use] + np.uint64(side))
                for n in range(1, int(need.max(initial=0)) + 1):
                    place = place if side else place - 1
                    inside = (n <= need) & ((place < hi) if side else (place >= lo))
                    h, place, lo, hi, pos, text, need = (x[inside] for x in (h, place, lo, hi, pos, text, need))
                    h = textscan.mix(h * np.uint64(0x9E3779B97F4A7C15) + word[place])
                    place = place + 1 if side else place
                    if n % STEP == 0 and len(h):
                        cols = [h.view(np.int64), keys[text + a], np.full(len(h), side, np.int8), pos.astype(np.int32), np.full(len(h), n, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "key", "side", "pos", "n"])


def whole_runs(rows: DataFrame, docs: DataFrame, min_words: int, whole_words: int) -> DataFrame:
    """key, run, shared_words of the runs of rows that have whole_words words with the equal words on either side.

    Every holder of a cluster that begins or ends a shorter run gives the hashes of the words beside it; a hash that two documents have is a
    shared extension. Each hash is counted, never paired, so a cluster of any size is aggregated before it is shuffled.
    """
    runs = rows.groupBy("key", "run").agg(
        (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("total"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min_by("root", "number").alias("before"), F.max_by("root", "number").alias("after"),
    ).where(F.col("total") >= min_words)
    if whole_words <= min_words:
        return runs.select("key", "run", F.col("total").alias("shared_words"))
    runs = materialize(runs, free=True)
    short = runs.where(F.col("total") < whole_words)
    need = (F.ceil((whole_words - F.col("total")) / STEP) * STEP).cast("int")
    ends = short.select(F.col("before").alias("root"), need.alias("before"), F.lit(0).alias("after"))
    ends = ends.union(short.select("after", F.lit(0), need)).groupBy("root")
    ends = materialize(ends.agg(F.max("before").alias("before"), F.max("after").alias("after")))
    held = rows.select("key", "root", "start", "end").join(ends, "root").groupBy("key")
    held = materialize(held.agg(F.collect_list(F.struct("root", "start", "end", "before", "after")).alias("held")), free=True)
    texts = docs.select(text_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    beside = texts.join(held, "key").select("key", "text", "held").mapInArrow(_beside, "h long, key long, side byte, pos int, n int")
    beside = materialize(beside, free=True)
    shared = beside.groupBy("h").agg(F.min("key").alias("p"), F.max("key").alias("q")).where("p <> q").select("h")
    longest = beside.join(materialize(shared, free=True), "h").groupBy("key", "side", "pos").agg(F.max("n").alias("n"))
    longest = materialize(longest, free=True)
    left = longest.where("side = 0").select("key", F.col("pos").alias("start"), F.col("n").alias("left"))
    right = longest.where("side = 1").select("key", F.col("pos").alias("end"), F.col("n").alias("right"))
    wide = runs.join(left, ["key", "start"], "left").join(right, ["key", "end"], "left")
    wide = wide.select("key", "run", (F.col("total") + F.coalesce("left", F.lit(0)) + F.coalesce("right", F.lit(0))).alias("shared_words"))
    whole = materialize(wide.where(F.col("shared_words") >= whole_words), free=True)
    discard(beside)
    return whole


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, whole_words: int = 0) -> DataFrame:
    """doc_id, start, end, n_words, n_paragraphs, removed, first_doc_id, clusters, shared_words of passages that repeat across documents.

    A passage is a run of adjacent paragraphs of a document, each in a cluster that spans two documents or more, of min_words words or more
    in all, and of whole_words or more with the equal words on either side (0: these aren't looked at); it is cut where removed changes, and parts of
    fewer words than min_words are left out beside one that has them. removed: the paragraphs aren't the earliest of their clusters (by doc_id, then
    place). start and end are character offsets in the text, first_doc_id the smallest document that holds the earliest paragraphs of the
    run's clusters, clusters the clusters' ids, shared_words the words of the whole run, with the equal words on either side where it has fewer than
    whole_words. Null texts have no paragraphs, null doc_ids are carried as null and come last, rows of one
    doc_id are one document. An empty table gives no rows.
    """
    units = materialize(paragraphs(docs))
    equal = units.groupBy("node").agg(F.min("key").alias("p"), F.max("key").alias("q")).where("p <> q")
    equal = materialize(equal, free=True)
    place = F.col("start").cast("long") * (1 << 31) + F.col("end")
    found = reduce(DataFrame.union, [_close(units, f"b{k}", place) for k in range(BANDS)])
    near = found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    place = found.groupBy("node").agg(F.min("p").alias("key"), F.min_by("at", "p").alias("at")).join(ends, "node")
    place = place.select("node", "key", F.expr("int(at div 2147483648)").alias("start"), F.expr("int(at % 2147483648)").alias("end"))
    texts = docs.select(text_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    snippet = texts.join(place, "key")
    snippet = snippet.select("node", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("t"))
    snippet = materialize(snippet.groupBy("node").agg(F.first("t").alias("t")), free=True)
    pairs = near.join(snippet.toDF("a", "ta"), "a").join(snippet.toDF("b", "tb"), "b")
    tried = materialize(pairs.select("a", "b", "ta", "tb").mapInPandas(_jaccard(threshold), "a long, b long, ok boolean"), free=True)
    mixed = tried.groupBy("b").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad")).where("n > 1 and bad > 0")
    again = materialize(tried.join(materialize(mixed.select("b"), free=True), "b").select(F.col("a").alias("node")).distinct(), free=True)
    same = tried.where("ok").select("a", "b")
    if not again.isEmpty():
        same = same.union(similar_nodes(snippet.join(again, "node"), threshold))
    group = connected_components(same)
    every = found.select("node", "p", "q").union(equal).groupBy("node").agg(F.min("p").alias("p"), F.max("q").alias("q")).join(group, "node", "left")
    every = every.withColumn("root", F.coalesce("root", "node"))
    spans = every.groupBy("root").agg(F.min("p").alias("p"), F.max("q").alias("q")).where("p <> q").select("root")
    cluster = materialize(every.join(spans, "root").select("node", "root"))
    rows = units.select("doc_id", "key", "number", "start", "end", "word", "n_words", "node").join(cluster, "node").drop("node")
    rows = materialize(rows, free=True)
    discard(units)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"), F.col("number"))
    first = materialize(rows.groupBy("root").agg(F.min(order).alias("first")))
    rows = rows.join(first, "root").withColumn("removed", F.col("first") != order).withColumn("from", F.col("first.doc_id")).drop("first")
    rows = rows.dropDuplicates(["key", "number", "start"])
    doc = Window.partitionBy("key").orderBy("number")
    rows = rows.withColumn("run", F.col("number") - F.row_number().over(doc))
    whole = Window.partitionBy("key", "run")
    turn = F.coalesce((F.col("removed") != F.lag("removed").over(doc)) | (F.col("run") != F.lag("run").over(doc)), F.lit(True))
    words = F.max(F.col("word") + F.col("n_words")) - F.min("word")
    rows = rows.withColumn("part", F.sum(turn.cast("int")).over(doc))
    rows = materialize(rows, free=True)
    rows = rows.join(whole_runs(rows, docs, min_words, whole_words), ["key", "run"])
    parts = rows.groupBy("key", "run", "part", "removed").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        words.cast("long").alias("n_words"), F.count("*").alias("n_paragraphs"), F.min("from").alias("first_doc_id"),
        F.sort_array(F.collect_set("root")).alias("clusters"), F.max("shared_words").cast("long").alias("shared_words"),
    )
    longest = F.max("n_words").over(whole)
    return parts.withColumn("longest", longest).where((F.col("n_words") >= min_words) | (F.col("longest") < min_words)).select(
        "doc_id", "start", "end", "n_words", "n_paragraphs", "removed", "first_doc_id", "clusters", "shared_words"
    )


def remove_passages(docs: DataFrame, whole_words: int = 0) -> DataFrame:
    """doc_id and text of docs without the removed passages (blanks around them, and equal words beside their paragraphs, stay)."""
    spans = repeated_passages(docs, whole_words=whole_words).where("removed").groupBy("doc_id")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, "doc_id", "left")
    cut_out = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])).alias("t"), s["end"].alias("at")
        ),
        lambda acc: F.concat(acc["t"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))),
    )
    return x.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut_out).alias("text"))
