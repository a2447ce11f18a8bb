"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark items.

Normalised text: A-Z lower-cased, words joined by one space with a space at either end. Patterns are the items' windows
(WINDOW consecutive words; a shorter item is one window), also with spaces at the ends, so that a match starts and ends
with words. A text is scanned once; match offsets become word numbers and, for hit documents, spans of the original.

One automaton holds the whole benchmark up to BLOCK_BYTES of its text, which bounds what each worker keeps. A larger
benchmark is split into blocks, each with one automaton and one scan whose hits are written before the next block is read; the
hits are then merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ledgerloom.runtime import prepare_python, materialize

WINDOW = 10
BLOCK_BYTES = 512 << 10

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_HITS = "n_words long, hits array<struct<a:int,b:int>>, spans array<struct<start:int,end:int>>, items array<string>"

Items = list[tuple[str, str | None]]


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of text in UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _spaced(w: list[bytes]) -> str:
    return (b" " + b" ".join(w) + b" ").decode("latin-1")


class Automaton:
    """The windows of items (id, text): scan() finds which of them occur among words, and where."""

    def __init__(self, items: Items, window: int = WINDOW):
        self.items: dict[str, set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                self.items.setdefault(_spaced(w[i : i + window]), set()).add(item)
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for k in self.items:
            self.find.add_word(k, k)
        if self.items:
            self.find.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges [a, b), merged and in order, and the ids of items with windows among w."""
        if not self.items or not w:
            return [], set()
        found = list(self.find.iter(_spaced(w)))
        if not found:
            return [], set()
        space = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)  # offset of the space after each word
        last = np.array([e for e, _ in found])
        first = last - np.array([len(k) for _, k in found]) + 1
        a, b = np.searchsorted(space, first, side="right"), np.searchsorted(space, last) + 1
        return merged(zip(a.tolist(), b.tolist(), strict=True)), set().union(*(self.items[k] for k in {k for _, k in found}))


def merged(spans) -> list[tuple[int, int]]:
    """The union of ranges [a, b), in order; touching ranges become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges in text of the word ranges."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


_cache: dict[bytes, Automaton] = {}


def _automaton(items: Items, window: int) -> Automaton:
    """Built once in a worker process for the same items."""
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).digest()
    if key not in _cache:
        _cache.clear()
        _cache[key] = Automaton(items, window)
    return _cache[key]


def _blocks(bench: DataFrame) -> Iterator[Items]:
    """The benchmark's rows in blocks; streamed, so that the driver holds one at a time."""
    block, size, some = [], 0, False
    for item, text in bench.selectExpr("coalesce(cast(item_id as string), '')", "text").toLocalIterator():
        block.append((item, text))
        size += len(text or "") + 50
        if size >= BLOCK_BYTES:
            yield sorted(block, key=str)
            block, size, some = [], 0, True
    if block or not some:
        yield sorted(block, key=str)


def _scan(docs: DataFrame, items: Items, window: int) -> DataFrame:
    """docs' columns, then those of _HITS."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    kinds = StructType([*docs.schema.fields, *_parse_datatype_string(_HITS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(held.value, window)
        hit_type, span_type = (pa.list_(pa.struct([(x, pa.int32()), (y, pa.int32())])) for x, y in (("a", "b"), ("start", "end")))
        for batch in batches:
            count, hits, spans, ids = [], [], [], []
            for text in batch.column("__text").to_pylist():
                w = words(text)
                hit, item = auto.scan(w)
                count.append(len(w))
                hits.append([{"a": a, "b": b} for a, b in hit])
                spans.append([{"start": a, "end": b} for a, b in original_spans(text, hit)] if hit else [])
                ids.append(sorted(item))
            arrays = [pa.array(count, pa.int64()), pa.array(hits, hit_type), pa.array(spans, span_type), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=kinds.names)

    return docs.mapInArrow(run, kinds)


def _merge_blocks(found: DataFrame) -> DataFrame:
    """One row for each (__id, __mark), the hits of all blocks merged; only hit documents come here."""
    lists = found.groupBy("__id", "__mark").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "spans", "items")))

    def run(pdfs):
        for pdf in pdfs:
            for i, (hits, spans) in enumerate(zip(pdf["hits"], pdf["spans"], strict=True)):
                word = [(h["a"], h["b"]) for h in hits]
                start = {a: s["start"] for (a, _), s in zip(word, spans, strict=True)}
                end = {b: s["end"] for (_, b), s in zip(word, spans, strict=True)}
                out = merged(word)
                pdf.at[i, "hits"] = [{"a": a, "b": b} for a, b in out]
                pdf.at[i, "spans"] = [{"start": start[a], "end": end[b]} for a, b in out]
                pdf.at[i, "items"] = sorted(set(pdf["items"][i]))
            yield pdf

    return lists.mapInPandas(run, lists.schema)


def scan_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for every row of docs (with keep: docs' columns and
    a column __contaminated instead).

    bench has item_id and text. A word is hit if it lies in an occurrence of a window of an item. items_sha256 is over the
    ids of items with occurring windows, as strings, sorted and joined by commas. spans: character ranges of hits in the
    original text. Null and empty texts have no words; null item ids count as ''; items without words have no window.
    Repeated rows are scanned each by itself, an empty docs gives no rows, an empty bench no hits.
    """
    prepare_python(docs.sparkSession)
    read = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text", F.col("text"))
    read = read.select(*([F.struct(*(docs[c] for c in docs.columns)).alias("__row")] if keep else []), "__id", "__text")
    blocks = _blocks(bench.select("item_id", "text"))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        x = _scan(read, first, window)
    else:
        marked = read.withColumn("__mark", F.xxhash64("__text"))
        slim = marked.select("__id", "__mark", "__text")
        hits = (_scan(slim, b, window).where("size(hits) > 0").drop("__text", "n_words") for b in chain((first, second), blocks))
        found = reduce(DataFrame.union, map(materialize, hits))
        x = _scan(marked, [], window).drop("hits", "spans", "items")
        hit = materialize(_merge_blocks(found)).withColumnsRenamed({"__id": "__i", "__mark": "__m"})
        x = x.join(hit, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__mark") == F.col("__m")), "left")
    n_hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["b"] - h["a"]), F.lit(0))
    if keep:
        return x.select("__row.*", (n_hit > 0).alias("__contaminated"))
    items, spans = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return x.select(
        F.col("__id").alias("doc_id"),
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        spans.alias("spans"),
    )


def clean_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit word, with all their columns."""
    return scan_documents(docs, bench, window, keep=True).where("not __contaminated").drop("__contaminated")


ORACLE = r"""with bw as (select item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from (select item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from benchmark)),
  win as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as k
    from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bw where len(w) > 0)),
  dw as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
    from (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
  pos as (select r, i, m, array_to_string(w[i:i + m - 1], ' ') as k
    from (select r, w, unnest(range(1, len(w) + 1)) as i from dw) cross join (select distinct m from win) where i + m - 1 <= len(w)),
  hit as (select r, i, m, item_id from pos join win using (m, k)),
  n as (select r, count(distinct i + j) as n_hit from (select r, i, unnest(range(0, m)) as j from (select distinct r, i, m from hit)) group by r),
  ids as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
    from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join n using (r) left join ids using (r)"""
