"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text becomes code points, letters lower-cased, every run of other characters one blank; all n-grams of ORDERS are hashed
into DIM buckets. Training counts buckets by language on a bounded sample of labelled rows (MAX_DOCS for each language,
chosen by hash) and sums partial counts in Spark; the log-probability matrix (at most MAX_LANGS x DIM) is broadcast. Scoring
sums a text's rows of that matrix in numpy, batch by batch, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgerloom.runtime import prepare_python

ORDERS = (1, 2, 3)
DIM = 1 << 15
MAX_DOCS = 4_000
MAX_LANGS = 512
SMOOTHING = 0.5
PIECE = 1 << 19
UNKNOWN = "und"
#: Scores below this count as rejected.
MIN_SCORE = 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-cased letter by code point; 0 for everything else."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x20, 0x32000):
        s = chr(c)
        if s.isalpha():
            table[c] = ord(s.lower()[0])
    return table


def _codes(text: str) -> np.ndarray:
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not len(c):
        return c
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    return c[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of the codes (blanks are 0), those of single blanks left out."""
    out = []
    c = codes.astype(np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + (c[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x ^= x >> np.uint32(13)
            out.append((x * np.uint32(0x297A2D39) >> np.uint32(17)) & np.uint32(DIM - 1) if n > 1 else x[c > 0] & np.uint32(DIM - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _pieces(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text, piece by piece, of pieces with a letter; only n-grams over piece ends are missed."""
    text = text or ""
    for k in range(0, len(text), PIECE):
        c = _codes(text[k : k + PIECE])
        if c.any():
            yield grams(np.concatenate([[np.uint32(0)], c, [np.uint32(0)]]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log-probabilities by bucket (float32, languages x DIM) with the log-prior in a last
    column. Learns from rows with text, lang and doc_id whose crc32(doc_id) mod 5 isn't 0."""
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = dict(may.groupBy(F.col("lang").cast("string")).count().limit(MAX_LANGS + 1).collect())
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, DIM + 1), np.float32)
    number = {x: i for i, x in enumerate(langs)}
    part = F.create_map(*(F.lit(y) for x in langs for y in (x, min(1.0, MAX_DOCS / sizes[x]))))
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    rows = may.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id").where(place < part[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in _pieces(text):
                    k = number[lang]
                    total[k] = total.get(k, 0) + np.bincount(g, minlength=DIM)
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["lang", "bucket", "n"])

    prepare_python(docs.sparkSession)
    counted = rows.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long")
    table: pd.DataFrame = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most MAX_LANGS x DIM rows
    n = np.zeros((len(langs), DIM))
    n[table["lang"], table["bucket"]] = table["n"]
    n += SMOOTHING
    logs = np.log(n) - np.log(n.sum(axis=1, keepdims=True))
    prior = np.log([sizes[x] for x in langs]) - np.log(sum(sizes.values()))
    return langs, np.concatenate([logs, prior[:, None]], axis=1).astype(np.float32)


def score_batch(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-posterior by text and language up to a constant, has a letter) of whole texts."""
    out = np.repeat(matrix[:, DIM].astype(np.float64)[None], len(texts), axis=0)
    some = np.zeros(len(texts), bool)
    run: list[np.ndarray] = []
    who: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal run, who, size
        if run:
            g = np.concatenate(run)
            at = np.cumsum([0, *map(len, run[:-1])])
            for k in range(len(matrix)):
                np.add.at(out[:, k], who, np.add.reduceat(matrix[k][g], at, dtype=np.float64))
        run, who, size = [], [], 0

    for i, text in enumerate(texts):
        for g in _pieces(text):
            some[i] = True
            run.append(g)
            who.append(i)
            size += len(g)
            if size > PIECE:
                flush()
    flush()
    return out, some


def identify(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (with keep: docs' columns, then lang_pred and score in a
    struct __lang).

    score is the posterior probability of lang_pred. Texts that are null or have no letter get 'und' and score 0, and so
    does every text if there is nothing to learn from. Ties go to the first language by name. A null doc_id isn't
    learnt from and isn't held out. Predictions use the text only, the whole of it.
    """
    spark = docs.sparkSession
    langs, matrix = train(docs.select("doc_id", "lang", "text"))
    held = spark.sparkContext.broadcast((langs, matrix))
    prepare_python(spark)
    read = docs.select(
        *([F.struct(*(docs[c] for c in docs.columns)).alias("__row")] if keep else []),
        F.col("doc_id").cast("long").alias("__id"),
        F.col("text").alias("__text"),
    )
    fields = [f for f in read.schema.fields if f.name != "__text"]
    out = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = held.value
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            if names:
                logs, some = score_batch(texts, table)
                best = logs.argmax(axis=1)
                sure = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                sure = np.where(some, sure, 0.0)
            else:
                pred, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rest = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(sure, pa.float64())], names=out.names)

    x = read.mapInArrow(run, out)
    if keep:
        return x.select("__row.*", F.struct("lang_pred", "score").alias("__lang"))
    return x.select(F.col("__id").alias("doc_id"), held_out(F.col("__id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs whose language is known with at least min_score, with all their columns."""
    x = identify(docs, keep=True)
    return x.where((F.col("__lang.lang_pred") != UNKNOWN) & (F.col("__lang.score") >= min_score)).drop("__lang")
