"""N-gram Jaccard join with a MinHash LSH forest.

Every document is a set of N-word shingles. Its signature has TREES labels of DEPTH levels (a byte of one minimum each): the paths of
a forest of prefix tries. Prefixes are shortened from DEPTH levels to the depth at which a pair at the threshold is found with the target recall, and
all documents that share a shortened prefix are compared by a sketch of TREES x DEPTH bits, which drops pairs that are clearly below the threshold.

The pairs that are left give groups of documents (connected components). All pairs of different texts within a group are then verified exactly, in blocks of
BLOCK documents, so that links are counted in full without writing pairs. Classes are the components of the verified links.

Documents of the same word sequence are one node throughout: copies are counted, never compared or paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textscan
from ledgerloom.llm.components import connected_components, local_components
from ledgerloom.runtime import bounded_broadcast, materialize, prepare_python

N = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.998
#: Nodes of one prefix whose sketches are compared with each other in one task.
SKETCH_BLOCK = 1024
#: Linked pairs that a task holds at a time.
PAIRS = 1 << 16
BLOCK = 96
_rng = np.random.default_rng(41)
_MUL = (_rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def search_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which one of the trees holds a pair at the threshold with the target recall."""
    for d in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**d) ** TREES >= recall:
            return d
    return 1


def least_agreement(threshold: float = THRESHOLD) -> int:
    """Equal sketch bits from which a pair is kept: four standard errors under what the threshold gives."""
    n, p = TREES * DEPTH, (1 + threshold) / 2
    return int(n * p - 4 * math.sqrt(n * p * (1 - p)))


def minima(x: np.ndarray, bounds: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    """Minima (uint32, hash functions x texts) of the shingle hashes of each text; texts without any get 2^32 - 1."""
    sizes = np.diff(bounds)
    out = np.full((len(_MUL), len(sizes)), 0xFFFFFFFF, dtype=np.uint32)
    x32 = (x >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + part, side="right")) - 1)
        some = np.flatnonzero(sizes[i:j]) + i
        if len(some):
            run = x32[bounds[i] : bounds[j]]
            starts = (bounds[some] - bounds[i]).astype(np.int64)
            buf = np.empty_like(run)
            for k in range(len(_MUL)):
                np.multiply(run, _MUL[k], out=buf)
                buf += _ADD[k]
                out[k, some] = np.minimum.reduceat(buf, starts)
        i = j
    return out


def signature(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (int64, texts x TREES) and sketches (int64, texts x TREES * DEPTH / 64) from minima."""
    v = m * np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x85EBCA6B)
    level = (v >> np.uint32(24)).astype(np.uint8).reshape(TREES, DEPTH, -1)
    labels = np.ascontiguousarray(level.transpose(2, 0, 1)).view(">u8")[..., 0].astype(np.uint64).view(np.int64)
    bits = np.packbits(((v >> np.uint32(11)) & np.uint32(1)).astype(np.uint8).T, axis=1)
    return labels, np.ascontiguousarray(bits).view(np.int64)


def text_key(docs: DataFrame) -> Column:
    """The document's id; for a null id a hash of its text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, node (hash of the word sequence, 0 without words), labels, s0, s1 for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            node, label, sketch = [], [], []
            for a, b in textscan.in_runs(texts):
                w = textscan.Words(texts[a:b])
                x, bounds = textscan.shingles(w.hash, w.bounds, N)
                labels, sketches = signature(minima(x, bounds))
                node.append(textscan.sequence_hash(w.hash, w.bounds))
                label.append(labels)
                sketch.append(sketches)
            if not texts:
                continue
            labels, sketches = np.concatenate(label), np.concatenate(sketch)
            flat = pa.ListArray.from_arrays(np.arange(0, labels.size + 1, TREES, dtype=np.int32), labels.ravel())
            cols = [batch.column(0), batch.column(1), pa.array(np.concatenate(node)), flat, pa.array(sketches[:, 0]), pa.array(sketches[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "node", "labels", "s0", "s1"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, labels array<long>, s0 long, s1 long")


def _group_links(agree: int):
    """Stars of the groups that the sketches link: all rows of equal (tree, prefix, bi, bj), of block bi against those of block bj."""

    def links(key: np.ndarray, side: np.ndarray, node: np.ndarray, sketch: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs at growing distance, as long as a group reaches that far."""
        end = np.searchsorted(key, key, side="right")
        at = np.arange(len(key))
        lag = 1
        while len(at := at[at + lag < end[at]]):
            i = at[(side[at] < 0) | (side[at] != side[at + lag])]
            bits = sum(np.bitwise_count(s[i] ^ s[i + lag]).astype(np.int32) for s in sketch)
            i = i[TREES * DEPTH - bits >= agree]
            yield node[i], node[i + lag]
            lag += 1

    def joined(node: np.ndarray, root: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate([node, *(f[0] for f in found)]), np.concatenate([root, *(f[1] for f in found)])
        return local_components(a, b) if len(a) else (a, b)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["tree", "prefix", "bi", "bj"]

        def stars(rows: pd.DataFrame) -> pd.DataFrame:
            key = np.cumsum((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())
            side = np.where(rows["bi"] == rows["bj"], -1, rows["block"] == rows["bj"])
            node = root = np.zeros(0, np.int64)
            found, size = [], 0
            for pair in links(key, side, rows["node"].to_numpy(), [rows[s].to_numpy().view(np.uint64) for s in ("s0", "s1")]):
                found.append(pair)
                size += len(pair[0])
                if size > PAIRS:  # keep the stars, not the pairs of a dense group
                    node, root = joined(node, root, found)
                    found, size = [], 0
            node, root = joined(node, root, found)
            return pd.DataFrame({"a": node[node != root], "b": root[node != root]})

        held: list[pd.DataFrame] = []
        for pdf in pdfs:
            if not len(pdf):
                continue
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield stars(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cut:])
        if held:
            yield stars(pd.concat(held, ignore_index=True))

    return run


def candidate_links(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """a, b: links between nodes (node, labels, s0, s1) that share a shortened prefix and whose sketches agree, as stars of each task's groups.
    All pairs of a group are compared, in blocks of SKETCH_BLOCK."""
    shift = 8 * (DEPTH - search_depth(threshold, recall))
    rows = nodes.select("node", "s0", "s1", F.posexplode("labels").alias("tree", "label"))
    rows = materialize(rows.select("node", "s0", "s1", "tree", F.shiftright("label", shift).alias("prefix")))
    sizes = rows.groupBy("tree", "prefix").agg(F.expr(f"int(ceil(count(*) / {SKETCH_BLOCK}))").alias("blocks"), F.count("*").alias("n"))
    sizes = materialize(sizes.where("n > 1").drop("n"), free=True)
    rows = rows.join(sizes, ["tree", "prefix"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tree", "prefix", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "s0", "s1")
    rows = rows.repartition("tree", "prefix", "bi", "bj").sortWithinPartitions("tree", "prefix", "bi", "bj", "node")
    return materialize(rows.mapInPandas(_group_links(least_agreement(threshold)), "a long, b long").distinct(), free=True)


def _sets(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in textscan.in_runs(texts):
        w = textscan.Words(texts[a:b])
        x, bounds = textscan.shingles(w.hash, w.bounds, N)
        out += [np.unique(x[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of sets with Jaccard similarity of at least the threshold (same: of one list, i < j)."""
    size_l, size_r = (np.array([len(s) for s in x], dtype=np.int64) for x in (left, right))
    every = np.concatenate([*left, *right])
    _, at, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(count), -1, dtype=np.int64)
    number[shared] = np.arange(len(shared))
    column = number[at]
    row_l = np.repeat(np.arange(len(left)), size_l)
    row_r = np.repeat(np.arange(len(right)), size_r)
    col_l, col_r = column[: len(row_l)], column[len(row_l) :]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    order_l, order_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    col_l, row_l, col_r, row_r = col_l[order_l], row_l[order_l], col_r[order_r], row_r[order_r]
    for c in range(0, len(shared), 4096):
        i, j = (slice(*np.searchsorted(x, (c, c + 4096))) for x in (col_l, col_r))
        wide = min(4096, len(shared) - c)
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        x[row_l[i], col_l[i] - c] = 1
        y[row_r[j], col_r[j] - c] = 1
        both += x @ y.T
    union = size_l[:, None] + size_r[None] - both
    near = (both >= threshold * union - 1e-9) & (union > 0)
    if same:
        near &= np.triu(np.ones_like(near), 1)
    return np.nonzero(near)


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        node, copies, block = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        sets = _sets(pdf["text"].tolist())
        i, j = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        a, b = similar_pairs([sets[k] for k in i], [sets[k] for k in j], threshold, bi == bj)
        a, b = i[a], j[b]
        docs, classes = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for x, y in ((a, b), (b, a)):
            np.add.at(docs, x, copies[y])
            np.add.at(classes, x, 1)
        root = node.copy()
        if len(a):
            n, r = local_components(node[a], node[b])
            root[np.searchsorted(node, n)] = r
        some = classes > 0
        return pd.DataFrame({"node": node[some], "root": root[some], "docs": docs[some], "classes": classes[some]})

    return run


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, rep_id, n_copies, n_links, n_link_texts for every row of docs (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of N-word shingles is at least the threshold. Words: runs of letters and
    digits of the lower-cased text; fewer than N words are one shingle; a text without words has none and links to nothing.
    rep_id: the smallest doc_id with the same word sequence; n_copies: their number. n_link_texts counts the other word sequences that are
    linked to this one, n_links the other documents (with n_copies - 1). class_id: the smallest doc_id of the connected component.
    Null doc_ids are carried as null; rows of one doc_id count as copies. An empty table gives no rows.
    """
    prepare_python(docs.sparkSession)
    seen = materialize(signatures(docs))
    words = seen.where("node <> 0")
    nodes = materialize(
        words.groupBy("node").agg(
            F.min("key").alias("key"), F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"),
            F.max(F.struct("labels", "s0", "s1")).alias("sig"),
        )
    )
    links = candidate_links(nodes.select("node", "sig.labels", "sig.s0", "sig.s1"), threshold, recall)
    group = materialize(connected_components(links))
    blocks = materialize(group.groupBy("root").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks")))
    member = group.join(blocks, "root").join(nodes.select("node", "key", "copies"), "node")
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(text_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    held = texts.join(bounded_broadcast(materialize(member)), "key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    held = held.select("root", "node", "copies", "text", "block", other)
    held = held.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    found = held.groupBy("root", "bi", "bj").applyInPandas(_verify(threshold), "node long, root long, docs long, classes long")
    found = materialize(found)
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = nodes.select("node", "rep_id")
    joined = materialize(joined)
    least = materialize(joined.join(ids, "node").groupBy("root").agg(F.min("rep_id").alias("class_id")))
    count = found.groupBy("node").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("classes"))
    result = joined.join(least, "root").join(count, "node").select("node", "class_id", "docs", "classes")
    whole = materialize(nodes.select("node", "rep_id", "copies").join(result, "node", "left"))
    out = seen.select("doc_id", F.when(F.col("node") != 0, F.col("node")).alias("node")).join(whole, "node", "left")
    copies = F.coalesce("copies", F.lit(1))
    return out.select(
        "doc_id",
        F.coalesce("class_id", "rep_id", "doc_id").alias("class_id"),
        F.coalesce("rep_id", "doc_id").alias("rep_id"),
        copies.cast("long").alias("n_copies"),
        (copies - 1 + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("classes", F.lit(0)).cast("long").alias("n_link_texts"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay when of each class only the document of the smallest doc_id is kept; of repeated rows of
    that doc_id one stays. Rows with a null doc_id stay."""
    classes = join_documents(docs.select("doc_id", "text"), threshold)
    gone = materialize(classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct())
    twice = materialize(classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice"))
    kept = docs.join(bounded_broadcast(gone), docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
    if twice.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == F.col("__twice")
    again = kept.join(bounded_broadcast(twice), same, "left_semi").dropDuplicates(["doc_id"])
    rest = kept.join(bounded_broadcast(twice), same, "left_anti")
    return rest.select(*docs.columns).union(again.select(*docs.columns))
