"""Sharding by Karmarkar-Karp differencing: indivisible groups of equal texts, shards of nearly equal bytes.

Differencing keeps partial partitions (one sum for each bin) in a heap by spread and again and again combines the
two of largest spread, the largest bins of one with the smallest of the other. Over a corpus it runs in rounds: groups
above a fixed share of all bytes stay single items (there can't be more than HEAVY of them), the rest are
dealt by hash into chunks of bounded size, and each chunk is differenced into bundles of nearly equal bytes, the items of
the next round; a few single groups stay as small change. The last round sees at most FINAL items, on the driver.

A text longer than a shard's fair share can't be split, nor can copies of one text that are: that shard is then
larger than the others, which stay equal among themselves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import bounded_broadcast, materialize, prepare_python

HEAVY, CHANGE, FINAL = 10_000, 4_000, 40_000
CHUNK, BUNDLES = 20_000, 200
SLOTS = 2_000  # rows of a shard that one task numbers


def differencing(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each size, by Karmarkar-Karp differencing. Ties in size are taken in the order given."""
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    if not n or bins == 1:
        return out
    follows = np.full(n, -1, dtype=np.int64)  # a bin's items are a linked list
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = n

    def part(i: int):
        if i < n:
            one = np.array([i])
            return sizes[i : i + 1].astype(np.int64), one, one
        return parts.pop(i)

    while len(heap) > 1:
        (va, ha, ta), (vb, hb, tb) = part(heapq.heappop(heap)[1]), part(heapq.heappop(heap)[1])
        over = len(va) + len(vb) - bins  # bins of both that meet
        if over > 0:
            alone = len(va) - over
            meet = vb[len(vb) - over :][::-1]
            follows[ta[alone:]] = hb[len(vb) - over :][::-1]
            values = np.concatenate([va[:alone], va[alone:] + meet, vb[: len(vb) - over]])
            heads = np.concatenate([ha, hb[: len(vb) - over]])
            tails = np.concatenate([ta[:alone], tb[len(vb) - over :][::-1], tb[: len(vb) - over]])
        else:
            values, heads, tails = (np.concatenate(x) for x in ((va, vb), (ha, hb), (ta, tb)))
        order = np.argsort(-values, kind="stable")
        values = values[order]
        parts[fresh] = values, heads[order], tails[order]
        low = int(values[-1]) if len(values) == bins else 0
        heapq.heappush(heap, (low - int(values[0]), fresh))
        fresh += 1
    _, heads, _ = part(heap[0][1])
    at, which = heads, np.arange(len(heads))
    while len(at):
        out[at] = which
        at, which = follows[at], which[follows[at] >= 0]
        at = at[at >= 0]
    return out


def _bundles(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True])
        to = differencing(pdf["bytes"].to_numpy(), BUNDLES)
        ids = -(1 + to + BUNDLES * (pdf["chunk"].to_numpy() + (level << 40)))
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "parent": ids, "bytes": pdf["bytes"].to_numpy()})

    return run


def assign_groups(groups: DataFrame, shards: int, final: int = FINAL) -> DataFrame:
    """(item, shard) for groups (item long, bytes long, one row each)."""
    spark = groups.sparkSession
    prepare_python(spark)
    items, maps, level = groups, [], 0
    n, total = items.agg(F.count("*"), F.sum("bytes")).first()
    while n > final:
        heavy = F.col("bytes") >= F.lit(max(1, -(-total // HEAVY)))
        single = heavy | (F.pmod(F.xxhash64("item", F.lit(level)), F.lit(max(1, n // CHANGE))) == 0)
        chunks = max(1, -(-n // CHUNK))
        light = items.where(~single).withColumn("chunk", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(chunks)))
        to = materialize(light.groupBy("chunk").applyInPandas(_bundles(level), "item long, parent long, bytes long"))
        bundle = to.groupBy(F.col("parent").alias("item")).agg(F.sum("bytes").alias("bytes"))
        kept = items.where(single).select("item", "bytes")
        items = materialize(kept.union(bundle))
        maps.append((kept, to))
        n, _ = items.agg(F.count("*"), F.sum("bytes")).first()
        level += 1
    last = items.select("item", "bytes").toPandas().sort_values(["bytes", "item"], ascending=[False, True])
    last["shard"] = differencing(last["bytes"].to_numpy(), shards)
    out = spark.createDataFrame(last[["item", "shard"]], "item long, shard long")
    for kept, to in reversed(maps):
        found = bounded_broadcast(out.withColumnRenamed("item", "parent"))
        below = to.join(found, "parent").select("item", "shard")
        single = kept.select(F.col("item").alias("parent")).join(found, "parent").toDF("item", "shard")
        out = materialize(single.union(below))
    return out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group_bytes for every row of docs.

    size: UTF-8 bytes of the text plus 16; a null text counts as an empty one (CRC 0) and belongs to the same group.
    Rows of equal texts share a shard. slot numbers a shard's rows from 0 without gaps, in the order of hashed
    buckets and of doc_id within them (nulls first); repeated rows each get a slot of their own. law is 'bytes'. An
    empty table gives no rows. Other columns of docs aren't looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("item"),
        )
    )
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("bytes")))
    to = assign_groups(groups, shards).join(groups.withColumnRenamed("bytes", "group_bytes"), "item")
    to = materialize(to)
    n = rows.count()
    buckets = max(1, -(-n // (shards * SLOTS)))
    bucket = F.pmod(F.xxhash64("doc_id", "item"), F.lit(buckets))
    placed = materialize(rows.join(to, "item").withColumn("bucket", bucket))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "item")
    numbered = placed.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(start, ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("nth") + F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "group_bytes",
    )
