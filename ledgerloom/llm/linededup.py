"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its lower-cased, trimmed text; lines are compared as sequences of words. Every distinct line emits its deletion variants
(the line without its i-th word, and the line itself) as 64-bit keys. Lines that agree without word i differ by a substitution; a line
that equals another's variant differs by an insertion. Each group of equal variants is linked to its earliest line only, links are
verified by exact word edit distance, and a line is removed if an earlier line lies within the bound of one edit.

Variants are made only of lines that can have a partner: of two lines within one edit, the first or the last half of the
shorter one's words are equal, so lines whose half keys occur once are left out beforehand. Variant keys are exclusive-or sums over words and
places, so that a line of n words costs n steps, however long it is.

Joins with the lines and texts are merge joins at every size: their small sides grow with the corpus, and what a small corpus writes to disk is then
a measure for a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import discard, materialize

#: Words from which a line may match another one that isn't equal to it.
MIN_WORDS = 8


def _position(doc_id: str, line_no: str) -> Column:
    """Order of lines: by document, then by line; null documents last."""
    big = F.lit("9223372036854775808").cast("decimal(38,0)")
    return F.coalesce(F.col(doc_id).cast("decimal(38,0)"), big) * F.lit(1 << 31).cast("decimal(38,0)") + F.col(line_no)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, norm of the lines that aren't blank; line_no counts all lines from 0."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return x.select("doc_id", "line_no", F.lower(F.trim("line")).alias("norm")).where("norm <> ''")


def _half(side: str, h: Column, words: Column) -> Column:
    start = F.lit(1) if side == "p" else F.size(words) - h + 1
    return F.xxhash64(F.lit(side), h, F.slice(words, start, h))


def _common(a: Column, b: Column) -> Column:
    """How many first elements of two arrays are equal, pairwise."""
    stop = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(stop == 0, F.size(a)).otherwise((stop - 1).cast("int"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the edit distance of two arrays of words is at most one."""
    n, m = F.size(a), F.size(b)
    agree = _common(a, b) + _common(F.reverse(a), F.reverse(b))
    return ((n == m) & (agree >= n - 1)) | ((F.abs(n - m) == 1) & (agree >= F.least(n, m)))


def similar_lines(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """lh of the distinct lines (lh, pos, nw, k0 to k3) that have an earlier one within one edit.

    texts: lh, pos and norm of lines, with repeats."""
    long = lines.where(F.col("nw") >= MIN_WORDS)
    keys = long.select("lh", "pos", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    shared = materialize(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), free=True)
    may = materialize(keys.join(shared, "k").groupBy("lh").agg(F.min("pos").alias("pos")), free=True)
    discard(shared)
    held = texts.where(F.size(F.split("norm", " ")) >= MIN_WORDS).join(may.hint("merge"), ["lh", "pos"])
    text = materialize(held.groupBy("lh", "pos").agg(F.first("norm").alias("norm")), free=True)
    discard(may)
    words = text.select("lh", "pos", F.posexplode(F.split("norm", " ")).alias("i", "w"))
    words = words.select("lh", "pos", "i", F.xxhash64("w", "i").alias("f"), F.xxhash64("w", F.col("i") - 1).alias("g"))
    whole, upto = Window.partitionBy("lh"), Window.partitionBy("lh").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = words.select(
        "lh", "pos", "i",
        F.bit_xor("f").over(whole).alias("all"), F.bit_xor("f").over(upto).bitwiseXOR(F.col("f")).alias("before"),
        F.bit_xor("g").over(whole).bitwiseXOR(F.bit_xor("g").over(upto)).alias("after"),
        F.count("*").over(whole).alias("n"),
    )
    own = x.where("i = 0").select("lh", "pos", F.lit(-1).alias("i"), F.xxhash64("n", "all").alias("v"))
    deleted = x.select("lh", "pos", "i", F.xxhash64(F.col("n") - 1, F.col("before").bitwiseXOR(F.col("after"))).alias("v"))
    variants = materialize(own.union(deleted), free=True)
    some = variants.where("i >= 0")
    first = F.min(F.struct("pos", "lh"))
    swap = materialize(some.groupBy("v", "i").agg(first.alias("to"), F.count("*").alias("c")).where("c > 1"), free=True)
    swapped = some.join(swap, ["v", "i"]).where(F.col("pos") > F.col("to.pos")).select("lh", F.col("to.lh").alias("to"))
    both = variants.groupBy("v").agg(
        F.min(F.when(F.col("i") < 0, F.struct("pos", "lh"))).alias("own"), F.min(F.when(F.col("i") >= 0, F.struct("pos", "lh"))).alias("cut")
    )
    both = materialize(both.where("own is not null and cut is not null"), free=True)
    longer = some.join(both, "v").where(F.col("pos") > F.col("own.pos")).select("lh", F.col("own.lh").alias("to"))
    shorter = both.where(F.col("own.pos") > F.col("cut.pos")).select(F.col("own.lh").alias("lh"), F.col("cut.lh").alias("to"))
    link = materialize(swapped.union(longer).union(shorter).distinct(), free=True)
    for done in (variants, swap, both):
        discard(done)
    a, b = (text.select(F.col("lh").alias(k), F.split("norm", " ").alias(f"w_{k}")) for k in ("lh", "to"))
    near = link.join(a, "lh").join(b, "to").where(within_one_edit(F.col("w_lh"), F.col("w_to"))).select("lh").distinct()
    near = materialize(near, free=True)
    for done in (text, link):
        discard(done)
    return near


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text for every row of docs: the text without its removed lines.

    Lines are separated by line feeds. A line is removed if an equal or (from MIN_WORDS words) a similar one comes earlier, in
    the order of doc_id and line; similar: at most one word inserted, deleted or replaced. Blank lines always stay.
    A null text stays null with no lines. Rows of one doc_id count as one document and get the same decisions; documents with a null doc_id come
    last and stay as they are. An empty table gives no rows.
    """
    lines = _lines(docs.where("doc_id is not null"))
    words, nw = F.split("norm", " "), F.col("nw")
    keyed = lines.select("doc_id", "line_no", F.xxhash64("norm").alias("lh"), words.alias("w")).withColumn("nw", F.size("w"))
    h0, h1 = F.expr("(nw - 1) div 2").cast("int"), F.expr("nw div 2").cast("int")
    key = [_half(side, h, F.col("w")) for side in "ps" for h in (h0, h1)]
    keyed = keyed.select("doc_id", "line_no", "lh", "nw", *(F.when(nw >= MIN_WORDS, k).alias(f"k{i}") for i, k in enumerate(key)))
    keyed = materialize(keyed)
    place = _position("doc_id", "line_no")
    distinct = keyed.groupBy("lh", "nw", "k0", "k1", "k2", "k3").agg(F.min(place).alias("pos"), F.count("*").alias("copies"))
    distinct = materialize(distinct, free=True)
    texts = lines.select(F.xxhash64("norm").alias("lh"), place.alias("pos"), "norm")
    near = similar_lines(distinct, texts)
    known = distinct.select("lh", "pos", "copies").join(near.withColumn("gone", F.lit(True)), "lh", "left").where("copies > 1 or gone")
    known = materialize(known, free=True)
    out = keyed.select("doc_id", "line_no", "lh").join(known.select("lh", "pos", "gone").hint("merge"), "lh")
    out = out.where(F.col("gone") | (place > F.col("pos")))
    removed = materialize(out.groupBy("doc_id").agg(F.collect_set("line_no").alias("removed")), free=True)
    for done in (keyed, distinct, near, known):
        discard(done)
    every = F.split("text", "\n")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = x.join(removed.hint("merge"), "doc_id", "left")
    kept = F.filter(every, lambda line, i: ~F.array_contains(F.col("removed"), i))
    return x.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(every)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


ORACLE = f"""with l as (select doc_id, i - 1 as line_no, lower(trim(a[i], ' ')) as norm, a from (select doc_id, a, unnest(range(1, len(a) + 1)) as i
    from (select doc_id, string_split(text, chr(10)) as a from documents))),
  f as (select norm, min((doc_id, line_no)) as pos from l where norm <> '' group by norm),
  w as (select norm, pos, string_split(norm, ' ') as w from f where len(string_split(norm, ' ')) >= {MIN_WORDS}),
  v as (select norm, pos, i, md5(array_to_string(w[:i - 1] || w[i + 1:], ' ') || len(w)) as v
      from (select norm, pos, w, unnest(range(1, len(w) + 1)) as i from w)
    union all select norm, pos, 0, md5(norm || (len(w) + 1)) from w),
  s as (select distinct a.norm from v a join v b on a.v = b.v and a.pos > b.pos and (a.i = b.i or a.i = 0 or b.i = 0)),
  d as (select l.doc_id, line_no from l join f using (norm) left join s on s.norm = l.norm where s.norm is not null or pos < (doc_id, line_no)),
  r as (select doc_id, list(line_no) as removed from d group by doc_id)
select doc_id, cast(len(a) as bigint) as n_lines, cast(coalesce(len(removed), 0) as bigint) as n_removed,
  case when removed is null then text else array_to_string([a[i] for i in range(1, len(a) + 1) if not list_contains(removed, i - 1)], chr(10)) end as text
from (select doc_id, text, string_split(text, chr(10)) as a from documents) left join r using (doc_id)"""
