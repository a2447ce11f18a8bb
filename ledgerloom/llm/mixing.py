"""Mixing sources to target weights by hierarchical budgeting.

A token budget is split down the tree domain - language - source by integer weights. Each node can take as many tokens as
its leaves hold in max_epochs passes, so a short leaf's rest goes to its siblings first and leaves the parent only
when the whole subtree is short. A leaf then takes whole epochs and, of the next one, the prefix of documents, in an
order seeded by leaf epoch, whose tokens stay within its budget. All sums are integers, so results are exact.

The order within an epoch is that of md5(seed:epoch:doc_id). The prefix is found without sorting a leaf: sums by the
first BUCKET_HEX digits give the digit group in which the budget ends, sums within it by the next digits a smaller group, and after ROUNDS
rounds only the last group's rows are sorted. A leaf has at most 16 ** BUCKET_HEX sums in a round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import bounded_broadcast, materialize

#: After three rounds a leaf of 10 ** 10 documents has about 600 left to sort.
BUCKET_HEX, ROUNDS = 2, 3
LEVELS = ("domain", "lang", "source")


def domain_of_source(source: Column) -> Column:
    """'dom' and the source's number modulo 4; 'dom?' for names without a number."""
    digits = F.regexp_extract(source, "([0-9]{1,9})", 1)
    return F.when(digits == "", F.lit("dom?")).otherwise(F.concat(F.lit("dom"), (digits.cast("long") % 4).cast("string")))


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level (others: the default), the budget in thousandths of all tokens, and the seed.

    budget_permille None: the largest budget at which no domain is short, so that the domains reach their target shares.
    """

    domain: dict[str, int] = field(default_factory=lambda: {"dom0": 40, "dom1": 30, "dom2": 20, "dom3": 10})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source: dict[str, int] = field(default_factory=dict)
    default: int = 5
    budget_permille: int | None = 600
    max_epochs: int = 3
    seed: int = 17

    def weight(self, level: str) -> Column:
        out = F.lit(self.default)
        for name, w in sorted(getattr(self, level).items()):
            if w < 1:
                raise ValueError("weights are integers from 1")
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out.cast("long")


def tokens_of(text: Column) -> Column:
    """Tokens: runs of characters other than white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens; nulls in lang and source become '?'."""
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain_of_source(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"),
        source.alias("source"),
        tokens_of(F.col("text")).alias("n_tokens"),
    )


def _share(parents: DataFrame, children: DataFrame, over: list[str], name: str, mix: Mix) -> DataFrame:
    """Split each parent's budget among its children: those that it would overfill take their cap, the others the
    rest in proportion to weight, rounded down."""
    w = Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))
    order = w.orderBy(F.col("cap") / F.col("w"), name)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    x = children.withColumn("w", mix.weight(name))
    x = x.join(parents, over) if over else x.crossJoin(F.broadcast(parents))  # without over, parents is the one root row
    x = (
        x.withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("ws", F.sum("w").over(w) - F.sum("w").over(upto) + F.col("w"))
        .withColumn("full", F.col("cap") * F.col("ws") <= F.col("rest") * F.col("w"))
    )
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(name), F.col("rest"), F.col("ws")))).over(w)
    x = x.withColumn("open", first)
    part = F.expr("open.rest * w div open.ws")
    return x.select(*over, name, F.when(F.col("full"), F.col("cap")).otherwise(part).alias("budget"))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, supply, budget for leaves (domain, lang, source, supply), one row each."""
    caps = leaves.withColumn("cap", F.col("supply") * mix.max_epochs)
    if mix.budget_permille is None:
        top = caps.groupBy(LEVELS[0]).agg(F.sum("cap").alias("cap")).withColumn("w", mix.weight(LEVELS[0]))
        total = F.broadcast(top.agg(F.sum("w").alias("ws")))  # one row
        budget = top.crossJoin(total).agg(F.expr("coalesce(min(cap * ws div w), 0L)").alias("budget"))
    else:
        budget = leaves.agg(F.expr(f"coalesce(sum(supply), 0L) * {mix.budget_permille} div 1000").alias("budget"))
    for depth, name in enumerate(LEVELS):
        below = caps.groupBy(*LEVELS[: depth + 1]).agg(F.sum("cap").alias("cap"))
        budget = _share(budget, below, list(LEVELS[:depth]), name, mix)
    return budget.join(leaves, list(LEVELS))


def plan(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row for each leaf with tokens: supply, budget, whole epochs and last_key, the last order key that the begun epoch
    takes (the empty string: none). Reads docs' columns doc_id, lang, source and text."""
    mix = mix or Mix()
    named = materialize(_named(docs))
    leaves = named.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")).where("supply > 0")
    budgets = materialize(
        leaf_budgets(leaves, mix)
        .withColumn("epochs", F.expr("budget div supply"))
        .withColumn("rest", F.expr("budget % supply"))
    )
    rows = named.join(bounded_broadcast(budgets), list(LEVELS)).withColumn("key", order_key(mix))
    rows = rows.select(*LEVELS, "key", "n_tokens", "rest")
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for digits in range(BUCKET_HEX, BUCKET_HEX * ROUNDS + 1, BUCKET_HEX):
        rows = rows.withColumn("bucket", F.substring("key", 1, digits))
        sums = (
            rows.groupBy(*LEVELS, "bucket")
            .agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
            .withColumn("upto", F.sum("n").over(run))
        )
        cut = materialize(
            sums.where("upto > rest")
            .groupBy(*LEVELS)
            .agg(F.min("bucket").alias("bucket"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "bucket").alias("left"))
        )
        rows = rows.drop("rest").join(bounded_broadcast(cut), [*LEVELS, "bucket"])
        rows = materialize(rows.select(*LEVELS, "key", "n_tokens", F.col("left").alias("rest")))
    peers = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        rows.withColumn("upto", F.sum("n_tokens").over(peers))
        .where(F.col("upto") <= F.col("rest"))
        .groupBy(*LEVELS)
        .agg(F.max("key").alias("key"))
    )
    found = cut.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("key", "bucket").alias("last_key"))
    return materialize(
        budgets.join(found, list(LEVELS), "left").withColumn("last_key", F.coalesce("last_key", F.lit("")))
    )


def order_key(mix: Mix) -> Column:
    """A document's place in its leaf's begun epoch."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, leaf_budget, n_copies for every row: how often the mixture takes it.

    Null languages and sources count as '?', null texts have no tokens. A document without tokens is never taken.
    Rows of one doc_id in one leaf share an order key and are taken or left together, so a leaf stays within its
    budget by less than one document (or group of such rows). An empty table gives no rows.
    """
    mix = mix or Mix()
    leaf = bounded_broadcast(plan(docs, mix).select(*LEVELS, "budget", "epochs", "last_key"))
    x = _named(docs).join(leaf, list(LEVELS), "left")
    take = (F.col("n_tokens") > 0) & (order_key(mix) <= F.col("last_key"))
    copies = F.when(F.col("n_tokens") > 0, F.col("epochs") + take.cast("long"))
    return x.select(
        "doc_id", *LEVELS, "n_tokens",
        F.coalesce("budget", F.lit(0)).cast("long").alias("leaf_budget"),
        F.coalesce(copies, F.lit(0)).cast("long").alias("n_copies"),
    )


def keep_mixture(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of docs that the mixture takes, with all their columns, once for each time taken."""
    mix = mix or Mix()
    leaf = plan(docs, mix).select(F.struct(*LEVELS).alias("__leaf"), F.struct("epochs", "last_key").alias("__plan"))
    source = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("?"))
    x = docs.withColumn("__leaf", F.struct(domain_of_source(source).alias("domain"), lang.alias("lang"), source.alias("source")))
    x = x.join(bounded_broadcast(leaf), "__leaf")
    key = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("__plan.epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    some = F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    times = F.when(some, F.col("__plan.epochs") + (key <= F.col("__plan.last_key")).cast("long")).otherwise(0)
    if mix.max_epochs == 1:
        return x.where(times > 0).select(*docs.columns)
    copies = F.explode(F.when(times > 0, F.array_repeat(F.lit(0), times.cast("int"))))
    return x.select(*docs.columns, copies.alias("__copy")).select(*docs.columns)


def oracle(mix: Mix | None = None) -> str:
    """The same in DuckDB SQL, with one window over each leaf instead of buckets."""
    mix = mix or Mix()

    def weight(level: str) -> str:
        cases = "".join(f" when '{k}' then {v}" for k, v in sorted(getattr(mix, level).items()))
        return f"case {level}{cases} else {mix.default} end" if cases else str(mix.default)

    def share(depth: int) -> str:
        name, over = LEVELS[depth], ", ".join(LEVELS[:depth])
        by = f"partition by {over}" if over else ""
        join = f"join b{depth} using ({over})" if over else "cross join b0"
        keys = ", ".join(LEVELS[: depth + 1])
        return f"""
  c{depth} as (select {keys}, sum(supply) * {mix.max_epochs} as cap, {weight(name)} as w from leaves group by {keys}),
  r{depth} as (select *, budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as rest,
      sum(w) over (o rows between current row and unbounded following) as ws
    from c{depth} {join} window o as ({by} order by cap / w, {name})),
  f{depth} as (select *, cap * ws <= rest * w as is_full from r{depth}),
  g{depth} as (select *, min(case when not is_full then rest end) over ({by}) as x,
      arg_max(rest, case when is_full then null else ws end) over ({by}) as orest,
      max(case when is_full then null else ws end) over ({by}) as ows from f{depth}),
  b{depth + 1} as (select {keys}, case when is_full then cap else orest * w // ows end as budget from g{depth}),"""

    if mix.budget_permille is None:
        root = f"select coalesce(min(cap * ws // w), 0) as budget from (select sum(supply) * {mix.max_epochs} as cap, {weight('domain')} as w, sum({weight('domain')}) over () as ws from leaves group by domain)"
    else:
        root = f"select sum(supply) * {mix.budget_permille} // 1000 as budget from leaves"
    return f"""with d as (select doc_id, coalesce(lang, '?') as lang, coalesce(source, '?') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) as n_tokens from documents),
  named as (select *, case when regexp_extract(source, '([0-9]{{1,9}})', 1) = '' then 'dom?'
    else 'dom' || (cast(regexp_extract(source, '([0-9]{{1,9}})', 1) as bigint) % 4) end as domain from d),
  leaves as (select domain, lang, source, sum(n_tokens) as supply from named group by all having sum(n_tokens) > 0),
  b0 as ({root}),{share(0)}{share(1)}{share(2)}
  leaf as (select *, budget // supply as epochs, budget % supply as rest from b3 join leaves using (domain, lang, source)),
  k as (select named.*, budget, epochs, rest, md5('{mix.seed}:' || epochs || ':' || doc_id) as key
    from named left join leaf using (domain, lang, source)),
  s as (select *, sum(n_tokens) over (partition by domain, lang, source order by key) as upto from k)
select doc_id, domain, lang, source, cast(n_tokens as bigint) as n_tokens, cast(coalesce(budget, 0) as bigint) as leaf_budget,
  cast(case when n_tokens > 0 then epochs + case when upto <= rest then 1 else 0 end else 0 end as bigint) as n_copies
from s"""
