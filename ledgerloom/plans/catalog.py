"""Registered queries over the graph view, each with the DuckDB SQL that gives the same rows.

Queries round what they compare between engines; operators don't.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import discovery, evaluate, features, gnn, ingest, labels, learn, report, search
from ledgerloom.operators.features import rounded
from ledgerloom.runtime import materialize
from ledgerloom.sources.graphview import FEATURES, GraphView, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: CTEs of the graph view; each oracle names those that it needs, and gets them with all that they need.
CTE: dict[str, tuple[str, str]] = {
    "raw_nodes": ("", "select 'c' || c_custkey as orig_id, c_acctbal as size from customer union all select 's' || s_suppkey, s_acctbal from supplier"),
    "nodes": ("raw_nodes", "select row_number() over (order by orig_id) - 1 as idx, orig_id, size from raw_nodes"),
    "raw_edges": ("", """select case when l_returnflag = 'R' then 's' || l_suppkey else 'c' || o_custkey end as x, case when l_returnflag = 'R' then 'c' || o_custkey else 's' || l_suppkey end as y,
      l_extendedprice as weight, cast(date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as double) as ts, l_quantity as quantity, l_discount as discount, l_tax as tax
      from lineitem join orders on l_orderkey = o_orderkey"""),
    "edges": ("nodes raw_edges", "select a.idx as src, b.idx as dst, weight, ts, quantity, discount, tax from raw_edges join nodes a on a.orig_id = x join nodes b on b.orig_id = y"),
    "links": ("nodes", """select a.idx as src, b.idx as dst from (select o_custkey as x, lead(o_custkey) over (partition by date_trunc('month', o_orderdate)
      order by o_orderdate, o_orderkey) as y from orders) join nodes a on a.orig_id = 'c' || x join nodes b on b.orig_id = 'c' || y"""),
    "paths": ("edges links", "select src, dst from edges where src <> dst union select src, dst from links where src <> dst"),
    "raw_members": ("", "select 'c' || c_custkey as clid, c_nationkey || ':' || c_mktsegment as ccid, c_acctbal from customer"),
    "comps": ("raw_members", """select row_id, ccid, case when ntile(10) over (order by mean, ccid) = 1 then 'suspicious' else 'licit' end as label
      from (select row_number() over (order by mean, ccid) - 1 as row_id, * from (select ccid, round(sum(c_acctbal), 2) / count(*) as mean from raw_members group by ccid))"""),
    "members": ("raw_members comps nodes", """select dense_rank() over (order by ccid) - 1 as pos, ccid, label, idx from raw_members join comps using (ccid) join nodes on orig_id = clid"""),
    "splits": ("comps", """select ccid as id, label, case when r < floor(n * 0.1) then 'val' when r < floor(n * 0.1) + floor(n * 0.1) then 'test' else 'train' end as split
      from (select *, row_number() over (partition by label order by md5('0:' || ccid), ccid) - 1 as r, count(*) over (partition by label) as n from comps)"""),
    "labels": ("members splits", "select distinct idx, pos, v_members.label, split = 'test' as is_test from members join splits on id = ccid"),
    "suspects": ("members", "select distinct idx from members where label = 'suspicious'"),
    "ends": ("nodes", "select idx from nodes where size >= (select quantile_cont(size, 0.98) from nodes)"),
    "und": ("paths", "select src as a, dst as b from paths union select dst, src from paths"),
    "deg": ("nodes edges", """select idx, coalesce(i, 0) as in_degree, coalesce(o, 0) as out_degree, coalesce(i, 0) + coalesce(o, 0) as total_degree,
      case when coalesce(o, 0) > 0 then coalesce(i, 0) / o else 0 end as in_out_ratio from nodes
      left join (select src as idx, count(*) as o from edges group by src) using (idx) left join (select dst as idx, count(*) as i from edges group by dst) using (idx)"""),
    "ev": ("edges", "select src as idx, ts, weight from edges union all select dst, ts, weight from edges"),
    "thr": ("nodes ev", "select idx, round(coalesce(w, 0), 2) as throughput from nodes left join (select idx, sum(weight) as w from ev group by idx) using (idx)"),
    "chan": ("deg thr nodes", "select idx, in_degree, out_degree, size, throughput from deg join thr using (idx) join nodes using (idx)"),
    "pct": ("chan", "select idx, " + ", ".join(
        f"(rank() over (order by {c}) - 1 + (count(*) over (partition by {c}) - 1) / 2.0) / (count(*) over () - 1) as p_{c[0]}" for c in ("in_degree", "out_degree", "size", "throughput")) + " from chan"),
    "role": ("pct", "select idx, (p_i + p_s + p_t) / 3 as endpoint_score, (p_o + p_s + p_t) / 3 as source_score, p_i - p_o as source_sink_axis from pct"),
    "back": ("paths ends", "select idx, min(hop) as hop from bk group by idx"),
    "fwd": ("paths suspects", "select idx, min(hop) as hop from fw group by idx"),
    "known": ("members", "select distinct idx from members"),
    "sig": ("nodes", "select idx, cast(('0x' || substr(md5(cast(idx as varchar)), 1, 4))::int as double) / 65536 as signal from nodes"),
    "gate": ("nodes known", "select idx, size as score from nodes where size >= (select quantile_cont(size, 0.9) from nodes) and idx not in (select idx from known) order by size desc, idx limit 1000"),
    "border": ("edges members", """select distinct pos, role, idx from (
      select m.pos, 'sender' as role, src as idx from edges join members m on m.idx = dst left join members s on s.idx = src where s.pos is distinct from m.pos
      union all select m.pos, 'receiver', dst from edges join members m on m.idx = src left join members r on r.idx = dst where r.pos is distinct from m.pos)"""),
    "scored": ("", "select d.doc_id, round(n_chars / 40000.0, 2) as score, quality as label from documents d join labels l using (doc_id)"),
    "lead": ("members", "select distinct pos, ccid, label from members"),
}
RECURSIVE = {
    "back": ("bk(idx, hop)", "select idx, 0 from ends union select src, hop + 1 from bk join paths on dst = idx where hop < 6"),
    "fwd": ("fw(idx, hop)", "select idx, 0 from suspects union select dst, hop + 1 from fw join paths on src = idx where hop < 6"),
}


def sql(needs: str, body: str) -> str:
    """body behind the CTEs that it needs. The tables labels and nodes of the view hide none of the driver's in their own text."""
    parts: list[str] = []
    done: set[str] = set()

    def add(name: str) -> None:
        if name in done:
            return
        done.add(name)
        before, text = CTE[name]
        for b in before.split():
            add(b)
        if name in RECURSIVE:
            head, step = RECURSIVE[name]
            parts.append(f"{head} as ({step})")
        parts.append(f"v_{name} as materialized ({text})")

    for n in needs.split():
        add(n)
    out = f"with recursive {', '.join(parts)} {body}"
    names = "|".join(sorted(done, key=len, reverse=True))
    return re.sub(rf"(?<=from )({names})\b|(?<=join )({names})\b", lambda m: f"v_{m[0]}", out)


def query(name: str, needs: str | None = None, body: str = ""):
    """Register a function of a GraphView; with needs, also its SQL."""

    def keep(f: Callable[[GraphView], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir))
        if needs is not None:
            ORACLES[name] = sql(needs, body)
        return f

    return keep


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(rounded(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns)


# ingest ---------------------------------------------------------------------------------------------------------------

query("id_map", "nodes", "select idx, orig_id from nodes")(lambda v: ingest.id_map(v.raw_nodes))
query("id_bijection", "raw_nodes", "select count(*) as n_rows, count(distinct orig_id) as n_ids, count(*) = count(distinct orig_id) as is_bijection from raw_nodes")(
    lambda v: ingest.id_bijection(v.raw_nodes)
)
query("remap_nodes", "nodes", "select idx, size from nodes")(lambda v: ingest.remap_nodes(v.raw_nodes, v.ids).select("idx", "size"))
query("remap_edges", "edges", "select src, dst, weight, ts, quantity, discount, tax from edges")(lambda v: ingest.remap_edges(v.raw_edges, v.ids))
query("dangling_edges", "raw_edges nodes", """select count(*) as n_edges, count(*) filter (a.idx is null or b.idx is null) as n_dangling from raw_edges
  left join (select * from nodes where size >= 0) a on a.orig_id = x left join (select * from nodes where size >= 0) b on b.orig_id = y""")(
    lambda v: ingest.dangling_edges(v.raw_edges, v.ids.join(v.nodes.where("size >= 0"), "idx"))
)
query("subgraphs", "members", """select pos, ccid as "ccId", label as "ccLabel", count(*) as n_members, string_agg(cast(idx as varchar), ',' order by idx) as members
  from members group by all""")(lambda v: v.groups.select("pos", "ccId", "ccLabel", "n_members", F.array_join("member_idx", ",").alias("members")))  # fmt: skip
query("orphan_counts", "raw_members nodes comps", """select count(*) as n_rows, count(*) filter (n.idx is null) as n_unknown_nodes, count(*) filter (c.ccid is null) as n_unknown_groups
  from raw_members m left join (select * from nodes where size >= 0) n on n.orig_id = m.clid left join (select * from comps where label = 'licit') c on c.ccid = m.ccid""")(
    lambda v: ingest.orphan_counts(v.raw_members, v.components.where("ccLabel = 'licit'"), v.ids.join(v.nodes.where("size >= 0"), "idx"))
)
query("membership_explode", "members", 'select pos, ccid as "ccId", label as "ccLabel", idx from members')(lambda v: v.members)
query("base_rate", "comps", """select count(*) as n_groups, count(*) filter (label = 'suspicious') as n_suspicious, count(*) filter (label = 'licit') as n_licit,
  round(count(*) filter (label = 'suspicious') / count(*), 6) as rate from comps""")(lambda v: _round(ingest.base_rate(v.components), "rate"))  # fmt: skip
query("finite_guard", "edges", " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null or not isfinite({c})) as n_bad from edges" for c in FEATURES))(
    lambda v: ingest.finite_guard(v.edges, FEATURES)
)
query("contiguous_idx", "nodes", "select count(*) as n_rows, min(idx) as lo, max(idx) as hi, count(distinct idx) as n_ids, count(*) = max(idx) + 1 as is_contiguous from nodes")(
    lambda v: ingest.contiguous_idx(v.nodes)
)
query("graph_validate", "edges nodes", """select (select count(*) from nodes) as n_nodes, count(*) as n_edges, count(*) filter (src < 0 or dst < 0) as n_out_of_range,
  count(*) filter (src = dst) as n_self_loops, count(*) filter (weight < 0) as n_negative_weights from edges""")(lambda v: ingest.graph_validate(v.nodes, v.edges))  # fmt: skip
query("edge_columns", "edges", "select src, dst, quantity, tax from edges")(lambda v: ingest.edge_columns(v.edges, ["quantity", "tax"]))

# features -------------------------------------------------------------------------------------------------------------

query("degree", "deg", f"select idx, in_degree, out_degree, total_degree, {_r('in_out_ratio')} from deg")(lambda v: _round(features.degree(v.nodes, v.edges), "in_out_ratio"))


@query("edge_aggs", "nodes edges", "select idx, " + ", ".join(
    f"coalesce({d}.{c}_{s}, 0) as {d}_{c}_{s}" for d in ("o", "i") for c in FEATURES for s in ("sum", "mean", "max", "std")).replace("as o_", "as out_").replace("as i_", "as in_")
    + " from nodes " + " ".join(f"left join (select {side} as idx, " + ", ".join(
        f"round(sum({c}), 2) as {c}_sum, round(round(sum({c}), 2) / count(*), 6) as {c}_mean, max({c}) as {c}_max, round(stddev_pop({c}), 6) as {c}_std" for c in FEATURES)
        + f" from edges group by {side}) {d} using (idx)" for d, side in (("o", "src"), ("i", "dst"))))
def _edge_aggs(v: GraphView) -> DataFrame:
    x = features.edge_aggs(v.nodes, v.edges, FEATURES).join(features.degree(v.nodes, v.edges).select("idx", "in_degree", "out_degree"), "idx")
    out = [F.col("idx")]
    for c in features.aggregate_columns(FEATURES):
        side, stat = c.split("_")[0], c.rsplit("_", 1)[1]
        exact = F.round(F.col(c.removesuffix("mean") + "sum"), 2) / F.nullif(F.col(f"{side}_degree"), F.lit(0)) if stat == "mean" else F.col(c)
        out.append(F.coalesce(F.round(exact, 2 if stat == "sum" else 6), F.lit(0.0)).alias(c))
    return x.select(*out)


query("counterparty_flow", "edges", "select src as idx, dst as other, round(sum(weight), 2) as w from edges group by all")(
    lambda v: features.counterparty_flow(v.edges).withColumn("w", F.round("w", 2))
)
_FLOW = [f"{d}_{s}" for d in ("out", "in") for s in ("gini", "hhi", "max_share")]
query("flow_concentration", "nodes edges", "select idx, " + ", ".join(f"coalesce({c}, 0.0) as {c}" for c in _FLOW) + " from nodes " + " ".join(f"""left join (
  select idx, round(least(greatest((2 * sum(r * w) - (count(*) + 1) * sum(w)) / (count(*) * sum(w)), 0), 1), 6) as {d}_gini, round(sum(w * w) / (sum(w) * sum(w)), 6) as {d}_hhi,
    round(max(w) / sum(w), 6) as {d}_max_share
  from (select *, row_number() over (partition by idx order by w, other) as r from (select {a} as idx, {b} as other, sum(weight) as w from edges group by all)) group by idx) using (idx)"""
  for d, a, b in (("out", "src", "dst"), ("in", "dst", "src"))))(lambda v: _round(features.flow_concentration(v.nodes, v.edges), *_FLOW))
query("temporal", "nodes ev", """select idx, coalesce(activity_span, 0) as activity_span, coalesce(round(burstiness, 6), 0) as burstiness from nodes left join (
  select idx, max(ts) - min(ts) as activity_span, case when stddev_pop(gap) + avg(gap) > 0 then (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) end as burstiness
  from (select idx, ts, ts - lag(ts) over (partition by idx order by ts) as gap from ev) group by idx) using (idx)""")(
    lambda v: _round(features.temporal(v.nodes, v.edges), "burstiness")
)
query("throughput", "thr", "select idx, throughput from thr")(lambda v: features.throughput(v.nodes, v.edges).withColumn("throughput", F.round("throughput", 2)))


def _channels(v: GraphView) -> DataFrame:
    x = features.degree(v.nodes, v.edges).select("idx", "in_degree", "out_degree").join(v.nodes, "idx")
    return x.join(features.throughput(v.nodes, v.edges), "idx").withColumn("throughput", F.round("throughput", 2))


_ROLE = ("endpoint_score", "source_score", "source_sink_axis")
query("path_role", "role", f"select idx, {_r(*_ROLE)} from role")(lambda v: _round(features.path_role(_channels(v)), *_ROLE))


def _neighborhood(v: GraphView) -> DataFrame:
    return labels.neighborhood(v.nodes, v.paths, labels.node_labels(v.members, v.splits))


_HOP2 = """hub as (select a from v_und group by a having count(*) > 100),
  far as (select distinct x.a, y.b from v_und x join v_und y on x.b = y.a where x.a <> y.b and x.a not in (from hub) and x.b not in (from hub) and y.b not in (from hub)),
  hop2 as (select a, b from far except select a, b from v_und)"""


def _frac(hop: int, pairs: str) -> str:
    known = "l.label is not null and not l.is_test and o.pos is distinct from l.pos"
    share = [f"count(*) filter ({known} and l.label = '{x}') / count(*)" for x in ("suspicious", "licit")]
    return f"""left join (select p.a as idx, round({share[0]}, 6) as hop{hop}_frac_suspicious, round({share[1]}, 6) as hop{hop}_frac_licit,
    round(1 - {share[0]} - {share[1]}, 6) + 0.0 as hop{hop}_frac_unknown
  from {pairs} p left join v_labels o on o.idx = p.a left join v_labels l on l.idx = p.b group by p.a) using (idx)"""


_NB = [f"hop{h}_frac_{c}" for h in (1, 2) for c in ("suspicious", "licit", "unknown")]


@query("neighborhood")
def _neighborhood_query(v: GraphView) -> DataFrame:
    return _round(_neighborhood(v), *_NB)


ORACLES["neighborhood"] = sql("nodes und labels", "").rstrip() + f""", {_HOP2} select idx, {', '.join(f'coalesce({c}, 0.0) as {c}' for c in _NB)} from v_nodes
  {_frac(1, 'v_und')} {_frac(2, 'hop2')}"""
query("two_hop")(lambda v: labels.two_hop(v.paths))
ORACLES["two_hop"] = sql("und", "").rstrip() + f", {_HOP2} select a, b from hop2"


@query("cluster_features")
def _cluster_features(v: GraphView) -> DataFrame:
    """Every block in one table; compared with SQL block by block above."""
    return features.cluster_features(v.nodes, v.edges, FEATURES, [_neighborhood(v)])


# labels and splits ----------------------------------------------------------------------------------------------------

query("node_labels", "labels", "select idx, pos, label, is_test from labels")(lambda v: labels.node_labels(v.members, v.splits))
query("labeled_members", "members splits", "select distinct idx from members join splits on id = ccid where split = 'train'")(lambda v: labels.labeled_members(v.members, v.splits, "train"))
query("positive_members", "members splits", "select distinct idx from members join splits on id = ccid where split = 'train' and members.label = 'suspicious'".replace("members.label", "v_members.label"))(
    lambda v: labels.positive_members(v.members, v.splits, "train")
)
query("known_members", "members splits", "select distinct idx from members join splits on id = ccid where split = 'test'")(lambda v: labels.known_members(v.members, v.splits, "test"))


def _ids(v: GraphView) -> DataFrame:
    return v.components.select("row_id", F.col("ccId").alias("id"), F.col("ccLabel").alias("label"))


query("split_stratified", "splits", "select id, label, split from splits")(lambda v: labels.split_stratified(_ids(v)))
query("split_random", "comps", """select ccid as id, label, case when r < floor(n * 0.1) then 'val' when r < floor(n * 0.1) + floor(n * 0.1) then 'test' else 'train' end as split
  from (select *, row_number() over (order by md5('0:' || ccid), ccid) - 1 as r, count(*) over () as n from comps)""")(lambda v: labels.split_random(_ids(v)))  # fmt: skip
query("split_round_robin", "comps", "select ccid as id, label, case when (row_id + 1) % 10 <= 7 then 'train' when (row_id + 1) % 10 = 8 then 'val' else 'test' end as split from comps")(
    lambda v: labels.split_round_robin(_ids(v))
)
query("split_counts", "splits", """select split, count(*) as n, count(*) filter (label = 'suspicious') as n_positive, count(*) filter (label <> 'suspicious') as n_negative,
  round(count(*) filter (label = 'suspicious') / count(*), 6) as rate from splits group by split""")(lambda v: _round(labels.split_counts(v.splits), "rate"))  # fmt: skip
query("split_hash", "splits", "select sha256(string_agg(id || chr(9) || split || chr(10), '' order by id || chr(9) || split || chr(10))) as sha256 from splits")(lambda v: labels.split_hash(v.splits))
query("splits_disjoint", "splits", """select a.split as split_a, b.split as split_b, count(distinct a.id) as n_shared from splits a join (select id, split from splits union all
  select id, 'audit' from splits where split = 'test') b on a.id = b.id and a.split < b.split group by all union all
  select 'audit', split, count(distinct id) from splits where split = 'test' group by split""")(
    lambda v: labels.splits_disjoint(v.splits.union(v.splits.where("split = 'test'").withColumn("split", F.lit("audit"))))
)
query("membership_fingerprint", "members deg", """select c as "column", flat and vals = n and n >= 2 as is_fingerprint from (
  select c, bool_and(lo = hi) as flat, count(distinct lo) as vals, count(*) as n from (
    select c, pos, min(x) as lo, max(x) as hi from (select pos, unnest(['in_degree', 'group']) as c, unnest([in_degree, pos]) as x from members join deg using (idx)) group by c, pos) group by c)""")(
    lambda v: labels.membership_fingerprint(
        features.degree(v.nodes, v.edges).select("idx", "in_degree").join(ingest.node_group(v.members).withColumnRenamed("pos", "group"), "idx", "left"), v.members, ["in_degree", "group"])
)
query("test_labels_masked", "labels deg", "select count(*) as n_test, count(*) filter (in_degree > 0) as n_exposed from labels join deg using (idx) where is_test")(
    lambda v: labels.test_labels_masked(features.degree(v.nodes, v.edges), labels.node_labels(v.members, v.splits), ["in_degree"])
)

# graph search ---------------------------------------------------------------------------------------------------------

query("adjacency", "edges", "select distinct src, dst from edges where src <> dst")(lambda v: search.adjacency(v.edges))
query("hubs", "edges", "select idx from (select src as idx from edges union all select dst from edges) group by idx having count(*) > 100")(lambda v: search.hubs(v.edges, 100))
query("bfs", "fwd", "select cast(0 as bigint) as grp, idx, cast(hop as int) as hop from fwd")(lambda v: search.bfs(v.paths, v.suspects))
query("bfs_hubs", "paths suspects edges", """select cast(0 as bigint) as grp, idx, cast(min(hop) as int) as hop from fh group by idx""")(
    lambda v: search.bfs(v.paths, v.suspects, hub=search.hubs(v.edges, 100))
)
ORACLES["bfs_hubs"] = ORACLES["bfs_hubs"].replace(" select cast(0", """, hb as (select idx from (select src as idx from v_edges union all select dst from v_edges) group by idx having count(*) > 100),
  fh(idx, hop) as (select idx, 0 from v_suspects union select dst, hop + 1 from fh join v_paths on src = idx where hop < 6 and (hop = 0 or idx not in (select idx from hb)))
  select cast(0""", 1)  # fmt: skip
query("bfs_capped")(lambda v: search.bfs(v.paths, v.suspects, cap=50))
query("reachability", "fwd back", "select cast(0 as bigint) as grp, f.idx, cast(f.hop as int) as fwd, cast(b.hop as int) as back from fwd f join back b on f.idx = b.idx")(
    lambda v: search.reachability(v.paths, v.suspects, v.ends)
)
query("survivors", "fwd back", """select cast(0 as bigint) as grp, f.idx, cast(f.hop as int) as fwd, cast(b.hop as int) as back from fwd f join back b on f.idx = b.idx
  where f.hop + b.hop <= 6""")(lambda v: search.survivors(search.reachability(v.paths, v.suspects, v.ends)))  # fmt: skip
query("induced_subgraph", "paths suspects", """select p.src, p.dst, a.n as new_src, b.n as new_dst from paths p join (select idx, row_number() over (order by idx) - 1 as n
  from (select idx from suspects union select dst from paths join suspects on src = idx)) a on a.idx = src join (select idx, row_number() over (order by idx) - 1 as n
  from (select idx from suspects union select dst from paths join suspects on src = idx)) b on b.idx = dst""")(
    lambda v: search.induced_subgraph(v.paths, search.bfs(v.paths, v.suspects, max_hops=1))
)
_CARVE = sql("gate back", "").rstrip() + """, cf(grp, idx, hop) as (select idx, idx, 0 from v_gate union select grp, dst, hop + 1 from cf join v_paths on src = idx where hop < 6),
  carved as (select grp as candidate, c.idx from (select grp, idx, min(hop) as hop from cf group by all) c join v_back b on b.idx = c.idx where c.hop + b.hop <= 6 and c.idx not in (select idx from v_ends))"""
query("carve")(lambda v: search.carve(v.paths, discovery.gate1(v.scores, labels.known_members(v.members)), v.ends))
ORACLES["carve"] = _CARVE + " select candidate, idx from carved"
query("endpoints", "role", "select idx from (select idx, round(endpoint_score, 9) as s from role) where s >= (select quantile_cont(round(endpoint_score, 9), 0.99) from role)")(
    lambda v: search.endpoints(features.path_role(_channels(v)).withColumn("endpoint_score", F.round("endpoint_score", 9)), q=0.99)
)
query("exit_paths")(lambda v: search.exit_paths(v.paths, v.members, v.ends).select("pos", F.array_join("path", ">").alias("path")))
ORACLES["exit_paths"] = sql("members back", "").rstrip() + """, nxt as (select x.idx, min(dst) as to_idx from v_back x join v_paths on src = x.idx join v_back y on y.idx = dst and y.hop = x.hop - 1 group by x.idx),
  st as (select pos, arg_min(idx, hop * 1000000000::bigint + idx) as idx from v_members join v_back using (idx) group by pos),
  tr(pos, idx, path) as (select pos, idx, cast(idx as varchar) from st union all select pos, to_idx, path || '>' || to_idx from tr join nxt using (idx)),
  best as (select pos, arg_max(path, length(path) - length(replace(path, '>', ''))) as path from tr group by pos)
  select pos, coalesce(path, '') as path from (select distinct pos from v_members) left join best using (pos)"""  # fmt: skip
query("border_sets", "border", "select pos, role, idx from border")(lambda v: search.border_sets(v.edges, v.members))
query("border_sets_capped", "border", "select pos, role, idx from border qualify row_number() over (partition by pos, role order by md5('0:' || idx), idx) <= 64")(
    lambda v: search.border_sets_capped(search.border_sets(v.edges, v.members))
)


query("internal_edges", "members links", "select a.pos, src, dst from links join members a on a.idx = src join members b on b.idx = dst and b.pos = a.pos")(
    lambda v: search.internal_edges(v.links, v.members)
)
query("neighbor_sample", "paths suspects", """, h1 as (select src, dst from v_paths join v_suspects on dst = idx qualify row_number() over (partition by dst order by md5('0:' || src || ':' || dst), src) <= 15),
  f1 as (select distinct src as idx from h1 except select idx from v_suspects),
  h2 as (select src, dst from v_paths join f1 on dst = idx qualify row_number() over (partition by dst order by md5('1:' || src || ':' || dst), src) <= 10)
  select 1 as hop, src, dst from h1 union all select 2, src, dst from h2""")(lambda v: search.neighbor_sample(v.paths, v.suspects))  # fmt: skip
ORACLES["neighbor_sample"] = ORACLES["neighbor_sample"].replace(") , h1", "), h1")
query("seed_batches", "suspects", "select (row_number() over (order by md5('0:' || idx), idx) - 1) // 16 as batch, idx from suspects")(lambda v: search.seed_batches(v.suspects, 16))
_W_EGO, _W_NEIGH = np.array([[0.5, -0.25], [0.125, 1.0]]), np.array([[1.0, 0.5], [-0.5, 0.25]])


@query("ego_neighbor_conv", "nodes paths", """select idx, round(0.5 * floor(size) + 1.0 * coalesce(a, 0) + -0.25 * (idx % 7) + 0.5 * coalesce(b, 0), 8) + 0.0 as y0,
  round(0.125 * floor(size) + -0.5 * coalesce(a, 0) + 1.0 * (idx % 7) + 0.25 * coalesce(b, 0), 8) + 0.0 as y1 from nodes left join (
  select dst as idx, sum(floor(size)) / count(*) as a, sum(idx % 7) / count(*) as b from paths join nodes on idx = src group by dst) using (idx)""")
def _ego(v: GraphView) -> DataFrame:
    x = v.nodes.select("idx", F.array(F.floor("size").cast("double"), (F.col("idx") % 7).cast("double")).alias("x"))
    y = search.ego_neighbor_conv(x, v.paths, _W_EGO, _W_NEIGH)
    return y.select("idx", *((F.round(F.col("x")[i], 8) + 0.0).alias(f"y{i}") for i in range(2)))


@query("encoder_forward")
def _encoder(v: GraphView) -> DataFrame:
    x = v.nodes.select("idx", F.array(F.col("size") / 10000, (F.col("idx") % 7).cast("double")).alias("x"))
    y = search.encode(x, v.paths, [(_W_EGO, _W_NEIGH), (_W_NEIGH, _W_EGO)], normalize=True)
    return y.select("idx", *(F.round(F.col("x")[i], 6).alias(f"y{i}") for i in range(2)))


# metrics --------------------------------------------------------------------------------------------------------------


def _scored(v: GraphView) -> DataFrame:
    x = v.table("documents").join(v.table("labels"), "doc_id")
    return x.select("doc_id", F.round(F.col("n_chars") / 40000.0, 2).alias("score"), F.col("quality").alias("label"))


query("pr_auc", "scored", """select round(sum(tp / total * cum_tp / cum_n), 6) as average_precision from (select tp, sum(tp) over (order by score desc) as cum_tp,
  sum(n) over (order by score desc) as cum_n, sum(tp) over () as total from (select score, sum(label) as tp, count(*) as n from scored group by score))""")(
    lambda v: _round(evaluate.pr_auc(_scored(v)), "average_precision")
)
query("pu_metrics", "scored", """select n, n_positive, n_predicted, round(2 * tp / (n_positive + n_predicted), 6) as f1, round(tp / n_positive, 6) as recall,
  round(coalesce((tp / n_positive) * (tp / n_positive) * n / nullif(n_predicted, 0), 0), 6) as lee_liu from (select count(*) as n, count(*) filter (label = 1) as n_positive,
  count(*) filter (score >= 0.05) as n_predicted, count(*) filter (label = 1 and score >= 0.05) as tp from scored)""")(
    lambda v: _round(evaluate.pu_metrics(_scored(v), 0.05), "f1", "recall", "lee_liu")
)
query("nnpu_risk", "scored", """select round(pr, 6) as positive_risk, round(nr, 6) as negative_risk, nr < 0 as clamped, round(pr + nr, 6) as upu_risk, round(pr + greatest(nr, 0), 6) as nnpu_risk,
  round(case when nr < 0 then -nr else pr + nr end, 6) as surrogate from (select 0.3 * avg(1 / (1 + exp(score))) filter (label = 1) as pr,
  avg(1 / (1 + exp(-score))) filter (label = 0) - 0.3 * avg(1 / (1 + exp(-score))) filter (label = 1) as nr from scored)""")(
    lambda v: _round(evaluate.nnpu_risk(_scored(v).select(F.col("score").alias("z"), (F.col("label") == 1).alias("is_positive")), 0.3),
                     "positive_risk", "negative_risk", "upu_risk", "nnpu_risk", "surrogate")
)


@query("tice_prior")
def _tice(v: GraphView) -> DataFrame:
    """At the default depth; tested against a brute-force version."""
    x = v.table("documents").join(v.table("labels"), "doc_id")
    x = x.select((F.col("n_chars") / 40000.0).alias("size"), F.col("toxic").cast("double").alias("toxic"), (F.col("quality") == 1).alias("labeled"))
    return _round(evaluate.tice_prior(x, ["size", "toxic"]), "prior", "label_frequency", "labeled_fraction")


query("prior_grid", "", "")(lambda v: _round(evaluate.prior_grid(v.spark, include=0.02), "prior"))
ORACLES["prior_grid"] = "select round(pow(10.0, i - 5), 6) as prior from range(5) t(i) union select 0.02"


@query("recovery")
def _recovery(v: GraphView) -> DataFrame:
    found = _discovered(v).select(F.col("candidate").alias("id"), F.explode("member_idx").alias("idx"))
    x = evaluate.recovery(found, discovery.recovery_targets(v.members, v.splits, "train"), v.nodes.count())
    return _round(x, "rate", "baseline", "lift")


ORACLES["recovery"] = _CARVE.replace("with recursive", "with recursive", 1) + """, u as (select distinct idx from carved), sz as (select count(*) as d from u), nn as (select count(*) as n from v_nodes),
  tg as (select pos, idx from v_members join (select ccid as id from v_comps) on id = ccid where label = 'suspicious' and ccid in (select id from v_splits where split = 'train')),
  per as (select pos, max(case when u.idx is null then 0 else 1 end) as hit, count(distinct tg.idx) as m from tg left join u on u.idx = tg.idx group by pos),
  ch as (select pos, hit, case when m > n - d then 1.0 else 1 - (select product((n - d - i) / (n - i)) from range(m) r(i)) end as c from per, sz, nn)
  select count(*) as n_targets, cast(sum(hit) as bigint) as n_recovered, round(avg(hit), 6) as rate, round(avg(c), 6) as baseline, round(case when avg(c) > 0 then avg(hit) / avg(c)
    when avg(hit) > 0 then cast('inf' as double) else 0 end, 6) as lift, cast(any_value(d) as int) as union_size from ch, sz"""  # fmt: skip
ORACLES["recovery"] = ORACLES["recovery"].replace("v_gate as materialized", "v_splits as materialized (" + sql("splits", "").split("v_splits as materialized (")[1].rstrip()[:-1] + "), v_gate as materialized", 1)

# discovery ------------------------------------------------------------------------------------------------------------

query("score_gate", "nodes", "select idx, size as score from nodes where size >= (select quantile_cont(size, 0.9) from nodes)")(lambda v: discovery.score_gate(v.scores))
query("score_pct", "nodes", "select idx, size as score, round(cume_dist() over (order by size), 6) as score_pct from nodes")(lambda v: _round(discovery.score_pct(v.scores), "score_pct"))
query("gate1", "gate", "select idx, score from gate")(lambda v: discovery.gate1(v.scores, labels.known_members(v.members)))
query("typology_signal", "role", "select idx, round(source_sink_axis, 6) + 0.0 as signal from role")(lambda v: _round(discovery.typology_signal(features.path_role(_channels(v))), "signal"))
query("discover", "nodes back sig", """select row_number() over (order by score desc, idx) as rank, idx, score, score_pct, cast(hop as int) as hops, signal from (
  select idx, size as score, round(cume_dist() over (order by size), 6) as score_pct from nodes) join back using (idx) join sig using (idx)
  where score >= (select quantile_cont(size, 0.9) from nodes) and signal >= 0.25""")(
    lambda v: _round(discovery.discover(v.scores, v.paths, v.ends, v.signal, threshold=0.25), "score_pct")
)


def _discovered(v: GraphView) -> DataFrame:
    return discovery.discover_background(v.scores, v.paths, v.ends, v.signal, labels.known_members(v.members))


query("discover_background")(lambda v: _discovered(v).select("rank", "ccId", "ccLabel", "split", "candidate", "score", "n_members", F.array_join("member_idx", ",").alias("members")))
ORACLES["discover_background"] = _CARVE + """ select row_number() over (order by score desc, candidate) as rank, 'bg' || candidate as "ccId", 'unknown' as "ccLabel", 'discovered' as split, candidate, score, n_members, members
  from (select candidate, count(*) as n_members, string_agg(cast(idx as varchar), ',' order by idx) as members from carved group by candidate) join v_gate g on g.idx = candidate"""  # fmt: skip
query("recovery_targets", "members splits", "select pos as id, idx from members join splits on splits.id = ccid where split = 'train' and v_members.label = 'suspicious'".replace("splits.id", "v_splits.id"))(
    lambda v: discovery.recovery_targets(v.members, v.splits, "train")
)

# learning -------------------------------------------------------------------------------------------------------------

_VECTOR = [f"e{i}" for i in range(64)]


def _vectors(v: GraphView) -> DataFrame:
    """idx, label and the components of the embeddings."""
    return v.table("embeddings").select(F.col("vec_id").alias("idx"), "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_VECTOR)))


query("standardize", "", "")(lambda v: _round(learn.standardize(_vectors(v), _VECTOR).select("idx", *_VECTOR), *_VECTOR))
ORACLES["standardize"] = "select vec_id as idx, " + ", ".join(
    f"round((embedding[{i + 1}] - avg(cast(embedding[{i + 1}] as double)) over ()) / stddev_pop(cast(embedding[{i + 1}] as double)) over (), 6) + 0.0 as {c}" for i, c in enumerate(_VECTOR)) + " from embeddings"
query("fit_standardizer", "nodes members border", """select round(avg(size), 6) as size_mean, round(stddev_pop(size), 6) as size_std from nodes
  where idx in (select idx from members union select idx from border)""")(
    lambda v: _round(learn.fit_standardizer(v.nodes, v.members, search.border_sets(v.edges, v.members), ["size"]), "size_mean", "size_std")
)
query("class_weights", "scored", """select doc_id, score, label, round(case when label = 1 then (select count(*) filter (label = 0) / count(*) filter (label = 1) from scored) else 1 end, 6) as weight
  from scored""")(lambda v: _round(learn.class_weights(_scored(v)), "weight"))  # fmt: skip
_POOLED = [f"{p}__size" for p in ("mean", "max", "min", "std", "sum")]
query("subgraph_pool", "members nodes", """select pos, round(round(sum(size), 2) / count(*), 8) as mean__size, max(size) as max__size, min(size) as min__size, round(stddev_pop(size), 5) as std__size,
  round(sum(size), 2) as sum__size from members join nodes using (idx) group by pos""")(
    lambda v: learn.subgraph_pool(v.members, v.nodes, ["size"]).join(v.groups.select("pos", "n_members"), "pos").select(
        "pos", F.round(F.round("sum__size", 2) / F.col("n_members"), 8).alias("mean__size"), "max__size", "min__size", F.round("std__size", 5).alias("std__size"), F.round("sum__size", 2).alias("sum__size"))
)
query("segment_pool", "members nodes", """select pos, coalesce(round(sum(size), 2), 0) as sum__size, coalesce(round(round(sum(size), 2) / count(size), 8), 0) as mean__size, coalesce(max(size), 0) as max__size
  from members left join (select idx, size from nodes where size > 5000) using (idx) group by pos""")(
    lambda v: learn.segment_pool(v.members, v.members.join(v.nodes.where("size > 5000"), "idx"), ["size"]).join(
        v.members.join(v.nodes.where("size > 5000"), "idx").groupBy("pos").agg(F.count("*").alias("n")), "pos", "left").select(
        "pos", F.round("sum__size", 2).alias("sum__size"), F.coalesce(F.round(F.round("sum__size", 2) / F.col("n"), 8), F.lit(0.0)).alias("mean__size"), "max__size")
)
query("mil_max_pool", "members nodes", "select pos, coalesce(max(size), 0) as score from members left join nodes using (idx) group by pos")(lambda v: learn.mil_max_pool(v.members, v.scores))
query("set_batch", "members border nodes", """select pos, role, idx, size from (select pos, 'internal' as role, idx from members union select pos, role, idx from border) join nodes using (idx)""")(
    lambda v: learn.set_batch(v.members, search.border_sets(v.edges, v.members), v.nodes, ["size"])
)


def _node_table(v: GraphView) -> DataFrame:
    x = features.degree(v.nodes, v.edges).join(v.nodes, "idx").join(features.flow_concentration(v.nodes, v.edges), "idx")
    return x.select("idx", *(F.col(c).cast("double").alias(c) for c in x.columns if c != "idx"))


@query("gbt_groups")
def _gbt_groups(v: GraphView) -> DataFrame:
    table = _node_table(v)
    rows = learn.pooled_rows(v.members, table, v.splits, [c for c in table.columns if c != "idx"]).cache()
    columns = [c for c in rows.columns if "__" in c]
    model = learn.TreeScorer(columns, max_iter=20, max_depth=3).fit(rows.where("split = 'train'"))
    return model.score(rows).select("pos", "ccId", "label", "split", F.round("score", 4).alias("score"))


@query("gbt_nodes")
def _gbt_nodes(v: GraphView) -> DataFrame:
    table = _node_table(v)
    rows = learn.node_rows(v.members, table, v.splits, "train").cache()
    model = learn.TreeScorer([c for c in table.columns if c != "idx"], max_iter=10, max_depth=3).fit(rows)
    return model.score(table).select("idx", F.round("score", 4).alias("score"))


@query("deep_sets")
def _deep_sets(v: GraphView) -> DataFrame:
    table = _node_table(v)
    columns = [c for c in table.columns if c != "idx"]
    border = search.border_sets_capped(search.border_sets(v.edges, v.members))
    rows = learn.set_batch(v.members, border, learn.standardize(table, columns), columns).cache()
    y = v.members.select("pos", "ccId", (F.col("ccLabel") == "suspicious").cast("int").alias("label")).distinct().join(v.splits.select(F.col("id").alias("ccId"), "split"), "ccId")
    model = learn.DeepSets(columns, hidden=8, epochs=60).fit(rows, y.where("split = 'train'"))
    return model.score(rows).select("pos", F.round("score", 4).alias("score"))


@query("nnpu_scorer")
def _nnpu_scorer(v: GraphView) -> DataFrame:
    table = _node_table(v)
    columns = [c for c in table.columns if c != "idx"]
    x = materialize(learn.standardize(table, columns).select("idx", F.array(*columns).alias("x")))
    model = gnn.GraphScorer(len(columns), hidden=(16, 8), epochs=10, seeds=1024).fit(x, v.paths, labels.positive_members(v.members, v.splits, "train"), 0.1)
    return model.score(x, v.paths).select("idx", F.round("score", 4).alias("score"))


@query("prior_estimate")
def _prior_estimate(v: GraphView) -> DataFrame:
    x = gnn.estimate_prior(features.degree(v.nodes, v.edges).join(v.nodes, "idx"), labels.positive_members(v.members, v.splits, "train"), ["size", "in_degree"])
    return _round(x, "prior", "label_frequency", "labeled_fraction")


# reports --------------------------------------------------------------------------------------------------------------


def _lead(v: GraphView) -> tuple[DataFrame, DataFrame]:
    return report.lead_graph(v.edges, v.members)


_LEAD = """, d as (select distinct src, dst from v_edges), x as (select src, dst, a.pos as pa, b.pos as pb from d left join v_members a on a.idx = src left join v_members b on b.idx = dst),
  snd as (select pos, idx, 'sender' as role from (select pb as pos, src as idx, min((src, dst)) as f from x where pb is not null and pa is distinct from pb group by all)
    qualify row_number() over (partition by pos order by f) <= 12),
  rcv as (select pos, idx, 'receiver' as role from (select pa as pos, dst as idx, min((src, dst)) as f from x where pa is not null and pa is distinct from pb
    and (pa, dst) not in (select (pos, idx) from snd) group by all) qualify row_number() over (partition by pos order by f) <= 12),
  ln as (select distinct pos, idx, 'internal' as role from v_members union all select * from snd union all select * from rcv),
  le as (select pa as pos, src, dst from x where pa = pb union select pb, src, dst from x join snd on snd.pos = pb and snd.idx = src where pa is distinct from pb
    union select pa, src, dst from x join ln on ln.pos = pa and ln.idx = dst and ln.role <> 'internal' where pa is distinct from pb),
  sg as (select pos, n, coalesce(m, 0) as m, coalesce(mi, 0) as max_in, coalesce(mo, 0) as max_out, case when n > 1 then coalesce(m, 0) / (n - 1) else 0 end as linearity
    from (select pos, count(distinct idx) as n from ln group by pos) left join (select pos, count(*) as m from le group by pos) using (pos)
    left join (select pos, max(c) as mi from (select pos, dst, count(*) as c from le group by all) group by pos) using (pos)
    left join (select pos, max(c) as mo from (select pos, src, count(*) as c from le group by all) group by pos) using (pos)),
  ty as (select *, case when max_in >= 2 and max_out >= 2 then 'nested_service' when max_in >= 2 then 'consolidation' when max_out >= 2 then 'layering_smurfing'
    when linearity >= 0.5 then 'peeling_chain' end as rule from sg)"""  # fmt: skip
_LEADS = sql("edges members", "").rstrip() + _LEAD
query("lead_graph")(lambda v: _lead(v)[1])
ORACLES["lead_graph"] = _LEADS + " select pos, src, dst from le"
query("lead_nodes")(lambda v: _lead(v)[0])
ORACLES["lead_nodes"] = _LEADS + " select pos, idx, role from ln"
query("lead_layout")(lambda v: _round(report.lead_layout(_lead(v)[0]), "x", "y"))
ORACLES["lead_layout"] = _LEADS + """ select pos, idx, role, case role when 'sender' then -1.0::double when 'receiver' then 1.0 else 0.0 end as x,
  round(case when count(*) over w > 1 then 1 - 2 * (row_number() over (partition by pos, role order by idx) - 1) / (count(*) over w - 1) else 0 end, 6) + 0.0 as y from ln window w as (partition by pos, role)"""  # fmt: skip
query("structural_signals")(lambda v: _round(report.structural_signals(_lead(v)[1], _lead(v)[0]), "linearity"))
ORACLES["structural_signals"] = _LEADS + " select pos, n, m, max_in, max_out, round(linearity, 6) as linearity from sg"
query("lead_stats")(lambda v: report.lead_stats(*_lead(v)))
ORACLES["lead_stats"] = _LEADS + """ select pos, count(*) filter (role = 'internal') as n_internal, count(*) filter (role = 'sender') as n_senders, count(*) filter (role = 'receiver') as n_receivers,
  any_value(m) as n_edges, any_value(max_in) as max_in_degree, any_value(max_out) as max_out_degree from ln join sg using (pos) group by pos"""  # fmt: skip


def _signals(v: GraphView) -> DataFrame:
    nodes, graph = _lead(v)
    return report.structural_signals(graph, nodes)


query("typology")(lambda v: report.typology(_signals(v)))
ORACLES["typology"] = _LEADS + " select pos, case when n >= 2 then rule end as structural from ty"
query("typology_heuristic")(lambda v: report.typology_heuristic(_signals(v)))
ORACLES["typology_heuristic"] = _LEADS + """ select pos, coalesce(rule, 'layering_smurfing') as typology, cast(case rule when 'nested_service' then 0.8 when 'consolidation' then 0.75 when 'layering_smurfing' then 0.75
  when 'peeling_chain' then 0.7 else 0.4 end as double) as confidence from ty"""  # fmt: skip
query("typology_validate")(lambda v: report.typology_validate(report.typology(_signals(v)).withColumn("claimed", F.lit("consolidation"))).select("pos", "claimed", "structural", "agrees", "flagged", "final"))
ORACLES["typology_validate"] = _LEADS + """ select pos, 'consolidation' as claimed, s as structural, coalesce(s = 'consolidation', true) as agrees, not coalesce(s = 'consolidation', true) as flagged,
  coalesce(s, 'consolidation') as final from (select pos, case when n >= 2 then rule end as s from ty)"""  # fmt: skip
query("rank_leads", "members nodes", """select row_number() over (order by score desc, pos) as rank, pos, "ccId", score, round(place / n, 6) as percentile from (select *, row_number() over (order by score, pos) as place,
  count(*) over () as n from (select pos, ccid as "ccId", max(size) as score from members join nodes using (idx) group by all)) order by score desc, pos limit 20""")(
    lambda v: _round(report.rank_leads(_leads(v)), "percentile").withColumn("rank", F.col("rank").cast("long"))
)


def _leads(v: GraphView) -> DataFrame:
    return learn.mil_max_pool(v.members, v.scores).join(v.groups.select("pos", "ccId"), "pos")


query("bin_features", "members nodes", """select pos, idx, cast(case when hi > lo then least(floor((size - lo) / (hi - lo) * 10), 9) else 0 end as int) as size from (select pos, idx, size,
  min(size) over (partition by pos) as lo, max(size) over (partition by pos) as hi from members join nodes using (idx))""")(
    lambda v: report.bin_features(v.members.select("pos", "idx").join(v.nodes, "idx").select("pos", "idx", "size"), ["size"])
)
query("subgraph_int_id", "lead", 'select pos, ccid as "ccId", coalesce(try_cast(ccid as bigint), pos) as subgraph_id from lead')(lambda v: report.subgraph_int_id(v.groups))
query("local_exit_path")(lambda v: report.local_exit_path(*_lead(v)).select("pos", F.array_join("path", ">").alias("path")))


def _documents(v: GraphView) -> tuple[DataFrame, DataFrame]:
    leads = materialize(report.rank_leads(_leads(v)))
    nodes, graph = (materialize(x) for x in _lead(v))
    binned = report.bin_features(nodes.join(v.nodes, "idx").select("pos", "idx", "size"), ["size"])
    paths = materialize(search.exit_paths(v.paths, v.members, v.ends))
    return leads, materialize(report.candidate_docs(leads, nodes, graph, binned, ["size"], paths))


query("candidate_docs")(lambda v: _documents(v)[1].select("pos", "subgraph_id", "pu_score", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.size("exit_paths").alias("n_paths")))
query("serialize")(lambda v: report.serialize(_documents(v)[1], 4000))
query("cards")(lambda v: report.cards(*reversed(_documents(v))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nodes of the highest endpoint score, with degree, flow concentration and burstiness."""
    v = view(spark, sf_dir)
    x = features.path_role(_channels(v)).join(features.degree(v.nodes, v.edges), "idx")
    x = x.join(features.flow_concentration(v.nodes, v.edges), "idx").join(features.temporal(v.nodes, v.edges), "idx")
    x = x.select("idx", "endpoint_score", "total_degree", "in_gini", "out_gini", "burstiness")
    return _round(x, "endpoint_score", "in_gini", "out_gini", "burstiness").orderBy(F.desc("endpoint_score"), "idx").limit(20)


QUERIES["flagship"] = flagship
ORACLES["flagship"] = sql("role deg nodes edges ev", "").rstrip() + """, fl as (select o.idx, o.g as out_gini, i.g as in_gini from """ + " join ".join(
    f"""(select idx, least(greatest((2 * sum(r * w) - (count(*) + 1) * sum(w)) / (count(*) * sum(w)), 0), 1) as g from (select *, row_number() over (partition by idx order by w, other) as r
    from (select {a} as idx, {b} as other, sum(weight) as w from v_edges group by all)) group by idx) {n}""" for a, b, n in (("src", "dst", "o"), ("dst", "src", "i"))
) + """ on o.idx = i.idx), bu as (select idx, (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) as b from (select idx, ts - lag(ts) over (partition by idx order by ts) as gap from v_ev) group by idx)
  select idx, round(endpoint_score, 6) as endpoint_score, total_degree, coalesce(round(in_gini, 6), 0) as in_gini, coalesce(round(out_gini, 6), 0) as out_gini, coalesce(round(b, 6), 0) as burstiness
  from v_role join v_deg using (idx) left join fl using (idx) left join bu using (idx) order by round(endpoint_score, 6) desc, idx limit 20"""  # fmt: skip
