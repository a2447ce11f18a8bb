"""Typology rules, ranked leads, lead graphs, candidate documents and cards."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.ingest import node_group
from ledgerloom.operators.ranks import dense_ids
from ledgerloom.runtime import materialize, prepare_python

# fixed values: names of typologies, and the confidences of the offline classifier
NESTED, CONSOLIDATION, LAYERING, PEELING = "nested_service", "consolidation", "layering_smurfing", "peeling_chain"
CONFIDENCE = {NESTED: 0.8, CONSOLIDATION: 0.75, LAYERING: 0.75, PEELING: 0.7}
DEFAULT_CONFIDENCE = 0.4

#: What every card says at its end.
CAVEATS = (
    "A lead produced by a machine: a person has to review it before anything is done.",
    "Scores come from positive and unlabelled data; a high score doesn't prove illicit activity.",
    "Roles and endpoint types are derived by rules, not taken from labels.",
    "The typology is a classifier's verdict; a flagged one contradicts the structure.",
    "Expect false positives and look for independent evidence.",
)


def structural_signals(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """pos, n, m, max_in, max_out, linearity of each group's graph: nodes (pos, idx), graph edges (pos, src, dst)."""
    n = nodes.select("pos", "idx").distinct().groupBy("pos").agg(F.count("*").alias("n"))
    m = graph.groupBy("pos").agg(F.count("*").alias("m"))
    ends = {}
    for name, c in (("max_in", "dst"), ("max_out", "src")):
        ends[name] = graph.groupBy("pos", c).agg(F.count("*").alias("d")).groupBy("pos").agg(F.max("d").alias(name))
    x = n.join(m, "pos", "left").join(ends["max_in"], "pos", "left").join(ends["max_out"], "pos", "left")
    x = x.select("pos", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("m", "max_in", "max_out")))
    return x.withColumn("linearity", F.when(F.col("n") > 1, F.col("m") / (F.col("n") - 1)).otherwise(0.0))


def _rule() -> Column:
    i, o = F.col("max_in"), F.col("max_out")
    return (
        F.when((i >= 2) & (o >= 2), NESTED).when((i >= 2) & (o <= 1), CONSOLIDATION).when((o >= 2) & (i <= 1), LAYERING)
        .when((i <= 1) & (o <= 1) & (F.col("linearity") >= 0.5), PEELING)
    )


def typology(signals: DataFrame) -> DataFrame:
    """pos, structural: the typology that the structure implies; null where it is open or there are under two nodes."""
    return signals.select("pos", F.when(F.col("n") >= 2, _rule()).alias("structural"))


def typology_heuristic(signals: DataFrame) -> DataFrame:
    """pos, typology, confidence of the offline classifier, which always decides."""
    rule = _rule()
    sure = F.coalesce(*(F.when(rule == k, v) for k, v in CONFIDENCE.items()), F.lit(DEFAULT_CONFIDENCE))
    return signals.select("pos", F.coalesce(rule, F.lit(LAYERING)).alias("typology"), sure.alias("confidence"))


def typology_validate(claims: DataFrame, override: bool = True) -> DataFrame:
    """claims (pos, claimed, structural) with agrees, flagged, final and reason."""
    against = F.coalesce(F.col("structural") != F.col("claimed"), F.lit(False))
    reason = (
        F.when(F.col("structural").isNull(), "open structure: the claim stands").when(against, f"structure contradicts the claim: {'replaced' if override else 'kept'}")
        .otherwise("structure supports the claim")
    )
    final = F.when(against, F.col("structural")).otherwise(F.col("claimed")) if override else F.col("claimed")
    return claims.select("*", (~against).alias("agrees"), against.alias("flagged"), final.alias("final"), reason.alias("reason"))


def rank_leads(scores: DataFrame, k: int = 20, split: str | None = None) -> DataFrame:
    """rank, pos, ccId, score, percentile of the k best groups, of one split if given; ties to the smaller pos. percentile: the
    ordinal place among all groups."""
    n = F.broadcast(scores.agg(F.count("*").alias("__n")))  # one row
    x = dense_ids(scores, "score", "pos", out="__r").crossJoin(n).withColumn("percentile", (F.col("__r") + 1) / F.col("__n"))
    if split is not None:
        x = x.where(F.col("split") == split)
    top = x.orderBy(F.desc("score"), "pos").limit(k)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "pos"))  # k rows
    return top.select(place.alias("rank"), "pos", "ccId", "score", "percentile")


def lead_graph(edges: DataFrame, members: DataFrame, max_border: int = 12) -> tuple[DataFrame, DataFrame]:
    """Nodes (pos, idx, role) and edges (pos, src, dst) of each group's inside and border.

    At most max_border senders and receivers a group, the first in the order of (src, dst); an outside node that is both keeps the role
    sender and doesn't count as a receiver.
    """
    group = node_group(members)
    x = edges.select("src", "dst").distinct().join(group.toDF("src", "a"), "src", "left").join(group.toDF("dst", "b"), "dst", "left")
    inside = x.where("a = b").select(F.col("a").alias("pos"), "src", "dst")
    cross = x.where(~F.col("a").eqNullSafe(F.col("b")))

    def border(edge: DataFrame, node: str, role: str) -> DataFrame:
        first = edge.groupBy("pos", node).agg(F.min(F.struct("src", "dst")).alias("f"))
        place = F.row_number().over(Window.partitionBy("pos").orderBy("f"))
        return first.withColumn("r", place).where(F.col("r") <= max_border).select("pos", F.col(node).alias("idx"), F.lit(role).alias("role"))

    sent = cross.where("b is not null").select(F.col("b").alias("pos"), "src", "dst")
    got = cross.where("a is not null").select(F.col("a").alias("pos"), "src", "dst")
    senders = border(sent, "src", "sender")
    known = senders.select("pos", F.col("idx").alias("dst"))
    receivers = border(got.join(known, ["pos", "dst"], "left_anti"), "dst", "receiver")
    nodes = members.select("pos", "idx", F.lit("internal").alias("role")).distinct().union(senders).union(receivers)
    ends = nodes.where("role <> 'internal'").select("pos", "idx")
    kept = inside.union(sent.join(senders.select("pos", F.col("idx").alias("src")), ["pos", "src"], "left_semi").select("pos", "src", "dst"))
    kept = kept.union(got.join(ends.withColumnRenamed("idx", "dst"), ["pos", "dst"], "left_semi").select("pos", "src", "dst"))
    return nodes, kept.distinct()


def lead_stats(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """pos, n_internal, n_senders, n_receivers, n_edges, max_in_degree, max_out_degree."""
    role = {"n_internal": "internal", "n_senders": "sender", "n_receivers": "receiver"}
    x = nodes.groupBy("pos").agg(*(F.count_if(F.col("role") == r).alias(c) for c, r in role.items()))
    s = structural_signals(graph, nodes).select("pos", F.col("m").alias("n_edges"), F.col("max_in").alias("max_in_degree"), F.col("max_out").alias("max_out_degree"))
    return x.join(s, "pos")


def lead_layout(nodes: DataFrame) -> DataFrame:
    """pos, idx, role, x, y: a column for each role; rows from 1 down to -1, a single node at 0."""
    w = Window.partitionBy("pos", "role")
    i, n = F.row_number().over(w.orderBy("idx")) - 1, F.count("*").over(w)
    x = F.when(F.col("role") == "sender", -1.0).when(F.col("role") == "receiver", 1.0).otherwise(0.0)
    return nodes.select("pos", "idx", "role", x.alias("x"), F.when(n > 1, 1 - 2 * i / (n - 1)).otherwise(0.0).alias("y"))


def local_exit_path(nodes: DataFrame, graph: DataFrame, max_hops: int | None = None) -> DataFrame:
    """pos, path: a shortest path in the group's graph from its entry (the smallest internal node fed by a sender, else the smallest) to a
    receiver; ties: the smallest path. Empty without one. max_hops: the longest path looked for; any length by default.

    Only the paths to nodes that weren't reached before go on, and only in groups without a path yet."""
    role = nodes.select("pos", "idx", "role")
    fed = graph.join(role.where("role = 'sender'").select("pos", F.col("idx").alias("src")), ["pos", "src"], "left_semi").select("pos", F.col("dst").alias("idx"))
    inner = role.where("role = 'internal'").select("pos", "idx")
    first = inner.join(fed.distinct().withColumn("fed", F.lit(0)), ["pos", "idx"], "left").groupBy("pos")
    path = first.agg(F.min(F.struct(F.coalesce("fed", F.lit(1)), "idx")).alias("s")).select("pos", F.col("s.idx").alias("idx"), F.array("s.idx").alias("path"))
    ends = materialize(role.where("role = 'receiver'").select("pos", "idx"))
    links = materialize(graph.select("pos", F.col("src").alias("idx"), "dst").distinct())
    seen = path = materialize(path)
    found, hop = None, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = path.join(links, ["pos", "idx"]).groupBy("pos", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        new = materialize(step.withColumnRenamed("dst", "idx").select("pos", "idx", "path").join(seen.select("pos", "idx"), ["pos", "idx"], "left_anti"))
        hit = materialize(new.join(ends, ["pos", "idx"], "left_semi").groupBy("pos").agg(F.min("path").alias("path")))
        found = hit if found is None else found.union(hit)
        path = materialize(new.join(hit.select("pos"), "pos", "left_anti"))
        if path.isEmpty():
            break
        seen = materialize(seen.select("pos", "idx").union(path.select("pos", "idx")))
    if found is None:
        found = path.select("pos", "path").where("false")
    return role.select("pos").distinct().join(found, "pos", "left").select("pos", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


def bin_features(rows: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """rows with the columns as equal-width bins from 0 between their extremes within the group (pos); 0 without spread."""
    w = Window.partitionBy("pos")

    def cell(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int").alias(c)

    return rows.select(*(cell(c) if c in columns else F.col(c) for c in rows.columns))


def subgraph_int_id(groups: DataFrame) -> DataFrame:
    """pos, ccId, subgraph_id: ccId as a number, else pos."""
    return groups.select("pos", "ccId", F.coalesce(F.expr("try_cast(ccId as bigint)"), F.col("pos")).alias("subgraph_id"))


def candidate_docs(leads: DataFrame, nodes: DataFrame, graph: DataFrame, binned: DataFrame, columns: Sequence[str], paths: DataFrame) -> DataFrame:
    """pos, subgraph_id, pu_score, nodes, edges, exit_paths, stats: a lead's graph (at most members plus border) as one row.

    paths (pos, path): nodes outside the graph join as conduits, the last as endpoint, with the path's edges.
    """
    ids = subgraph_int_id(leads.select("pos", "ccId")).select("pos", "subgraph_id")
    steps = paths.where("size(path) > 1").join(leads.select("pos"), "pos", "left_semi")
    extra = steps.select("pos", F.size("path").alias("n"), F.posexplode("path").alias("i", "idx")).join(nodes.select("pos", "idx"), ["pos", "idx"], "left_anti")
    extra = extra.groupBy("pos", "idx").agg(F.max(F.when(F.col("i") == F.col("n") - 1, "endpoint").otherwise("conduit")).alias("role"))
    all_nodes = nodes.select("pos", "idx", "role").union(extra.select("pos", "idx", "role")).join(leads.select("pos"), "pos", "left_semi")
    hops = steps.select("pos", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("s"), F.slice("path", 2, F.size("path")).alias("t"))).alias("e"))
    all_edges = graph.select("pos", "src", "dst").union(hops.select("pos", "e.s", "e.t")).distinct().join(leads.select("pos"), "pos", "left_semi")
    bins = binned.select("pos", "idx", F.array(*columns).alias("bins"))
    n = all_nodes.join(bins, ["pos", "idx"], "left").groupBy("pos")
    n = n.agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("id"), "role", F.coalesce("bins", F.array().cast("array<int>")).alias("bins")))).alias("nodes"))
    e = all_edges.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("s"), F.col("dst").alias("t")))).alias("edges"))
    stats = lead_stats(nodes, graph)
    keys = [c for c in stats.columns if c != "pos"]
    stats = stats.select("pos", F.create_map(*(y for c in keys for y in (F.lit(c), F.col(c).cast("double")))).alias("stats"))
    x = leads.select("pos", F.col("score").alias("pu_score")).join(ids, "pos").join(n, "pos").join(e, "pos", "left").join(stats, "pos", "left")
    x = x.join(paths.withColumnRenamed("path", "p"), "pos", "left")
    none = F.array().cast("array<array<bigint>>")
    return x.select(
        "pos", "subgraph_id", "pu_score", "nodes", F.coalesce("edges", F.array().cast("array<struct<s:bigint,t:bigint>>")).alias("edges"),
        F.when(F.size("p") > 0, F.array("p")).otherwise(none).alias("exit_paths"), "stats",
    )


def encode_document(doc: dict, max_bytes: int | None = None, precision: int = 6) -> str:
    """Compact JSON with sorted keys and rounded numbers; over max_bytes, edges and then nodes off the exit paths are left out from
    the end until it fits. Raises if even one node doesn't fit."""

    def number(v: float) -> float:
        return round(float(v), precision) or 0.0

    on_path = {n for p in doc["exit_paths"] for n in p}
    rank = sorted(doc["nodes"], key=lambda n: (n["id"] not in on_path, n["id"]))
    weight = lambda e: (-float(e.get("weight", 1.0)), e["s"], e["t"])

    def build(n_nodes: int, n_edges: int | None, cut: bool) -> str:
        nodes = sorted(rank[:n_nodes], key=lambda n: n["id"])
        ids = {n["id"] for n in nodes}
        edges = sorted((e for e in doc["edges"] if e["s"] in ids and e["t"] in ids), key=weight)[:n_edges]
        full = [{"s": e["s"], "t": e["t"]} | {k: number(e.get(k, d)) for k, d in (("weight", 1.0), ("volume", 0.0), ("timestamp", 0.0))} for e in edges]
        out = {
            "subgraph_id": doc["subgraph_id"], "pu_score": number(doc["pu_score"]), "n_nodes": len(nodes), "n_edges": len(full), "nodes": nodes,
            "edges": sorted(full, key=lambda e: (e["s"], e["t"])), "exit_paths": [p for p in doc["exit_paths"] if ids.issuperset(p)],
            "stats": {k: number(v) for k, v in doc["stats"].items()}, "truncated": cut,
        }
        return json.dumps(out, sort_keys=True, separators=(",", ":"))

    fits = lambda s: max_bytes is None or len(s.encode()) <= max_bytes
    if fits(whole := build(len(rank), None, False)):
        return whole

    def most(lo: int, hi: int, ok) -> int:  # size grows with the count, so the largest that fits is found by halving
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid - 1)
        return lo

    n = most(0, len(rank), lambda k: k == 0 or fits(build(k, 0, True)))
    if not n:
        raise ValueError(f"no document fits {max_bytes} bytes")
    return build(n, most(0, len(doc["edges"]), lambda k: fits(build(n, k, True))), True)


def serialize(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """pos, json of candidate_docs() rows."""
    prepare_python(docs.sparkSession)

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"pos": pdf["pos"], "json": [encode_document(json.loads(d), max_bytes) for d in pdf["d"]]})

    whole = F.to_json(F.struct("subgraph_id", "pu_score", "nodes", "edges", "exit_paths", "stats"))
    return docs.select("pos", whole.alias("d")).mapInPandas(run, "pos long, json string")


def cards(docs: DataFrame, percentiles: DataFrame, override: bool = True) -> DataFrame:
    """pos, card: a Markdown card for each candidate document, by the offline classifier. percentiles: pos, percentile."""
    nodes = docs.select("pos", F.explode("nodes").alias("n")).select("pos", F.col("n.id").alias("idx"))
    graph = docs.select("pos", F.explode("edges").alias("e")).select("pos", F.col("e.s").alias("src"), F.col("e.t").alias("dst"))
    signals = structural_signals(graph, nodes)
    verdict = typology_heuristic(signals).join(typology(signals), "pos").withColumnRenamed("typology", "claimed")
    x = docs.join(typology_validate(verdict, override), "pos").join(signals, "pos").join(percentiles.select("pos", "percentile"), "pos")
    flag = F.when(F.col("flagged"), " (flagged: contradicts the structure)").otherwise("")
    arrows = F.array_join(F.transform("exit_paths", lambda p: F.concat(F.lit("- "), F.array_join(p.cast("array<string>"), " -> "))), "\n")
    stats = F.array_join(F.transform(F.sort_array(F.map_entries("stats")), lambda s: F.concat(F.lit("- "), s["key"], F.lit(": "), s["value"].cast("long").cast("string"))), "\n")
    lines = [
        F.concat(F.lit("# Suspicious group "), F.col("subgraph_id").cast("string")),
        F.lit(""),
        F.concat(F.lit("- Score: "), F.format_string("%.6f", "pu_score"), F.lit(", percentile "), F.format_string("%.1f%%", F.col("percentile") * 100)),
        F.concat(F.lit("- Typology: "), F.col("final"), F.lit(", confidence "), F.format_string("%.2f", "confidence"), flag),
        F.concat(F.lit("  - "), F.col("reason")),
        F.lit("\n## Exit paths"),
        F.when(F.size("exit_paths") > 0, arrows).otherwise("- none found"),
        F.lit("\n## Structure"),
        stats,
        F.lit("\n## Rationale"),
        F.concat(F.lit("Fan-in "), F.col("max_in").cast("string"), F.lit(", fan-out "), F.col("max_out").cast("string"), F.lit(", linearity "), F.format_string("%.2f", "linearity"), F.lit(".")),
        F.lit("\n## Caveats\n" + "\n".join(f"- {c}" for c in CAVEATS)),
    ]
    return x.select("pos", F.concat_ws("\n", *lines).alias("card"))
