"""Clone families: connected components, greedy linkages, medoids and family measures over edges (k1, k2, sim)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import shared_folder


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair, with its largest similarity."""
    return edges.where("k1 <> k2").groupBy(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).agg(F.max("sim").alias("sim"))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): labels spread and jump until none changes; lineage is cut by checkpoint()."""
    cut = checkpointer(edges.sparkSession)
    # both directions from one pass over the edges: a union would evaluate what makes them twice
    ways = F.array(F.struct(F.col("k1").alias("u"), F.col("k2").alias("v")), F.struct(F.col("k2").alias("u"), F.col("k1").alias("v")))
    both = cut(edges.select(F.inline(ways)).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = both.join(labels.toDF("v", "lv"), "v").groupBy("u").agg(F.min("lv").alias("near"))
        hooked = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("low"))
        jump = hooked.select(F.col("u").alias("low"), F.col("low").alias("lower"))
        new = cut(hooked.join(jump, "low", "left").select("u", F.least("low", F.coalesce("lower", "low")).alias("label"), F.col("label").alias("was")))
        labels = new.select("u", "label")
        if new.where("label <> was").isEmpty():
            return labels.toDF("node", "component")


def checkpointer(spark):
    """Cuts lineage with checkpoint(), in the folder that the cluster shares."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lambda d: d.checkpoint()


def medoids(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members: node, component. Per component the member with the greatest mean similarity (itself 1, no edge 0; ties: smaller node) and that mean."""
    sums = edges.select(F.col("k1").alias("node"), "sim").union(edges.select("k2", "sim")).groupBy("node").agg(F.sum("sim").alias("s"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    scored = members.join(sums, "node", "left").join(sizes, "component").withColumn("mean", (F.coalesce("s", F.lit(0.0)) + 1.0) / F.col("n"))
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.round("mean", 9)), "node"))  # sums of doubles depend on their order
    return scored.withColumn("r", first).where("r = 1").select("component", F.col("node").alias("medoid"), F.col("mean").alias("coherence"))


def family_table(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, member_count, avg / max / min similarity of edges inside, medoid, coherence, family_id by rank."""
    inside = edges.join(members.toDF("k1", "component"), "k1").join(members.toDF("k2", "c2"), "k2").where("component = c2")
    sims = inside.groupBy("component").agg(F.avg("sim").alias("avg_similarity"), F.max("sim").alias("max_similarity"), F.min("sim").alias("min_similarity"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("member_count"))
    out = sizes.join(sims, "component").join(medoids(members, inside.select("k1", "k2", "sim")), "component")
    rank = F.row_number().over(Window.orderBy(F.desc("member_count"), F.desc(F.round("avg_similarity", 9)), "component"))
    return out.withColumn("family_id", F.format_string("CF-%03d", rank))


def _center(sums: dict, nodes: list):
    """The node with the greatest mean similarity to nodes; ties: the least."""
    return min((-round((1.0 + sums[a]) / len(nodes), 9), a) for a in nodes)[1]


def greedy_clusters(edges: list[tuple], linkage: str, floor: float, tolerance: float = 0.0) -> dict:
    """node -> smallest node of its cluster. edges: (k1, k2, sim) of one component.

    What lies between two clusters is kept (number of edges, least and summed similarity) and summed when they merge,
    so that no step looks at all pairs of members; a pair without an edge counts as 0. Two clusters that may not merge
    are not tried again until one of them has grown. Means count to 9 digits: sums of doubles depend on their order.
    """
    sim = {(min(a, b), max(a, b)): s for a, b, s in edges}
    del edges
    between: dict = {}
    for (a, b), s in sim.items():
        row = (1, s, s)
        between.setdefault(a, {})[b] = row
        between.setdefault(b, {})[a] = row
    near = {n: {m: row[1] for m, row in found.items()} for n, found in between.items()} if linkage == "medoid" else {}
    group = {n: n for n in between}
    members = {n: [n] for n in between}
    inner = dict.fromkeys(between, 0.0)  # what a node's similarities to its own cluster add up to
    refused: dict = {n: set() for n in between}
    for a, b in sorted(sim, key=lambda x: (-round(sim[x], 9), x)):
        s = sim[a, b]
        ga, gb = group[a], group[b]
        if ga == gb or s < floor - tolerance or gb in refused[ga]:
            continue
        count, least, total = between[ga][gb]
        pairs = len(members[ga]) * len(members[gb])
        if linkage in ("complete", "quasi_complete"):
            ok = (least if count == pairs else min(least, 0.0)) >= floor - tolerance and (tolerance == 0 or round(total / pairs, 9) >= floor)
        elif linkage == "average":
            ok = round(total / pairs, 9) >= floor
        else:
            whole = members[ga] + members[gb]
            sums = {x: inner[x] for x in whole}
            small, large = sorted((ga, gb), key=lambda g: len(members[g]))
            for x in members[small]:
                for y, v in near[x].items():
                    if group[y] == large:
                        sums[x] += v
                        sums[y] += v
            mid = _center(sums, whole)
            ok = all(x == mid or near[mid].get(x, 0.0) >= floor for x in whole)
        if not ok:
            refused[ga].add(gb)
            refused[gb].add(ga)
            continue
        if linkage == "medoid":
            inner.update(sums)
        for g in (ga, gb):
            for other in refused[g]:
                refused[other].discard(g)
            refused[g] = set()
        if len(between[ga]) < len(between[gb]):
            ga, gb = gb, ga
        for x in members[gb]:
            group[x] = ga
        members[ga] += members.pop(gb)
        for other, (n, low, t) in between.pop(gb).items():
            del between[other][gb]
            if other != ga:
                n0, low0, t0 = between[ga].get(other, (0, low, 0.0))
                between[ga][other] = between[other][ga] = n0 + n, min(low0, low), t0 + t
    lowest = {g: min(found) for g, found in members.items()}
    return {n: lowest[g] for n, g in group.items()}


def linked_families(edges: DataFrame, linkage: str = "single", floor: float | None = None, tolerance: float | None = None) -> DataFrame:
    """node, component. Single linkage ignores the floor; others merge along edges only, so each connected component is clustered alone."""
    edges = unique_edges(edges)
    parts = connected_components(edges)
    if linkage == "single":
        return parts
    if floor is None:
        floor = edges.agg(F.min("sim")).first()[0] or 0.0
    tol = (0.05 if linkage == "quasi_complete" else 0.0) if tolerance is None else tolerance
    kind = edges.schema["k1"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = greedy_clusters(list(zip(frame.k1, frame.k2, frame.sim, strict=True)), linkage, floor, tol)
        return pd.DataFrame({"node": list(found), "component": list(found.values())})

    grouped = edges.join(parts.toDF("k1", "component"), "k1").groupBy("component")
    return grouped.applyInPandas(run, f"node {kind}, component {kind}")
