"""Link graphs: typed and weighted edges, co-citation, expansion, ranking, communities and gaps.

Edges are rows; nothing here gathers a graph in one place but :func:`louvain`, whose sweep is sequential
by definition and runs on one component's (bounded, caller-chosen) edge list per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators.components import components
from lakequill.sources.tables import checkpointed, discard

# Rank and weight of edge kinds.
KINDS = {"claim-link": (5, 1.5), "claim-cite": (4, 1.0), "link": (3, 1.0), "fm-source": (2, 0.6), "fm-related": (1, 0.4)}
RECIPROCAL, DECAY, SOURCES_CAP = 0.5, 0.5, 8
#: Nodes that are sent to all links, hops that are followed so, and edges that one task takes.
SENT_NODES, HOPS, FEW_EDGES = 200_000, 8, 3_000_000


def _case(values: dict[str, float], col: str) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col(col) == k, F.lit(v)).otherwise(out)
    return out


def collapse(directed: DataFrame) -> DataFrame:
    """``(a, b, kind, w)`` of undirected pairs from ``(src, dst, kind)``: the highest kind wins; links both ways weigh more."""
    d = directed.where("src <> dst").withColumn("r", _case({k: v[0] for k, v in KINDS.items()}, "kind")).where("r is not null")
    pair = d.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("fwd"), "kind", "r")
    won = pair.groupBy("a", "b").agg(F.max_by("kind", "r").alias("kind"), F.max(F.col("fwd").cast("int")).alias("f"), F.min(F.col("fwd").cast("int")).alias("g"))
    both = (F.col("f") == 1) & (F.col("g") == 0) & F.col("kind").isin("claim-link", "link")
    return won.select("a", "b", "kind", (_case({k: v[1] for k, v in KINDS.items()}, "kind") + F.when(both, RECIPROCAL).otherwise(0.0)).alias("w"))


def pairs_through(bip: DataFrame, via: str, node: str, least: int, most: int, weight: Column) -> DataFrame:
    """``(a, b, via, w)`` for pairs of nodes under one ``via`` with ``least`` to ``most`` nodes; ``weight`` is of ``k``, their number.

    The bound on k is part of the semantics and is applied before the self-join, so no hub squares.
    """
    rows = bip.select(via, node).distinct()
    sized = rows.join(rows.groupBy(via).agg(F.count("*").alias("k")).where((F.col("k") >= least) & (F.col("k") <= most)), via)
    left, right = sized.select(via, "k", F.col(node).alias("a")), sized.select(via, F.col(node).alias("b"))
    return left.join(right, via).where("a < b").select("a", "b", F.col(via).alias("via"), weight.alias("w"))


def cocitation(bip: DataFrame, via: str, node: str) -> DataFrame:
    """Co-citation weight 1/log2(2+k) over sources that 2 to 200 nodes cite."""
    p = pairs_through(bip, via, node, 2, 200, 1.0 / F.log2(2 + F.col("k")))
    return p.groupBy("a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("sources"))


def symmetric(edges: DataFrame) -> DataFrame:
    e = edges.select("a", "b", "w")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def adamic_adar(und: DataFrame) -> DataFrame:
    """Sum of 1/log2(degree) over common neighbours of degree 2 to 150, for unlinked pairs."""
    both = symmetric(und.withColumn("w", F.lit(1.0))).select("a", "b").distinct()
    scored = pairs_through(both.withColumnsRenamed({"a": "mid", "b": "node"}), "mid", "node", 2, 150, 1.0 / F.log2("k"))
    return scored.groupBy("a", "b").agg(F.sum("w").alias("score")).join(und.select("a", "b"), ["a", "b"], "left_anti")


def expand(adj: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """``(node, score, best_seed)`` around ``seeds(seed, weight, pos)`` over ``adj(a, b, w)`` both ways.

    Strength is what comes in times the edge, halved per hop; score adds strength/log2(2+degree). Reached
    nodes and seeds are left out of later hops; a node goes on with its greatest strength, credited to
    one seed. Hops are few, so the joins are unrolled. The graph is made once; a hop reads it, and shuffles the front's edges.
    """
    adj = checkpointed(adj.select("a", "b", "w"))
    front = seeds.select(F.col("seed").alias("a"), F.col("weight").alias("s"), "seed", "pos")
    reached, parts = seeds.select(F.col("seed").alias("b")), []
    for hop in range(hops):
        near = checkpointed(front.join(adj, "a").join(reached, "b", "left_anti"))
        # degrees of the nodes reached alone
        deg = adj.select(F.col("a").alias("b")).join(near.select("b").distinct(), "b", "left_semi").groupBy("b").agg(F.count("*").alias("deg"))
        step = near.join(deg, "b").select("b", "seed", "pos", "a", (F.col("s") * F.col("w") * DECAY**hop).alias("s"), "deg")
        parts.append(step.select("b", "seed", "pos", (F.col("s") / F.log2(2 + F.col("deg"))).alias("c")))
        best = step.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("s"), "pos", "a"))).where("r = 1")
        front = best.select(F.col("b").alias("a"), "s", "seed", "pos")
        reached = reached.unionByName(best.select("b"))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    by_seed = all_parts.groupBy("b", "seed", "pos").agg(F.sum("c").alias("c"))
    credit = by_seed.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc(F.round("c", 9)), "pos"))).where("r = 1").select("b", F.col("seed").alias("best_seed"))
    return by_seed.groupBy("b").agg(F.sum("c").alias("score")).join(credit, "b").select(F.col("b").alias("node"), "score", "best_seed")


def _sent(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= SENT_NODES else nodes


def _reach(adj: DataFrame, center: str, checkpoint) -> DataFrame:
    """Those rows of ``adj(a, b, w)`` that ``center`` reaches.

    Hop by hop the nodes found are sent to the links, so that these are read and not shuffled. What is not done after
    ``HOPS`` is told by its component.
    """
    spark = adj.sparkSession
    front = checkpoint(spark.createDataFrame([(center,)], "a string"))
    reached, layers = front, [front]
    for _ in range(HOPS):
        near = adj.join(_sent(front), "a").select(F.col("b").alias("a")).distinct()
        front = checkpoint(near.join(reached, "a", "left_anti"))
        layers.append(front)
        if front.isEmpty():
            known = checkpoint(adj.join(_sent(reached), "a", "left_semi").groupBy("a", "b").agg(F.sum("w").alias("w")))
            break
        reached = reached.unionByName(front)
    else:
        tie = checkpoint(components(adj.where("a < b").select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))))
        home = layers[0].select(F.xxhash64("a").alias("u")).join(tie, "u", "left").select(F.coalesce("v", "u").alias("v")).first()[0]
        inside = tie.where(F.col("v") == home).select("u").unionByName(spark.createDataFrame([(home,)], "u long"))
        known = checkpoint(adj.withColumn("u", F.xxhash64("a")).join(inside, "u", "left_semi").groupBy("a", "b").agg(F.sum("w").alias("w")))
        discard(tie)
    discard(*layers)
    return known


def _ranked(out: pa.Table, center: str, alpha: float, rounds: int) -> pa.RecordBatch:
    names, code = np.unique(np.concatenate([out["a"].to_numpy(), out["b"].to_numpy()]), return_inverse=True)
    a, b, share, home = code[: len(out)], code[len(out) :], out["share"].to_numpy(), np.searchsorted(names, center)
    leads = np.bincount(a, minlength=len(names)) > 0
    rank = np.zeros(len(names))
    rank[home] = 1.0
    for _ in range(rounds):
        lost = rank[~leads].sum()
        rank = (1 - alpha) * np.bincount(b, rank[a] * share, len(names))
        rank[home] += alpha + (1 - alpha) * lost
    return pa.record_batch({"node": pa.array(names, pa.string()), "r": pa.array(rank)})


def pagerank_from(adj: DataFrame, center: str, checkpoint, alpha: float = 0.15, rounds: int = 30) -> DataFrame:
    """Personalised PageRank over ``adj(a, b, w)`` both ways; mass at nodes without edges returns to the centre. Rows of one edge add up.

    Only pages that the centre reaches can hold anything, so that their edges alone are kept, see :func:`_reach`. Up to
    ``FEW_EDGES`` of them go to one task, which does all rounds. Beyond that a round is a join that is stored, and the round before it removed.
    """
    spark = adj.sparkSession
    known = _reach(adj.select("a", "b", "w"), center, checkpoint)
    out = checkpoint(known.join(known.groupBy("a").agg(F.sum("w").alias("total")), "a").select("a", "b", (F.col("w") / F.col("total")).alias("share")))
    discard(known)
    if out.count() <= FEW_EDGES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _ranked(pa.Table.from_batches(list(batches), schema), center, alpha, rounds)

        schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("share", pa.float64())])
        rank = checkpoint(out.coalesce(1).mapInArrow(run, "node string, r double")) if not out.isEmpty() else spark.createDataFrame([(center, 1.0)], "node string, r double")
        discard(out)
        return rank.where("r > 0")
    rank = spark.createDataFrame([(center, 1.0)], "node string, r double")
    home, before = spark.createDataFrame([(center,)], "node string"), None
    for _ in range(rounds):
        kept = rank.join(out, rank["node"] == out["a"], "left")
        moved = kept.select(F.coalesce("b", F.lit(center)).alias("node"), ((1 - alpha) * F.col("r") * F.coalesce("share", F.lit(1.0))).alias("r"))
        rank = moved.unionByName(home.withColumn("r", F.lit(alpha))).groupBy("node").agg(F.sum("r").alias("r"))
        rank = checkpoint(rank)
        if before is not None:
            discard(before)
        before = rank
    discard(out)
    return rank.where("r > 0")


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Q = sum over clusters of inner share minus squared total share, for ``edges(a, b, w)`` undirected and ``label(node, c)``."""
    la, lb = label.select(F.col("node").alias("a"), F.col("c").alias("ca")), label.select(F.col("node").alias("b"), F.col("c").alias("cb"))
    e = edges.join(la, "a").join(lb, "b")
    ends = e.select(F.col("ca").alias("c"), "w").unionByName(e.select(F.col("cb").alias("c"), "w"))
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("inner_w"))
    tot = ends.groupBy("c").agg(F.sum("w").alias("tot"))
    whole = tot.agg(F.sum("tot").alias("m2"))
    per = tot.join(inner, "c", "left").crossJoin(F.broadcast(whole))
    return per.agg(F.round(F.sum(2 * F.coalesce("inner_w", F.lit(0.0)) / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)), 8).alias("q"))


def best_gain(near: dict, tot: dict, k: float, m2: float, own: int) -> tuple[int, float]:
    """Community with the greatest gain for a node of strength k, taken out of ``own``; the least number on ties, and only what beats staying."""
    stay = near.get(own, 0.0) - tot[own] * k / m2
    best, gain = own, stay
    for c in sorted(near):
        g = near[c] - tot[c] * k / m2
        if g > gain + 1e-12:
            best, gain = c, g
    return best, gain - stay


def louvain_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Undirected Louvain: sequential sweeps in node order, then the communities as nodes, until nothing moves."""
    where = np.arange(n)
    while True:
        adj: list[dict[int, float]] = [{} for _ in range(n)]
        for x, y, z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            adj[x][y] = adj[x].get(y, 0.0) + z
            if x != y:
                adj[y][x] = adj[y].get(x, 0.0) + z
        k = [sum(z for y, z in adj[x].items() if y != x) + 2 * adj[x].get(x, 0.0) for x in range(n)]
        m2, label, tot = sum(k), list(range(n)), dict(enumerate(k))
        if not m2:
            return where
        moved = any_move = True
        first = True
        while moved:
            moved = False
            for x in range(n):
                near: dict[int, float] = {}
                for y, z in adj[x].items():
                    if y != x:
                        near[label[y]] = near.get(label[y], 0.0) + z
                tot[label[x]] -= k[x]
                c, gain = best_gain(near, tot, k[x], m2, label[x])
                tot[c] += k[x]
                if c != label[x] and gain > 1e-12:
                    label[x], moved = c, True
            any_move = moved if first else any_move or moved
            first = False
        names, new = np.unique(label, return_inverse=True)
        if not any_move or len(names) == n:
            return where
        where = new[where]
        a, b = new[a], new[b]
        key = np.minimum(a, b) * len(names) + np.maximum(a, b)
        uniq, inv = np.unique(key, return_inverse=True)
        a, b, w, n = uniq // len(names), uniq % len(names), np.bincount(inv, w), len(names)


def louvain(edges: DataFrame, group: str) -> DataFrame:
    """``(group, node, cluster)`` by Louvain inside each group of ``edges(group, a, b, w)``; clusters are numbered by size, then least node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, idx = np.unique(np.concatenate([pdf.a, pdf.b]), return_inverse=True)
        labels = louvain_labels(idx[: len(pdf)], idx[len(pdf) :], pdf.w.to_numpy(float), len(nodes))
        t = pd.DataFrame({"node": nodes, "l": labels})
        order = t.groupby("l").agg(size=("node", "size"), least=("node", "min")).sort_values(["size", "least"], ascending=[False, True])
        number = {label: i for i, label in enumerate(order.index)}
        return pd.DataFrame({group: pdf[group].iloc[0], "node": nodes, "cluster": [number[x] for x in labels]})

    kind, node = dict(edges.dtypes)[group], dict(edges.dtypes)["a"]
    return edges.groupBy(group).applyInPandas(run, f"{group} {kind}, node {node}, cluster int")


def top_edge_per_pair(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The strongest edge between each pair of clusters, of ``edges(id, src, dst, count)``; the least id on ties."""
    ls, lt = label.select(F.col("node").alias("src"), F.col("c").alias("cs")), label.select(F.col("node").alias("dst"), F.col("c").alias("ct"))
    e = edges.join(ls, "src").join(lt, "dst").where("cs <> ct").withColumn("ca", F.least("cs", "ct")).withColumn("cb", F.greatest("cs", "ct"))
    # an aggregate of one row a pair, so that no task holds or sorts the edges of a pair
    others = [c for c in edges.columns if c not in ("count", "id")]
    best = e.groupBy("ca", "cb").agg(F.min(F.struct((-F.col("count")).alias("c"), "id", *others)).alias("m"))
    return best.select(*[(-F.col("m.c")).alias(c) if c == "count" else F.col(f"m.{c}").alias(c) for c in edges.columns], "ca", "cb")
