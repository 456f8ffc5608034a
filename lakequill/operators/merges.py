"""Merging of pages: redirects followed to their end, names of what was merged, links rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.sources.tables import checkpointed


def roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links(node, to)``, each node having one ``to`` at most.

    A chain ends at the node that goes nowhere; a circle stands as its least node, and so do the chains into it.
    Pointers are doubled: after k rounds a node knows where 2^k steps lead and the least node on the way, so the
    rounds follow the logarithm of the longest chain. Nodes that have reached an end leave the join. A node without
    a name and a link to nowhere are left out; a node that goes to itself is an end.
    """
    steps = links.where("node is not null and to is not null")
    # two nodes that lead to each other are the common circle: the lesser one is an end at once
    back = steps.select(F.col("node").alias("to"), F.col("to").alias("again"))
    steps = steps.join(back, "to", "left").select("node", F.when((F.col("again") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
    nodes = steps.select("node").union(steps.select(F.col("to").alias("node"))).distinct()
    state = nodes.join(steps, "node", "left").select("node", F.coalesce("to", "node").alias("ptr"), F.col("node").alias("low"))
    state = checkpointed(state)
    left = state.count().bit_length() + 1
    ends = state.where("node = ptr").select(F.col("node").alias("ptr"))
    open_ = state.join(ends, "ptr", "left_anti").select("node", "ptr", "low")
    done = state.join(ends, "ptr", "left_semi").select("node", F.col("ptr").alias("root"))
    while left and not open_.isEmpty():
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"))
        moved = open_.join(ahead, "ptr").select("node", F.col("next").alias("ptr"), F.least("low", "low2").alias("low"))
        moved = checkpointed(moved)
        # nodes at an end keep their pointer, which no later round changes
        state = checkpointed(state.join(moved.select("node"), "node", "left_anti").select("node", "ptr", "low").unionByName(moved))
        done = done.unionByName(moved.join(ends, "ptr", "left_semi").select("node", F.col("ptr").alias("root")))
        open_ = moved.join(ends, "ptr", "left_anti").select("node", "ptr", "low")
        left -= 1
    # what is left leads into circles
    circle = open_.select("node", "ptr").join(state.select(F.col("node").alias("ptr"), F.col("low").alias("root")), "ptr").select("node", "root")
    return done.unionByName(circle)


def names_of(surfaces: DataFrame, root: DataFrame) -> DataFrame:
    """``(root, key, surface, node)``: names of all pages merged into ``root``, one of each folded form.

    ``surfaces(node, place, surface)``, ``root(node, root)``. A name of the page that stays wins over the same one of
    a page that goes, then the least page and place. Names without letters or digits are left out. One sum by root and
    form, so that no page's names are gathered.
    """
    named = surfaces.join(root, "node").withColumn("key", T.fold_latin("surface")).where("key <> ''")
    order = F.struct((F.col("node") != F.col("root")).cast("int").alias("o"), "node", "place", "surface")
    won = named.groupBy("root", "key").agg(F.min(order).alias("x"))
    return won.select("root", "key", F.col("x.surface").alias("surface"), F.col("x.node").alias("node"))


def merge_kind(has_page: Column, has_topics: Column) -> Column:
    """What a merge asks for: only names to add, an inbox to move, or the page that stays to be written anew."""
    return F.when(~F.coalesce(has_page, F.lit(False)), "alias-only").when(F.coalesce(has_topics, F.lit(False)), "recompile-keep").otherwise("inbox-append")


def plan(decisions: DataFrame, pages: DataFrame, surfaces: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, to, kind, new_names, linkers)`` of every decision ``(node, to)``: ``node`` goes into ``to``.

    ``pages(node, has_topics)``, ``surfaces(node, place, surface)``, ``links(src, dst)``. ``new_names`` are the folded
    names of the page that goes which the other one does not have, ``linkers`` counts the pages that link to it.
    """
    names = surfaces.select("node", T.fold_latin("surface").alias("key")).where("key <> ''").distinct()
    kept = decisions.join(names.withColumnRenamed("node", "to"), "to").select("node", "key")
    extra = decisions.join(names, "node").select("node", "key").join(kept, ["node", "key"], "left_anti").groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("new_names"))
    counted = links.where("src is not null").groupBy("dst", "src").count().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("linkers"))
    page = pages.select("node", "has_topics", F.lit(True).alias("has_page"))
    out = decisions.join(page, "node", "left").join(extra, "node", "left").join(counted, "node", "left")
    return out.select(
        "node", "to", merge_kind(F.col("has_page"), F.col("has_topics")).alias("kind"),
        F.coalesce("new_names", F.array().cast("array<string>")).alias("new_names"), F.coalesce("linkers", F.lit(0)).alias("linkers"),
    )


def rewritten(links: DataFrame, root: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links ``(src, dst)`` with merged targets replaced, counted; links equal by now fall together."""
    few = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    new = few.join(root.withColumnRenamed("node", "dst"), "dst", "left").select("src", F.coalesce("root", "dst").alias("dst"), "n")
    return new.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def maximum_spanning_tree(edges: DataFrame) -> DataFrame:
    """``(a, b, w)`` of the edges of the maximum spanning forest of ``edges(a, b, w)``, undirected, one row a pair.

    Borůvka's rounds: every component takes its greatest edge, of equal ones that of the least ends, and the
    components so tied become one by :func:`roots`. At least half of the components go each round. Edges inside a
    component leave.
    """
    left = checkpointed(edges.where("a <> b").select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    tree = None
    while not left.isEmpty():
        both = left.select(F.col("ca").alias("node"), F.col("cb").alias("to"), "w", "a", "b").unionByName(left.select(F.col("cb").alias("node"), F.col("ca").alias("to"), "w", "a", "b"))
        best = checkpointed(both.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("o"), "a", "b", "to", "w")).alias("x")).select("node", "x.to", "x.a", "x.b", "x.w"))
        taken = best.select("a", "b", "w").distinct()
        tree = taken if tree is None else tree.unionByName(taken)
        now = roots(best.select("node", "to"))
        left = left.join(now.select(F.col("node").alias("ca"), F.col("root").alias("ra")), "ca").join(now.select(F.col("node").alias("cb"), F.col("root").alias("rb")), "cb")
        left = checkpointed(left.where("ra <> rb").select("a", "b", "w", F.col("ra").alias("ca"), F.col("rb").alias("cb")))
    return edges.select("a", "b", "w").limit(0) if tree is None else tree
