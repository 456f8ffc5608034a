"""Related pages of every page by role: neighbourhoods of two hops with their provenance, opponents, and the assignment of pages to roles."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Roles in the order they are filled, pages a role takes, decay of the second hop, shortest title that is looked for.
ROLES = ["contradiction", "evidence", "definition", "cluster"]
CAP, DECAY, NEEDLE = 2, 0.5, 4
REASONS = {"contradiction": "no-callout", "evidence": "no-source", "definition": "no-concept-neighbor", "cluster": "no-nearby-cluster-peer"}
#: No more of a role's pages can matter: its own cap, what the roles before it may have taken, and one to tell two from three.
DEEP = CAP * len(ROLES) + 1


def log2_udf(n: Column) -> Column:
    """Binary logarithm of the C library. Spark's is a quotient of two logarithms, so that scores which are equal (1 / log2(3), 2 / log2(9)) come apart."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(math.log2)

    return F.pandas_udf(run, DoubleType())(n)


def neighbourhood(adj: DataFrame) -> DataFrame:
    """``(seed, page, dist, score, pred, via)`` of all pages within two hops of every page, over ``adj(a, b, w, sources)`` both ways.

    A page two hops away comes by its strongest middle page, the least of equal ones. ``via`` is the distinct
    sources of the edges on the way, in order. The second hop costs the sum of squared degrees, so the caller
    gives a graph whose hubs have been left out or bounded.
    """
    deg = adj.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("deg")).select("b", log2_udf(F.col("deg") + 2).alias("damp"))
    edges, damp = adj.join(deg, "b"), F.col("damp")
    one = edges.select(F.col("a").alias("seed"), F.col("b").alias("page"), F.lit(1).alias("dist"), (F.col("w") / damp).alias("score"), F.col("a").alias("pred"), F.array_distinct("sources").alias("via"))
    first = adj.select(F.col("a").alias("seed"), F.col("b").alias("mid"), F.col("w").alias("w1"), F.col("sources").alias("v1"))
    second = edges.select(F.col("a").alias("mid"), F.col("b").alias("page"), "w", "damp", "sources")
    step = first.join(second, "mid").where("seed <> page").select("seed", "page", "mid", (F.col("w1") * F.col("w") * DECAY).alias("strength"), "damp", F.array_distinct(F.concat("v1", "sources")).alias("via"))
    step = step.join(one.select("seed", "page"), ["seed", "page"], "left_anti")
    best = step.groupBy("seed", "page").agg(F.min_by(F.struct("mid", "strength", "damp", "via"), F.struct(-F.col("strength"), "mid")).alias("m"))
    two = best.select("seed", "page", F.lit(2).alias("dist"), (F.col("m.strength") / F.col("m.damp")).alias("score"), F.col("m.mid").alias("pred"), F.col("m.via").alias("via"))
    return one.unionByName(two)


def neighbours(adj: DataFrame) -> DataFrame:
    """``(seed, page, score)`` of the pages one hop away, over ``adj(a, b, w)`` both ways; scores as in :func:`neighbourhood`."""
    return adj.select(F.col("a").alias("seed"), F.col("b").alias("page"), "w").join(damping(adj), "page").select("seed", "page", (F.col("w") / F.col("damp")).alias("score"))


def damping(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("a").alias("page")).agg(F.count("*").alias("deg")).select("page", log2_udf(F.col("deg") + 2).alias("damp"))


def second_hop(first: DataFrame, second: DataFrame, near: DataFrame, on: list[str]) -> DataFrame:
    """``(seed, page, strength)`` of pages two hops away and not in ``near(seed, page)``, from ``first(seed, mid, w1)`` and ``second(mid, page, w)``.

    ``on`` has ``mid`` and what else the two must share, so that pairs which nobody asks for are not made. A page
    comes by its strongest way, of which the strength alone is kept, added up where the ways are made.
    """
    ways = first.join(second, on).where("seed <> page").groupBy("seed", "page").agg(F.max(F.col("w1") * F.col("w") * DECAY).alias("strength"))
    return ways.join(near.select("seed", "page"), ["seed", "page"], "left_anti")


def opponents(callouts: DataFrame) -> DataFrame:
    """``(seed, page, open)`` from ``callouts(id, host, page, open)`` with a row per page that a callout names.

    A host's opponents are the pages it names, a named page's opponent is the host; open if any callout between them is.
    """
    both = callouts.select(F.col("host").alias("seed"), "page", "open").unionByName(callouts.select(F.col("page").alias("seed"), F.col("host").alias("page"), "open"))
    return both.where("seed <> page").groupBy("seed", "page").agg(F.max("open").alias("open"))


def opponent_reasons(seeds: DataFrame, callouts: DataFrame, named: DataFrame) -> DataFrame:
    """``(seed, reason)`` for seeds without opponents: no callout at all, or callouts whose pages are no opponent.

    ``callouts(id, host)`` holds callouts that name no page, too.
    """
    touched = callouts.select(F.col("host").alias("seed")).unionByName(named.select(F.col("page").alias("seed"))).distinct().withColumn("called", F.lit(True))
    rest = seeds.join(opponents(named).select("seed").distinct(), "seed", "left_anti")
    return rest.join(touched, "seed", "left").select("seed", F.when(F.col("called"), "no-opponent").otherwise("no-callout").alias("reason"))


def ordered(population: DataFrame, role: str, order: list[Column | str]) -> DataFrame:
    """``(seed, role, rank, page, dist, title)``: a role's pages in its order, as far as they can matter."""
    ranked = population.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy(*order)))
    return ranked.where(F.col("rank") <= DEEP).select("seed", F.lit(role).alias("role"), "rank", "page", "dist", "title")


def assign(seeds: DataFrame, populations: DataFrame) -> DataFrame:
    """``(seed, role, place, page, reason)``: up to two pages a role, or the reason why a role is empty.

    ``seeds(seed, label, fixed, called)``: the titles that make up the cluster's label, the reason that rules the
    cluster role out, and whether any callout touches the seed. Roles are filled in their order; a page taken by
    one leaves those behind it, but evidence may show what stands in contradiction. Two cluster pages that are
    the cluster's label itself, both two hops away, are left out for the next two. A seed's pages are at most
    ``DEEP`` a role, so that they meet in one row and are assigned by expressions over arrays.
    """
    listed = populations.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("role", "rank", "page", "dist", "title"))).alias("all"))
    row = seeds.join(listed, "seed", "left").withColumn("all", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)))

    def pages(role: str) -> Column:
        return F.filter("all", lambda x: x["role"] == role)

    def free(role: str, *taken: str) -> Column:
        gone = F.concat(*(F.col(t)["page"] for t in taken))
        return F.filter(pages(role), lambda x: ~F.array_contains(gone, x["page"]))

    row = row.withColumn("contradiction", F.slice(pages("contradiction"), 1, CAP)).withColumn("evidence", F.slice(pages("evidence"), 1, CAP))
    row = row.withColumn("definition", F.slice(free("definition", "contradiction", "evidence"), 1, CAP))
    row = row.withColumn("left", F.when(F.col("fixed").isNull(), free("cluster", "contradiction", "evidence", "definition")).otherwise(F.slice("all", 1, 0)))
    two = F.slice("left", 1, 2)
    same = (F.size(F.array_except(two["title"], F.col("label"))) == 0) & (F.size(F.array_except(F.col("label"), two["title"])) == 0)
    dump = (F.size(two) == 2) & (F.size("label") > 0) & same & F.forall(two, lambda x: x["dist"] == 2)
    row = row.withColumn("cluster", F.when(dump, F.slice("left", 3, CAP)).otherwise(F.slice("left", 1, CAP)))
    empty = {r: F.lit(why) for r, why in REASONS.items()}
    empty["contradiction"] = F.when(F.col("called"), "no-opponent").otherwise("no-callout")
    empty["cluster"] = F.coalesce("fixed", F.lit(REASONS["cluster"]))
    none = F.lit(None).cast("string")
    entry = lambda role: F.when(
        F.size(role) > 0, F.transform(F.col(role), lambda x, i: F.struct(F.lit(role).alias("role"), (i + 1).cast("int").alias("place"), x["page"].alias("page"), none.alias("reason")))
    ).otherwise(F.array(F.struct(F.lit(role).alias("role"), F.lit(0).alias("place"), none.alias("page"), empty[role].alias("reason"))))
    return row.select("seed", F.explode(F.concat(*(entry(r) for r in ROLES))).alias("x")).select("seed", "x.*")
