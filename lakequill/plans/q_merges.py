"""Merges of clients, and the sales that name them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.operators import merges as M
from lakequill.plans.fixtures import Derived
from lakequill.plans.registry import SQL, query, tbl

# of seven clients side by side, five make a chain and two name each other
DECISIONS = Derived("decisions", "SELECT DISTINCT client_id AS node, client_id + CASE WHEN client_id % 7 = 5 THEN 1 ELSE -1 END AS keep FROM {clients} WHERE client_id % 7 <> 0")
PAGES = Derived("pg", "SELECT client_id AS node, max(balance) > 1000 AS has_topics FROM {clients} WHERE nation_id % 5 <> 0 GROUP BY client_id")
SURFACES = Derived("sf", "SELECT client_id AS node, 0 AS place, name AS surface FROM {clients} WHERE client_id IS NOT NULL AND name IS NOT NULL UNION SELECT client_id, 1, city FROM {clients} WHERE client_id IS NOT NULL AND city IS NOT NULL UNION SELECT client_id, 2, segment FROM {clients} WHERE client_id IS NOT NULL AND segment IS NOT NULL")
FOLD = "regexp_replace(lower(surface), '[^0-9a-z]+', '', 'g')"
# one step after the other; a walk ends where it goes nowhere or comes to a page again
WALK = """walk AS (SELECT node AS start, node, keep AS nxt, [node] AS path FROM decisions UNION ALL SELECT start, w.nxt, d.keep, list_append(path, w.nxt) FROM walk w JOIN decisions d ON d.node = w.nxt WHERE NOT list_contains(path, w.nxt)),
fin AS (SELECT start, nxt, path FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path) DESC) = 1),
roots AS (SELECT start AS node, CASE WHEN list_contains(path, nxt) THEN list_min(path[list_position(path, nxt):]) ELSE nxt END AS root FROM fin UNION SELECT keep, keep FROM decisions WHERE keep NOT IN (SELECT node FROM decisions))"""


def _decisions(spark, d):
    return DECISIONS.frame(spark, d).withColumnRenamed("keep", "to")


def _links(spark, d):
    return tbl(spark, d, "sales").select(F.col("sale_id").alias("src"), F.col("client_id").alias("dst"))


@query("q25_merge_plan", SQL(f"""WITH {DECISIONS.cte}, {PAGES.cte}, {SURFACES.cte}, k AS (SELECT DISTINCT node, {FOLD} AS key FROM sf WHERE {FOLD} <> ''),
extra AS (SELECT d.node, list(key ORDER BY key) AS new_names FROM decisions d JOIN k USING (node) WHERE NOT EXISTS (SELECT 1 FROM k z WHERE z.node = d.keep AND z.key = k.key) GROUP BY d.node), l AS (SELECT client_id AS node, count(DISTINCT sale_id) AS linkers FROM sales GROUP BY 1)
SELECT d.node, d.keep, CASE WHEN pg.node IS NULL THEN 'alias-only' WHEN has_topics THEN 'recompile-keep' ELSE 'inbox-append' END AS kind, coalesce(new_names, []) AS new_names, coalesce(linkers, 0) AS linkers FROM decisions d LEFT JOIN pg USING (node) LEFT JOIN extra USING (node) LEFT JOIN l USING (node)"""))
def merge_plan(spark, d):
    return M.plan(_decisions(spark, d), PAGES.frame(spark, d), SURFACES.frame(spark, d), _links(spark, d)).withColumnRenamed("to", "keep")


@query("q26_redirects", SQL(f"WITH RECURSIVE {DECISIONS.cte}, {WALK} SELECT node, root FROM roots"))
def redirects(spark, d):
    return M.roots(_decisions(spark, d))


@query("q26_merged_names", SQL(f"""WITH RECURSIVE {DECISIONS.cte}, {SURFACES.cte}, {WALK} SELECT root, {FOLD} AS key, surface, node FROM sf JOIN roots USING (node) WHERE {FOLD} <> ''
QUALIFY row_number() OVER (PARTITION BY root, {FOLD} ORDER BY node <> root, node, place, surface) = 1"""))
def merged_names(spark, d):
    return M.names_of(SURFACES.frame(spark, d), M.roots(_decisions(spark, d)))


@query("q26_rewritten_links", SQL(f"WITH RECURSIVE {DECISIONS.cte}, {WALK} SELECT sale_id AS src, coalesce(root, client_id) AS dst, count(*) AS n FROM sales LEFT JOIN roots ON node = client_id GROUP BY 1, 2"))
def rewritten_links(spark, d):
    return M.rewritten(_links(spark, d), M.roots(_decisions(spark, d)))
