"""Lists of a vault's health, over items that sale lines link, and names in several dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.operators import resolve as R
from lakequill.plans.fixtures import Derived
from lakequill.plans.registry import SQL, query, tbl

DIALECTS, GROUPS = {"little": ["small"], "tiny": ["mini", "blue"], "big": ["large"]}, [["little", "tiny"]]
SUFFIXES = {"fastener": ["bolt", "screw"], "hoop": ["ring", "rings"]}
NAMES = Derived("names", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN ' - ' ELSE 's.' END AS name FROM {part}")


# the last word is taken apart here, and the words before it are replaced one by one
@query("h12_dialect_key", SQL(f"""WITH {NAMES.cte}, c AS (SELECT id, regexp_replace(lower(name), '[^a-z]+$', '') AS s FROM names), w AS (SELECT id, regexp_extract(s, '^(.*?)([a-z]+)$', 1) AS pre, regexp_extract(s, '([a-z]+)$', 1) AS last FROM c),
r AS (SELECT id, replace(replace(replace(pre, 'small', 'little'), 'large', 'big'), 'blue', 'little') AS pre, CASE WHEN regexp_matches(last, '(bolt|screw)s?$') THEN regexp_replace(last, '(bolt|screw)s?$', 'fastener') WHEN regexp_matches(last, 'rings?$') THEN regexp_replace(last, 'rings?$', 'hoop') ELSE last END AS last FROM w)
SELECT id, regexp_replace(pre || last, '[^0-9a-z]+', '', 'g') AS key FROM r"""))
def dialect_keys(spark, d):
    return NAMES.frame(spark, d).select("id", R.dialect_key("name", DIALECTS, GROUPS, SUFFIXES).alias("key"))


# swapped lines link the item with the vendor that they name; small items are seeds
LINKED = "l AS (SELECT item_id, count(*) AS n FROM sale_lines WHERE flag = 'swapped' AND item_id IS NOT NULL GROUP BY 1), i AS (SELECT DISTINCT item_id, name, size FROM items WHERE item_id IS NOT NULL)"


@query("f11_health_lists", SQL(f"""WITH {LINKED} SELECT 'promotion' AS list, CAST(item_id AS VARCHAR) AS page, n FROM i JOIN l USING (item_id) WHERE size < 10
UNION ALL SELECT 'orphan', CAST(item_id AS VARCHAR), 0 FROM i WHERE item_id NOT IN (SELECT item_id FROM l) UNION ALL SELECT 'duplicate', lower(name), count(DISTINCT item_id) FROM i WHERE name IS NOT NULL GROUP BY lower(name) HAVING count(DISTINCT item_id) > 1"""))
def health_lists(spark, d):
    """Seeds with links into them, pages without any link, and names of more than one page."""
    items = tbl(spark, d, "items").where("item_id is not null").select("item_id", "name", "size").distinct()
    linked = tbl(spark, d, "sale_lines").where("flag = 'swapped'").groupBy("item_id").agg(F.count("*").alias("n"))
    page = F.col("item_id").cast("string").alias("page")
    seeds = items.where("size < 10").join(linked, "item_id").select(F.lit("promotion").alias("list"), page, "n")
    alone = items.join(linked, "item_id", "left_anti").select(F.lit("orphan").alias("list"), page, F.lit(0).cast("long").alias("n"))
    twice = items.where("name is not null").groupBy(F.lower("name").alias("page")).agg(F.countDistinct("item_id").alias("n")).where("n > 1").select(F.lit("duplicate").alias("list"), "page", "n")
    return seeds.unionByName(alone).unionByName(twice)
