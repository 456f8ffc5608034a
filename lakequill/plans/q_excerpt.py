"""Excerpts of all documents, their lines set out in sections of six."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.operators import excerpt as E
from lakequill.plans.registry import SQL, query, tbl

BUDGETS = [150, 400, 1200]
# the first section is a definition of two paragraphs, every second one a list of bullets with a line below some
MARK = "CASE WHEN i % 6 = 0 THEN '## ' WHEN floor(i / 6) % 2 = 1 AND i % 6 IN (1, 3, 4) THEN '- ' WHEN floor(i / 6) % 2 = 1 AND i % 6 = 2 THEN '  - ' ELSE '' END"
LINES = f"""l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l1 AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l0),
lines AS (SELECT doc_id, i // 6 AS section, CASE WHEN i < 6 THEN 'definition' WHEN (i // 6) % 2 = 1 THEN 'tail' ELSE 'prose' END AS kind, i AS place, CASE WHEN i = 3 THEN '' ELSE rtrim(regexp_replace({MARK} || ls[i + 1], '\\s+$', '')) END AS line FROM l1)"""


def _lines(spark, d):
    rows = tbl(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    kind = F.when(F.col("i") < 6, "definition").when(F.floor(F.col("i") / 6) % 2 == 1, "tail").otherwise("prose")
    line = F.when(F.col("i") == 3, "").otherwise(F.concat(F.expr(MARK), "t"))
    return rows.select(F.col("doc_id").alias("doc"), F.floor(F.col("i") / 6).alias("section"), kind.alias("kind"), F.col("i").alias("place"), line.alias("line"))


# bullets are tried one number after the other here: every number is summed anew
@query("h30_budget_shrink", SQL(f"""WITH {LINES}, m AS (SELECT *, kind = 'tail' AND starts_with(line, '- ') AS st, length(line) + 1 AS size FROM lines),
n AS (SELECT *, CASE WHEN kind = 'tail' THEN CASE WHEN st OR starts_with(line, '  - ') THEN (SELECT count(*) FROM m z WHERE z.doc_id = m.doc_id AND z.section = m.section AND z.st AND (z.place > m.place)) + CASE WHEN st OR EXISTS (SELECT 1 FROM m y WHERE y.doc_id = m.doc_id AND y.place = m.place - 1 AND y.st) THEN 1 END END END AS back, kind = 'definition' AND place >= 3 AS later FROM m),
t AS (SELECT doc_id, sum(size) AS total, coalesce(max(back), 0) AS most FROM n GROUP BY 1), b AS (SELECT *, unnest({BUDGETS}) AS budget FROM t), ov AS (SELECT *, greatest(1, total // 3) > budget AS over FROM b),
tries AS (SELECT doc_id, budget, unnest(range(most + 1)) AS k FROM ov WHERE over), fit AS (SELECT tries.doc_id, budget, k FROM tries JOIN n ON n.doc_id = tries.doc_id AND NOT later AND (back IS NULL OR back <= k) GROUP BY ALL HAVING greatest(1, sum(size) // 3) <= budget),
kp AS (SELECT ov.doc_id, ov.budget, over, CASE WHEN over THEN coalesce((SELECT max(k) FROM fit WHERE fit.doc_id = ov.doc_id AND fit.budget = ov.budget), 0) END AS bullets FROM ov),
tx AS (SELECT kp.doc_id, budget, any_value(bullets) AS bullets, string_agg(line, chr(10) ORDER BY place) FILTER (NOT over OR (NOT later AND (back IS NULL OR back <= bullets))) || chr(10) AS text, bool_or(over AND (later OR coalesce(back, 0) > bullets)) AS lost FROM kp JOIN n ON n.doc_id = kp.doc_id GROUP BY 1, 2),
c AS (SELECT *, bullets IS NOT NULL AND greatest(1, length(text) // 3) > budget AS cut FROM tx)
SELECT doc_id, CAST(budget AS INTEGER) AS budget, bullets, lost OR cut AS truncated, md5(CASE WHEN cut THEN regexp_replace(text[1:greatest(200, 3 * budget)], '\\s+$', '') || chr(10) ELSE text END) AS digest FROM c"""))
def budget_shrink(spark, d):
    return E.shrink(_lines(spark, d), BUDGETS).select(F.col("doc").alias("doc_id"), "budget", F.col("bullets").cast("long").alias("bullets"), "truncated", F.md5("excerpt").alias("digest"))


# a bullet's bold beginning, where it has one, is its claim
OUTLINED = LINES.replace("lines AS (", "lines0 AS (") + ", lines AS (SELECT doc_id, section, kind, place, CASE WHEN place % 6 = 3 AND starts_with(line, '- ') THEN '- **' || substr(line, 3, 20) || '** ' || substr(line, 3) ELSE line END AS line FROM lines0)"
WIDEST = 120


def _outlined(spark, d):
    bold = F.concat(F.lit("- **"), F.substring("line", 3, 20), F.lit("** "), F.substr("line", F.lit(3)))
    clean = _lines(spark, d).withColumn("line", F.regexp_replace("line", r"\s+$", ""))
    return clean.withColumn("line", F.when((F.col("place") % 6 == 3) & F.col("line").startswith("- "), bold).otherwise(F.col("line")))


@query("h29_last_bullets", SQL(f"""WITH {LINES}, n AS (SELECT *, kind = 'tail' AND starts_with(line, '- ') AS st FROM lines), b AS (SELECT *, CASE WHEN st THEN place WHEN kind = 'tail' AND starts_with(line, '  - ') THEN (SELECT max(z.place) FROM n z WHERE z.doc_id = n.doc_id AND z.section = n.section AND z.place < n.place AND z.st AND z.place = n.place - 1) END AS own FROM n)
SELECT doc_id, section, CAST(count(*) AS BIGINT) AS n_lines, md5(string_agg(line, chr(10) ORDER BY place)) AS digest FROM b WHERE own IS NULL OR (SELECT count(*) FROM n z WHERE z.doc_id = b.doc_id AND z.section = b.section AND z.st AND z.place >= b.own) <= 2 GROUP BY 1, 2"""))
def last_bullets(spark, d):
    kept = E.last_bullets(_lines(spark, d).withColumn("line", F.regexp_replace("line", r"\s+$", "")), 2)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy(F.col("doc").alias("doc_id"), F.col("section").cast("long").alias("section")).agg(F.count("*").alias("n_lines"), F.md5(text).alias("digest"))


# claims are tried one number after the other: an outline has as many of its first ones as go
@query("h31_outline", SQL(rf"""WITH {OUTLINED}, m AS (SELECT *, place % 6 = 0 AS head, kind = 'tail' AND starts_with(line, '- ') AS st FROM lines), c AS (SELECT doc_id, section, count(*) FILTER (st) AS k FROM m GROUP BY 1, 2),
x AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(line, '^- +\*\*.+?\*\*') THEN trim(regexp_extract(line, '^- +\*\*(.+?)\*\*', 1)) ELSE trim(line[3:]) END, '\s+', ' ', 'g') AS t FROM m),
o AS (SELECT doc_id, place, head, CASE WHEN head THEN line || CASE WHEN kind = 'definition' THEN '' ELSE '  (' || k || ')' END WHEN st THEN '- ' || CASE WHEN length(t) > {E.CLAIM} THEN rtrim(t[1:{E.CLAIM}]) || '…' ELSE t END END AS s FROM x JOIN c USING (doc_id, section) WHERE head OR st),
g AS (SELECT doc_id, count(*) FILTER (NOT head) AS total, 'total: ' || count(*) FILTER (NOT head) || chr(10) AS title, string_agg(s, chr(10) ORDER BY place) || chr(10) AS alls, string_agg(s, chr(10) ORDER BY place) FILTER (head) || chr(10) AS heads FROM o GROUP BY 1),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS no FROM o WHERE NOT head), ov AS (SELECT *, greatest(1, length(title || alls) // 3) > {WIDEST} AS over, greatest(1, (length(title || heads) + {len(E.NOTE) + 1}) // 3) AS base FROM g),
fit AS (SELECT ov.doc_id, unnest(range(1, total + 1)) AS no FROM ov WHERE over), ok AS (SELECT fit.doc_id, fit.no FROM fit JOIN nu ON nu.doc_id = fit.doc_id AND nu.no <= fit.no JOIN ov ON ov.doc_id = fit.doc_id GROUP BY ALL HAVING any_value(base) + sum(greatest(1, (length(s) + 1) // 3)) <= {WIDEST}), best AS (SELECT doc_id, max(no) AS no FROM ok GROUP BY 1),
tx AS (SELECT o.doc_id, string_agg(o.s, chr(10) ORDER BY o.place) || chr(10) AS body FROM o JOIN ov ON ov.doc_id = o.doc_id LEFT JOIN nu ON nu.doc_id = o.doc_id AND nu.place = o.place LEFT JOIN best ON best.doc_id = o.doc_id WHERE NOT over OR o.head OR nu.no <= best.no GROUP BY 1)
SELECT doc_id, total, over AS truncated, md5(CASE WHEN NOT over THEN title || body WHEN base > {WIDEST} THEN regexp_replace((title || body)[1:{max(E.LEAST, 3 * WIDEST)}], '\s+$', '') || chr(10) || '{E.NOTE}' || chr(10) ELSE title || body || '{E.NOTE}' || chr(10) END) AS digest FROM ov JOIN tx USING (doc_id)"""))
def outline(spark, d):
    return E.outline(_outlined(spark, d), WIDEST).select(F.col("doc").alias("doc_id"), "total", "truncated", F.md5("outline").alias("digest"))
