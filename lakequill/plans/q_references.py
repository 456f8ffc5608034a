"""Bibliographies and spelt numbers, in texts made from all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.operators import references as R
from lakequill.operators import spelt as S
from lakequill.plans.registry import SQL, query, tbl

# line i of n: a bibliography from the middle to three quarters, headed twice before it; numbers are cited in the lines before
AT, ENDS = "floor(n / 2)", "floor(3 * n / 4) + 1"
LINE = f"""CASE WHEN i = floor(n / 4) THEN 'References ........ 12' WHEN i = {AT} THEN CASE WHEN doc_id % 9 = 0 THEN 'Index' WHEN doc_id % 9 < 4 THEN '7. R E F E R E N C E S' ELSE '■ Bibliography' END WHEN i = {ENDS} THEN 'Appendix A'
WHEN i > {AT} AND i < {ENDS} THEN '[' || CAST(i - {AT} AS BIGINT) || '] ' || substr(t, 1, 60) || CASE WHEN doc_id % 3 = 0 THEN ', arXiv:2401.1' || lpad(CAST(i AS VARCHAR(9)), 4, '0') || 'v2' WHEN doc_id % 3 = 1 THEN ' doi.org/10.1000/X(' || CAST(i AS VARCHAR(9)) || ').' ELSE ' 10.5281/zenodo.' || CAST(i AS VARCHAR(9)) END
WHEN i % 4 = 0 THEN 'Unlike ' || substr(t, 1, 40 + CAST(doc_id % 70 AS INTEGER)) || ' [1, 3-4] ' || substr(t, 111, 200) WHEN i % 4 = 1 THEN 'xwhereas ' || substr(t, 1, 20) || ' [2]. ' || t ELSE t END"""
TEXTS = f"""tx0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), tx1 AS (SELECT doc_id, CAST(len(ls) AS INTEGER) AS n, unnest(ls) AS t, CAST(unnest(range(len(ls))) AS INTEGER) AS i FROM tx0),
tl AS (SELECT doc_id, n, i, {LINE} AS line FROM tx1), hd AS (SELECT doc_id, max(i) FILTER (regexp_matches(line, '^(7\\. R E F E R E N C E S|■ Bibliography)$')) AS first FROM tl GROUP BY 1),
bd AS (SELECT doc_id, any_value(first) AS first, CASE WHEN any_value(first) IS NOT NULL THEN coalesce(min(i) FILTER (regexp_matches(line, '^Appendix\\b') AND i > first), any_value(n)) END AS fin FROM tl JOIN hd USING (doc_id) GROUP BY 1)"""
ITEMS = """pc AS (SELECT doc_id, i - first AS k, line FROM tl JOIN bd USING (doc_id) WHERE i >= first AND i < fin)"""


def _texts(spark, d):
    rows = tbl(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("ls"))
    each = rows.select("doc_id", F.size("ls").alias("n"), F.posexplode("ls").alias("i", "t")).withColumn("line", F.expr(LINE))
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("h21_bibliography_region", SQL(f"WITH {TEXTS}, {ITEMS}, r AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM pc GROUP BY 1) SELECT doc_id, first, CAST(fin AS INTEGER) AS fin, digest FROM bd LEFT JOIN r USING (doc_id)"))
def region(spark, d):
    return R.regions(_texts(spark, d), "doc_id", "text").select("doc_id", "first", F.col("end").alias("fin"), F.md5("region").alias("digest"))


# an item is a line here, but for the heading; where no line has a number, the heading is one itself
@query("n7_bibliography_items", SQL(rf"""WITH {TEXTS}, {ITEMS}, m AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS whole FROM pc GROUP BY 1), s AS (SELECT doc_id, string_split(regexp_replace(whole, '(\[\d+\])', chr(1) || '\1', 'g'), CASE WHEN regexp_matches(whole, '\[\d+\]') THEN chr(1) ELSE chr(10) END) AS parts FROM m),
f AS (SELECT doc_id, list_filter(parts, lambda x: regexp_matches(x, '\S')) AS parts FROM s), u AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS item FROM f)
SELECT doc_id, pos, TRY_CAST(regexp_extract(item, '^\s*\[(\d+)\]', 1) AS INTEGER) AS number, md5(item) AS digest FROM u"""))
def bibliography_items(spark, d):
    return R.items(R.regions(_texts(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "pos", "number", F.md5("item").alias("digest"))


# every opening bracket of the text before the bibliography is tried
@query("h24_cited_in_contrast", SQL(rf"""WITH {TEXTS}, {ITEMS}, body AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS b FROM tl JOIN bd USING (doc_id) WHERE first IS NULL OR i < first GROUP BY 1),
op AS (SELECT doc_id, b, unnest(list_filter(range(1, length(b) + 1), lambda p: b[p:p] = '[')) AS p FROM body), ci AS (SELECT doc_id, b, p, regexp_extract(b[p:p + 20], '^\[(\d+(, \d+-\d+)?)\]', 1) AS inside FROM op),
wi AS (SELECT doc_id, inside, (SELECT bool_or(starts_with(regexp_replace(lower(z), '\s+', ' ', 'g'), c) AND NOT regexp_matches(substr(b, q - 1, 1), '[A-Za-z0-9_]') AND NOT regexp_matches(z[length(c) + 1:length(c) + 1], '[A-Za-z0-9_]'))
 FROM (SELECT q, b[q:p - 1] AS z FROM (SELECT unnest(range(greatest(1, p - 80), p)) AS q)), (SELECT unnest(['unlike', 'in contrast', 'whereas', 'as opposed to', 'differ from', 'differs from', 'differed from', 'differing from', 'different from']) AS c)) AS contrast FROM ci WHERE inside <> ''),
no AS (SELECT doc_id, unnest(CASE WHEN contains(inside, ',') THEN [1, 3, 4] ELSE [CAST(inside AS INTEGER)] END) AS number, contrast FROM wi), sa AS (SELECT doc_id, number, count(*) AS cites, count(*) FILTER (contrast) AS contrasts FROM no GROUP BY ALL),
it AS (SELECT doc_id, CAST(k AS INTEGER) AS number, CASE WHEN doc_id % 3 = 0 THEN 'arxiv:2401.1' || lpad(CAST(k + first AS VARCHAR), 4, '0') ELSE 'doi:10.1000/x(' || CAST(k + first AS VARCHAR) || ')' END AS ident FROM pc JOIN bd USING (doc_id) WHERE k > 0 AND doc_id % 3 < 2)
SELECT doc_id, number, coalesce(cites, 0) AS cites, coalesce(contrasts, 0) AS contrasts, [ident] AS idents FROM it LEFT JOIN sa USING (doc_id, number)"""))
def cited_in_contrast(spark, d):
    return R.cited_items(_texts(spark, d), "doc_id", "text")


# two numbers are spelt after each document's own text
ONE, TEN = "one two three four five six seven eight nine".split(), S.TENS


def _spell(at):
    o, t = at(ONE, "doc_id % 9"), at(TEN, "doc_id % 8")
    return f"CASE doc_id % 5 WHEN 0 THEN ' ' || {t} || '-' || {o} || ' million and ' || {o} WHEN 1 THEN ' ' || {o} || ' hundred  billion' WHEN 2 THEN ' Half thousand, TWICE' WHEN 3 THEN ' ' || {t} || ' ' || {o} || 's ' || {t} ELSE ' a dozen ' || {o} || ' thousandth seventeen' END"


MADE = "coalesce(text, '') || chr(10) || " + _spell(lambda ws, i: f"{ws}[CAST({i} AS INTEGER) + 1]")
SPARK_MADE = "coalesce(text, '') || chr(10) || " + _spell(lambda ws, i: f"array({', '.join(map(repr, ws))})[CAST({i} AS INTEGER)]")
VALUE = f"CASE WHEN ends_with(w, ' hundred') THEN 100 * (list_position({ONE}, split_part(w, ' ', 1))) ELSE list_sum(list_transform(string_split(replace(w, '-', ' '), ' '), lambda p: map_extract(MAP {{{', '.join(f"'{w}': {float(v)}" for w, v in S.WORDS.items())}}}, p)[1])) END"


@query("h26_spelt_numbers", SQL(f"""WITH d AS (SELECT doc_id, lower({MADE}) AS x FROM documents), a AS (SELECT doc_id, unnest(regexp_extract_all(x, '\\b({S.NUMBER})\\b', 1)) AS w, 1 AS s FROM d),
b AS (SELECT doc_id, unnest(regexp_extract_all(x, '\\b({S.NUMBER})\\s+(thousand|million|billion)\\b', 1)) AS w, unnest(regexp_extract_all(x, '\\b({S.NUMBER})\\s+(thousand|million|billion)\\b', 2)) AS u FROM d),
v AS (SELECT doc_id, {VALUE} * s AS v FROM a UNION SELECT doc_id, {VALUE} * CASE u WHEN 'thousand' THEN 1e3 WHEN 'million' THEN 1e6 ELSE 1e9 END FROM b)
SELECT doc_id, list(CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END ORDER BY v) AS keys FROM v GROUP BY 1"""))
def spelt_numbers(spark, d):
    made = tbl(spark, d, "documents").select("doc_id", F.expr(SPARK_MADE).alias("text"))
    keys = F.transform(F.array_sort(F.transform(S.spelt_keys("text"), lambda k: F.struct(k.cast("double").alias("v"), k.alias("k")))), lambda x: x["k"])
    return made.select("doc_id", keys.alias("keys")).where(F.size("keys") > 0)
