"""Checks of pages made from all documents, and survey signals of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.operators import lint as L
from lakequill.plans.fixtures import Derived
from lakequill.plans.registry import SQL, query, tbl

# sentences begin sections, clauses begin sections below them; a last line by the id
PAGES = Derived("pg", """SELECT doc_id, lang AS title, CASE WHEN doc_id % 2 = 0 THEN 'concept' ELSE 'source' END AS kind,
CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '# ' || lang ELSE '# ' || source END || chr(10) || replace(replace(coalesce(text, ''), '. ', '.' || chr(10) || '## '), ', ', chr(10) || '###  ')
|| CASE doc_id % 5 WHEN 0 THEN chr(10) || '## 知見と考察(まとめ)' WHEN 1 THEN chr(10) || '## 観察可能性' || chr(10) || chr(10) || '#### x' WHEN 2 THEN chr(10) || '## 横断的知見' WHEN 3 THEN chr(10) || '## 検証結果' ELSE chr(10) || '# Second' END AS body FROM {documents}""")
LINES = f"WITH {PAGES.cte}, sp AS (SELECT doc_id, title, kind, string_split(body, chr(10)) AS ls FROM pg), li AS (SELECT doc_id, title, kind, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line, unnest(ls) AS x FROM sp)"


# lines that are not blank are counted up; a section's are the difference to the next heading
@query("h36_empty_sections", SQL(rf"""{LINES}, hd AS (SELECT doc_id, line, x, length(regexp_extract(x, '^(#{{2,4}})\s+', 1)) AS level, sum(CASE WHEN regexp_matches(x, '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS up, count(*) FILTER (regexp_matches(x, '\S')) OVER (PARTITION BY doc_id) AS whole FROM li),
nx AS (SELECT doc_id, line, level, trim(regexp_replace(x, '^#+', '')) AS title, lead(up - 1, 1, whole) OVER w - up AS n_body, lead(level) OVER w AS nl FROM hd WHERE level > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, line, CAST(level AS INTEGER) AS level, md5(title) AS digest FROM nx WHERE n_body = 0 AND (nl IS NULL OR nl <= level)"""))
def empty_sections(spark, d):
    rows = L.empty_sections(L.sections(PAGES.frame(spark, d), "doc_id", "body"))
    return rows.select("doc_id", "line", "level", F.md5("title").alias("digest"))


# generic headings: nothing is left over of the words and the joining signs
@query("q4_heading_rules", SQL(rf"""{LINES}, h AS (SELECT doc_id, title, kind, line, CASE WHEN starts_with(x, '# ') THEN 1 ELSE 2 END AS level, trim(substr(x, CASE WHEN starts_with(x, '# ') THEN 3 ELSE 4 END)) AS t FROM li WHERE starts_with(x, '# ') OR starts_with(x, '## ')),
o AS (SELECT doc_id, list(line ORDER BY line) AS l1, list(t ORDER BY line) AS ts FROM h WHERE level = 1 GROUP BY 1)
SELECT doc_id, CAST(CASE WHEN len(l1) > 1 THEN l1[2] WHEN len(l1) = 1 THEN l1[1] END AS INTEGER) AS line, CASE WHEN l1 IS NULL THEN 'h1-none' WHEN len(l1) > 1 THEN 'h1-many' ELSE 'h1-title' END AS code FROM pg LEFT JOIN o USING (doc_id) WHERE l1 IS NULL OR len(l1) > 1 OR (title <> '' AND ts[1] <> title)
UNION ALL SELECT doc_id, line, 'verifying' FROM h WHERE level = 2 AND kind = 'source' AND (contains(t, '検証パス') OR contains(t, '検証結果') OR contains(t, '出典検査') OR contains(t, '出典検証') OR contains(t, 'ファクトチェック') OR contains(t, '検証済み'))
UNION ALL SELECT doc_id, line, 'generic' FROM h WHERE level = 2 AND kind = 'concept' AND t <> '' AND t NOT IN ('未編纂の観察', '未解決の問い', '横断的知見') AND regexp_full_match(t, '(知見|観察|考察|示唆|まとめ|その他|補足|横断的|[とやおよび並びに・／/、,＆&|｜()（）\[\]「」:：—〜~ \t　-])+')"""))
def heading_rules(spark, d):
    return L.heading_findings(PAGES.frame(spark, d), "doc_id", "title", "kind", "body")


# frequent words are replaced by marks and phrases, some of them inside links
MARKED = Derived("mk", """SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), ' der ', 'ア・イ'), ' and ', CASE WHEN doc_id % 2 = 0 THEN '・・カ' ELSE ' [[a—b・c]] ' END), ' in ', CASE WHEN doc_id % 3 = 0 THEN '—' ELSE '―' END), '. ', '多角的。極めて'), ' of ', ' ![[x|非常に]]掘り下げ不可欠') AS body FROM {documents}""")


# every position is tried
@query("h35_line_lint", SQL(rf"""WITH {MARKED.cte}, sp AS (SELECT doc_id, string_split(body, chr(10)) AS ls FROM mk), li AS (SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line, regexp_replace(unnest(ls), '!?\[\[[^\]]*\]\]', '', 'g') AS x FROM sp),
ch AS (SELECT doc_id, line, x, unnest(range(1, length(x) + 1)) AS p FROM li WHERE contains(x, '・')), dt AS (SELECT doc_id, line, p > 1 AND regexp_full_match(x[p - 1:p - 1], '[\x{{30A0}}-\x{{30FF}}]') AND regexp_full_match(x[p + 1:p + 1], '[\x{{30A0}}-\x{{30FF}}]') AS inner_dot FROM ch WHERE x[p:p] = '・'),
ph AS (SELECT unnest(['重要なのは', '正面から', '多角的', '掘り下げ', '深掘り', 'に他ならない', '包括的', '総合的', '不可欠', '核心的', '鍵となる', '極めて', '非常に']) AS w, unnest(['fail', 'fail', 'fail', 'fail', 'warn', 'warn', 'warn', 'warn', 'warn', 'warn', 'warn', 'warn', 'warn']) AS level),
hits AS (SELECT doc_id, line, 'dashes' AS "check", 'fail' AS level FROM li WHERE contains(x, '—') OR contains(x, '―') UNION ALL SELECT doc_id, line, 'dots', CASE WHEN inner_dot THEN 'warn' ELSE 'fail' END FROM dt UNION ALL SELECT doc_id, line, 'phrases', level FROM li JOIN ph ON contains(x, w))
SELECT doc_id, "check", level, count(*) AS n, min(line) AS first FROM hits GROUP BY 1, 2, 3"""))
def line_lint(spark, d):
    return L.line_findings(MARKED.frame(spark, d), "doc_id", "body")


NUMBER = "lpad(CAST(doc_id % 100000 AS VARCHAR(9)), 5, '0')"
PAPERS = Derived("pp", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'book' ELSE 'paper' END AS kind, CASE doc_id % 11 WHEN 0 THEN '2401.' || {NUMBER} WHEN 1 THEN '2401.' || {NUMBER} || 'v2' WHEN 2 THEN '' END AS arxiv,
CASE doc_id % 13 WHEN 0 THEN '10.1000/a' || {NUMBER} WHEN 1 THEN 'https://doi.org/10.1000/b' || {NUMBER} WHEN 2 THEN '10.1000/C' || {NUMBER} WHEN 3 THEN '11.1000/d' END AS doi,
CASE doc_id % 5 WHEN 0 THEN 'https://arXiv.org/abs/2402.' || {NUMBER} || 'v3' WHEN 1 THEN 'https://doi.org/10.1000/e' || {NUMBER} WHEN 2 THEN 'https://example.org' END AS url,
ARR('arxiv-2403.' || {NUMBER}, CASE WHEN doc_id % 4 = 0 THEN 'notes' WHEN doc_id % 4 = 1 THEN 'arxiv-2403.' || {NUMBER} || 'v2' ELSE 'arxiv-2404.' || {NUMBER} END) AS slugs,
coalesce(text, '') || ' https://arxiv.org/pdf/2405.' || {NUMBER} || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'https://arxiv.org/html/2405.' || {NUMBER} || ' https://doi.org/10.5281/zenodo.77' ELSE 'https://arxiv.org/abs/2406.' || {NUMBER} || ' doi.org/10.1000/h9' END || ' https://doi.org/10.1000/g' || {NUMBER} || ' ' AS body FROM {{documents}}""")


# what the ids were made from is told from the ids alone
@query("h17_derived_identifiers", SQL(f"""WITH {PAPERS.cte}, k AS (SELECT *, {NUMBER} AS n FROM pp) SELECT doc_id,
CASE WHEN doc_id % 11 < 2 THEN '2401.' || n WHEN doc_id % 5 = 0 THEN '2402.' || n WHEN doc_id % 4 < 2 THEN '2403.' || n WHEN kind = 'paper' AND doc_id % 2 = 0 THEN '2405.' || n END AS arxiv,
CASE WHEN doc_id % 11 < 2 THEN 'frontmatter' WHEN doc_id % 5 = 0 THEN 'url' WHEN doc_id % 4 < 2 THEN 'sources' WHEN kind = 'paper' AND doc_id % 2 = 0 THEN 'body' END AS arxiv_from,
CASE WHEN doc_id % 13 < 3 THEN '10.1000/' || ['a', 'b', 'c'][doc_id % 13 + 1] || n WHEN doc_id % 13 = 3 THEN NULL WHEN doc_id % 5 = 1 THEN '10.1000/e' || n WHEN kind = 'paper' AND doc_id % 2 = 0 THEN '10.1000/g' || n END AS doi,
CASE WHEN doc_id % 13 < 4 THEN 'frontmatter' WHEN doc_id % 5 = 1 THEN 'url' WHEN kind = 'paper' AND doc_id % 2 = 0 THEN 'body' END AS doi_from FROM k"""))
def derived_identifiers(spark, d):
    c = F.col
    return PAPERS.frame(spark, d).select("doc_id", *L.derived_identifiers(c("arxiv"), c("doi"), c("url"), c("slugs"), c("body"), c("kind")))


@query("q8_identifier_checks", SQL(f"""WITH {PAPERS.cte}, f AS (SELECT doc_id, unnest(list_filter([
CASE WHEN doc_id % 11 IN (1, 2) THEN {{'code': 'arxiv-shape', 'level': 'error'}} END, CASE WHEN doc_id % 13 = 1 THEN {{'code': 'doi-address', 'level': 'error'}} END, CASE WHEN doc_id % 13 = 3 THEN {{'code': 'doi-shape', 'level': 'error'}} END,
CASE WHEN doc_id % 13 = 2 THEN {{'code': 'doi-capitals', 'level': 'warn'}} END, CASE WHEN kind = 'paper' AND doc_id % 11 > 2 AND doc_id % 5 = 0 THEN {{'code': 'arxiv-missing', 'level': 'warn'}} END, CASE WHEN kind = 'paper' AND doc_id % 13 > 3 AND doc_id % 5 = 1 THEN {{'code': 'doi-missing', 'level': 'warn'}} END],
lambda x: x IS NOT NULL)) AS x FROM pp) SELECT doc_id, x.code AS code, x.level AS level FROM f"""))
def identifier_checks(spark, d):
    c = F.col
    return PAPERS.frame(spark, d).select("doc_id", F.inline(L.identifier_findings(c("arxiv"), c("doi"), c("url"), c("kind"))))


PROFILE = {"out_of_scope": ["Bolt", "ring-"], "core": ["large widget", "small-plate and more"], "adjacent": ["widget", "pin"]}


# items are the concepts, sales the documents, swapped lines lie in the inbox
@query("o16_survey_signals", SQL("""WITH i AS (SELECT DISTINCT item_id, name FROM items WHERE item_id IS NOT NULL), l AS (SELECT item_id, count(DISTINCT sale_id) AS v, count(*) FILTER (flag = 'swapped') AS s FROM sale_lines GROUP BY 1),
f AS (SELECT *, regexp_replace(lower(coalesce(name, '')), '[\\s—・/-]+', '', 'g') AS k FROM i) SELECT item_id, name, coalesce(v, 0) AS n_documents, coalesce(s, 0) AS n_inbox, CASE WHEN v >= 13 THEN 'dense' WHEN v >= 8 THEN 'near' END AS gate, coalesce(s, 0) >= 5 AS in_debt,
CASE WHEN k = '' THEN 'unknown' WHEN length(k) > 3 AND (contains(k, 'bolt') OR contains('bolt', k) OR contains(k, 'ring') OR contains('ring', k)) THEN 'out_of_scope'
WHEN length(k) > 3 AND (contains(k, 'largewidget') OR contains('largewidget', k) OR contains(k, 'smallplateandmore') OR contains('smallplateandmore', k)) THEN 'core' WHEN k = 'pin' OR length(k) > 3 AND (contains(k, 'widget') OR contains('widget', k)) THEN 'adjacent' ELSE 'unknown' END AS fit FROM f LEFT JOIN l USING (item_id)"""))
def survey_signals(spark, d):
    concepts = tbl(spark, d, "items").where("item_id is not null").select("item_id", "name").distinct()
    cites = tbl(spark, d, "sale_lines").select("item_id", F.col("sale_id").alias("document"), (F.coalesce("flag", F.lit("")) == "swapped").alias("inbox"))
    return L.survey_signals(concepts, cites, "item_id", PROFILE)


# a type by the id; a field is left out now and then
FIELDS = Derived("fi", """SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'source' WHEN 1 THEN 'entity' WHEN 2 THEN 'concept' WHEN 3 THEN 'question' WHEN 4 THEN 'survey' END AS type,
CASE WHEN item_id % 7 = 0 THEN '' ELSE kind END AS source_type, brand AS entity_type, CAST(size AS VARCHAR(9)) AS complexity, CASE WHEN item_id % 9 > 3 THEN name END AS answer_quality FROM {items} WHERE item_id IS NOT NULL""")


@query("b6_subtype", SQL(f"""WITH {FIELDS.cte} SELECT item_id, type, coalesce(CASE type WHEN 'source' THEN source_type WHEN 'entity' THEN entity_type WHEN 'concept' THEN complexity ELSE answer_quality END, '') AS subtype FROM fi"""))
def subtypes(spark, d):
    fields = F.create_map(*[x for k in [*L.SUBTYPE.values(), L.OTHERS] for x in (F.lit(k), F.col(k))])
    return FIELDS.frame(spark, d).select("item_id", "type", L.subtype(F.col("type"), fields).alias("subtype"))
