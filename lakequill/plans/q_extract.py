"""Extraction queries: Markdown fixtures, and the raw pages and documents of the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators import extract as X
from lakequill.plans.fixtures import Derived, Fixture
from lakequill.plans.registry import SQL, query, tbl
from lakequill.sources.tables import checkpointed

# every part is a page of one layout, with links to other parts (some of which there are not), sources and files; large ones have no text
_N = "chr(10)"
_C, _E, _A, _B = "'P' || (p_partkey * 7 % 3000)", "'P' || (p_partkey * 3 % 1000)", "'@S' || (p_partkey % 50)", "'@S' || (p_partkey % 50 + 100)"
_LINES = [
    "'---'", "'title: \"' || p_name || '\"'", "'status: ' || CASE WHEN p_size < 10 THEN 'seed' ELSE 'grown' END", "'sources:'",
    f"'  - \"[[' || {_A} || ']]\"'", f"'  - \"[[raw/' || {_B} || '.md|two]]\"'", f"'related: [ [[' || {_C} || ']], [[' || {_E} || '#h|see]] ]'", "'empty:'", "'---'", "'# ' || p_name", "''",
    "'## 定義'", f"'- **not a claim** [[' || {_A} || ']]'", "''", "'## Results (続き)'", f"'- **Latency of ' || p_name || ' halves** with [[' || {_C} || ']] [[' || {_A} || ']]'",
    f"'  - 根拠: [[' || {_B} || ']] table'", f"'  - 反証: [[' || {_A} || ']] none'", f"'- plain bullet [[' || {_E} || ']]'", "'- **Cost is ' || p_size || '** [1, 3-5] at 12.5% and 3K runs'", "''",
    f"'> [!contradiction] With [[' || {_C} || ']]'", f"'> [[' || {_B} || ']] says 10,000 not 20%'", "''", "'```'", "'[[Hidden' || p_size || ']]'", "'## not a heading'", "'```'",
    "'## Log'", "'## [2024-01-02] ingest | one'", f"'- created [[' || {_C} || ']]'", "'## [2024-02-03] lint | two ' || p_name", f"'- updated [[' || {_E} || ']]'",
]
_PAGE = "'concepts/P' || p_partkey || '.md'"
MD = Derived("md", f"SELECT {_PAGE} AS page, CASE WHEN p_size <= 48 THEN {f' || {_N} || '.join(_LINES)} END AS body FROM {{part}}")
WRITTEN = "part WHERE p_size <= 48"
LINK = X.WIKILINK


@query("b1_front_matter_scalar", SQL(f"WITH {MD.cte} SELECT page, nullif(trim(regexp_extract(body, '(?m)^title:[ \\t]*(.+?)[ \\t]*$', 1), '\"'''), '') AS title, nullif(regexp_extract(body, '(?m)^status:[ \\t]*(.+?)[ \\t]*$', 1), '') AS status, nullif(regexp_extract(body, '(?m)^empty:[ \\t]*(.+?)[ \\t]*$', 1), '') AS empty FROM md"))
def scalars(spark, d):
    return MD.frame(spark, d).select("page", *[X.scalar("body", k).alias(k) for k in ("title", "status", "empty")])


@query("b2_front_matter_links", SQL(f"SELECT {_PAGE} AS page, CASE WHEN p_size <= 48 THEN [{_A}, 'raw/' || {_B} || '.md'] END AS sources, CASE WHEN p_size <= 48 THEN [{_C}, {_E}] END AS related FROM part"))
def front_links(spark, d):
    return MD.frame(spark, d).select("page", *[X.front_links("body", k).alias(k) for k in ("sources", "related")])


@query("h7_wikilinks", SQL(f"WITH {MD.cte} SELECT page, regexp_extract_all(body, '{LINK}', 1) AS links FROM md"))
def wikilinks(spark, d):
    return MD.frame(spark, d).select("page", X.wikilinks("body").alias("links"))


@query("h8_link_names", SQL(f"WITH {MD.cte}, l AS (SELECT page, unnest(regexp_extract_all(body, '{LINK}', 1)) AS t FROM md) SELECT page, regexp_replace(string_split(trim(t), '/')[-1], '\\.md$', '') AS name, count(*) AS n FROM l GROUP BY ALL"))
def link_names(spark, d):
    return MD.frame(spark, d).select("page", F.explode(X.wikilinks("body")).alias("t")).select("page", X.link_name(F.col("t")).alias("name")).groupBy("page", "name").agg(F.count("*").alias("n"))


@query("c1_first_wins_link_resolution", SQL(f"""WITH {MD.cte}, stems AS (SELECT regexp_extract(page, '([^/]+)\\.md$', 1) AS name, min(page) AS target FROM md GROUP BY 1), l AS (SELECT page, unnest(regexp_extract_all(body, '{LINK}', 1)) AS name FROM md)
SELECT DISTINCT l.page AS src, target AS dst FROM l JOIN stems USING (name) WHERE l.page <> target"""))
def resolution(spark, d):
    md = MD.frame(spark, d)
    stems = md.groupBy(F.regexp_extract("page", r"([^/]+)\.md$", 1).alias("name")).agg(F.min("page").alias("dst")).hint("merge")  # as many as pages, so never broadcast
    return md.select(F.col("page").alias("src"), F.explode(X.wikilinks("body")).alias("name")).join(stems, "name").where("src <> dst").select("src", "dst").distinct()


@query("c2_dead_links", SQL(f"""WITH {MD.cte}, stems AS (SELECT regexp_extract(page, '([^/]+)\\.md$', 1) AS name FROM md), l AS (SELECT page, unnest(regexp_extract_all(body, '{LINK}', 1)) AS name FROM md)
SELECT name AS target, count(*) AS refs, list_sort(list(DISTINCT page)) AS referrers FROM l WHERE name NOT IN (SELECT name FROM stems) GROUP BY name"""))
def dead(spark, d):
    md = MD.frame(spark, d)
    stems = md.select(F.regexp_extract("page", r"([^/]+)\.md$", 1).alias("target")).hint("merge")
    gone = md.select("page", F.explode(X.wikilinks("body")).alias("target")).join(stems, "target", "left_anti")
    return gone.groupBy("target").agg(F.count("*").alias("refs"), F.sort_array(F.collect_set("page")).alias("referrers"))


@query("b7_dead_target_causes", SQL(f"""WITH {MD.cte}, t AS (SELECT DISTINCT unnest(regexp_extract_all(body, '{LINK}', 1)) AS t FROM md)
SELECT t AS target, CASE WHEN t LIKE 'raw/%' OR t LIKE '_attachments/%' THEN 'file-ref' WHEN regexp_matches(t, '\\.[A-Za-z0-9]{{1,5}}$') THEN 'file-ref' WHEN t LIKE '@%' THEN 'missing-source' ELSE 'missing-page' END AS cause FROM t"""))
def causes(spark, d):
    t = MD.frame(spark, d).select(F.explode(X.wikilinks("body")).alias("target")).distinct()
    cause = F.when(F.col("target").rlike("^(raw|_attachments)/") | F.col("target").rlike(r"\.[A-Za-z0-9]{1,5}$"), "file-ref").when(F.startswith("target", F.lit("@")), "missing-source").otherwise("missing-page")
    return t.select("target", cause.alias("cause"))


@query("h9_links_outside_fences", SQL(f"SELECT {_PAGE} AS page, unnest([{_A}, 'raw/' || {_B} || '.md', {_C}, {_E}, {_A}, {_C}, {_A}, {_B}, {_A}, {_E}, {_C}, {_B}, {_C}, {_E}]) AS link, unnest([5, 6, 7, 7, 13, 16, 16, 17, 18, 19, 22, 23, 31, 33]) AS no FROM {WRITTEN}"))
def outside(spark, d):
    rows = X.fenced(MD.frame(spark, d), "page", "body").where("not fence")
    return rows.select("page", F.explode(X.wikilinks("line")).alias("link"), "no")


@query("h28_sections", SQL(f"""SELECT {_PAGE} AS page, section, CAST(n AS BIGINT) AS n FROM {WRITTEN.replace(' WHERE', ", (VALUES ('定義', 2), ('Results (続き)', 11), ('not a heading', 1), ('Log', 0), ('[2024-01-02] ingest | one', 1)) v(section, n) WHERE")}
UNION ALL SELECT {_PAGE}, '[2024-02-03] lint | two ' || p_name, 1 FROM {WRITTEN}"""))
def sections(spark, d):
    rows = X.sections(X.lines(MD.frame(spark, d).where("body is not null"), "page", "body"), "page").where("section is not null")
    return rows.groupBy("page", "section").agg(F.count_if(~F.col("is_heading")).alias("n"))


@query("b13_section_kinds", SQL(f"""SELECT * FROM (VALUES ('定義', 'definition'), ('Results (続き)', 'topic'), ('not a heading', 'topic'), ('Log', 'topic'), ('[2024-01-02] ingest | one', 'topic')) v(section, kind)
UNION ALL SELECT DISTINCT '[2024-02-03] lint | two ' || p_name, 'topic' FROM {WRITTEN}"""))
def section_kinds(spark, d):
    s = X.sections(X.lines(MD.frame(spark, d).where("body is not null"), "page", "body"), "page").where("is_heading").select("section").distinct()
    base = F.trim(F.regexp_replace("section", r"[(（][^()（）]*[)）]\s*$", ""))
    return s.select("section", F.when(base == "定義", "definition").when(base == "子概念", "children").when(base.isin("関連", "出典", "参照"), "reference").otherwise("topic").alias("kind"))


@query("n1_claims", SQL(f"""SELECT {_PAGE} AS page, 'Results (続き)' AS section, 16 AS line, 'Latency of ' || p_name || ' halves' AS claim, [{_A}, {_B}] AS sources, [{_C}] AS targets, 2 AS evidence FROM {WRITTEN}
UNION ALL SELECT {_PAGE}, 'Results (続き)', 20, 'Cost is ' || p_size, [], [], 0 FROM {WRITTEN}"""))
def claims(spark, d):
    c = MD.frame(spark, d).select("page", F.explode(X.claims_udf("body")).alias("c"))
    return c.select("page", "c.section", "c.line", "c.claim", "c.sources", "c.targets", F.size("c.evidence").alias("evidence"))


@query("n2_evidence_roles", SQL(f"SELECT 'Latency of ' || p_name || ' halves' AS claim, role, count(*) AS n FROM {WRITTEN.replace(' WHERE', ", (VALUES ('根拠'), ('反証')) v(role) WHERE")} GROUP BY ALL"))
def evidence(spark, d):
    c = MD.frame(spark, d).select(F.explode(X.claims_udf("body")).alias("c")).select("c.claim", F.explode("c.evidence").alias("e"))
    return c.groupBy("claim", F.regexp_extract("e", "^([^:：]+)[:：]", 1).alias("role")).agg(F.count("*").alias("n"))


@query("n3_callouts", SQL(f"SELECT {_PAGE} AS page, 'Results (続き)' AS section, 22 AS line, 1 AS depth, 'With [[' || {_C} || ']]' AS title, '[[' || {_B} || ']] says 10,000 not 20%' AS body, [{_C}] AS pages, [{_B}] AS sources FROM {WRITTEN}"))
def callouts(spark, d):
    return MD.frame(spark, d).select("page", F.explode(X.callouts_udf("body")).alias("c")).select("page", "c.*")


@query("q19_callout_ids", SQL(f"SELECT 'x-' || lpad(CAST(row_number() OVER (ORDER BY {_PAGE}) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY {_PAGE}) AS VARCHAR))) AS INTEGER), '0') AS id, {_PAGE} AS page, 'open' AS status FROM {WRITTEN}"))
def callout_ids(spark, d):
    """Numbers run over all pages in order: counted within ranges of pages, behind the sum of the ranges before."""
    c = checkpointed(callouts(spark, d).select("page", "line", "body").repartitionByRange("page", "line").withColumn("part", F.spark_partition_id()))
    before = c.groupBy("part").agg(F.count("*").alias("k"))  # a row a partition
    before = before.withColumn("before", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = (F.row_number().over(W.partitionBy("part").orderBy("page", "line")) + F.col("before")).cast("string")
    explained = F.col("body").rlike("(?i)resolved|explained|解消")
    c = c.join(F.broadcast(before), "part").withColumn("n", n)
    return c.select(F.concat(F.lit("x-"), F.when(F.length("n") < 4, F.lpad("n", 4, "0")).otherwise(F.col("n"))).alias("id"), "page", F.when(explained, "explained").otherwise("open").alias("status"))


@query("n4_log_entries", SQL(f"SELECT {_PAGE} AS page, '2024-01-02' AS date, 'ingest' AS op, 'one' AS title, [{_C}] AS links FROM {WRITTEN} UNION ALL SELECT {_PAGE}, '2024-02-03', 'lint', 'two ' || p_name, [{_E}] FROM {WRITTEN}"))
def log_entries(spark, d):
    rows = X.lines(MD.frame(spark, d).where("body is not null"), "page", "body")
    head = r"^## \[(\d{4}-\d{2}-\d{2})\] (\S+) \| (.*)$"
    w = W.partitionBy("page").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.sum(F.col("line").rlike(head).cast("int")).over(w)).where("entry > 0")
    first = F.min_by("line", "no")
    return rows.groupBy("page", "entry").agg(first.alias("h"), F.flatten(F.collect_list(X.wikilinks("line"))).alias("links")).select("page", F.regexp_extract("h", head, 1).alias("date"), F.regexp_extract("h", head, 2).alias("op"), F.regexp_extract("h", head, 3).alias("title"), "links")


BRACKETS = Derived("brackets", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size || ', ' || (p_size + 2) || '-' || (p_size + 4) WHEN 1 THEN '' || p_size WHEN 2 THEN '1-90' ELSE p_size || '–' || (p_size + 1) END AS inside FROM {part}")
NUMBERS = Derived("numbers", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'at ' || p_size || '.5% and ' || p_size || 'K runs [4]' WHEN 1 THEN p_size || ',000 not 20%' WHEN 2 THEN p_size || '.5億 in 2024, Figure 3' WHEN 3 THEN NULL
 ELSE p_size || ',000,000 = ' || p_size || 'M' END AS text FROM {part}""")


@query("h23_citation_brackets", SQL("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN [p_size, p_size + 2, p_size + 3, p_size + 4] WHEN 1 THEN [p_size] WHEN 2 THEN [] ELSE [p_size, p_size + 1] END AS numbers FROM part"))
def brackets(spark, d):
    return BRACKETS.frame(spark, d).select("id", X.bracket_numbers(F.col("inside")).alias("numbers"))


@query("h25_number_keys", SQL("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN [p_size || '.5%', p_size || '000'] WHEN 1 THEN [p_size || '000', '20%'] WHEN 2 THEN [p_size || '50000000', '2024'] WHEN 3 THEN [] ELSE [p_size || '000000'] END AS keys FROM part"))
def numbers(spark, d):
    return NUMBERS.frame(spark, d).select("id", X.numbers_udf("text").alias("keys"))


@query("o8_number_verification", SQL("""SELECT p_partkey AS claim, p_size || '.5%' AS key, CASE WHEN p_size % 3 = 0 THEN 'ok' WHEN p_size % 3 = 1 THEN 'raw_only' ELSE 'missing' END AS state FROM part
UNION ALL SELECT p_partkey, p_size || '000', CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'missing' END FROM part"""))
def verification(spark, d):
    part = tbl(spark, d, "part").select(F.col("p_partkey").alias("claim"), F.col("p_size").alias("n"))
    claims_ = part.select("claim", F.concat("n", F.lit(".5% of "), "n", F.lit("K")).alias("text"))
    share, whole = F.concat("n", F.lit(".5 % here: "), "n", F.lit(".5%")), F.concat("n", F.lit(",000 nodes"))
    held = part.select("claim", F.lit("page").alias("side"), F.concat_ws(" and ", F.when(F.col("n") % 3 == 0, share), F.when(F.col("n") % 2 == 0, whole)).alias("text"))
    held = held.unionByName(part.where("n % 3 < 2").select("claim", F.lit("raw").alias("side"), share.alias("text")))
    c = claims_.select("claim", F.explode(X.numbers_udf("text")).alias("key"))
    h = held.select("claim", "side", F.explode(X.numbers_udf("text")).alias("key")).groupBy("claim", "key").agg(F.max(F.col("side") == "page").alias("page"))
    return c.join(h, ["claim", "key"], "left").select("claim", "key", F.when(F.col("page"), "ok").when(F.col("page").isNotNull(), "raw_only").otherwise("missing").alias("state"))


@query("h4_paragraph_chunks", None)
def chunks(spark, d):
    docs = tbl(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    c = docs.select("doc_id", F.posexplode(X.pieces_udf("text", X.paragraph_chunks)).alias("chunk", "body"))
    return c.select("doc_id", "chunk", F.length("body").alias("chars"), F.sha2("body", 256).alias("body_hash"))


@query("h6_byte_pieces", SQL("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text <> ''"))
def pieces(spark, d):
    c = tbl(spark, d, "documents").select("doc_id", F.explode(X.pieces_udf("text", X.byte_pieces)).alias("piece"))
    return c.groupBy("doc_id").agg(F.sum(F.octet_length("piece").cast("long")).alias("bytes"))


@query("h5_synthetic_prefix", SQL("SELECT doc_id, lang || ': ' || left(regexp_extract(text, '^[^.!?]*[.!?]?'), 300) AS prefix FROM documents"))
def prefix(spark, d):
    return tbl(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(": "), F.substring(F.regexp_extract("text", "^[^.!?]*[.!?]?", 0), 1, 300)).alias("prefix"))


HREF = 'href="([^"]*)"'


@query("n9_page_hrefs", SQL(f"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY ALL"))
def hrefs(spark, d):
    return tbl(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("q3_unresolved_hrefs", SQL(f"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages) SELECT href, count(*) AS refs FROM h WHERE href NOT IN (SELECT url FROM pages) GROUP BY href"))
def unresolved(spark, d):
    h = tbl(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    return h.join(tbl(spark, d, "pages").select(F.col("url").alias("href")).distinct(), "href", "left_anti").groupBy("href").agg(F.count("*").alias("refs"))


@query("h41_tag_strip", SQL("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars FROM pages"))
def tag_strip(spark, d):
    return tbl(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("chars"))


@query("b20_url_host", SQL("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('localhost', '127.0.0.1', '::1') AS loopback FROM pages"))
def hosts(spark, d):
    host = F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit(""))
    return tbl(spark, d, "pages").select("page_id", host.alias("host"), host.isin("localhost", "127.0.0.1", "::1").alias("loopback"))


@query("l6_hashes", SQL("SELECT doc_id, sha256(text) AS body_hash, left(sha1(text), 10) AS claim_id FROM documents"))
def hashes(spark, d):
    return tbl(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("body_hash"), F.substring(F.sha1("text"), 1, 10).alias("claim_id"))


@query("d27_inverted_abstract", SQL("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\S+'), ' ') AS text FROM documents"))
def inverted(spark, d):
    """Words with their positions, turned back to text."""
    return tbl(spark, d, "documents").select("doc_id", X.from_inverted(X.inverted(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))).alias("text"))


@query("q49_slugs", SQL("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier"))
def slugs(spark, d):
    return tbl(spark, d, "supplier").select("s_suppkey", F.regexp_replace(F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", "-"), "^-|-$", "").alias("slug"))
