"""Resolution queries: identifiers and names of small fixtures, and pairs over suppliers, customers, parts and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.functions import text as TX
from lakequill.operators import resolve as R
from lakequill.operators import tiles as TI
from lakequill.plans.fixtures import Derived
from lakequill.plans.registry import SQL, query, tbl

# clients are persons; a vendor is an organisation with an acronym behind its name, and stands a second time under the acronym alone
ENT = Derived("ent", """SELECT client_id * 3 AS id, name AS title, 'person' AS kind, ARR(substr(name, 1, 1) || '. ' || city, city, substr(name, 1, 5), 'ab', name || ' ' || city) AS aliases FROM {clients} WHERE name IS NOT NULL
UNION ALL SELECT vendor_id * 3 + 1, name || ' (V' || vendor_id || ')', 'organization', ARR('V ' || vendor_id, name) FROM {vendors} WHERE name IS NOT NULL
UNION ALL SELECT vendor_id * 3 + 2, 'V' || vendor_id, 'organization', ARR('vendor ' || vendor_id) FROM {vendors}""")
_FOLD = "regexp_replace(lower({}), '[^0-9a-z\u3040-\u30ff\u4e00-\u9fff]+', '', 'g')"
EXACT = f"""{ENT.cte}, f AS (SELECT id, {_FOLD.format('title')} AS k FROM ent), ex AS (SELECT x.id AS a, y.id AS b, 'strong' AS tier FROM f x JOIN f y USING (k) WHERE x.id < y.id AND k <> '')"""


_BEFORE, _AFTER = ["", "The ", "A ", "the "], ["", " Inc.", " Company", " KK", ", Ltd. Co.", " 株式会社", " Co Works"]
_NAMES = f"SELECT p_partkey AS id, {_BEFORE}[1 + p_partkey % 4] || p_name || {_AFTER}[1 + p_partkey % 7] AS title FROM part"
_KEYS = f"regexp_replace(regexp_replace(regexp_replace(' ' || regexp_replace(lower(title), '[-,./&()_ ]+', ' ', 'g') || ' ', ' the ', ' ', 'g'), '( ({'|'.join(R.LEGAL)}))+ *$', ''), '[^0-9a-z\u3040-\u30ff\u4e00-\u9fff]+', '', 'g')"


@query("h11_entity_keys", SQL(f"WITH n AS ({_NAMES}) SELECT id, {_KEYS} AS entity_key FROM n"))
def entity_keys(spark, d):
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (1 + F.col("p_partkey") % n).cast("int"))
    names = tbl(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(pick(_BEFORE, 4), "p_name", pick(_AFTER, 7)).alias("title"))
    return names.select("id", R.entity_key("title", F.lit("organization")).alias("entity_key"))


@query("h10_fold", SQL(f"WITH {ENT.cte} SELECT id, {_FOLD.format('title')} AS folded FROM ent"))
def folds(spark, d):
    return ENT.frame(spark, d).select("id", TX.fold_udf("title").alias("folded"))


@query("c11_exact_key_pairs", SQL(f"WITH {EXACT} SELECT * FROM ex"))
def exact_pairs(spark, d):
    e = ENT.frame(spark, d).select("id", R.entity_key("title", "kind").alias("k")).where("k <> ''")
    return R.blocked_pairs(e, "id", "k").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.lit("strong").alias("tier"))


@query("c12_person_names", None)
def person_pairs(spark, d):
    e = ENT.frame(spark, d).where("kind = 'person'").select("id", R.person_name("title").alias("name")).select("id", "name.surname", "name.given")
    return R.blocked_pairs(e, "id", "surname", 2, 60).where(R.given_names_agree(F.col("a_given"), F.col("b_given"))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _word_set(col):
    ws = F.split(F.regexp_replace(F.lower(col), "[^a-z0-9-]+", " "), " ")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(ws, lambda w: (w != "") & ~w.isin(R.CONNECTORS)))), " ")


SETS = """list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ('of', 'for', 'and', 'de', 'der', 'the')))), 'string_agg', ' ')"""


@query("c13_set_equality", SQL(f"WITH {ENT.cte}, s AS (SELECT id, {SETS} AS k FROM ent) SELECT x.id AS a, y.id AS b, x.k AS words FROM s x JOIN s y USING (k) WHERE x.id < y.id"))
def set_pairs(spark, d):
    e = ENT.frame(spark, d).select("id", _word_set("title").alias("words"))
    return R.blocked_pairs(e, "id", "words").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "words")


@query("c14_acronym_join", SQL(f"WITH {ENT.cte}, a AS (SELECT id, regexp_replace(lower(regexp_extract(title, '[(（]([A-Z0-9&.-]{{2,12}})[)）]\\s*$', 1)), '[^0-9a-z]+', '', 'g') AS k FROM ent), n AS (SELECT id, regexp_replace(lower(title), '[^0-9a-z]+', '', 'g') AS k FROM ent) SELECT a.id AS a, n.id AS b, k AS acronym FROM a JOIN n USING (k) WHERE k <> '' AND a.id <> n.id"))
def acronyms(spark, d):
    e = ENT.frame(spark, d)
    a = e.select(F.col("id").alias("a"), TX.fold_latin(F.regexp_extract("title", r"[(（]([A-Z0-9&.\-]{2,12})[)）]\s*$", 1)).alias("acronym")).where("acronym <> ''")
    return a.join(e.select(F.col("id").alias("b"), TX.fold_latin("title").alias("acronym")), "acronym").where("a <> b").select("a", "b", "acronym")


@query("c15_fuzzy_blocked", None)
def fuzzy(spark, d):
    e = ENT.frame(spark, d).select("id", R.entity_key("title", "kind").alias("k")).where("length(k) >= 8").withColumn("block", F.substring("k", 1, 2))
    p = R.blocked_pairs(e, "id", "block", 2, 400).where("a_k <> b_k and abs(length(a_k) - length(b_k)) <= 3")
    return p.where(R.ratio_udf("a_k", "b_k") >= 0.92).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.lit("weak").alias("tier"))


@query("b17_identifying_aliases", SQL(f"""WITH {ENT.cte}, x AS (SELECT id, kind, title, unnest(aliases) AS alias FROM ent), y AS (SELECT *, {_FOLD.format('alias')} AS fa, {_FOLD.format('title')} AS ft FROM x)
SELECT id, alias FROM y WHERE length(fa) >= 3 AND NOT (fa <> ft AND contains(ft, fa)) AND NOT (kind = 'person' AND regexp_matches(alias, '^[A-Za-z]\\.\\s*\\S'))"""))
def aliases(spark, d):
    e = ENT.frame(spark, d).select("id", "kind", F.explode("aliases").alias("alias"), TX.fold_udf("title").alias("ft")).withColumn("fa", TX.fold_udf("alias"))
    initial = F.col("kind").isin("person") & F.col("alias").rlike(r"^[A-Za-z]\.\s*\S")
    return e.where((F.length("fa") >= 3) & ~((F.col("fa") != F.col("ft")) & F.contains("ft", F.col("fa"))) & ~initial).select("id", "alias")


# decisions: clients that share a master, by where the second came from
DEC = Derived("dec", """SELECT x.client_id * 3 AS a, y.client_id * 3 AS b, CASE WHEN y.source = 'web' THEN 'rejected' ELSE 'merged' END AS verdict, y.client_id AS dropped
FROM {clients} x JOIN {clients} y ON x.master_id = y.master_id WHERE x.client_id < y.client_id AND y.source IN ('web', 'crm')""")


@query("c18_decided_pairs_left_out", SQL(f"WITH {EXACT}, {DEC.cte} SELECT a, b FROM ex WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.a = ex.a AND dec.b = ex.b)"))
def undecided(spark, d):
    return exact_pairs(spark, d).join(DEC.frame(spark, d), ["a", "b"], "left_anti").select("a", "b")


# at table scale
@query("c11_same_name_suppliers_customers", SQL("WITH s AS (SELECT s_suppkey, regexp_replace(lower(s_name), '[^0-9]+', '', 'g') AS k FROM supplier), c AS (SELECT c_custkey, regexp_replace(lower(c_name), '[^0-9]+', '', 'g') AS k FROM customer) SELECT s_suppkey, c_custkey FROM s JOIN c USING (k)"))
def same_names(spark, d):
    s = tbl(spark, d, "supplier").select("s_suppkey", F.regexp_replace(F.lower("s_name"), "[^0-9]+", "").alias("k"))
    return s.join(tbl(spark, d, "customer").select("c_custkey", F.regexp_replace(F.lower("c_name"), "[^0-9]+", "").alias("k")), "k").select("s_suppkey", "c_custkey")


@query("c16_part_pairs_by_rule", SQL("""WITH p AS (SELECT p_partkey AS id, p_type AS t, p_brand AS b, p_size AS z FROM part), r AS (
SELECT x.id AS a, y.id AS b, 2 AS tier FROM p x JOIN p y USING (t, b, z) WHERE x.id < y.id UNION ALL SELECT x.id, y.id, 1 FROM p x JOIN p y USING (t, b) WHERE x.id < y.id AND abs(x.z - y.z) <= 1)
SELECT a, b, max(tier) AS tier FROM r GROUP BY ALL"""))
def by_rule(spark, d):
    """Both rules in one equi-join: a part meets its type and brand under its own size and those beside it, so that only pairs of the result are made.

    A pair comes once unless an id has several rows; pairs of such ids alone are grouped for their best tier.
    """
    p = tbl(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand", F.col("p_size").cast("long").alias("z")).where("id is not null and z is not null").distinct()
    several = p.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").hint("merge")
    once, multi = p.join(several, "id", "left_anti"), p.join(several, "id", "left_semi")

    def met(x, y):
        a = x.select(F.col("id").alias("a"), "p_type", "p_brand", F.explode(F.array(F.struct((F.col("z") - 1).alias("z"), F.lit(1).alias("tier")), F.struct("z", F.lit(2).alias("tier")), F.struct((F.col("z") + 1).alias("z"), F.lit(1).alias("tier")))).alias("s"))
        b = y.select(F.col("id").alias("b"), "p_type", "p_brand", "z").hint("merge")
        return a.select("a", "p_type", "p_brand", "s.z", "s.tier").join(b, ["p_type", "p_brand", "z"]).where("a < b").select("a", "b", "tier")

    again = met(multi, p).unionByName(met(once, multi)).groupBy("a", "b").agg(F.max("tier").alias("tier"))
    return met(once, once).unionByName(again)


def _tiling_sql(error: float, review: float) -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
c AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(list_zip(x.e, y.e), lambda z: z[1] * z[2])) / (x.n * y.n) AS cos FROM n x JOIN n y ON x.vec_id < y.vec_id WHERE x.n > 0 AND y.n > 0)
SELECT a, b, CASE WHEN cos >= {error} THEN 'error' ELSE 'review' END AS band FROM c WHERE cos >= {review}"""


def _tiling(spark, d, error: float, review: float):
    """All pairs at or over the threshold, exactly."""
    v = tbl(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return TI.similar_pairs(v, review).select("a", "b", F.when(F.col("cos") >= error, "error").otherwise("review").alias("band"))


@query("c17_tiling_pairs", SQL(_tiling_sql(0.90, 0.80)))
def tiling(spark, d):
    return _tiling(spark, d, 0.90, 0.80)


@query("c17_tiling_pairs_lower_bands", SQL(_tiling_sql(0.42, 0.36)))
def tiling_lower(spark, d):
    """The same with thresholds that the supplied vectors reach."""
    return _tiling(spark, d, 0.42, 0.36)


_NUM = "lpad(CAST(p_partkey % 100000 AS STRING), 5, '0')"
IDS = Derived("ids", f"""SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'see arXiv:2401.' || {_NUM} || 'v2 for' WHEN 1 THEN '1.2401.' || {_NUM} WHEN 2 THEN 'https://arxiv.org/abs/1706.' || {_NUM}
WHEN 3 THEN 'doi:10.1016/0167-' || {_NUM} || '(94)90040-4).' WHEN 4 THEN 'https://doi.org/10.1145/' || {_NUM} || '.330?x=1#y' WHEN 5 THEN p_name WHEN 6 THEN '10.5281/ZENODO.' || {_NUM} || '.' WHEN 7 THEN NULL ELSE '20240.' || {_NUM} END AS raw FROM {{part}}""")


@query("h14_arxiv_ids", SQL(f"SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '2401.' || {_NUM} WHEN 2 THEN '1706.' || {_NUM} END AS arxiv FROM part"))
def arxiv(spark, d):
    return IDS.frame(spark, d).select("id", R.arxiv_id("raw").alias("arxiv"))


@query("h15_dois", SQL(f"SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 3 THEN '10.1016/0167-' || {_NUM} || '(94)90040-4' WHEN 4 THEN '10.1145/' || {_NUM} || '.330' WHEN 6 THEN '10.5281/zenodo.' || {_NUM} END AS doi FROM part"))
def dois(spark, d):
    return IDS.frame(spark, d).select("id", R.doi("raw").alias("doi"))


@query("h16_reference_kinds", SQL("SELECT p_partkey AS id, CASE WHEN p_partkey % 9 IN (0, 2) THEN 'arxiv' WHEN p_partkey % 9 IN (3, 4, 6) THEN 'doi' ELSE 'title' END AS kind FROM part"))
def kinds(spark, d):
    a = F.col("raw").rlike(r"(?i)arxiv(\.org/|:)\S*\d{4}\.\d{4,5}") | F.col("raw").rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")
    return IDS.frame(spark, d).select("id", F.when(a, "arxiv").when(R.doi("raw").isNotNull(), "doi").otherwise("title").alias("kind"))


DOCS = Derived("papers", """SELECT p_partkey AS id, '@D' || CAST(floor(p_partkey / 5) AS BIGINT) || CASE p_partkey % 5 WHEN 0 THEN ' - Chapter 1 Intro' WHEN 1 THEN ' - chapter 2' WHEN 2 THEN CASE WHEN p_size > 20 THEN '' ELSE ' - 付録' END WHEN 3 THEN ' - Part II' ELSE ' about ' || p_name END AS title,
'10.1/x' || CAST(floor(p_partkey / 4) AS BIGINT) AS ident FROM {part}""")
FOLDED = r"trim(regexp_replace(title, '(?i)\s+-\s+(Chapter|Ch\.|Part|Section|Appendix|第|付録)\s*.*$', ''))"


@query("h18_chapter_folding", SQL(f"WITH {DOCS.cte} SELECT id, {FOLDED} AS doc FROM papers"))
def chapters(spark, d):
    return DOCS.frame(spark, d).select("id", R.document_key("title").alias("doc"))


@query("d13_duplicate_groups", SQL(f"WITH {DOCS.cte} SELECT ident, count(DISTINCT {FOLDED}) AS documents, list(id ORDER BY id) AS pages FROM papers GROUP BY ident HAVING count(DISTINCT {FOLDED}) > 1"))
def dupes(spark, d):
    return DOCS.frame(spark, d).groupBy("ident").agg(F.countDistinct(R.document_key("title")).alias("documents"), F.sort_array(F.collect_list("id")).alias("pages")).where("documents > 1")


@query("d14_identifier_index", SQL(f"WITH {DOCS.cte} SELECT 'ident' AS kind, ident AS key, list(id ORDER BY id) AS pages FROM papers GROUP BY ident UNION ALL SELECT 'title', k, list(id ORDER BY id) FROM (SELECT id, regexp_replace(lower(title), '[^0-9a-z]+', '', 'g') AS k FROM papers) WHERE length(k) >= 12 GROUP BY k"))
def identifier_index(spark, d):
    p = DOCS.frame(spark, d)
    keys = p.select("id", F.lit("ident").alias("kind"), F.col("ident").alias("key")).unionByName(p.select("id", F.lit("title").alias("kind"), TX.fold_latin("title").alias("key")).where("length(key) >= 12"))
    return keys.groupBy("kind", "key").agg(F.sort_array(F.collect_list("id")).alias("pages"))


@query("c26_whole_and_chapters", SQL(f"WITH {DOCS.cte}, k AS (SELECT *, {FOLDED} AS doc FROM papers) SELECT doc, count(*) FILTER (title <> doc) AS chapters FROM k GROUP BY doc HAVING bool_or(title = doc) AND bool_or(title <> doc)"))
def coexist(spark, d):
    k = DOCS.frame(spark, d).withColumn("doc", R.document_key("title"))
    return k.groupBy("doc").agg(F.count_if(F.col("title") != F.col("doc")).alias("chapters"), F.count_if(F.col("title") == F.col("doc")).alias("whole")).where("chapters > 0 and whole > 0").select("doc", "chapters")


KEEP = Derived("cand", """SELECT x.client_id AS a, y.client_id AS b, coalesce(x.nation_id, 0) % 4 AS a_deg, coalesce(y.nation_id, 0) % 4 AS b_deg, length(coalesce(x.city, '')) AS a_aliases, length(coalesce(y.city, '')) AS b_aliases,
coalesce(x.name, '') AS a_title, coalesce(y.name, '') AS b_title FROM {clients} x JOIN {clients} y ON x.master_id = y.master_id WHERE x.client_id < y.client_id""")


@query("q27_keep_or_drop", SQL(f"WITH {KEEP.cte} SELECT a, b, CASE WHEN (b_deg, b_aliases, -length(b_title)) > (a_deg, a_aliases, -length(a_title)) THEN b ELSE a END AS keep FROM cand"))
def keep(spark, d):
    a = F.struct(F.col("a_deg"), F.col("a_aliases"), (-F.length("a_title")))
    b = F.struct(F.col("b_deg"), F.col("b_aliases"), (-F.length("b_title")))
    return KEEP.frame(spark, d).select("a", "b", F.when(b > a, F.col("b")).otherwise(F.col("a")).alias("keep"))


@query("q28_unfinished_merges", SQL(f"WITH {DEC.cte} SELECT a, b FROM dec WHERE verdict = 'merged' AND dropped IN (SELECT client_id FROM sales)"))
def unfinished(spark, d):
    return DEC.frame(spark, d).where("verdict = 'merged'").join(tbl(spark, d, "sales").select(F.col("client_id").alias("dropped")), "dropped", "left_semi").select("a", "b")


# names that are asked for: those of vendors, their acronyms, and aliases of which half are nobody's
ASK = Derived("ask", "SELECT lower(name) AS name FROM {vendors} UNION SELECT 'v' || vendor_id FROM {vendors} UNION SELECT 'vendor ' || (vendor_id * 2) FROM {vendors}")


@query("o14_name_lookup_cascade", SQL(f"""WITH {ENT.cte}, {ASK.cte}, t AS (SELECT lower(title) AS k, min(id) AS id FROM ent GROUP BY 1), al AS (SELECT lower(a) AS k, min(id) AS id, count(DISTINCT id) AS n FROM (SELECT id, unnest(aliases) AS a FROM ent) GROUP BY 1)
SELECT name, coalesce(t.id, CASE WHEN al.n = 1 THEN al.id END) AS id, CASE WHEN t.id IS NOT NULL THEN 'title' WHEN al.n = 1 THEN 'alias' ELSE 'none' END AS how FROM ask LEFT JOIN t ON t.k = name LEFT JOIN al ON al.k = name"""))
def cascade(spark, d):
    e = ENT.frame(spark, d)
    ask = ASK.frame(spark, d)
    t = e.groupBy(F.lower("title").alias("name")).agg(F.min("id").alias("t"))
    al = e.select("id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("name")).agg(F.min("id").alias("al"), F.countDistinct("id").alias("n"))
    one = F.when(F.col("n") == 1, F.col("al"))
    return ask.join(t, "name", "left").join(al, "name", "left").select("name", F.coalesce("t", one).alias("id"), F.when(F.col("t").isNotNull(), "title").when(F.col("n") == 1, "alias").otherwise("none").alias("how"))


@query("q43_prefix_unique_lookup", SQL("SELECT left(CAST(o_orderkey AS VARCHAR), 3) AS prefix, count(DISTINCT o_orderkey) AS n, CASE WHEN count(DISTINCT o_orderkey) = 1 THEN min(o_orderkey) END AS hit FROM orders GROUP BY 1"))
def prefix_lookup(spark, d):
    o = tbl(spark, d, "orders").select("o_orderkey", "o_custkey", F.substring(F.col("o_orderkey").cast("string"), 1, 3).alias("prefix"))
    return o.groupBy("prefix").agg(F.countDistinct("o_orderkey").alias("n"), F.min("o_orderkey").alias("m")).select("prefix", "n", F.when(F.col("n") == 1, F.col("m")).alias("hit"))


@query("o15_resolver_scores", SQL(f"""WITH {ENT.cte}, {ASK.cte},
h AS (SELECT name, id, 1.0 AS score, 'title' AS how FROM ask JOIN ent ON lower(title) = name UNION ALL SELECT name, id, 0.9, 'alias' FROM ask JOIN (SELECT id, unnest(aliases) AS a FROM ent) ON lower(a) = name UNION ALL SELECT name, id, 0.6, 'part' FROM ask JOIN ent ON contains(lower(title), name))
SELECT name, id, CAST(max(score) AS DOUBLE) AS score, arg_max(how, score) AS how FROM h GROUP BY ALL"""))
def resolver(spark, d):
    e = ENT.frame(spark, d)
    ask = ASK.frame(spark, d)
    h = ask.join(e, F.lower("title") == F.col("name")).select("name", "id", F.lit(1.0).alias("score"), F.lit("title").alias("how"))
    al = e.select("id", F.explode("aliases").alias("a"))
    h = h.unionByName(ask.join(al, F.lower("a") == F.col("name")).select("name", "id", F.lit(0.9).alias("score"), F.lit("alias").alias("how")))
    h = h.unionByName(R.containing(e.select("id", F.lower("title").alias("title")), ask).select("name", "id", F.lit(0.6).alias("score"), F.lit("part").alias("how")))
    w = W.partitionBy("name", "id").orderBy(F.desc("score"))
    return h.withColumn("r", F.row_number().over(w)).where("r = 1").select("name", "id", "score", "how")
