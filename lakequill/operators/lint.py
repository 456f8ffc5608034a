"""Checks of pages: headings and their sections, marks and phrases of lines, identifiers of papers, signals for surveys.

All but the sums over lines are expressions over one text, so that texts are not shuffled. A null text is an
empty one; a text without headings has no sections; code fences are to be taken out beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.operators import resolve as R

# Words for how a page came about, which alone make no heading, what joins them, and headings that are allowed all the same.
GENERIC = ["知見", "観察", "考察", "示唆", "まとめ", "その他", "補足", "横断的"]
JOINERS = "とやおよび並びに・／/、,＆&|｜()（）[]「」:：-—〜~ \t　"
ALLOWED = ["未編纂の観察", "未解決の問い", "横断的知見"]
# Words of headings that belong into a report about a page and not on it.
VERIFYING = ["検証パス", "検証結果", "出典検査", "出典検証", "ファクトチェック", "検証済み"]
# Phrases that are not allowed, and those that are often empty.
BANNED = ["重要なのは", "正面から", "多角的", "掘り下げ"]
EMPTY = ["深掘り", "に他ならない", "包括的", "総合的", "不可欠", "核心的", "鍵となる", "極めて", "非常に"]
LINK = r"!?\[\[[^\]]*\]\]"
DASH = "[—―]"
KATAKANA = "[゠-ヿ]"
# Shapes of identifiers and the addresses that hold them.
ARXIV, DOI = r"^\d{4}\.\d{4,5}$", r"^10\.\d{4,9}/\S+$"
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5})"
ARXIV_SLUG = r"(?i)arxiv-(\d{4}\.\d{4,5})"
DOI_URL = r"(?i)(doi\.org/10\.\d{4,9}/[\x21-\x7e&&[^\"'<>\]`]]+)"
DATA_SET = r"^(10\.5281/zenodo\.|10\.48550/arxiv\.)"

# The field that tells the subtype of a page of each type, and of all others.
SUBTYPE, OTHERS = {"source": "source_type", "entity": "entity_type", "concept": "complexity"}, "answer_quality"


def subtype(kind: Column, fields: Column, keys: dict[str, str] = SUBTYPE, others: str = OTHERS) -> Column:
    """The field of the map ``fields`` that goes with a page's type; empty where the map or the field is null or missing. A null type counts as another one."""
    names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    key = F.coalesce(F.try_element_at(names, F.coalesce(kind, F.lit(""))), F.lit(others))
    return F.coalesce(F.try_element_at(fields, key), F.lit(""))


def _lines(text: Column | str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line, level, title, n_body, next_level)`` of headings of the second to fourth level: lines that are not blank before the next of them, and its level (null for the last)."""
    found = lambda x, g: F.regexp_extract(x, r"^(#{2,4})\s+(.*)$", g)
    heads = F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line"), F.length(found(x, 1)).alias("level"), F.trim(found(x, 2)).alias("title"))), lambda h: h["level"] > 0)
    at = docs.select(key, _lines(F.col(text)).alias("ls")).withColumn("hs", heads)

    def whole(h: Column, k: Column) -> Column:
        after = F.get("hs", k + 1)
        between = F.slice("ls", h["line"] + 1, F.coalesce(after["line"] - 1, F.size("ls")) - h["line"])
        return F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), F.size(F.filter(between, lambda x: x.rlike(r"\S"))).alias("n_body"), after["level"].alias("next_level"))

    return at.select(key, F.inline(F.transform("hs", whole)))


def empty_sections(rows: DataFrame) -> DataFrame:
    """Of :func:`sections` those without a body, unless a deeper section follows at once."""
    return rows.where((F.col("n_body") == 0) & (F.col("next_level").isNull() | (F.col("next_level") <= F.col("level"))))


def generic_heading(heading: Column, words: Sequence[str] = GENERIC) -> Column:
    """Whether nothing but joining signs is left of a heading without ``words``."""
    rest = heading
    for w in words:
        rest = F.replace(rest, F.lit(w), F.lit(""))
    return (F.trim(heading) != "") & (F.translate(rest, JOINERS, "") == "")


def heading_findings(docs: DataFrame, key: str, title: str, kind: str, text: str) -> DataFrame:
    """``(key, line, code)``: ``h1-none``, ``h1-many`` at the second, ``h1-title`` where the only one is not the title; ``verifying`` in sources; ``generic`` in concepts."""
    rows = docs.select(key, F.col(title).alias("title"), F.col(kind).alias("kind"), F.transform(_lines(F.col(text)), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x"))).alias("ls"))
    of = lambda mark: F.transform(F.filter("ls", lambda r: r["x"].startswith(mark)), lambda r: F.struct(r["line"].alias("line"), F.trim(F.substr(r["x"], F.lit(len(mark) + 1))).alias("t")))
    rows = rows.select(key, "title", "kind", of("# ").alias("h1"), of("## ").alias("h2"))

    def finding(line: Column, code: str) -> Column:
        return F.struct(line.cast("int").alias("line"), F.lit(code).alias("code"))

    none = F.array().cast("array<struct<line:int,code:string>>")
    first = F.get("h1", F.lit(0))
    top = (
        F.when(F.size("h1") == 0, F.array(finding(F.lit(None), "h1-none")))
        .when(F.size("h1") > 1, F.array(finding(F.get("h1", F.lit(1))["line"], "h1-many")))
        .when((F.col("title") != "") & (first["t"] != F.col("title")), F.array(finding(first["line"], "h1-title")))
        .otherwise(none)
    )
    verifying = F.transform(F.filter("h2", lambda h: (F.col("kind") == "source") & h["t"].rlike("|".join(VERIFYING))), lambda h: finding(h["line"], "verifying"))
    generic = F.transform(F.filter("h2", lambda h: (F.col("kind") == "concept") & ~h["t"].isin(ALLOWED) & generic_heading(h["t"])), lambda h: finding(h["line"], "generic"))
    return rows.select(key, F.inline(F.concat(top, F.coalesce(verifying, none), F.coalesce(generic, none))))


def line_findings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, check, level, n, first)`` with the first line: lines with dashes; middle dots, a warning between katakana; phrases, once a line each. Links are taken out first."""
    rows = docs.select(key, F.posexplode(_lines(F.col(text))).alias("i", "x")).select(key, (F.col("i") + 1).alias("line"), F.regexp_replace("x", LINK, "").alias("x"))
    dots = F.regexp_count("x", F.lit("・"))
    inner = F.regexp_count("x", F.lit(f"(?<={KATAKANA})・(?={KATAKANA})"))
    held = lambda words: sum((F.col("x").contains(w).cast("int") for w in words), F.lit(0))
    counts = {("dashes", "fail"): F.col("x").rlike(DASH).cast("int"), ("dots", "fail"): dots - inner, ("dots", "warn"): inner, ("phrases", "fail"): held(BANNED), ("phrases", "warn"): held(EMPTY)}
    each = rows.select(key, "line", *[c.alias(f"c{k}") for k, c in enumerate(counts.values())]).where(" + ".join(f"c{k}" for k in range(len(counts))) + " > 0")
    sums = each.groupBy(key).agg(*[F.struct(F.lit(c).alias("check"), F.lit(v).alias("level"), F.sum(f"c{k}").alias("n"), F.min(F.when(F.col(f"c{k}") > 0, F.col("line"))).alias("first")).alias(f"s{k}") for k, (c, v) in enumerate(counts)])
    return sums.select(key, F.inline(F.filter(F.array(*[f"s{k}" for k in range(len(counts))]), lambda s: s["n"] > 0)))


def _only(found: Column) -> Column:
    """What is found, if all that is found is one and the same."""
    one = F.array_distinct(found)
    return F.when(F.size(one) == 1, F.get(one, F.lit(0)))


def _first(pattern: str, s: Column) -> Column:
    return F.get(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(pattern), F.lit(1)), F.lit(0))


def derived_identifiers(arxiv: Column, doi: Column, url: Column, slugs: Column, body: Column, kind: Column) -> list[Column]:
    """``arxiv, arxiv_from, doi, doi_from``: a page's own field before its address, before the names of its sources (arxiv only, if they agree), before its body (papers only, if all there agree)."""
    text = F.coalesce(body, F.lit(""))
    names = F.flatten(F.transform(slugs, lambda s: F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(ARXIV_SLUG), F.lit(1))))
    in_body = F.when(kind == "paper", _only(F.regexp_extract_all(text, F.lit(ARXIV_URL), F.lit(1))))
    dois = F.filter(F.transform(F.regexp_extract_all(text, F.lit(DOI_URL), F.lit(1)), R.doi), lambda x: x.isNotNull() & ~x.rlike(f"(?i){DATA_SET}"))
    ways = {
        "arxiv": [("frontmatter", F.coalesce(arxiv, F.lit("")) != "", R.arxiv_id(arxiv)), ("url", None, _first(ARXIV_URL, url)), ("sources", None, _only(names)), ("body", None, in_body)],
        "doi": [("frontmatter", F.coalesce(doi, F.lit("")) != "", R.doi(doi)), ("url", None, F.when(F.coalesce(url, F.lit("")).rlike(DOI_URL), R.doi(url))), ("body", None, F.when(kind == "paper", _only(dois)))],
    }
    out = []
    for name, steps in ways.items():
        value, origin = F.lit(None).cast("string"), F.lit(None).cast("string")
        for where, when, found in reversed(steps):
            met = found.isNotNull() if when is None else when
            value, origin = F.when(met, found).otherwise(value), F.when(met, F.lit(where)).otherwise(origin)
        out += [value.alias(name), origin.alias(f"{name}_from")]
    return out


def identifier_findings(arxiv: Column, doi: Column, url: Column, kind: Column) -> Column:
    """Array of ``{code, level}``: fields of a wrong shape, DOIs with an address or in capitals, and what a paper's address holds but its fields do not."""
    address = F.lower(doi).rlike("^(http|doi:)")
    url = F.coalesce(url, F.lit(""))
    tests = [
        ("arxiv-shape", "error", ~arxiv.rlike(ARXIV)),
        ("doi-address", "error", address),
        ("doi-shape", "error", ~address & ~doi.rlike(DOI)),
        ("doi-capitals", "warn", ~address & doi.rlike(DOI) & (doi != F.lower(doi))),
        ("arxiv-missing", "warn", (kind == "paper") & arxiv.isNull() & url.rlike(ARXIV_URL)),
        ("doi-missing", "warn", (kind == "paper") & doi.isNull() & url.rlike(r"(?i)doi\.org/10\.\d{4,9}/\S+")),
    ]
    return F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(v).alias("level"))) for c, v, t in tests]))


def profile_fit(title: Column, profile: dict[str, Sequence[str]], least: int) -> Column:
    """The first bucket of ``profile`` with a topic that is the title or, both of ``least`` letters or more, is held by or holds it; ``unknown`` otherwise."""
    folded = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\s\-—・/]+", "")
    out = F.lit("unknown")
    for bucket, topics in reversed(profile.items()):
        names = ["".join(t.lower().replace("-", " ").split()) for t in topics]
        hits = [(folded == n) | ((F.length(folded) >= least) & F.lit(len(n) >= least) & (folded.contains(n) | F.contains(F.lit(n), folded))) for n in names if n]
        for h in hits:
            out = F.when(h, F.lit(bucket)).otherwise(out)
    return F.when(folded == "", F.lit("unknown")).otherwise(out)


def survey_signals(concepts: DataFrame, cites: DataFrame, key: str, profile: dict[str, Sequence[str]], dense: int = 13, near: int = 8, debt: int = 5, least: int = 4) -> DataFrame:
    """``(key, name, n_documents, n_inbox, gate, in_debt, fit)`` of ``concepts(key, name)`` over ``cites(key, document, inbox boolean)``.

    ``gate`` is ``dense``, ``near`` or null by distinct documents. Pairs of concept and document are made
    distinct before documents are counted, so that a concept with very many rows is summed in parts.
    """
    pairs = cites.groupBy(key, "document").agg(F.sum(F.col("inbox").cast("long")).alias("boxed"))
    counts = pairs.groupBy(key).agg(F.count("document").alias("n_documents"), F.coalesce(F.sum("boxed"), F.lit(0)).alias("n_inbox"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = concepts.select(key, "name").join(counts, key, "left").select(key, "name", zero("n_documents"), zero("n_inbox"))
    gate = F.when(F.col("n_documents") >= dense, "dense").when(F.col("n_documents") >= near, "near")
    return rows.select("*", gate.alias("gate"), (F.col("n_inbox") >= debt).alias("in_debt"), profile_fit(F.col("name"), profile, least).alias("fit"))
