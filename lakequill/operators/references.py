"""Bibliographies of texts: their region, items and identifiers, and what is said where they are cited.

Everything but the join of citations with items is an expression over one text, so that texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.operators import extract as X
from lakequill.operators import resolve as R

# Headings of a bibliography (letters may stand apart), what ends it, marks around headings.
HEADINGS = ["REFERENCES", "BIBLIOGRAPHY", "参考文献"]
END = r"(?:Appendix|Appendices|Supplementary|Acknowledg(?:e)?ments?|謝辞)"
DECORATIONS = "♦●■※"
SECTION = r"(?:(?:\d+|[A-Z]|[IVXLCDM]+)[.)]\s+)?"
# Cues of a contrast and the characters before a citation in which one must begin.
CONTRAST = r"\b(?:unlike|in\s+contrast|whereas|as\s+opposed\s+to|differ(?:s|ed|ing)?\s+from|different\s+from)\b"
CONTRAST_EAST = ["とは異なり", "と異なり", "対照的", "に対して"]
WINDOW = 80
# Identifiers of data sets and of preprints under another name, which are no papers of their own.
ARTEFACT = r"^(10\.5281/zenodo\.|10\.48550/arxiv\.)"
ARXIV = r"(?<![\d.])(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)"
CITED = r"\[(\d+(?:\s*[-–—]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–—]\s*\d+)?)*)\]"


def _apart(word: str) -> str:
    return r"\s*".join(word)


_MARKS = rf"^\s*[{DECORATIONS}]*\s*"
_CORE = "|".join([*map(_apart, HEADINGS), _apart("LITERATURE") + r"\s+" + _apart("CITED")])
HEADING = rf"(?i){_MARKS}{SECTION}(?:{_CORE})(?:[\s{DECORATIONS}]*$|\s*\[\d+\])"
END_HEADING = rf"(?i){_MARKS}{END}(?![A-Za-z0-9_])"
_CUES = "|".join([CONTRAST, *map(_apart, CONTRAST_EAST)])


def region_bounds(lines: Column) -> Column:
    """``{first, end}`` of the lines of a bibliography: from its last heading up to the heading after it that ends it, or to the end; null if there is none."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(HEADING).alias("h"), x.rlike(END_HEADING).alias("e")))
    of = lambda rows, kind: F.transform(F.filter(rows, lambda r: r[kind]), lambda r: r["i"])
    first = F.array_max(of(at, "h"))
    ends = F.filter(of(at, "e"), lambda i: i > first)
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.coalesce(F.array_min(ends), F.size(lines)).alias("end")))


def regions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, body, first, end, region)``: the text before the bibliography and the bibliography; both of no bibliography are the text and null."""
    lines = docs.select(key, F.split(F.coalesce(text, F.lit("")), "\n").alias("lines")).withColumn("b", region_bounds(F.col("lines")))
    cut = lambda lo, n: F.array_join(F.slice("lines", lo, n), "\n")
    first, end = F.col("b.first"), F.col("b.end")
    body = F.when(F.col("b").isNull(), F.array_join("lines", "\n")).otherwise(cut(F.lit(1), F.coalesce(first, F.lit(0))))
    region = F.when(F.col("b").isNotNull(), cut(F.coalesce(first, F.lit(0)) + 1, F.coalesce(end - first, F.lit(0))))
    return lines.select(key, body.alias("body"), first.alias("first"), end.alias("end"), region.alias("region"))


def identifiers(text: Column | str) -> Column:
    """Distinct ``arxiv:`` and ``doi:`` identifiers of a text, the former first, each kind in order; artefacts are left out."""
    arxiv = F.transform(F.regexp_extract_all(text, F.lit(ARXIV), F.lit(1)), lambda x: F.concat(F.lit("arxiv:"), x))
    dois = F.transform(F.regexp_extract_all(text, F.lit(R.DOI), F.lit(0)), R.doi)
    dois = F.filter(dois, lambda x: x.isNotNull() & ~x.rlike("(?i)" + ARTEFACT))
    return F.array_distinct(F.concat(arxiv, F.transform(dois, lambda x: F.concat(F.lit("doi:"), x))))


def items(found: DataFrame, key: str) -> DataFrame:
    """``(key, pos, number, item)`` of ``found(key, region)``: pieces that begin with a number in brackets, or lines if there is no such number."""
    marked = F.col("region").rlike(r"\[\d+\]")
    parts = F.when(marked, F.split("region", r"(?=\[\d+\])")).otherwise(F.split("region", "\n"))
    each = found.where("region is not null").select(key, F.posexplode(F.filter(parts, lambda x: F.regexp_replace(x, r"\s", "") != "")).alias("pos", "item"))
    return each.select(key, "pos", F.regexp_extract("item", r"^\s*\[(\d+)\]", 1).try_cast("int").alias("number"), "item")


def numbered(listed: DataFrame, key: str) -> DataFrame:
    """``(key, number, idents)``: the first item of each number from one up that has identifiers."""
    own = listed.where("number >= 1").withColumn("idents", identifiers(F.col("item"))).where(F.size("idents") > 0)
    return own.groupBy(key, "number").agg(F.min_by("idents", "pos").alias("idents"))


def citations(found: DataFrame, key: str) -> DataFrame:
    """``(key, number, contrast)`` of every number cited in ``found(key, body)``: whether a cue of contrast begins in the 80 characters before its bracket.

    Positions without a bracket are passed over before the text behind them is looked at. The cue is looked for in a window of one character more, so that one that is the rest of a longer word does not count.
    """
    before = rf"(?s)(?=\[\d)(?<=(^.{{0,{WINDOW}}}|.{{{WINDOW + 1}}}))(?<!\[){CITED}"
    pair = F.arrays_zip(F.regexp_extract_all("body", F.lit(before), F.lit(1)).alias("w"), F.regexp_extract_all("body", F.lit(before), F.lit(2)).alias("inside"))
    each = found.select(key, F.explode(pair).alias("c"))
    near = F.when(F.length("c.w") <= WINDOW, F.concat(F.lit(" "), F.col("c.w"))).otherwise(F.col("c.w"))
    contrast = near.rlike(rf"(?is)(?<=.)(?:{_CUES})")
    numbers = X.bracket_numbers(F.regexp_replace("c.inside", "—", "-"))
    return each.select(key, F.explode(numbers).alias("number"), contrast.alias("contrast")).where("number >= 1")


def cited_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, number, cites, contrasts, idents)``: how often each numbered item is cited, and how often in contrast; items nobody cites count none."""
    found = regions(docs, key, text)
    said = citations(found, key).groupBy(key, "number").agg(F.count("*").alias("cites"), F.count_if("contrast").alias("contrasts"))
    out = numbered(items(found, key), key).join(said, [key, "number"], "left")
    return out.select(key, "number", F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("contrasts", F.lit(0)).alias("contrasts"), "idents")
