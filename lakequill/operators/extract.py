"""Extraction from Markdown-like text: front matter, links, sections, claims, callouts, logs, references."""

from __future__ import annotations

import re
from decimal import Decimal
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lakequill.functions import text as T

#: Fixed value: a link between pages, with its target.
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
_LINK = re.compile(WIKILINK)


def scalar(text: Column | str, key: str) -> Column:
    """First value of ``key:`` in flat front matter, without quotes; empty is null."""
    raw = F.regexp_extract(text, rf"(?m)^{key}:[ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(raw, "^([\"'])(.*)\\1$", "$2"), F.lit(""))


def front_links(text: Column | str, key: str) -> Column:
    """Links of a list in front matter, written in one line or as indented items up to the first line that is not indented."""
    block = F.regexp_extract(text, rf"(?m)^{key}:([^\n]*(?:\n[ \t]+[^\n]*)*)", 1)
    return F.regexp_extract_all(block, F.lit(WIKILINK), F.lit(1))


def wikilinks(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1))


def link_name(target: Column) -> Column:
    """Last path part without ``.md``."""
    return F.regexp_replace(F.element_at(F.split(F.trim(target), "/"), -1), r"\.md$", "")


def lines(pages: DataFrame, key: str, text: str) -> DataFrame:
    return pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line")).withColumn("no", F.col("no") + 1)


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def fence_states(text: str | None) -> list[bool]:
    """For each line, whether it is inside a code block, which a fence of the same sign and at least its length closes; fences are inside."""
    held = (text or "").split("\n")
    if "```" not in (text or "") and "~~~" not in (text or ""):
        return [False] * len(held)
    opened, out = "", []
    for line in held:
        found = _FENCE.match(line)
        m = found[1] if found else ""
        closes = opened and m[:1] == opened[0] and len(m) >= len(opened) and not line.strip().strip(m[:1] or " ")
        out.append(bool(opened) or bool(m))
        opened = "" if closes else opened or m
    return out


def fenced(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of every page with ``fence``: inside a code block. A page's lines are told apart in its own row, so that nothing is grouped or shuffled."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(fence_states)

    states = F.pandas_udf(run, ArrayType(BooleanType()))(text)
    both = F.arrays_zip(F.split(text, "\n", -1).alias("line"), states.alias("fence"))
    rows = pages.where(F.col(text).isNotNull()).select(key, F.posexplode(both).alias("no", "x"))
    return rows.select(key, (F.col("no") + 1).alias("no"), "x.line", "x.fence")


def sections(rows: DataFrame, key: str, level: str = "##") -> DataFrame:
    """Lines with the heading of ``level`` they stand under (null before the first)."""
    w = W.partitionBy(key).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    own = F.nullif(F.regexp_extract("line", rf"^{level}\s+(.+?)\s*$", 1), F.lit(""))
    return rows.withColumn("is_heading", own.isNotNull()).withColumn("section", F.last(own, ignorenulls=True).over(w))


_STRINGS = ArrayType(StringType())
CLAIM = StructType([StructField(n, t) for n, t in (("section", StringType()), ("line", IntegerType()), ("claim", StringType()), ("sources", _STRINGS), ("targets", _STRINGS), ("evidence", _STRINGS))])
# Headings that are not topics.
_OTHER = {"定義", "子概念", "関連", "出典", "参照", "未解決の問い", "受信箱"}


def page_claims(text: str | None) -> list[dict]:
    """Bold bullets of topic sections with the indented lines under them."""
    out, section, held = [], None, None
    for no, line in enumerate((text or "").split("\n"), 1):
        if h := re.match(r"##\s+(.+?)\s*$", line):
            section, held = h[1], None
        elif section is None or re.sub(r"[(（].*[)）]$", "", section).strip() in _OTHER:
            continue
        elif m := re.match(r"[-*]\s+\*\*(.+?)\*\*(.*)$", line):
            whole = m[1] + m[2]
            links = list(dict.fromkeys(t.strip().rsplit("/", 1)[-1].removesuffix(".md") for t in _LINK.findall(whole)))
            held = {"section": section, "line": no, "claim": m[1].strip(), "sources": [x for x in links if x[:1] == "@"], "targets": [x for x in links if x[:1] != "@"], "evidence": []}
            out.append(held)
        elif held and re.match(r"\s+[-*]\s+", line):
            held["evidence"].append(line.strip()[2:].strip())
            held["sources"] += [x for t in _LINK.findall(line) if (x := t.strip().rsplit("/", 1)[-1])[:1] == "@" and x not in held["sources"]]
        elif line.strip():
            held = None
    return out


def claims_udf(text: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(page_claims)

    return F.pandas_udf(run, ArrayType(CLAIM))(text)


CALLOUT = StructType(
    [StructField(n, t) for n, t in (("section", StringType()), ("line", IntegerType()), ("depth", IntegerType()), ("title", StringType()), ("body", StringType()), ("pages", _STRINGS), ("sources", _STRINGS))]
)


_QUOTED = re.compile(r"((?:>\s*)+)(?:\[!(\w+)\][+-]?)?\s*(.*)$")


def page_callouts(text: str | None, kind: str = "contradiction") -> list[dict]:
    """Quoted callouts of one kind with the quoted lines under them, at any depth: a fold over the lines with at most one callout open."""
    out, section, is_open = [], "", False
    for number, line in enumerate((text or "").split("\n"), 1):
        quoted = _QUOTED.match(line)
        if not quoted:
            heading = re.match(r"#{2,}\s+(.+?)\s*$", line)
            section, is_open = heading[1] if heading else section, False
            continue
        depth, named, rest = quoted[1].count(">"), quoted[2], quoted[3].rstrip()
        if named:
            is_open = named == kind
            if is_open:
                out.append({"section": section, "line": number, "depth": depth, "title": rest.strip(), "body": []})
        elif is_open and depth >= out[-1]["depth"]:
            out[-1]["body"].append(rest)
        else:
            is_open = False
    for c in out:
        c["body"] = "\n".join(c["body"])
        links = list(dict.fromkeys(t.strip().rsplit("/", 1)[-1] for t in _LINK.findall(c["title"] + "\n" + c["body"])))
        c |= {"body": c["body"].strip(), "pages": [x for x in links if x[:1] != "@"], "sources": [x for x in links if x[:1] == "@"]}
    return out


def callouts_udf(text: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(page_callouts)

    return F.pandas_udf(run, ArrayType(CALLOUT))(text)


def bracket_numbers(inside: Column) -> Column:
    """Numbers of a citation bracket: ``1, 3-5`` is 1, 3, 4, 5; ranges over nine wide give nothing."""
    parts = F.transform(F.split(F.regexp_replace(inside, r"\s", ""), ","), lambda p: F.split(p, "[-–]"))
    lo, hi = (lambda p: F.try_element_at(p, F.lit(1)).try_cast("int")), (lambda p: F.try_element_at(p, F.lit(-1)).try_cast("int"))
    span = F.transform(parts, lambda p: F.when((lo(p) <= hi(p)) & (hi(p) - lo(p) <= 9), F.sequence(lo(p), F.least(hi(p), lo(p) + 9))).otherwise(F.array().cast("array<int>")))
    return F.flatten(span)


def inverted(ws: Column) -> Column:
    """``array<struct<word, at>>``: each word of an array once, with its positions from 0. A text's words are sorted in its own row."""
    placed = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, F.greatest(i - 2, F.lit(0)))))
    runs = lambda x: F.transform(x["s"], lambda b, k: F.struct(F.get(x["w"], b - 1).alias("word"), F.slice(x["p"], b, F.coalesce(F.get(x["s"], k + 1), F.size(x["w"]) + 1) - b).alias("at")))
    # arrays of one element, so that each is made once a row
    apart = F.transform(F.array(placed), lambda z: F.struct(z["word"].alias("w"), z["pos"].alias("p")))
    kept = F.transform(apart, lambda z: F.struct(z["w"].alias("w"), z["p"].alias("p"), starts(z["w"]).alias("s")))
    index = F.flatten(F.transform(kept, runs))
    return F.when(F.size(ws) > 0, index).when(ws.isNotNull(), F.filter(index, lambda _: F.lit(False)))


def from_inverted(index: Column) -> Column:
    """The words of :func:`inverted` in order, by single spaces."""
    back = F.flatten(F.transform(index, lambda x: F.transform(x["at"], lambda i: F.struct(i.alias("pos"), x["word"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(back), lambda x: x["word"]), " ")


_SCALE = {"k": 10**3, "m": 10**6, "b": 10**9, "万": 10**4, "億": 10**8}
_NUMBER = re.compile(r"(?<![\w.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?(%|[KMBkmb](?![A-Za-z])|万|億)?")
_DIGITS = str.maketrans("〇一二三四五六七八九", "0123456789")


def number_keys(text: str | None) -> list[str]:
    """Canonical values of the numbers of a text; percentages keep their sign, citations and figure numbers are left out."""
    import unicodedata

    s = unicodedata.normalize("NFKC", text or "").translate(_DIGITS)
    s = re.sub(r"\[\d+(?:\s*[,–-]\s*\d+)*\]|(?i:(?:fig(?:ure)?|table|section|sec|eq)\.?)\s*\d+(?:\.\d+)*|\[\[[^\]]*\]\]", " ", s)
    out = {}
    for m in _NUMBER.finditer(s):
        v = Decimal(m[1].replace(",", "")) * _SCALE.get((m[2] or "").lower(), 1)
        key = format(v.normalize(), "f") + ("%" if m[2] == "%" else "")
        out[key] = None
    return list(out)


def numbers_udf(text: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(number_keys)

    return F.pandas_udf(run, ArrayType(StringType()))(text)


def paragraph_chunks(text: str | None, size: int = 2000, overlap: int = 200) -> list[str]:
    """Paragraphs gathered to ``size`` characters; each next chunk begins with the last ``overlap`` of the one before.

    The chunk of each paragraph comes from a running length, which starts anew at the overlap where it has reached the size.
    """
    paragraphs = [p for p in map(str.strip, re.split(r"\n\s*\n", text or "")) if p]

    def placed(state: tuple[int, int], p: str) -> tuple[int, int]:
        chunk, length = (state[0] + 1, overlap) if state[1] >= size else state
        return chunk, length + len(p) + 2

    states = list(accumulate(paragraphs, placed, initial=(0, 0)))
    out: list[str] = []
    for _, of_chunk in groupby(zip(states[1:], paragraphs, strict=True), key=lambda x: x[0][0]):
        out.append("\n\n".join([*(x[-overlap:] for x in out[-1:]), *(p for _, p in of_chunk)]))
    # a chunk that the last paragraph has filled leaves its overlap behind
    return [*out, out[-1][-overlap:]] if states[-1][1] >= size else out


def byte_pieces(text: str | None, cap: int = 1800) -> list[str]:
    """Pieces of at most ``cap`` UTF-8 bytes, cut at a paragraph, a line or a space of the second half where there is one."""
    out, raw = [], (text or "").encode()
    while len(raw) > cap:
        cut = cap
        while raw[cut] & 0xC0 == 0x80:
            cut -= 1
        for mark in (b"\n\n", b"\n", b" "):
            at = raw.rfind(mark, cap // 2, cut)
            if at > 0:
                cut = at + len(mark)
                break
        out.append(raw[:cut].decode())
        raw = raw[cut:]
    return [*out, raw.decode()] if raw else out


def pieces_udf(text: Column | str, f) -> Column:
    return T.lists_udf(text, f)
