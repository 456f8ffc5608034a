"""Text expressions that stay in the JVM, and Arrow functions for what Spark has no built-in for."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Function words left out of the index.
STOPWORDS = (
    "a an and are as at be by for from has have he her him his i if in is it its "
    "of on or that the their them they this to was were will with you your"
).split()
LATIN = "[a-zà-öø-ÿß0-9]+"
# Code ranges of Japanese and Korean letters (kana, ideographs, hangul, the iteration mark).
CJK = "ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힯々"
_EAST = re.compile(f"[{CJK}]").match
_STOP = frozenset(STOPWORDS)


def latin_tokens(text: Column | str) -> Column:
    """Lower-case Latin words of two letters or more that are not stop words; duplicates stay."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({LATIN})"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def mixed_tokens(text: str | None) -> list[str]:
    """Words, numbers and pairs of East Asian letters of a text.

    After compatibility folding: words longer than a letter that are no stop words, and their closing
    digits; numbers without separators; of a run of East Asian letters all pairs, then its first and
    last letter; and where a number touches such a run, the number with the letter it touches.
    """
    out: list[str] = []
    last = ("", "")  # class and body of the piece that ends where the next one begins
    for kind, body in _scan(unicodedata.normalize("NFKC", text or "").casefold()):
        if kind == "number":
            out += [last[1][-1] + body] if last[0] == "east" else []
            out.append(body)
        elif kind == "east":
            out += [last[1] + body[0]] if last[0] == "number" else []
            out += [body] if len(body) == 1 else [*map("".join, pairwise(body)), body[0], body[-1]]
        elif kind == "word":
            if len(body) > 1 and body not in _STOP:
                out.append(body)
            digits = body[len(body.rstrip("0123456789")) :]
            if digits and digits != body:
                out.append(digits)
                kind, body = "number", digits
        last = (kind, body)
    return out


def _class(ch: str) -> str:
    if ch in "0123456789":
        return "digit"
    return "east" if _EAST(ch) else "letter" if ch.isalnum() or ch == "_" else "mark"


def _scan(s: str) -> Iterator[tuple[str, str]]:
    """Pieces of a text in order: numbers (groups of three digits joined), East Asian runs, words, and the marks between them."""
    runs = [(c, "".join(g)) for c, g in groupby(s, _class)]
    at = 0
    while at < len(runs):
        kind, body = runs[at]
        at += 1
        if kind == "digit":
            while at + 1 < len(runs) and runs[at][1] == "," and runs[at + 1][0] == "digit" and len(runs[at + 1][1]) >= 3:
                more = runs[at + 1][1]
                body, at = body + more[:3], at + 2
                if len(more) > 3:
                    runs[at - 1] = ("digit", more[3:])
                    at -= 1
                    break
            yield "number", body
        elif kind == "letter":
            # a word goes on over digits, apostrophes and hyphens
            while at < len(runs) and runs[at][0] != "east":
                inside = runs[at][1]
                joined = len(inside) if runs[at][0] != "mark" else len(inside) - len(inside.lstrip("'-"))
                body += inside[:joined]
                if joined < len(inside):
                    runs[at] = ("mark", inside[joined:])
                    break
                at += 1
            yield "word", body
        else:
            yield kind, body


def tokens_udf(text: Column | str) -> Column:
    """:func:`mixed_tokens` in Arrow batches."""
    return lists_udf(text, mixed_tokens)


def lists_udf(text: Column | str, f: Callable[[str | None], list[str]], at_once: int = 128) -> Column:
    """``f`` of each text. Texts and strings stand as Python objects for ``at_once`` rows only; a batch otherwise holds Arrow arrays."""

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([f(x) for x in texts.slice(s, at_once).to_pylist()], kind) for s in range(0, len(texts), at_once)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, ArrayType(StringType()))(text)


def fold(s: str | None) -> str:
    """Compatibility-folded, case-folded, letters and digits only."""
    return re.sub(r"[^0-9a-z぀-ヿ一-鿿]+", "", unicodedata.normalize("NFKC", s or "").casefold())


def _where_not_ascii(s: Column | str, plain: Callable[[Column], Column], f: Callable[[str | None], str]) -> Column:
    """``plain`` for texts in ASCII, in the JVM; only the others go through ``f`` in Arrow batches."""
    s = F.col(s) if isinstance(s, str) else s
    ascii_only = s.rlike(r"^\p{ASCII}*$")

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: f(t) if t is not None else None)

    return F.when(ascii_only, plain(s)).otherwise(F.coalesce(F.pandas_udf(run, StringType())(F.when(~ascii_only, s)), F.lit("")))


def fold_udf(s: Column | str) -> Column:
    """:func:`fold` of a column."""
    return _where_not_ascii(s, fold_latin, fold)


def compatible(s: Column | str) -> Column:
    """Compatibility-folded, case-folded and trimmed; a null is empty."""
    return _where_not_ascii(s, lambda c: F.trim(F.lower(c)), lambda t: unicodedata.normalize("NFKC", t).casefold().strip())


def compatible_lower(s: Column | str) -> Column:
    """Compatibility-folded and lower-cased; unlike case folding this keeps a sharp s. A null is empty."""
    return _where_not_ascii(s, F.lower, lambda t: unicodedata.normalize("NFKC", t).lower())


def fold_latin(s: Column | str) -> Column:
    """``fold`` for text without compatibility characters, in the JVM."""
    return F.regexp_replace(F.lower(s), "[^0-9a-z]+", "")


def snippet(text: Column | str, n: int = 200) -> Column:
    """The first ``n`` characters without trailing white space, with an ellipsis if there is more."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r"\s+$", ""), F.lit("…")))


def tokens_by_thirds(text: Column | str) -> Column:
    """Token estimate of catalogues: a third of the length, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long")


def tokens_by_script(text: Column | str) -> Column:
    """Token estimate of usage reports: one per East Asian letter, one per four other characters that are not white space."""
    wide = F.length(text) - F.length(F.regexp_replace(text, "[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]", ""))
    other = F.length(F.regexp_replace(text, "[\\s぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]", ""))
    return (wide + F.ceil(other / 4)).cast("long")
