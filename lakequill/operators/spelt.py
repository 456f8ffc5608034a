"""Numbers spelt in English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of numbers.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ORDINAL = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
OTHER = {"twice": 2, "double": 2, "triple": 3, "half": 0.5, "dozen": 12}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}

WORDS: dict[str, float] = {w: i for i, w in enumerate(SMALL)} | {w: i + 1 for i, w in enumerate(ORDINAL)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | OTHER
_ONES = "|".join(SMALL[1:10])
#: What stands for one number: a count of hundreds, tens with ones, or one word, the longer reading first.
NUMBER = rf"(?:(?:{_ONES}) hundred|(?:{'|'.join(TENS)})[- ](?:{_ONES})|{'|'.join(sorted(WORDS, key=lambda w: (-len(w), w)))})"


#: First letters of the words that a number can begin with: elsewhere the long alternation is not tried.
_FIRST = "".join(sorted({w[0] for w in WORDS}))
#: A number, with the scale after it if one follows.
FOUND = rf"(?i)\b(?=[{_FIRST}])(?:{NUMBER})\b(?:\s+(?:{'|'.join(SCALES)})\b)?"


def _value(parts: Column) -> Column:
    """Value of a spelt number in lower-case words: words add up, and a hundred multiplies."""
    of = F.create_map(*(F.lit(x) for w, v in WORDS.items() for x in (w, float(v))))
    known = F.transform(parts, lambda p: F.coalesce(F.try_element_at(of, p), F.lit(0.0)))
    total = F.aggregate(known, F.lit(0.0), lambda x, y: x + y)
    return F.when(F.element_at(parts, -1) == "hundred", total * 100).otherwise(total)


def _plain(v: Column) -> Column:
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def spelt_keys(text: Column | str) -> Column:
    """Distinct canonical values of the numbers spelt in a text, with those of a thousand, million or billion after them; a null text gives null."""
    of = F.create_map(*(F.lit(x) for w, v in SCALES.items() for x in (w, float(v))))

    def values(found: Column) -> Column:
        parts = F.split(F.lower(found), r"[-\s]+")
        scale = F.try_element_at(of, F.element_at(parts, -1))
        number = _value(F.when(scale.isNull(), parts).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1)))
        return F.when(scale.isNull(), F.array(number)).otherwise(F.array(number, number * scale))

    # the scaled numbers are those that a scale follows, so that a text is searched once
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)))
    return F.array_distinct(F.transform(F.flatten(F.transform(found, values)), _plain))
