"""Excerpts that keep to a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters a token in the estimate, least characters that a cut leaves.
PER_TOKEN, LEAST = 3, 200
BULLET = r"^[-*] "
NESTED = r"^[ \t]"


def _fits(chars: Column, budget: Column) -> Column:
    """Whether the estimate, a third of the characters but one at least, keeps to the budget."""
    return F.greatest(F.lit(1), F.floor(chars / PER_TOKEN)) <= budget


def bullet_lines(lines: DataFrame, kinds: Column | None = None) -> DataFrame:
    """``lines(doc, section, kind, place, line)`` with ``back``: for lines of a top-level bullet, its number from the end of its section.

    A bullet goes on over lines that begin with white space and are not empty; the line that follows another one
    without being such a line belongs to none. ``kinds`` tells which sections have
    bullets: those of the kind ``tail`` if it is not given.
    """
    counted = F.col("kind") == "tail" if kinds is None else kinds
    of = W.partitionBy("doc", "section").orderBy("place")
    starts = counted & F.col("line").rlike(BULLET)
    goes_on = F.col("line").rlike(NESTED) & (F.trim("line") != "")
    # a run of lines begins with a bullet or with a line that is none and goes on from none
    run = lines.withColumn("starts", starts).withColumn("head", F.when(starts, 1).when(~goes_on, 0))
    run = run.withColumn("inside", F.last("head", True).over(of.rowsBetween(W.unboundedPreceding, 0)) == 1)
    run = run.withColumn("number", F.sum(F.col("starts").cast("int")).over(of.rowsBetween(W.unboundedPreceding, 0)))
    all_ = F.max("number").over(W.partitionBy("doc", "section"))
    return run.withColumn("back", F.when(F.col("inside") & counted, all_ - F.col("number") + 1)).drop("starts", "head", "inside", "number")


def first_paragraph(lines: DataFrame) -> DataFrame:
    """``lines`` with ``first``: whether the line stands in the heading, the first paragraph, or the empty lines before it."""
    of = W.partitionBy("doc", "section").orderBy("place")
    before = of.rowsBetween(W.unboundedPreceding, -1)
    full = (F.trim("line") != "") & (F.col("at") > 1)
    told = lines.withColumn("at", F.row_number().over(of)).withColumn("begun", F.coalesce(F.max(full.cast("int")).over(before), F.lit(0)))
    ends = (F.col("begun") == 1) & (F.trim("line") == "")
    return told.withColumn("first", F.sum(ends.cast("int")).over(of.rowsBetween(W.unboundedPreceding, 0)) == 0).drop("at", "begun")


def shrink(lines: DataFrame, budgets: list[int]) -> DataFrame:
    """``(doc, budget, bullets, truncated, excerpt)`` of every document for every budget.

    ``lines(doc, section, kind, place, line)``; the first line of a section is its heading. What is over budget loses,
    in this order and only as far as it must: of sections of the kind ``definition`` all but the first paragraph;
    of sections of the kind ``tail`` the oldest bullets, all these sections keeping the same number of their last ones,
    ``bullets`` (null where nothing was over); then all characters beyond 200 or three a token, whichever is more.
    How many bullets fit is read off a running size over their numbers from the end, one sum a document and number,
    so nothing is tried again and again. White space at line ends is dropped; null lines are empty.
    """
    clean = lines.withColumn("line", F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+$", ""))
    told = first_paragraph(bullet_lines(clean)).withColumn("size", F.length("line") + 1)
    stays = (F.col("kind") != "definition") | F.col("first")
    whole = told.groupBy("doc").agg(F.sum("size").alias("total"), F.sum(F.when(stays & F.col("back").isNull(), F.col("size")).otherwise(0)).alias("fixed"), F.coalesce(F.max("back"), F.lit(0)).alias("most"))
    steps = told.where("back is not null").groupBy("doc", "back").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(W.partitionBy("doc").orderBy("back")))
    asked = whole.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    over = asked.withColumn("over", ~_fits(F.col("total"), F.col("budget")))
    room = over.where("over").join(steps, "doc").where(_fits(F.col("fixed") + F.col("upto"), F.col("budget"))).groupBy("doc", "budget").agg(F.max("back").alias("room"))
    kept = over.join(room, ["doc", "budget"], "left").withColumn("bullets", F.when(F.col("over"), F.coalesce("room", F.lit(0)))).select("doc", "budget", "over", "most", "bullets")
    shown = told.join(kept, "doc").withColumn("shown", ~F.col("over") | stays & (F.col("back").isNull() | (F.col("back") <= F.col("bullets"))))
    text = shown.groupBy("doc", "budget").agg(
        F.first("bullets").alias("bullets"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("shown"), F.struct("section", "place", "line")))), lambda x: x["line"]), "\n").alias("text"),
        F.max((~F.col("shown")).cast("int")).alias("lost"),
    )
    text = text.withColumn("text", F.concat("text", F.lit("\n")))
    cut = ~_fits(F.length("text"), F.col("budget")) & F.col("bullets").isNotNull()
    most = F.greatest(F.lit(LEAST), F.col("budget") * PER_TOKEN)
    short = F.concat(F.regexp_replace(F.substr("text", F.lit(1), most), r"\s+$", ""), F.lit("\n"))
    return text.select("doc", "budget", "bullets", ((F.col("lost") == 1) | cut).alias("truncated"), F.when(cut, short).otherwise(F.col("text")).alias("excerpt"))


#: Fixed value: characters of a claim in an outline.
CLAIM = 90
NOTE = "<!-- cut to its budget: claims are left out, counts are whole -->"


def last_bullets(lines: DataFrame, n: int) -> DataFrame:
    """``lines`` without the bullets of sections of the kind ``tail`` but for the last ``n`` of each, and with no two empty lines side by side."""
    kept = bullet_lines(lines).where(F.col("back").isNull() | (F.col("back") <= n)).drop("back")
    empty = F.trim("line") == ""
    before = F.lag(empty).over(W.partitionBy("doc", "section").orderBy("place"))
    return kept.withColumn("twice", empty & F.coalesce(before, F.lit(False))).where("not twice").drop("twice")


def claim_text(line: Column) -> Column:
    """The bold beginning of a bullet, or its first line, of 90 characters at most."""
    body = F.trim(F.regexp_replace(line, BULLET, ""))
    bold = F.trim(F.regexp_extract(body, r"^\*\*(.+?)\*\*", 1))
    text = F.regexp_replace(F.when(body.rlike(r"^\*\*.+?\*\*"), bold).otherwise(body), r"\s+", " ")
    return F.when(F.length(text) > CLAIM, F.concat(F.regexp_replace(F.substring(text, 1, CLAIM), r"\s+$", ""), F.lit("…"))).otherwise(text)


def outline(lines: DataFrame, budget: int) -> DataFrame:
    """``(doc, total, truncated, outline)``: every section's heading with the number of its bullets, and the bullets' claims as far as the budget goes.

    ``lines`` as for :func:`shrink`. Claims and subheadings stand for sections of the kind ``tail`` only, whose bullets
    make up ``total``; definitions have no number. What does not fit goes from the first line on that is too much;
    headings stay, and are cut by characters only if they are over budget by themselves. Costs are a running sum in
    one window a document.
    """
    clean = lines.withColumn("line", F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+$", ""))
    told = bullet_lines(clean, F.lit(True)).withColumn("at", F.row_number().over(W.partitionBy("doc", "section").orderBy("place")))
    first = F.col("line").rlike(BULLET) & F.col("back").isNotNull()
    count = F.sum(first.cast("int")).over(W.partitionBy("doc", "section"))
    tail, head = F.col("kind") == "tail", F.col("at") == 1
    shown = F.when(head, F.concat(F.col("line"), F.when(F.col("kind") == "definition", "").otherwise(F.concat(F.lit("  ("), F.coalesce("count", F.lit(0)).cast("string"), F.lit(")")))))
    shown = shown.when(tail & first, F.concat(F.lit("- "), claim_text(F.col("line")))).when(tail & F.col("line").startswith("### "), F.col("line"))
    out = told.withColumn("count", count).withColumn("shown", shown).withColumn("head", head)
    sums = out.groupBy("doc").agg(
        F.sum(F.when(tail & first, 1).otherwise(0)).alias("total"), F.sum(F.when(head, F.length("shown") + 1).otherwise(0)).alias("heads"), F.sum(F.coalesce(F.length("shown") + 1, F.lit(0))).alias("chars")
    )
    sums = sums.withColumn("title", F.concat(F.lit("total: "), F.col("total").cast("string")))
    rows = out.where("shown is not null").join(sums, "doc")
    fixed = F.col("heads") + F.length("title") + 1
    cost = F.when(F.col("head"), 0).otherwise(F.greatest(F.lit(1), F.floor((F.length("shown") + 1) / PER_TOKEN)))
    used = F.greatest(F.lit(1), F.floor((fixed + len(NOTE) + 1) / PER_TOKEN)) + F.sum(cost).over(W.partitionBy("doc").orderBy("section", "place").rowsBetween(W.unboundedPreceding, 0))
    whole = _fits(F.col("chars") + F.length("title") + 1, F.lit(budget))
    rows = rows.withColumn("whole", whole).withColumn("stays", whole | F.col("head") | (used <= budget))
    bare = F.greatest(F.lit(1), F.floor((fixed + len(NOTE) + 1) / PER_TOKEN)) > budget
    text = rows.withColumn("bare", ~whole & bare).groupBy("doc").agg(
        F.first("total").alias("total"), F.first("title").alias("title"), F.first("whole").alias("whole"), F.first("bare").alias("bare"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("section", "place", "shown")))), lambda x: x["shown"]), "\n").alias("text"),
    )
    full = F.concat("title", F.lit("\n"), "text", F.lit("\n"))
    cut = F.concat(F.regexp_replace(F.substr(full, F.lit(1), F.lit(max(LEAST, PER_TOKEN * budget))), r"\s+$", ""), F.lit("\n"))
    noted = F.concat(F.when(F.col("bare"), cut).otherwise(full), F.lit(NOTE + "\n"))
    return text.select("doc", "total", (~F.col("whole")).alias("truncated"), F.when(F.col("whole"), full).otherwise(noted).alias("outline"))
