"""Claim audit: tokens, paragraphs, ranking of paragraphs for claims, and callouts without a counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.sources.tables import checkpointed

# Fixed values of the audit: paragraphs kept per claim, characters of an excerpt, least length of a paragraph, of a page that is no stub.
TOP, EXCERPT, LEAST, STUB = 3, 420, 20, 120
# What counts as a word, as a run of East Asian letters, as a number in a table.
WORD = r"[A-Za-z0-9][A-Za-z0-9.\-+%]*"
EAST = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ff66}-\x{ff9f}]+"
NUMERIC = r"^[0-9.,%±()\-–]+$"
WHOLE = r"(?<!\S)" + NUMERIC[1:-1] + r"(?!\S)"
#: The rarest words of a claim that the first round of :func:`best_paragraphs` looks up.
PROBES = 3
#: Rows that are sent to all tasks at most.
SENT_ROWS = 200_000


def audit_tokens(text: Column | str) -> Column:
    """The set of lower-case words and of pairs of East Asian letters side by side; everything else is left out."""
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower)
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"({EAST})"), F.lit(1)), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def table_dump(text: Column | str) -> Column:
    """Under six words, or over 35 of a hundred of them numbers."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return (words < 6) | (F.regexp_count(text, F.lit(WHOLE)) / words > 0.35)


def paragraphs(docs: DataFrame, key: str, text: str, breaks: str = r"\n\s*\n") -> DataFrame:
    """``(key, place, body)``: paragraphs of 20 characters or more that are no dump of a table, white space made single."""
    # white space goes before paragraphs become rows; else what is kept of them is made anew for each condition
    clean = docs.select(key, F.posexplode(F.transform(F.split(text, breaks), lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))).alias("place", "body"))
    return clean.where((F.length("body") >= LEAST) & ~table_dump("body"))


def sent(df: DataFrame) -> DataFrame:
    """Marks a checkpointed table for sending to all tasks if its counted rows are few enough; else it is joined by shuffling."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def score(overlap: Column, size: Column) -> Column:
    return overlap / F.sqrt(size.cast("double"))


def excerpt(body: str) -> Column:
    return F.when(F.length(body) <= EXCERPT, F.col(body)).otherwise(F.concat(F.substring(body, 1, EXCERPT - 1), F.lit("…")))


def ranked_within(pairs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``pairs`` with claim and paragraph tokens ``ct`` and ``pt``: overlap, score and rank of the best three of each group."""
    hit = pairs.withColumn("overlap", F.size(F.array_intersect("ct", "pt"))).where("overlap > 0").withColumn("score", score(F.col("overlap"), F.size("pt")))
    return hit.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *order))).where(F.col("rank") <= TOP)


def best_paragraphs(claims: DataFrame, paras: DataFrame) -> DataFrame:
    """``(claim, doc_id, place, overlap, score, rank)``: the three best paragraphs of all for each of ``claims(claim, ct)``.

    ``paras(doc_id, place, pt)``, read once. Exact, over the claims' words of each paragraph, kept as numbers. A claim's n words
    stand rarest first. The paragraphs of its rarest words give a score that the third best must reach. A paragraph of L
    words whose rarest shared word is the claim's i-th shares n - i words at most, so it is opened only where
    (n - i) / sqrt(L) reaches that score. It is opened by its rarest shared word alone, in the row that has its words,
    so that pairs are neither made twice nor shuffled; what is sent to all tasks is counted first.
    """
    wanted = checkpointed(claims.select(F.explode("ct").alias("term")).distinct().withColumn("word", F.monotonically_increasing_id()))
    # numbered before the words become rows: in one step numbers would be the words'
    numbered = paras.withColumn("row", F.monotonically_increasing_id())
    each = numbered.select("row", "doc_id", "place", F.size("pt").alias("size"), F.explode("pt").alias("term"))
    held = each.join(sent(wanted), "term").groupBy("row", "doc_id", "place", "size").agg(F.collect_list("word").alias("ws"))
    held = checkpointed(held.select("doc_id", "place", "size", "ws"))
    df = held.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    words = claims.select("claim", F.size("ct").alias("n"), F.explode("ct").alias("term")).join(wanted, "term").join(df, "word")
    words = checkpointed(words.withColumn("i", F.row_number().over(W.partitionBy("claim").orderBy("df", "term")) - 1).select("claim", "n", "word", "i"))
    asked = words.groupBy("claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]).alias("cw"))

    def best(lists: DataFrame) -> DataFrame:
        """The best of the paragraphs that ``lists(word, claim, longest)`` open, each by its rarest shared word."""
        lists = checkpointed(lists.join(asked, "claim").select("claim", F.col("word").alias("by"), "longest", "cw"))
        rows = held.select("doc_id", "place", "size", "ws", F.explode("ws").alias("word"))
        met = rows.join(sent(lists), (F.col("word") == F.col("by")) & (F.col("size") <= F.col("longest")))
        # an array of one element, so that words are compared once a pair
        met = met.select("claim", "doc_id", "place", "size", "word", F.explode(F.array(F.array_intersect("cw", "ws"))).alias("both"))
        met = met.where(F.get("both", F.lit(0)) == F.col("word")).withColumn("overlap", F.size("both"))
        met = met.select("claim", "doc_id", "place", "overlap", score(F.col("overlap"), F.col("size")).alias("score"))
        return met.withColumn("rank", F.row_number().over(W.partitionBy("claim").orderBy(F.desc("score"), "doc_id", "place"))).where(F.col("rank") <= TOP)

    first = best(words.where(F.col("i") < PROBES).withColumn("longest", F.lit(1e18)))
    least = first.where(F.col("rank") == TOP).select("claim", F.col("score").alias("least"))
    bound = words.join(least, "claim", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    return best(bound.withColumn("longest", F.when(F.col("least") > 0, F.pow((F.col("n") - F.col("i")) / F.col("least"), 2) * (1 + 1e-9)).otherwise(F.lit(1e18))))


def one_sided(callouts: DataFrame, mentions: DataFrame, parties: DataFrame) -> DataFrame:
    """``(id, host, party, party_type)``: parties of a callout that have no callout in return.

    ``callouts(id, host)``, ``mentions(id, name, is_source)``, ``parties(party, party_type)``. The first callout of a
    host that names a party stands for the pair. The party answers if one of its own callouts names the host, or a
    source or a page that the first callout names: one join on equal keys with the rows of all three, instead of one on an OR.
    What callouts name and the pairs are made once each and read again.
    """
    theirs = checkpointed(callouts.join(mentions, "id").select("id", "host", "name", "is_source"))
    named = theirs.join(parties, F.col("name") == F.col("party")).where("party <> host")
    pair = checkpointed(named.groupBy("host", "party", "party_type").agg(F.min("id").alias("id")))
    own = theirs.select(F.col("host").alias("party"), "name", "is_source").distinct()
    # what an answer may name, a row each: the host, as a page or source of its name, and all that the first callout names
    asked = pair.select("id", "host", "party").join(theirs.select("id", "name", "is_source"), "id").drop("id")
    asked = asked.unionByName(pair.select("host", "party", F.col("host").alias("name"), F.explode(F.array(F.lit(False), F.lit(True))).alias("is_source")))
    answered = asked.join(own, ["party", "name", "is_source"], "left_semi").select("host", "party").distinct()
    return pair.join(answered, ["host", "party"], "left_anti").select("id", "host", "party", "party_type")
