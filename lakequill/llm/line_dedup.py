"""Fuzzy line de-duplication by MinHash, in DataFrame operations only.

Equal lines, by two 64-bit hashes, are one class. Each class gets a one-permutation MinHash of its
character shingles: the shingles of a line are generated, hashed and reduced to the least hash of each
of ``BANDS * ROWS`` bins in one code-generated aggregate. Bands of ``ROWS`` minima are buckets.

Links are found in two rounds. First every class of a bucket meets the bucket's leader, its least key,
and the links join classes to components. Then each class outside its leader's component meets the
classes of the bucket that are in another component: first a few by lot, then all that are left. So any two classes of a bucket have been compared,
or are in one component.

A comparison has two steps, both exact. Each class has a bitmap of its shingles (``WORDS`` words); bits
that only one of two classes has are shingles that only it has, which bounds the Jaccard similarity from
above. Pairs that the bound leaves are verified on their whole shingle sets, and link if the similarity
is ``SIMILAR`` in 100 or more. Distributed union-find over the links keeps, of each component, the first line by
document id and line number.

Defined cases: lines are split at line feeds; blank lines are kept and never compared; a line shorter
than a shingle is one shingle; a null text stays null; documents without an id keep all their lines;
rows with one id share their lines' places, so an equal line at the same place is kept in all of them; a
document of which no line is left has an empty text; an empty table gives an empty result; all columns of
the input are returned, and where it has a column of the name of an added one, the added one's name gets
a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.llm.common import checkpointed, connected_components, free_name

SHINGLE, BANDS, ROWS = 8, 7, 4
SIMILAR = 75
#: 64-bit words of a class's bitmap of shingles, in groups of ``GROUP``.
WORDS, GROUP = 128, 8
#: Classes of a bucket, about, that its outsiders meet before they meet all.
ELECTED = 8
#: Characters of pairs that one task verifies; more tasks are made for more.
TASK_CHARS = 2_000_000
#: Rows, and bytes, that are sent to all tasks, when they have been counted; beyond them the texts are shuffled to them.
SENT_ROWS, SENT_BYTES = 600_000, 48 << 20
_BINS = BANDS * ROWS


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line, h1, h2)`` of all lines that are not blank."""
    cut = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return cut.where(F.trim("line") != "").withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit(7)))


def shingled(rows: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, h)``: the hash of each shingle of ``line``, with repeats; generated code all through.

    Shingles are cut out of the UTF-16 form, whose characters are two bytes each.
    """
    at = f"explode(sequence(1, greatest(1, length(body) - {2 * SHINGLE - 1}), 2))"
    body = rows.select(*keep, F.encode("line", "UTF-16BE").alias("body"))
    return body.select(*keep, "body", F.expr(at).alias("k")).select(*keep, F.expr(f"xxhash64(substring(body, k, {2 * SHINGLE}))").alias("h"))


def banded(rows: DataFrame) -> DataFrame:
    """``(h1, band)``: for each band of each line the hash of its bins' least hashes, to 24 bits; an empty bin takes the next one's.

    Grouping by band keeps the generated aggregate to ``ROWS`` minima, and small enough to be compiled.
    Equal lines fall together before the shuffle. A band without any shingle has no row.
    """
    each = shingled(rows, "h1").select("h1", F.expr(f"shiftrightunsigned(h, 32) * {_BINS}").alias("at"))
    each = each.select("h1", "at", F.expr("cast(shiftrightunsigned(at & 4294967295, 8) as int)").alias("v"))
    each = each.select("h1", "v", F.expr("cast(shiftright(at, 32) as int)").alias("bin")).select("h1", "v", F.expr(f"bin div {ROWS}").cast("int").alias("g"), F.expr(f"bin % {ROWS}").alias("r"))
    least = each.groupBy("h1", "g").agg(*[F.min(F.when(F.col("r") == j, F.col("v"))).alias(f"m{j}") for j in range(ROWS)])
    filled = [F.coalesce(*[F.col(f"m{(j + i) % ROWS}") for i in range(ROWS)]) for j in range(ROWS)]
    return least.select("h1", F.xxhash64("g", *filled).alias("band"))


def sent(df: DataFrame) -> DataFrame:
    """Marks a checkpointed table for sending to all tasks if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def crowded(bands: DataFrame) -> DataFrame:
    """``(band, h1, o1)``: the rows of bands that hold several keys, with the least of them. The window holds two numbers a row and spills."""
    bucket = W.partitionBy("band")
    met = bands.withColumn("o1", F.min("h1").over(bucket)).withColumn("most", F.max("h1").over(bucket))
    return checkpointed(met.where("o1 < most").select("band", "h1", "o1"))


def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cid, h1, line, p)`` for ``wanted(cid, h1, doc_id, line_no)``: the line at that place, and its number of shingles with repeats."""
    wanted = checkpointed(wanted)
    at = ["h1", "doc_id", "line_no"]
    texts = rows.join(sent(wanted), at).select("cid", "h1", "line", F.greatest(F.lit(1), F.expr(f"length(encode(line, 'UTF-16BE')) div 2 - {SHINGLE - 1}")).cast("int").alias("p"))
    texts = checkpointed(texts)
    # several rows of one id give a place several times
    return checkpointed(texts.dropDuplicates(["cid"])) if texts.count() > wanted.count() else texts


def bitmaps(texts: DataFrame) -> DataFrame:
    """``(cid, p, w, bits)``: the bitmap of a class's shingles in words, and how many bits are set. One shuffle, of the lines."""
    spread = texts.select("cid", "p", "line").repartition("cid")
    each = shingled(spread, "cid", "p").select("cid", "p", F.expr(f"cast(shiftrightunsigned(h, 6) & {WORDS - 1} as int)").alias("j"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("w"))
    each = each.select("cid", "p", F.expr(f"j div {GROUP}").cast("int").alias("g"), F.expr(f"j % {GROUP}").alias("r"), "w")
    none = F.lit(0).cast("long")
    word = each.groupBy("cid", "p", "g").agg(*[F.bit_or(F.when(F.col("r") == i, F.col("w")).otherwise(none)).alias(f"w{i}") for i in range(GROUP)])
    groups = word.groupBy("cid", "p").agg(F.map_from_entries(F.collect_list(F.struct("g", F.array(*[f"w{i}" for i in range(GROUP)])))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(WORDS // GROUP - 1))
    flat = groups.select("cid", "p", F.flatten(F.transform(at, lambda g: F.coalesce(F.try_element_at("m", g), F.array_repeat(none, GROUP)))).alias("w"))
    return checkpointed(flat.withColumn("bits", _summed(F.transform("w", F.bit_count))))


def _summed(counts):
    return F.aggregate(counts, F.lit(0), lambda s, x: s + x)


def _side(maps: DataFrame, side: str) -> DataFrame:
    return maps.select(*[F.col(c).alias(f"{side}_{c}") for c in maps.columns])


def _near():
    """Whether two classes ``a_`` and ``b_`` can be similar: u bits are only a's, v only b's; then at most a_p - u and b_p - v shingles are common, and u + v are not.

    The words are an array: over as many columns and a long sum the optimizer takes minutes.
    """
    sized = 100 * F.least("a_p", "b_p") >= SIMILAR * F.greatest("a_bits", "b_bits")
    apart = _summed(F.zip_with("a_w", "b_w", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    # 2u = apart + a_bits - b_bits, 2v = apart - a_bits + b_bits; similar: (100 - SIMILAR) * common >= SIMILAR * (u + v)
    common = F.least(2 * F.col("a_p") - F.col("a_bits") + F.col("b_bits"), 2 * F.col("b_p") - F.col("b_bits") + F.col("a_bits"))
    return sized & ((100 - SIMILAR) * common >= (100 + SIMILAR) * apart)


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the checkpointed ``pairs(a, b, chars)`` those whose shingle sets are similar, as ``(a, b)``.

    Both lines' shingles are counted in the task that holds the pair; ``b`` may be a leader of very many.
    """
    chars = pairs.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    if not chars:
        return pairs.select("a", "b")
    mine = texts.select(F.col("cid").alias("a"), F.col("line").alias("x"))
    other = texts.select(F.col("cid").alias("b"), F.col("line").alias("y"))
    met = pairs.select("a", "b").join(mine, "a").join(other, "b").repartition(max(8, -(-chars // TASK_CHARS)), "a", "b")
    sides = met.select("a", "b", F.explode(F.array(F.struct(F.col("x").alias("line"), F.lit(1).alias("side")), F.struct(F.col("y").alias("line"), F.lit(2).alias("side")))).alias("s"))
    each = shingled(sides.select("a", "b", "s.line", "s.side"), "a", "b", "side").groupBy("a", "b", "h").agg(F.bit_or("side").alias("side"))
    sizes = each.groupBy("a", "b").agg(F.count("*").alias("all"), F.sum(F.when(F.col("side") == 3, 1).otherwise(0)).alias("both"))
    return checkpointed(sizes.where(100 * F.col("both") >= SIMILAR * F.col("all")).select("a", "b"))


def _outsiders(members: DataFrame, comps: DataFrame, maps: DataFrame, elected: int | None) -> DataFrame:
    """Pairs that can be similar of a class outside its leader's component and one of the bucket in another component: all, or about ``elected`` of the bucket, by lot."""
    root = comps.withColumnsRenamed({"node": "cid"})
    rooted = members.join(root, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    rooted = rooted.join(root.select(F.col("cid").alias("lead"), F.col("root").alias("main")), "lead", "left").withColumn("main", F.coalesce("main", "lead"))
    rooted = checkpointed(rooted.where("cid <> lead").select("band", "cid", "root", "main"))
    outside = rooted.where("root <> main")
    inside = rooted.join(outside.select("band").distinct(), "band", "left_semi")
    if elected:
        crowd = rooted.groupBy("band").agg(F.count("*").alias("crowd"))
        inside = inside.join(crowd, "band").where(F.pmod(F.xxhash64("cid"), "crowd") < elected).drop("crowd")
    a = outside.join(maps, "cid").select("band", F.col("root").alias("a_root"), *[F.col(c).alias(f"a_{c}") for c in maps.columns])
    b = inside.join(maps, "cid").select("band", "main", F.col("root").alias("b_root"), *[F.col(c).alias(f"b_{c}") for c in maps.columns])
    # of two outsiders one order will do where all meet
    once = F.lit(True) if elected else F.expr("b_root = main or a_cid > b_cid")
    return a.join(b, "band").where(F.expr("a_root <> b_root") & once).where(_near())


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``(node, root)`` with further links between them."""
    ends = links.join(comps.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    more = checkpointed(connected_components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    joined = comps.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # classes that were alone before
    return checkpointed(joined.unionByName(more.join(joined.select("node"), "node", "left_anti").select("node", "root")))


def similar_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cid, root)`` of the classes that are in a component with another."""
    buckets = crowded(banded(rows))
    texts = fetch(rows, classes.join(buckets.select("h1").distinct(), "h1").select("cid", "h1", "doc_id", "line_no"))
    maps = bitmaps(texts)
    named = texts.select("h1", "cid")
    members = checkpointed(buckets.join(named, "h1").join(named.select(F.col("h1").alias("o1"), F.col("cid").alias("lead")), "o1").select("band", "cid", "lead"))

    # every class with its buckets' leaders
    pairs = members.where("cid <> lead").select(F.col("cid").alias("a_cid"), F.col("lead").alias("b_cid")).distinct()
    near = pairs.join(_side(maps, "a"), "a_cid").join(_side(maps, "b"), "b_cid").where(_near())
    chosen = [F.col("a_cid").alias("a"), F.col("b_cid").alias("b"), (F.col("a_p") + F.col("b_p")).cast("long").alias("chars")]
    first = verified(texts, checkpointed(near.select(*chosen)))
    comps = checkpointed(connected_components(first))

    # a few of each bucket, so that components that are alike in many pairs are joined by one of them; then all that are left
    for elected in (ELECTED, None):
        second = verified(texts, checkpointed(_outsiders(members, comps, maps, elected).select(*chosen).distinct()))
        if second.limit(1).count():
            comps = _joined(comps, second)
    return comps.select(F.col("node").alias("cid"), "root")


def duplicate_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places of all lines with the class, classes that lose lines with the place that is kept)."""
    rows = lines(docs.select("doc_id", "text"))
    places = checkpointed(rows.select("doc_id", "line_no", "h1", "h2"))
    classes = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "first.doc_id", "first.line_no", "times"))
    roots = classes.join(similar_classes(rows, classes), "cid")
    kept = roots.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("keep"))
    fuzzy = checkpointed(roots.join(kept, "root").select("h1", "h2", "keep.doc_id", "keep.line_no"))
    exact = classes.where("times > 1").join(fuzzy, ["h1", "h2"], "left_anti").select("h1", "h2", "doc_id", "line_no")
    return places, fuzzy.unionByName(exact)


def dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the text without its repeated lines, and ``n_lines`` and ``n_dropped``."""
    places, kept = duplicate_lines(docs)
    kept = kept.select("h1", "h2", F.col("doc_id").alias("keep_doc"), F.col("line_no").alias("keep_line"))
    key, gone, cut, rest, n_lines, n_dropped = (free_name(docs, c) for c in ("lq_id", "lq_gone", "lq_lines", "lq_left", "n_lines", "n_dropped"))
    lost = (
        places.join(kept, ["h1", "h2"]).where("doc_id <> keep_doc or line_no <> keep_line")
        .groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone))
    )
    lost = checkpointed(lost)
    if lost.agg(F.coalesce(F.sum(48 + 8 * F.size(gone)), F.lit(0))).first()[0] <= SENT_BYTES:
        lost = F.broadcast(lost)
    out = docs.join(lost, F.col("doc_id") == F.col(key), "left").withColumn(cut, F.split("text", "\n", -1))
    left = F.filter(cut, lambda x, i: ~F.array_contains(gone, i))
    return (
        out.withColumn(rest, F.when(F.col(gone).isNull(), F.col(cut)).otherwise(left))
        .withColumn(n_lines, F.coalesce(F.size(cut), F.lit(0)))
        .withColumn(n_dropped, F.col(n_lines) - F.coalesce(F.size(rest), F.lit(0)))
        .withColumn("text", F.array_join(rest, "\n"))
        .drop(key, gone, cut, rest)
    )
