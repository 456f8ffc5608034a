"""N-gram Jaccard self-join by a token-group matrix, exact at its threshold.

Documents with the same shingle set form a class; one document stands for it. Similar documents are
then partitioned into groups: minhash buckets elect a leader, members are checked against it exactly,
and the components of those links are cut into groups of a bounded size. Each group's token union is
its row of the matrix. A document (the query) can only link into a group whose union holds at least
75 in 100 of its tokens, so

* a query meets a group only if a token of its prefix (its rarest quarter) is in the prefix part of
  the group's row, the sizes allow a link, and the two are not yet in one component;
* that token must stand early enough in both orders: were it the first one shared, the tokens from it
  on must be as many as a link of these sizes needs (for equal sizes, within the first seventh);
* for those, the whole overlap with the group's union is the bound; and
* only groups that pass the bound are opened, member by member, until a link is found.

Rare means rare in all documents: counts of tokens that recur within a task are summed over all of
them, and the most frequent ones, at most ``RANKED`` whatever the corpus, are ranked last. The ranking
steers cost only; any one order that all tasks share finds every link.

Defined cases: a null or empty text, or one without words, has no shingles and stays alone; fewer than
five words are one shingle; equal texts link; repeated ids are seen as one document, which links as any
of its texts does; a row without an id links with equal texts only, and has no component where there are
none; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.llm.common import checkpointed, connected_components
from lakequill.llm.shingles import mix, shingle_sets

#: Most tokens that are ranked by count; their table goes to every worker, 16 bytes each.
RANKED = 1 << 18
BANDS, ROWS = 12, 3
#: Rows of (document, group) up to which they are sent to the texts; beyond it the texts are shuffled to them. About 50 bytes each.
SENT = 150_000
#: Shingles that are counted together before a task lets go of them.
COUNTED = 1 << 22
GROUP = 24
#: Shingles of queries that are held against one group in one task.
OPENED = 1 << 18


def linked(both: int, a: int, b: int) -> bool:
    """Jaccard similarity of at least 0.75, in whole numbers."""
    return 100 * both >= 75 * (a + b - both)


def prefix_size(n: int) -> int:
    """Tokens of which at least one is shared with any set that links to one of ``n``."""
    return n - (3 * n + 3) // 4 + 1


def minhash_bands(tokens: np.ndarray) -> list[int]:
    """One-permutation minhash of a sorted set of uniform hashes, as band keys."""
    bins = BANDS * ROWS
    bounds = (np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins)).astype(np.uint64)
    at = np.searchsorted(tokens, bounds)
    low = tokens[np.where(at == len(tokens), 0, at)].reshape(BANDS, ROWS)  # an empty bin takes the next one's
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
    return keys.view(np.int64).tolist()


def _counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    token, n = np.unique(np.concatenate(held), return_counts=True)
    token, n = token[n > 1], n[n > 1]
    for lo in range(0, len(token), 100_000):
        k = len(token[lo : lo + 100_000])
        yield _signed(token[lo : lo + 100_000].view(np.int64), n[lo : lo + 100_000], np.zeros(k, np.int64), np.zeros(k, np.int64), [None] * k)


def _signed(a, n, s1, s2, bands) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "bands"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (bands not null): size, two sums that name the set, band keys. A row per token that recurs in the task (bands null): its count."""
    held, size, seen = [], 0, set()
    for b in batches:
        rows = []
        for key, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist()), strict=True):
            if not len(s):
                rows.append((key, 0, 0, 0, []))
                continue
            s1, s2 = int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s).sum(dtype=np.uint64).view(np.int64))
            rows.append((key, len(s), s1, s2, minhash_bands(s)))
            if (s1, s2) not in seen:
                seen.add((s1, s2))
                held.append(s)
                size += len(s)
            if size >= COUNTED:
                yield from _counted(held)
                held, size, seen = [], 0, set()
        if rows:
            yield _signed(*zip(*rows, strict=True))
    if held:
        yield from _counted(held)


def _prefixes(ranked: tuple[np.ndarray, np.ndarray]):
    """Prefix tokens of each document with their places in it; copies within a task are given once, for the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ranked
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            tokens, docs, hot, place = [], [], [], []
            for key, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist()), strict=True):
                if not len(s):
                    continue
                mark = (len(s), int(s.sum(dtype=np.uint64)))
                if seen.get(mark, key + 1) <= key:
                    continue
                if len(seen) < 1_000_000:
                    seen[mark] = key
                count = np.zeros(len(s), np.int64)
                if len(names):
                    at = np.searchsorted(names, s)
                    at[at == len(names)] = 0
                    count = np.where(names[at] == s, counts[at], 0)
                first = np.lexsort((s, count))[: prefix_size(len(s))]
                tokens.append(s[first])
                hot.append(count[first] > 0)
                docs.append(np.full(len(first), key, np.int64))
                place.append(np.arange(len(first), dtype=np.int32))
            if tokens:
                cols = [np.concatenate(tokens).view(np.int64), np.concatenate(docs), np.concatenate(hot), np.concatenate(place)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "doc", "hot", "at"])

    return run


def _open(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group with some of its queries: bound by the token union, then member by member."""
    sets = list(zip(pdf.doc.tolist(), pdf.member.tolist(), shingle_sets(pdf.text.tolist()), strict=True))
    members = sorted(((len(s), d, s) for d, m, s in sets if m and len(s)), key=lambda x: x[:2])
    out = []
    if members:
        union = np.unique(np.concatenate([s for *_, s in members]))
        for q, m, s in sets:
            if m or not len(s):
                continue
            at = np.searchsorted(union, s)
            at[at == len(union)] = 0
            bound = int((union[at] == s).sum())
            if not linked(min(bound, members[0][0]), len(s), members[0][0]) and not linked(bound, len(s), bound):
                continue
            for size, d, t in members:
                if d != q and linked(min(size, len(s), bound), size, len(s)) and linked(len(np.intersect1d(s, t, assume_unique=True)), size, len(s)):
                    out.append((q, d))
                    break
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def verified(docs: DataFrame, pairs: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` out of ``pairs(doc, g)`` with ``members(doc, g)``: one shuffle of the texts on the id, one of those wanted on the group.

    A group with many queries is opened in several tasks, each with some of the queries and all of its
    (boundedly many) members.
    """
    load = pairs.join(sizes, "doc").groupBy("g").agg(F.sum("n").alias("load"))
    parts = checkpointed(load.select("g", F.ceil(F.col("load") / OPENED).cast("int").alias("parts")))
    if parts.count() <= SENT:
        parts = F.broadcast(parts)
    wanted = (
        pairs.join(parts, "g")
        .select("doc", "g", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("member"))
        .unionByName(members.join(parts, "g").select("doc", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member")))
    )
    wanted = checkpointed(wanted)
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, "doc").select("doc", "g", "part", "member", "text").groupBy("g", "part").applyInPandas(_open, "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = checkpointed(docs.mapInArrow(_sign, "id long, n long, s1 long, s2 long, bands array<long>"))
    sigs = signed.where("bands is not null")
    reps = checkpointed(sigs.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("doc"), F.first("bands").alias("bands")))
    sizes = reps.select("doc", "n")

    # leaders of minhash buckets
    banded = reps.select("doc", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("doc").alias("g"), F.max("doc").alias("last")).where("g < last").select("band", "g")
    pairs = checkpointed(banded.join(leaders, "band").where("doc <> g").select("doc", "g").distinct())
    first = checkpointed(verified(docs, pairs, pairs.select(F.col("g").alias("doc"), "g").distinct(), sizes))
    comps = checkpointed(connected_components(first))

    # the ranking of frequent tokens: at most RANKED of them, by a threshold from the histogram of counts
    counts = signed.where("bands is null").groupBy("id").agg(F.sum("n").alias("n"))
    hist = counts.groupBy(F.least(F.lit(4096), F.col("n")).alias("n")).count().collect()
    total, least = 0, 4097
    for n, k in sorted(((r["n"], r["count"]) for r in hist), reverse=True):
        if total + k > RANKED:
            break
        total, least = total + k, n
    top = counts.where(F.col("n") >= max(least, 4)).toPandas() if total else pd.DataFrame({"id": [], "n": []}, dtype="int64")
    names = top["id"].to_numpy("int64").view(np.uint64)
    order = np.argsort(names)
    ranked = spark.sparkContext.broadcast((names[order], top["n"].to_numpy("int64")[order]))

    # prefix tokens that occur in several components, with each document's group
    def prefixes(batches):
        yield from _prefixes(ranked.value)(batches)

    salted = W.partitionBy("token", "salt")
    postings = docs.where("doc_id is not null").mapInArrow(prefixes, "token long, doc long, hot boolean, at int").withColumn("salt", F.when(F.col("hot"), F.pmod("doc", F.lit(1021))).otherwise(0))
    shared = postings.withColumn("lo", F.min("doc").over(salted)).withColumn("hi", F.max("doc").over(salted)).where("hot or lo < hi").select("token", "doc", "at")
    group = (
        reps.select("doc", "n").join(comps.withColumnsRenamed({"node": "doc", "root": "comp"}), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    )
    chunks = group.groupBy("comp").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    group = checkpointed(group.join(chunks, "comp").select("doc", "n", "comp", F.xxhash64("comp", F.pmod(F.xxhash64("doc"), "chunks")).alias("g")))
    postings = checkpointed(shared.join(group, "doc"))
    several = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    postings = postings.join(several, "token")
    # a link of sizes n and m needs 3 (n + m) / 7 common tokens; n - at of them can be common from place at on
    matrix = postings.groupBy("token", "g", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(4 * F.col("n") - 7 * F.col("at")).alias("room"))
    met = (
        postings.select("token", "doc", "n", "at", F.col("comp").alias("own"))
        .join(matrix, "token")
        .where("own > comp and 100 * n >= 75 * least and 75 * n <= 100 * most and room >= 3 * n and 4 * n - 7 * at >= 3 * least")
        .select("doc", "g")
        .distinct()
    )
    met = checkpointed(met)
    members = group.select("doc", "g").join(met.select("g").distinct(), "g", "left_semi")
    second = checkpointed(verified(docs, met, members, sizes))

    comps = connected_components(first.unionByName(second)).withColumnsRenamed({"node": "doc", "root": "component_id"})
    named = reps.join(comps, "doc", "left").select("s1", "s2", "n", F.coalesce("component_id", "doc").alias("component_id"))
    return (
        sigs.select("id", "n", "s1", "s2")
        .join(named, ["s1", "s2", "n"], "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    )
