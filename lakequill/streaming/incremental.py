"""Indexes that are refreshed by what changed: a term index and a vector table, fed by micro-batches.

Both are logs of Parquet folders, one a version; the version is the number of the micro-batch, so a batch that is
replayed overwrites what it wrote before and changes nothing. A batch reads only the versions before its own.

* ``pages/version=v/part=p``: ``(doc_id, hash, dl, deleted)`` of the pages that the batch changed, by hash of the id.
  The newest version of an id counts; a deleted page leaves a tombstone. Written last, so it is what commits a version.
* ``postings/version=v/bucket=b``: ``(term, doc_id, tf)`` of those pages, by hash of the term. A posting lives as long as
  the page's newest version is its own, so nothing is rewritten when a page changes, and a batch touches the buckets
  of its own terms only.

Pages whose text hash is what the index holds already are left out before anything is tokenised or embedded.
Defined cases: a null text is empty; of several rows of one id in a batch the one of greatest ``seq`` counts;
a deletion of an unknown id does nothing; a batch without rows writes nothing; terms may be very common, as their
postings are spread over versions and are counted where they lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.operators.retrieval import bm25_parts, counted

PAGES = "doc_id long, hash string, dl int, deleted boolean, version int, part int"
POSTINGS = "term string, doc_id long, tf long, version int, bucket int"
#: Changed pages of a batch whose keys are broadcast at most.
SENT_PAGES = 600_000
VECTORS = "doc_id long, hash string, vec array<double>, deleted boolean, version int, part int"


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All versions of a log, none if nothing has been written yet."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _newest(log: DataFrame) -> DataFrame:
    """The row of the greatest version of each id."""
    rest = [c for c in log.columns if c not in ("doc_id", "part")]
    best = log.groupBy("part", "doc_id").agg(F.max_by(F.struct(*rest), "version").alias("best"))
    return best.select("part", "doc_id", "best.*")


def _keyed(batch: DataFrame, parts: int) -> DataFrame:
    """The rows of a batch with hash and part; missing values stand as what they mean."""
    text = F.coalesce("text", F.lit(""))
    seq = F.coalesce("seq", F.lit(-(2**63)).cast("long"))
    return batch.select("doc_id", text.alias("text"), F.coalesce("deleted", F.lit(False)).alias("deleted"), seq.alias("seq"), F.sha2(text, 256).alias("hash"), F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part"))


def _changed(batch: DataFrame, log: DataFrame, version: int, parts: int) -> DataFrame:
    """The last row of each id in a batch that changes what the log holds, with ``action`` (new, changed, deleted) and the number of its ``copies``.

    Told from hashes alone, so that no text is shuffled; :func:`_texts` brings the texts of what is left.
    """
    last = ["seq", "hash", "deleted"]
    each = _keyed(batch, parts).groupBy("part", "doc_id", *last).agg(F.count("*").alias("copies"))
    rows = each.groupBy("part", "doc_id").agg(F.max(F.struct(*last, "copies")).alias("last")).select("part", "doc_id", "last.*")
    held = _newest(log.where(F.col("version") < version).join(F.broadcast(rows.select("part").distinct()), "part", "left_semi"))
    held = held.where(~F.col("deleted")).select("part", "doc_id", F.col("hash").alias("held_hash"))
    both = rows.join(held, ["part", "doc_id"], "left")
    action = (
        F.when(F.col("deleted"), F.when(F.col("held_hash").isNotNull(), "deleted"))
        .when(F.col("held_hash").isNull(), "new")
        .when(F.col("held_hash") != F.col("hash"), "changed")
    )
    return both.withColumn("action", action).where("action is not null").drop("held_hash")


def _sizes(changed: DataFrame):
    """``n_rows``, ``n_live`` and the most ``copies`` of what has changed, by one pass."""
    return changed.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("deleted")).alias("n_live"), F.coalesce(F.max("copies"), F.lit(0)).alias("copies")).first()


def _texts(batch: DataFrame, changed: DataFrame, parts: int, sizes=None) -> DataFrame:
    """``(part, doc_id, text)`` of the live pages in ``changed``.

    The changed pages have been counted (``sizes``); up to ``SENT_PAGES`` they are broadcast and texts stay where they are, beyond
    that texts are shuffled by id. Only of pages that a batch has in equal copies one must be chosen.
    """
    live = changed.where(~F.col("deleted")).select("part", "doc_id", "seq", "hash", "copies")
    sizes = sizes or _sizes(changed)
    rows = _keyed(batch, parts).where(~F.col("deleted")).drop("deleted")
    found = rows.join(F.broadcast(live) if sizes["n_live"] <= SENT_PAGES else live, ["part", "doc_id", "seq", "hash"]).select("part", "doc_id", "copies", "text")
    if sizes["copies"] > 1:
        found = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["part", "doc_id"]))
    return found.drop("copies")


class TermIndex:
    """Postings by term bucket that follow a changing set of pages."""

    def __init__(self, spark: SparkSession, folder: str, tokens: Callable[[str], Column], buckets: int = 16, parts: int = 16) -> None:
        self.spark, self.folder, self.tokens, self.buckets, self.parts = spark, folder, tokens, buckets, parts

    def _pages_log(self) -> DataFrame:
        return _log(self.spark, f"{self.folder}/pages", PAGES)

    def apply(self, batch: DataFrame, version: int) -> None:
        """Takes in ``batch(doc_id, text, deleted, seq)`` as the given version; the same version again gives the same files."""
        rows = _changed(batch, self._pages_log(), version, self.parts).persist()
        try:
            sizes = _sizes(rows)
            if not sizes["n_rows"]:
                return
            ts = _texts(batch, rows, self.parts, sizes).select("doc_id", self.tokens("text").alias("ts"))
            terms = ts.select("doc_id", F.size("ts").alias("dl"), counted(F.col("ts")).alias("index")).persist()
            try:
                # a task writes what it holds of each bucket: postings are not shuffled
                out = terms.select("doc_id", F.inline("index")).select("term", "doc_id", "tf", self._bucket().alias("bucket"))
                out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/version={version}")
                pages = rows.join(terms.select("doc_id", "dl"), "doc_id", "left").select("doc_id", "hash", F.coalesce("dl", F.lit(0)).alias("dl"), "deleted", "part")
                pages.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/pages/version={version}")
            finally:
                terms.unpersist()
        finally:
            rows.unpersist()

    def _bucket(self) -> Column:
        return F.pmod(F.hash("term"), F.lit(self.buckets))

    def pages(self) -> DataFrame:
        """``(doc_id, hash, dl, version)`` of the pages there are."""
        return _newest(self._pages_log()).where(~F.col("deleted")).select("doc_id", "hash", "dl", "version")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``(term, doc_id, tf, dl)`` of the pages there are, of all terms or of ``terms(term)``.

        Buckets without such terms are not read: the list of wanted buckets prunes the scan and is no longer than their number.
        """
        log = _log(self.spark, f"{self.folder}/postings", POSTINGS)
        if terms is not None:
            wanted = terms.select("term", self._bucket().alias("bucket")).distinct()
            numbers = [r[0] for r in wanted.select("bucket").distinct().collect()]
            log = log.where(F.col("bucket").isin(numbers)).join(wanted, ["bucket", "term"], "left_semi")
        return log.join(self.pages().select("doc_id", "version", "dl"), ["doc_id", "version"]).select("term", "doc_id", "tf", "dl")

    def collection(self) -> DataFrame:
        """``(n_docs, avgdl)``, from the page log alone."""
        mean = F.avg("dl")
        return self.pages().agg(F.count("*").alias("n_docs"), F.when(F.coalesce(mean, F.lit(0.0)) == 0, 1.0).otherwise(mean).alias("avgdl"))

    def bm25(self, asked: DataFrame, query: str) -> DataFrame:
        """``(query, doc_id, score)`` for ``asked(query, term)`` with a row per query token."""
        return bm25_parts(self.postings(asked.select("term")), self.collection(), asked, "doc_id", query)


class VectorTable:
    """Vectors of pages, made anew only where the text hash of an id has changed."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[DataFrame], DataFrame], parts: int = 16) -> None:
        """``embed`` gives ``(doc_id, vec array<double>)`` for ``(doc_id, text)``."""
        self.spark, self.folder, self.embed, self.parts = spark, folder, embed, parts

    def _log(self) -> DataFrame:
        return _log(self.spark, f"{self.folder}/vectors", VECTORS)

    def apply(self, batch: DataFrame, version: int) -> None:
        """Embeds what is new or changed in ``batch(doc_id, text, deleted, seq)``; pages that the embedder gives nothing for get a null vector."""
        work = f"{self.folder}/work/version={version}"
        changed = _changed(batch, self._log(), version, self.parts).persist()
        try:
            texts = _texts(batch, changed, self.parts)
            changed.join(texts, ["part", "doc_id"], "left").write.mode("overwrite").parquet(work)
        finally:
            changed.unpersist()
        rows = self.spark.read.parquet(work)
        if rows.isEmpty():
            return
        made = self.embed(rows.where(~F.col("deleted")).select("doc_id", "text"))
        out = rows.select("doc_id", "hash", "deleted", "part").join(made, "doc_id", "left").select("doc_id", "hash", F.col("vec").cast("array<double>").alias("vec"), "deleted", "part")
        out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/vectors/version={version}")

    def vectors(self) -> DataFrame:
        """``(doc_id, hash, vec, version)`` of the pages there are."""
        return _newest(self._log()).where(~F.col("deleted")).select("doc_id", "hash", "vec", "version")

    def history(self) -> DataFrame:
        """``(doc_id, made)``: how often each page there is has been embedded."""
        made = self._log().where(~F.col("deleted")).groupBy("doc_id").agg(F.count("*").alias("made"))
        return self.vectors().select("doc_id", "version").join(made, "doc_id")


def refresh(spark: SparkSession, source: str, schema, checkpoint: str, *indexes) -> None:
    """One run over what is new in ``source``: each micro-batch goes to every index under its number."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for index in indexes:
                index.apply(batch, number)
        finally:
            batch.unpersist()

    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

