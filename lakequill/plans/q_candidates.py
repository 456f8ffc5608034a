"""References to read: items that sales mention, with the decisions that client changes stand for; identifiers of bibliographies."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators import candidates as C
from lakequill.operators import references as R
from lakequill.plans import q_references as Q
from lakequill.plans.registry import SQL, query, tbl

WHAT = "CASE WHEN op = 'D' THEN 'reject' WHEN op = 'I' THEN 'reopen' WHEN seq % 4 = 0 THEN 'mark' END"
# decisions are gone through one by one here: each undoes or replaces what stood before it
STATES = f"""me AS (SELECT item_id AS key, sale_id AS source, min(shipped_at) AS f, max(shipped_at) AS l FROM sale_lines WHERE item_id IS NOT NULL AND sale_id IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2),
sn AS (SELECT key, count(*) AS demand, min(f) AS first_seen, max(l) AS last_seen FROM me GROUP BY 1), de AS (SELECT client_id AS key, valid_at AS tm, change_id AS seq, {WHAT} AS what FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL AND change_id IS NOT NULL),
va AS (SELECT key, tm, seq, what FROM de JOIN sn USING (key) WHERE tm >= first_seen AND what IN ('mark', 'reject')), cl AS (SELECT * FROM va QUALIFY row_number() OVER (PARTITION BY key ORDER BY tm DESC, seq DESC) = 1),
ef AS (SELECT cl.key, cl.tm, cl.what FROM cl WHERE NOT (cl.what = 'reject' AND EXISTS (SELECT 1 FROM de WHERE de.key = cl.key AND de.what = 'reopen' AND (de.tm > cl.tm OR de.tm = cl.tm AND de.seq > cl.seq)))),
st AS (SELECT key, demand, CASE WHEN what = 'reject' THEN 'rejected' WHEN what = 'mark' OR EXISTS (SELECT 1 FROM items WHERE item_id = key AND size % 10 = 0) THEN 'ingested' ELSE 'pending' END AS state, first_seen, last_seen, tm FROM sn LEFT JOIN ef USING (key))"""


def _states(spark, d):
    sold, changed = tbl(spark, d, "sale_lines"), tbl(spark, d, "client_changes")
    mentions = C.fold_mentions(sold.select(F.col("item_id").alias("key"), F.col("sale_id").alias("source"), F.col("shipped_at").alias("first_at"), F.col("shipped_at").alias("last_at")))
    decisions = C.fold_decisions(C.decided(changed.select(F.col("client_id").alias("key"), F.col("valid_at").alias("at"), F.col("change_id").alias("seq"), F.expr(WHAT).alias("what"))))
    return C.ledger(mentions, decisions, tbl(spark, d, "items").where("size % 10 = 0").select(F.col("item_id").alias("key")))


@query("o10_reference_ledger", SQL(f"WITH {STATES} SELECT key, demand, state, first_seen, last_seen, CASE WHEN state <> 'pending' THEN coalesce(tm, last_seen) END AS resolved_at FROM st"))
def reference_ledger(spark, d):
    return _states(spark, d)


@query("q30_ready_references", SQL(f"WITH {STATES} SELECT key, demand, CAST(row_number() OVER (ORDER BY demand DESC, key) AS INTEGER) AS rank FROM st WHERE state = 'pending' AND demand >= {C.DEMAND} QUALIFY rank <= {C.LISTED}"))
def ready_references(spark, d):
    """The first lines of the report."""
    order = [F.desc("demand"), "key"]
    return C.ready(_states(spark, d)).orderBy(*order).limit(C.LISTED).withColumn("rank", F.row_number().over(W.orderBy(*order)))


# a document whose number ends in 0 or 5 has the first identifier of its own bibliography
@query("q30_extracted_identifiers", SQL(f"""WITH {Q.TEXTS}, {Q.ITEMS}, it AS (SELECT doc_id, k, CASE WHEN doc_id % 3 = 0 THEN 'arxiv:2401.1' || lpad(CAST(k + first AS VARCHAR), 4, '0') ELSE 'doi:10.1000/x(' || CAST(k + first AS VARCHAR) || ')' END AS ident FROM pc JOIN bd USING (doc_id) WHERE k > 0 AND doc_id % 3 < 2)
SELECT doc_id, ident FROM it WHERE NOT (doc_id % 5 = 0 AND k = 1)"""))
def extracted_identifiers(spark, d):
    found = R.regions(Q._texts(spark, d), "doc_id", "text").select("doc_id", "first", F.posexplode(R.identifiers("region")).alias("pos", "ident"))
    own = found.where("doc_id % 5 = 0 and pos = 0").select("doc_id", "ident")
    return C.extracted(found.select("doc_id", "ident"), own, "doc_id")
