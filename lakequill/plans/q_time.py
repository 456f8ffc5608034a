"""Timelines over orders and shipments, session analytics over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakequill.operators import sessions as S
from lakequill.operators import timeline as T
from lakequill.plans.fixtures import Derived, Fixture
from lakequill.plans.registry import SQL, query, tbl

BORN = "o AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_orderstatus AS status, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders)"


def _born(spark, d):
    return tbl(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.unix_date(F.to_date("o_orderdate")).alias("day"))


@query("e7_cumulative_by_day", SQL(f"WITH {BORN}, c AS (SELECT day, count(*) AS daily FROM o GROUP BY day) SELECT day, daily, CAST(sum(daily) OVER (ORDER BY day) AS BIGINT) AS cum FROM c"))
def cumulative(spark, d):
    return T.cumulative(_born(spark, d), "day")


@query("e8_daily_delta", SQL(f"WITH {BORN}, c AS (SELECT day, CAST(sum(count(*)) OVER (ORDER BY day) AS BIGINT) AS cum FROM o GROUP BY day) SELECT day, cum - lag(cum, 1, 0) OVER (ORDER BY day) AS delta FROM c"))
def delta(spark, d):
    c = T.cumulative(_born(spark, d), "day")
    return c.select("day", (F.col("cum") - F.lag("cum", 1, 0).over(W.partitionBy(F.lit(0)).orderBy("day"))).alias("delta"))


@query("e9_count_series_by_type", SQL(f"""WITH {BORN}, f AS (SELECT * FROM o WHERE status <> 'P'), g AS (SELECT * FROM (SELECT DISTINCT kind FROM f) CROSS JOIN (SELECT DISTINCT day FROM f)),
c AS (SELECT kind, day, count(f.id) AS daily FROM g LEFT JOIN f USING (kind, day) GROUP BY ALL) SELECT kind, day, daily, CAST(sum(daily) OVER (PARTITION BY kind ORDER BY day) AS BIGINT) AS cum FROM c"""))
def by_type(spark, d):
    return T.cumulative(_born(spark, d).where("status <> 'P'"), "day", ["kind"])


AT = 9800


@query("i7_replay_classification", SQL(f"WITH {BORN} SELECT id, CASE WHEN day > {AT} THEN 'hidden' WHEN day > {AT} - 90 THEN 'new' ELSE 'existing' END AS state FROM o"))
def replay(spark, d):
    return _born(spark, d).select("id", T.replay_class(F.col("day"), F.lit(AT), 90).alias("state"))


SHIP = f"{BORN}, l AS (SELECT l_orderkey AS id, max(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)) AS upd FROM lineitem GROUP BY 1)"


def _ship(spark, d):
    u = tbl(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.unix_date(F.to_date("l_shipdate"))).alias("upd"))
    return _born(spark, d).join(u, "id", "left")


@query("i8_diff_classification", SQL(f"WITH {SHIP} SELECT id, CASE WHEN day > {AT} THEN 'hidden' WHEN day > {AT} - 365 THEN 'new' WHEN upd > {AT} - 365 AND upd <= {AT} THEN 'updated' ELSE 'unchanged' END AS state FROM o LEFT JOIN l USING (id)"))
def diff(spark, d):
    return _ship(spark, d).select("id", T.diff_class(F.col("day"), F.col("upd"), F.lit(AT - 365), F.lit(AT)).alias("state"))


@query("i9_edge_birth", SQL(f"WITH {BORN} SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS no, greatest(o.day, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)) AS born FROM lineitem JOIN o ON o.id = l_orderkey"))
def edge_birth(spark, d):
    li = tbl(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("no"), F.unix_date(F.to_date("l_shipdate")).alias("s"))
    return li.join(_born(spark, d).select("id", "day"), "id").select(F.col("id").alias("src"), "dst", "no", F.greatest("day", "s").alias("born"))


@query("e16_new_edges_top", SQL("WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS cnt FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY ALL) SELECT src, dst, cnt FROM e ORDER BY cnt DESC, src, dst LIMIT 200"))
def new_edges(spark, d):
    e = tbl(spark, d, "lineitem").where("l_shipdate >= timestamp'1997-01-01'").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("cnt"))
    return e.orderBy(F.desc("cnt"), "src", "dst").limit(200)


@query("p7_recent_window", SQL(f"WITH {BORN} SELECT kind, count(*) AS recent FROM o WHERE day > {AT} - 30 AND day <= {AT} GROUP BY kind"))
def recent(spark, d):
    return _born(spark, d).where(f"day > {AT - 30} and day <= {AT}").groupBy("kind").agg(F.count("*").alias("recent"))


DATES = Derived("dates", "SELECT stamp_id AS id, raw FROM {stamps}")
_DAY = r"CASE WHEN regexp_matches(left(raw, 10), '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(left(raw, 10) AS DATE) END"


@query("i1_day_parse", SQL(f"WITH {DATES.cte} SELECT id, CAST(date_diff('day', DATE '1970-01-01', {_DAY}) AS INTEGER) AS day FROM dates"))
def day_parse(spark, d):
    return DATES.frame(spark, d).select("id", T.day("raw").alias("day"))


@query("i2_days_since", SQL(f"WITH {DATES.cte} SELECT id, CAST(coalesce(greatest(0, date_diff('day', {_DAY}, DATE '2024-03-10')), 10000) AS INTEGER) AS days, round(exp(-coalesce(greatest(0, date_diff('day', {_DAY}, DATE '2024-03-10')), 10000) / 30.0), 6) AS recency FROM dates"))
def since(spark, d):
    days = T.days_since(F.try_to_date(F.substring("raw", 1, 10), "yyyy-MM-dd"), F.lit("2024-03-10").cast("date"))
    return DATES.frame(spark, d).select("id", days.alias("days"), F.round(F.exp(-days / 30.0), 6).alias("recency"))


@query("i5_month_extraction", SQL("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL"))
def month(spark, d):
    return tbl(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?$"


@query("i6_timestamp_parse", SQL(f"""WITH {DATES.cte}, t AS (SELECT id, trim(raw) AS r FROM dates), z AS (SELECT id, r, regexp_extract(r, '([+-])(\\d{{2}}):?(\\d{{2}})$', ['s', 'h', 'm']) AS z FROM t WHERE regexp_matches(r, '{_ISO}'))
SELECT dates.id, CAST(epoch_us(TRY_CAST(replace(left(r, 19), 'T', ' ') AS TIMESTAMP)) - CASE WHEN z.z.s = '' OR length(r) = 19 THEN 0 ELSE (CASE z.z.s WHEN '-' THEN -1 ELSE 1 END) * (60 * CAST(z.z.h AS BIGINT) + CAST(z.z.m AS BIGINT)) * 60000000 END AS BIGINT) AS micros FROM dates LEFT JOIN z USING (id)"""))
def stamp(spark, d):
    return DATES.frame(spark, d).select("id", F.unix_micros(T.iso_timestamp("raw")).alias("micros"))


# sessions: events of a user in time order
@query("p1_inactivity_gaps", SQL("""WITH s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (step > 300000000) AS gaps, CAST(coalesce(sum(step) FILTER (step <= 300000000), 0) AS BIGINT) AS active_micros FROM s GROUP BY user_id"""))
def gaps(spark, d):
    return S.gaps(tbl(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


@query("p1_session_window", SQL("""WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 300000000 THEN 0 ELSE 1 END AS fresh, event_id, value FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS value FROM n GROUP BY user_id, sess"""))
def session_window(spark, d):
    w = tbl(spark, d, "events").groupBy("user_id", F.session_window("ts", "300 seconds").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "value")


@query("d15_session_metrics", SQL("""SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(length(text), turn) AS first_len, arg_max(length(text), turn) AS last_len, CAST(floor(avg(length(text))) AS BIGINT) AS mean_len, max(length(text)) AS most_len,
list_sort(list(length(text)))[len(list(length(text))) // 2 + 1] AS p50_len FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role, text) GROUP BY conv_id"""))
def session_metrics(spark, d):
    rows = S.first_wins(tbl(spark, d, "conversations"), ["conv_id", "turn"], ["role", "text"]).withColumn("n", F.length("text").cast("long"))
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum("n").alias("chars"), F.min_by("n", "turn").alias("first_len"), F.max_by("n", "turn").alias("last_len"),
        F.floor(F.avg("n")).alias("mean_len"), F.max("n").alias("most_len"), S.upper_median(F.collect_list("n")).alias("p50_len"),
    )


@query("e6_running_predecessor", SQL("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user_turn FROM conversations"))
def predecessor(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return tbl(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("prev_user_turn"))


@query("d16_tool_counts", SQL("SELECT event_type AS tool, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS bucket, count(*) AS calls, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY ALL"))
def tool_counts(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return tbl(spark, d, "events").groupBy(F.col("event_type").alias("tool"), F.floor(k / 10).alias("bucket")).agg(F.count("*").alias("calls"), F.sum(F.length("props").cast("long")).alias("chars"))


RATES = Fixture("rates", "cls string, rate double", [("view", 3.0), ("click", 15.0), ("other", 0.8)])


@query("d17_cost", SQL(f"WITH {RATES.cte}, e AS (SELECT user_id, CASE WHEN contains(event_type, 'view') THEN 'view' WHEN contains(event_type, 'click') THEN 'click' ELSE 'other' END AS cls, value FROM events) SELECT user_id, round(sum(value / 1e6 * rate), 4) AS cost FROM e JOIN rates USING (cls) GROUP BY user_id"))
def cost(spark, d):
    cls = S.ordered_case(F.col("event_type"), [("view", "view"), ("click", "click")], "other")
    return tbl(spark, d, "events").select("user_id", "value", cls.alias("cls")).join(F.broadcast(RATES.frame(spark)), "cls").groupBy("user_id").agg(F.round(F.sum(F.col("value") / 1e6 * F.col("rate")), 4).alias("cost"))


@query("b21_model_class", SQL("SELECT event_id, CASE WHEN contains(event_type, 'view') THEN 'a' WHEN contains(event_type, 'c') THEN 'b' ELSE 'fallback' END AS cls FROM events"))
def model_class(spark, d):
    return tbl(spark, d, "events").select("event_id", S.ordered_case(F.col("event_type"), [("view", "a"), ("c", "b")], "fallback").alias("cls"))


@query("c22_owner_join_default_unknown", SQL("""SELECT r.conv_id, r.turn, coalesce(q.role, 'unknown') AS owner FROM conversations r LEFT JOIN (SELECT conv_id, turn, role FROM conversations WHERE role = 'user') q ON q.conv_id = r.conv_id AND q.turn = r.turn - 1 WHERE r.role = 'assistant'"""))
def owner(spark, d):
    c = tbl(spark, d, "conversations")
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("owner"))
    return c.where("role = 'assistant'").select("conv_id", "turn").join(q, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("owner", F.lit("unknown")).alias("owner"))


@query("p9_dedupe_by_message_id", SQL("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT ON (user_id, CAST(floor(value) AS BIGINT)) * FROM events)"))
def dedupe_ids(spark, d):
    return tbl(spark, d, "events").withColumn("mid", F.floor("value")).dropDuplicates(["user_id", "mid"]).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("p6_monthly_rotation", SQL("SELECT strftime(ts, '%Y-%m') AS month, event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type, user_id FROM events) WHERE ts < TIMESTAMP '2024-01-25' GROUP BY ALL"))
def rotation(spark, d):
    e = tbl(spark, d, "events").where("ts < timestamp'2024-01-25'").dropDuplicates(["event_id"])
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type", "user_id").agg(F.count("*").alias("n"))


@query("e10_consecutive_runs", SQL("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY user_id, event_type, g HAVING count(*) >= 3"""))
def runs(spark, d):
    return S.runs(tbl(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").where("length >= 3")


@query("e15_first_last_seen", SQL("SELECT user_id, event_type, CAST(min(ts) AS DATE) AS first_seen, CAST(max(ts) AS DATE) AS last_seen, count(*) AS mentions FROM events GROUP BY ALL"))
def seen(spark, d):
    return tbl(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("first_seen"), F.max(F.to_date("ts")).alias("last_seen"), F.count("*").alias("mentions"))


@query("e13_history_append", SQL("SELECT user_id, event_id, event_type AS verdict, lag(event_type) OVER w AS previous, row_number() OVER w AS version FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"))
def history(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return tbl(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("verdict"), F.lag("event_type").over(w).alias("previous"), F.row_number().over(w).cast("long").alias("version"))


@query("e14_carry_forward_heading", SQL("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN left(text, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'none') AS heading FROM conversations"))
def carry(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    h = F.last(F.when(F.col("role") == "system", F.substring("text", 1, 20)), ignorenulls=True).over(w)
    return tbl(spark, d, "conversations").select("conv_id", "turn", F.coalesce(h, F.lit("none")).alias("heading"))


@query("q40_running_total_scaled", SQL("SELECT user_id, event_id, round(sum(value) OVER w / sum(value) OVER (PARTITION BY user_id) * 1000, 4) AS scaled FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"))
def scaled(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return tbl(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w) / F.sum("value").over(W.partitionBy("user_id")) * 1000, 4).alias("scaled"))


@query("q41_attach_to_next", SQL("SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events"))
def attach(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, W.unboundedFollowing)
    return tbl(spark, d, "events").select("user_id", "event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("next_purchase"))


@query("l3_usage_clamps", SQL("SELECT event_id, greatest(0, CAST(round(value) AS BIGINT) - 50) AS fresh, least(50, CAST(round(value) AS BIGINT)) AS cached FROM events"))
def clamps(spark, d):
    v = F.round("value").cast("long")
    return tbl(spark, d, "events").select("event_id", F.greatest(F.lit(0), v - 50).alias("fresh"), F.least(F.lit(50), v).alias("cached"))
