"""Operational logs: usage, cost, budgets, rate limits, turns, sessions, history.

The driver's events are the log: event_type is the caller, user_id the key, value the cost, props the details.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlore.session import table

#: Price of a million tokens by caller (fixed values of this module).
PRICES = {"click": 3.0, "view": 0.25, "purchase": 15.0, "signup": 5.0, "error": 1.0}
UNKNOWN_PRICE = 1.0
MOST_CALLS, PERIOD_S = 2, 86_400


def daily_rollup(events: DataFrame) -> DataFrame:
    """Calls and cost by day and caller."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("event_id").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


def costs(events: DataFrame, prices: dict[str, float] = PRICES) -> DataFrame:
    """Q13: cost of each event's tokens (props.k thousands) by its caller's price."""
    price = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), F.col("event_type")), F.lit(UNKNOWN_PRICE))
    tokens = F.get_json_object("props", "$.k").try_cast("bigint") * 1000
    return events.select("event_id", "event_type", "ts", "user_id", tokens.alias("tokens"), F.round(tokens / 1_000_000 * price, 6).alias("cost"))


def month_summary(events: DataFrame) -> DataFrame:
    """Q12: tokens and cost by caller and month."""
    return costs(events).groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def budgets(events: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Q12 and ST4: cost of each caller against its budget: ok, near (from 80 %) or over; no budget is none."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("event_type"))
    spent = costs(events).groupBy("event_type").agg(F.round(F.sum("cost"), 4).alias("spent"))
    return spent.withColumn("budget", limit).withColumn("status", F.when(F.col("budget").isNull(), "none").when(F.col("spent") >= F.col("budget"), "over").when(F.col("spent") >= 0.8 * F.col("budget"), "near").otherwise("ok"))


def recent_calls(events: DataFrame, period_s: int = 3600) -> DataFrame:
    """W11 without a limit: calls of the same key within the period up to each call."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    over = Window.partitionBy("user_id").orderBy(at).rangeBetween(-period_s * 1_000_000, 0)
    return events.select("event_id", "user_id", F.count("event_id").over(over).alias("calls"))


def _limit(most: int, period: float):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, kept = None, deque()
        for b in batches:
            allowed = []
            for u, t in zip(b["user_id"], b["at"]):
                if u != user:
                    user, kept = u, deque()
                while kept and kept[0] <= t - period:
                    kept.popleft()
                ok = len(kept) < most
                if ok:
                    kept.append(t)
                allowed.append(ok)
            yield pd.DataFrame({"event_id": b["event_id"], "user_id": b["user_id"], "allowed": allowed})

    return kernel


def rate_limited(events: DataFrame, most: int = MOST_CALLS, period_s: int = PERIOD_S) -> DataFrame:
    """Which calls a sliding window of the allowed ones admits. The keys' calls stream past in order with a state
    of at most ``most`` times, so that a key of any size needs no more."""
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at")).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return rows.mapInPandas(_limit(most, period_s * 1e6), "event_id bigint, user_id bigint, allowed boolean")


def turns(events: DataFrame) -> DataFrame:
    """Number of each call within its key and day."""
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return events.select("event_id", "user_id", F.row_number().over(order).alias("turn"))


def latest_by_key(events: DataFrame) -> DataFrame:
    """The newest event of each key is current."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_id", "e.event_type", "e.value")


def signal_gaps(events: DataFrame, least: float = 50.0, limit: int = 20) -> DataFrame:
    """Q10: callers and weekdays whose mean value is low."""
    return events.groupBy("event_type", F.weekday("ts").alias("weekday")).agg(F.count("event_id").alias("calls"), F.round(F.avg("value"), 6).alias("mean_value")).where(F.col("mean_value") < least).orderBy("mean_value", "event_type", "weekday").limit(limit)


def history(events: DataFrame, text: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Events whose details hold a text in any case, newest first, a page of them."""
    return events.where(F.col("props").ilike(f"%{text}%")).orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit).select("event_id", "ts", "user_id", "event_type", "props")


def redacted_log(claims: DataFrame, docs: DataFrame, runs: DataFrame, open_levels: tuple[str, ...] = ("public",)) -> DataFrame:
    """Q9: the log line of each claim, with its id hashed where its document is not open."""
    at = runs.select("run_id", "doc_id").join(docs.select("doc_id", "access_level"), "doc_id")
    return claims.join(at, "run_id").select(F.when(F.col("access_level").isin(list(open_levels)), F.col("claim_id")).otherwise(F.substring(F.sha2("claim_id", 256), 1, 16)).alias("logged_id"), "access_level")


def approximate_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """ST9 as an extension: sessions of a key by gaps."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("event_id").alias("calls")).groupBy("user_id").agg(F.count("calls").alias("sessions"), F.max("calls").alias("longest"))


BUDGETS = {"click": 300.0, "view": 5.0, "purchase": 1500.0, "signup": 60.0}
_BOUND = {
    "g6_daily_rollup": lambda s, d: daily_rollup(table(s, d, "events")), "q13_costs": lambda s, d: costs(table(s, d, "events")).drop("ts"), "q12_months": lambda s, d: month_summary(table(s, d, "events")), "q12_budgets": lambda s, d: budgets(table(s, d, "events"), BUDGETS),
    "w11_recent_calls": lambda s, d: recent_calls(table(s, d, "events")), "w11_rate_limit": lambda s, d: rate_limited(table(s, d, "events")), "w12_turns": lambda s, d: turns(table(s, d, "events")), "w10_current": lambda s, d: latest_by_key(table(s, d, "events")), "q10_signal_gaps": lambda s, d: signal_gaps(table(s, d, "events")),
    "q11_history": lambda s, d: history(table(s, d, "events"), '"K": 4'), "st9_sessions": lambda s, d: approximate_sessions(table(s, d, "events")),
}


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    from fieldlore.plans.graph import Graph

    g = Graph(spark, d)
    return redacted_log(g.claims, g.docs, g.runs)


QUERIES = _BOUND | {"q9_redacted_log": _redacted}
_PRICE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in PRICES.items()) + f" ELSE {UNKNOWN_PRICE}::double END"
_COST = f"SELECT event_id, event_type, ts, user_id, try_cast(json_extract_string(props, '$.k') AS bigint) * 1000 AS tokens, round(try_cast(json_extract_string(props, '$.k') AS bigint) * 1000 / 1000000 * {_PRICE}, 6) AS cost FROM events"
#: The limiter as recursion over each key's calls: calls beyond it leave the kept ones as they are.
_KEPT = f"list_filter(w.kept, lambda k: k > e.t - {PERIOD_S * 1_000_000})"
RATE_SQL = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "w AS (SELECT event_id, user_id, t, n, true AS allowed, [t] AS kept FROM e WHERE n = 1 UNION ALL "
    f"SELECT e.event_id, e.user_id, e.t, e.n, len({_KEPT}) < {MOST_CALLS}, CASE WHEN len({_KEPT}) < {MOST_CALLS} THEN list_append({_KEPT}, e.t) ELSE {_KEPT} END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) "
    "SELECT event_id, user_id, allowed FROM w"
)
ORACLES = {
    "w11_rate_limit": RATE_SQL,
    "g6_daily_rollup": "SELECT ts::date AS day, event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2",
    "q13_costs": f"SELECT * EXCLUDE (ts) FROM ({_COST})",
    "q12_months": f"SELECT strftime(ts, '%Y-%m') AS month, event_type, sum(tokens)::bigint AS tokens, round(sum(cost), 4) AS cost FROM ({_COST}) GROUP BY 1, 2",
    "q12_budgets": f"SELECT *, CASE WHEN budget IS NULL THEN 'none' WHEN spent >= budget THEN 'over' WHEN spent >= 0.8 * budget THEN 'near' ELSE 'ok' END AS status FROM (SELECT event_type, round(sum(cost), 4) AS spent, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in BUDGETS.items()) + f" END AS budget FROM ({_COST}) GROUP BY 1)",
    "w11_recent_calls": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS calls FROM events",
    "w12_turns": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::date ORDER BY ts, event_id)::int AS turn FROM events",
    "w10_current": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "q10_signal_gaps": "SELECT event_type, (isodow(ts) - 1)::int AS weekday, count(*) AS calls, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2 HAVING round(avg(value), 6) < 50 ORDER BY mean_value, event_type, weekday LIMIT 20",
    "q11_history": "SELECT event_id, ts, user_id, event_type, props FROM events WHERE props ILIKE '%\"K\": 4%' ORDER BY ts DESC, event_id LIMIT 50",
    "st9_sessions": "SELECT user_id, count(*) AS sessions, max(calls) AS longest FROM (SELECT user_id, s, count(*) AS calls FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1",
    "q9_redacted_log": "SELECT CASE WHEN access_level = 'public' THEN claim_id ELSE substr(sha256(claim_id), 1, 16) END AS logged_id, access_level FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM claims) JOIN (SELECT DISTINCT run_id, doc_id FROM extraction_runs) USING (run_id) JOIN (SELECT DISTINCT doc_id, access_level FROM document_records) USING (doc_id)",
}
