"""The logs as streams: ingest without repeats, daily rollups, a rate limiter with state, job status.

``drained`` runs a stream over what is there now and returns its result as a table in the shared folder, so that a
stream and its batch form can be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlore.plans.oplog import MOST_CALLS, PERIOD_S, PRICES, RATE_SQL, UNKNOWN_PRICE, costs
from fieldlore.session import scratch, ship


def read_events(spark: SparkSession, folder: str, name: str = "events", per_trigger: int | None = None) -> DataFrame:
    """The table as a stream of files."""
    ship(spark)
    path = f"{folder}/{name}.parquet"
    static = spark.read.parquet(path)
    reader = spark.readStream.schema(static.schema)
    if static.inputFiles()[:1] and static.inputFiles()[0].endswith(f"/{name}.parquet"):
        # a stream reads folders: the table is a single file of its folder
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), folder
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run to the end of the input. Each batch writes a folder of its own number, so that a batch that is done again
    replaces its rows; complete results are those of the last batch, appended ones all of them, of updated ones the last
    of each group (``finish`` picks them by the column batch)."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()
    query.awaitTermination()
    # what the stream needs to go on is not needed any more; its rows are the result
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/progress")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    rows = spark.read.parquet(f"{out}/rows")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return finish(rows) if mode == "update" else finish(rows.drop("batch"))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of an updated stream's rows the newest of each group."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def once_each(events: DataFrame, key: str = "event_id", delay: str = "60 days") -> DataFrame:
    """ST1: events without those whose key was seen before within the delay."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark([key]).drop("at")


def daily(events: DataFrame) -> DataFrame:
    """ST3: calls and cost by day and caller, kept up to date."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("event_id").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


def windows(events: DataFrame, size: str = "7 days", slide: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Sliding windows of event time; a window's state goes when no event within the lateness can reach it."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).groupBy(F.window("at", size, slide).alias("w"), "event_type").agg(F.count("event_id").alias("calls")).select(F.col("w.start").alias("start"), "event_type", "calls")


def _admit(most: int, period_us: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for t in rows["at"]:
            kept = [k for k in kept if k > t - period_us]
            ok = len(kept) < most
            if ok:
                kept.append(float(t))
            allowed.append(ok)
        state.update((kept,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    return step


def rate_limited(events: DataFrame, most: int = MOST_CALLS, period_s: int = PERIOD_S) -> DataFrame:
    """ST5: the sliding-window limiter; a key's state is at most ``most`` times."""
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(_admit(most, period_s * 1e6), "event_id bigint, user_id bigint, allowed boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


#: States in which an item is done.
DONE = ("purchase", "error")


def item_status(events: DataFrame) -> DataFrame:
    """ST7: the latest state of every item (user_id)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


def jobs(items: DataFrame, size: int = 10, done: tuple[str, ...] = DONE) -> DataFrame:
    """ST7: of each job (``size`` items in order of their number) the items, those completed and failed, and its status:
    sealed as completed once every item is done."""
    completed, failed = F.count_if(F.col("state") == done[0]), F.count_if(F.col("state") == done[1])
    by = items.groupBy(F.floor(F.col("user_id") / size).alias("job_id")).agg(F.count("user_id").alias("items"), completed.alias("completed"), failed.alias("failed"))
    return by.withColumn("status", F.when(F.col("items") == F.col("completed") + F.col("failed"), "completed").otherwise("running"))


def spending(events: DataFrame) -> DataFrame:
    """ST4: what each caller has spent by day, kept up to date."""
    return costs(events).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("cost").alias("spent"))


def alerts(spent: DataFrame, limits: dict[tuple[str, str], tuple[float, float]]) -> DataFrame:
    """ST4: budgets (caller, daily or monthly) whose cost of a period reaches the threshold's part of the limit; limits
    gives (limit, threshold). spent(event_type, day, spent)."""
    spark = spent.sparkSession
    table = spark.createDataFrame([(c, p, float(m), float(t)) for (c, p), (m, t) in sorted(limits.items())], "event_type string, period string, most double, threshold double")
    dated = spent.select("event_type", "spent", F.explode(F.array(F.struct(F.lit("daily").alias("period"), F.date_format("day", "yyyy-MM-dd").alias("at")), F.struct(F.lit("monthly").alias("period"), F.date_format("day", "yyyy-MM").alias("at")))).alias("p"))
    by = dated.groupBy("event_type", "p.period", "p.at").agg(F.sum("spent").alias("spent"))
    return by.join(F.broadcast(table), ["event_type", "period"]).where(F.col("spent") >= F.col("most") * F.col("threshold")).select("event_type", "period", "at", F.round("spent", 6).alias("spent"), "most")


def budget_alerts(stream: DataFrame, limits: dict[tuple[str, str], tuple[float, float]]) -> DataFrame:
    """ST4 over a stream: the alerts that its spending has given."""
    return drained(spending(stream), "complete", lambda rows: alerts(rows, limits))


def _prior():
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = int(state.get[0]) if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        before = range(seen, seen + len(rows))
        state.update((seen + len(rows),))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "before": list(before)})

    return step


def rolling_prior(events: DataFrame) -> DataFrame:
    """ST6: with each record how often its entity (user_id) was met before it, in the order of the stream; the state of
    an entity is one number. D7 is the same over a table."""
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(_prior(), "event_id bigint, user_id bigint, before bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)


def rescanned(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """ST8: claims (a stream or a table) against a table of rules(label, pattern, confidence): one row per hit. When the
    rules change, the same plan over the table of all claims scans them anew."""
    hit = F.expr("source_sentence RLIKE pattern")
    return claims.select("claim_id", "source_sentence").join(F.broadcast(rules.select("label", "pattern", "confidence")), hit).select("claim_id", "label", "confidence")


#: Rules of the re-scan's query: words of money, fire and water.
RULES = (("money", r"\$\s*[0-9]", 0.9), ("fire", r"(?i)\b(fire|burned)\b", 0.8), ("water", r"(?i)\b(dike|ditch|dam)\b", 0.7))
LIMITS = {("click", "daily"): (2.0, 0.8), ("view", "monthly"): (4.0, 0.5), ("purchase", "monthly"): (60.0, 0.9)}


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "label string, pattern string, confidence double")


QUERIES = {
    "st1_once_each": lambda s, d: drained(once_each(read_events(s, d)), "append").groupBy("event_type").agg(F.count("event_id").alias("events")),
    "st3_daily": lambda s, d: drained(daily(read_events(s, d)), "complete"),
    "st4_alerts": lambda s, d: budget_alerts(read_events(s, d), LIMITS),
    "st5_rate_limit": lambda s, d: drained(rate_limited(read_events(s, d)), "append"),
    "st6_windows": lambda s, d: drained(windows(read_events(s, d)), "update", lambda r: latest(r, "start", "event_type")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "calls"),
    "st6_prior": lambda s, d: drained(rolling_prior(read_events(s, d)), "append"),
    "st7_job_status": lambda s, d: drained(item_status(read_events(s, d)), "complete").groupBy("state").agg(F.count("user_id").alias("items")),
    "st7_jobs": lambda s, d: jobs(drained(item_status(read_events(s, d)), "complete")),
    "st8_rescan": lambda s, d: drained(rescanned(read_events(s, d, "claims").dropDuplicates(["claim_id"]), _rules(s)), "append"),
}
ORACLES = {
    "st1_once_each": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1",
    "st3_daily": "SELECT ts::date AS day, event_type, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2",
    "st4_alerts": "SELECT event_type, period, \"at\", round(spent, 6) AS spent, most FROM (SELECT event_type, 'daily' AS period, strftime(ts, '%Y-%m-%d') AS \"at\", sum(cost) AS spent FROM c GROUP BY ALL UNION ALL SELECT event_type, 'monthly', strftime(ts, '%Y-%m'), sum(cost) FROM c GROUP BY ALL) JOIN (VALUES " + ", ".join(f"('{c}', '{p}', {m}::double, {t}::double)" for (c, p), (m, t) in LIMITS.items()) + ") AS l(event_type, period, most, threshold) USING (event_type, period) WHERE spent >= most * threshold",
    "st5_rate_limit": RATE_SQL,
    "st6_windows": "SELECT strftime(ts::date - i::int, '%Y-%m-%d') AS start, event_type, count(*) AS calls FROM events, range(7) r(i) WHERE true GROUP BY 1, 2",
    "st6_prior": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS before FROM events",
    "st7_job_status": "SELECT state, count(*) AS items FROM (SELECT arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id) GROUP BY 1",
    "st7_jobs": "SELECT job_id, count(*) AS items, count(*) FILTER (state = 'purchase') AS completed, count(*) FILTER (state = 'error') AS failed, CASE WHEN count(*) = count(*) FILTER (state IN ('purchase', 'error')) THEN 'completed' ELSE 'running' END AS status FROM (SELECT floor(user_id / 10)::bigint AS job_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id, 1) GROUP BY 1",
    "st8_rescan": "SELECT claim_id, label, confidence FROM (SELECT DISTINCT claim_id, source_sentence FROM claims) JOIN (VALUES ('money', '\\$\\s*[0-9]', 0.9::double), ('fire', '(?i)\\b(fire|burned)\\b', 0.8::double), ('water', '(?i)\\b(dike|ditch|dam)\\b', 0.7::double)) AS r(label, pattern, confidence) ON regexp_matches(source_sentence, pattern)",
}
# the log's costs as a table, for the alerts
ORACLES["st4_alerts"] = "WITH c AS (SELECT event_type, ts, round(try_cast(json_extract_string(props, '$.k') AS bigint) * 1000 / 1000000.0 * CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRICES.items()) + f" ELSE {UNKNOWN_PRICE} END, 6) AS cost FROM events) " + ORACLES["st4_alerts"]
