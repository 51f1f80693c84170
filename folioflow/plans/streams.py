"""Queries that run a stream to its end; their SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.sources.workspace import table
from folioflow.streaming import keyed as K
from folioflow.streaming import stateful as S


def stream(spark: SparkSession, sf: str) -> DataFrame:
    return S.opened(spark, sf, "events.parquet")


@query("WITH r AS (SELECT event_id % 8 AS lane, event_id // 8 AS place, round(value, 6) AS value FROM events) SELECT * FROM r")
def stream_ordered_release(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of eight lanes leave in the order of their place, whatever order they come in."""
    rows = stream(spark, sf).select((F.col("event_id") % 8).alias("lane"), F.floor(F.col("event_id") / 8).alias("place"), "value")
    return S.finished(K.released(rows, "lane", "place", "value").select("lane", "place", "value"), "released").withColumn("value", F.round("value", 6))


@query("SELECT user_id, x AS cohort, 10::BIGINT AS n FROM (SELECT user_id, unnest(range(0, count(*) // 10)) AS x FROM events GROUP BY user_id)")
def stream_count_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return S.finished(S.counted_cohorts(stream(spark, sf), "user_id", "value", 10), "cohorts").select("user_id", "cohort", "n")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of a stream in complete mode, each batch written once."""
    rows = stream(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return S.finished(rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), "hours", "complete")


@query("SELECT h + INTERVAL (k * 30) MINUTE AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS h, unnest([0, -1]) AS k FROM events) GROUP BY ALL")
def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Hour-long windows every half hour."""
    rows = stream(spark, sf).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return S.finished(rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "slides", "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of each user and kind, within a watermark longer than the stream."""
    return S.finished(S.once(stream(spark, sf), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), "once")


@query("SELECT a.event_id, b.event_id AS other_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE")
def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks that follow a view of the same user within ten minutes: two streams joined."""
    view = stream(spark, sf).where("event_type = 'view'").select("event_id", "user_id", "ts")
    click = stream(spark, sf).where("event_type = 'click'").select("event_id", "user_id", "ts")
    return S.finished(S.joined(view, click, "user_id", "ts", "10 minutes", "1 day").select("event_id", "other_event_id"), "joined")


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.finished(S.enriched(stream(spark, sf).select("event_id", "user_id"), names, "user_id").select("event_id", "c_mktsegment"), "enriched")


@query("""WITH l AS (SELECT event_id % 8 AS lane, max(event_id // 8) AS last, CASE WHEN event_id % 8 < 2 THEN 255 ELSE 555 - 30 * (event_id % 8) END AS stop FROM events GROUP BY event_id % 8)
SELECT lane, stop, 'exact' AS rule, 1::BIGINT AS period FROM l WHERE last >= stop""")
def stream_loop_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Where eight lanes of events, whose tokens stay for 300 places at a time, first repeat long enough to be a loop, as the events come."""
    lane, place = F.col("event_id") % 8, F.floor(F.col("event_id") / 8)
    rows = stream(spark, sf).select(lane.alias("lane"), place.alias("place"), F.floor((place + 30 * lane) / 300).alias("token"))
    return S.finished(K.loop_stops(rows, "lane", "place", "token"), "loops")
