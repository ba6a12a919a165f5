"""Queries on streams, whose results equal the batch SQL over the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacell.plans.registry import query
from stratacell.session import table
from stratacell.sources.documents import pages_to_text
from stratacell.streaming import events as S


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.drained(S.tumbling(spark, sf_dir), "update", ("w", "event_type"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM s GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.drained(S.tumbling(spark, sf_dir, "1 hour", slide="30 minutes"), "update", ("w", "event_type"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t_us, event_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t_before FROM events),
i AS (SELECT *, sum(CASE WHEN t_before IS NULL OR t_us - t_before >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS island FROM g) SELECT user_id, min(t_us) AS start, count(*) AS n FROM i GROUP BY user_id, island""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.drained(S.sessions(spark, sf_dir), "complete")
    return got.select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.first_of_each(spark, sf_dir, ["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_to_text(table(spark, sf_dir, "pages"))
