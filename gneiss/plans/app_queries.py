"""Registered queries over conversations and traces (the events table is read as the trace log; type 'error' is a failed trace)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: Microseconds since 1970 of a time without zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation with its title (the first user turn, 60 characters), number of turns and last turn."""
    c = table(spark, d, "conversations")
    user = F.when(F.col("role") == "user", F.struct("turn", F.substring("text", 1, 60).alias("title")))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.min(user)["title"].alias("title"))


def message_history(spark: SparkSession, d: str) -> DataFrame:
    """Messages in order, each with the one before it."""
    c = table(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return c.select("conv_id", F.row_number().over(order).alias("place"), "role", F.length("text").alias("n_chars"), F.lag("role").over(order).alias("after"))


def recent_traces(spark: SparkSession, d: str) -> DataFrame:
    """The latest 50 failed traces: a top-k report."""
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", F.expr(MICROS).alias("ts_us"))


def trace_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 4).alias("mean_value"))


def admin_stats(spark: SparkSession, d: str) -> DataFrame:
    """One dashboard row; each table is read once."""
    c = table(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("messages"), F.count(F.when(F.col("role") == "user", 1)).alias("questions"))
    e = table(spark, d, "events").agg(F.count("*").alias("traces"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.countDistinct("user_id").alias("users"))
    k = table(spark, d, "customer").agg(F.count("*").alias("accounts"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("active"))
    return c.join(e, how="cross").join(k, how="cross")  # one row each


def session_join(spark: SparkSession, d: str) -> DataFrame:
    """The customer of each session: its last event, unless that is an error."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count("*").alias("n_events")).where("x.event_type != 'error'")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return last.join(c, "user_id").select("user_id", "c_name", "c_mktsegment", "n_events", F.col("x.event_type").alias("last_type"))


def trace_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's runs of events with less than 30 minutes between them."""
    e = table(spark, d, "events").select("user_id", "event_id", F.expr(MICROS).alias("us"))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.coalesce((F.col("us") - F.lag("us").over(order) > 30 * 60 * 1_000_000).cast("int"), F.lit(1))
    s = e.withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span_us"))


def bounded_trace_payload(spark: SparkSession, d: str) -> DataFrame:
    """Traces as they are kept: property text cut at 1,200 characters, the error text null unless it failed."""
    e = table(spark, d, "events")
    return e.select("event_id", F.substring("props", 1, 1200).alias("preview"), F.when(F.col("event_type") == "error", F.substring("props", 1, 500)).alias("error"), F.get_json_object("props", "$.k").alias("k"))


def role_balance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.count(F.lit(1)))
    return c.na.fill(0)


QUERIES = {"conversation_list": conversation_list, "message_history": message_history, "recent_traces": recent_traces, "trace_counters": trace_counters, "admin_stats": admin_stats, "session_join": session_join, "trace_sessions": trace_sessions, "trace_payload": bounded_trace_payload, "role_balance": role_balance}
ORACLES = {
    "conversation_list": "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, arg_min(substring(text, 1, 60), (turn, substring(text, 1, 60))) FILTER (WHERE role = 'user') AS title FROM conversations GROUP BY conv_id",
    "message_history": "SELECT conv_id, row_number() OVER w AS place, role, length(text) AS n_chars, lag(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "recent_traces": "SELECT event_id, user_id, epoch_us(ts) AS ts_us FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50",
    "trace_counters": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 4) AS mean_value FROM events GROUP BY 1",
    "admin_stats": "SELECT * FROM (SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS questions FROM conversations), (SELECT count(*) AS traces, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events), (SELECT count(*) AS accounts, count(*) FILTER (WHERE c_acctbal > 0) AS active FROM customer)",
    "session_join": "SELECT user_id, c_name, c_mktsegment, n_events, last_type FROM (SELECT user_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1) JOIN customer ON c_custkey = user_id WHERE last_type <> 'error'",
    "trace_sessions": "SELECT user_id, session, count(*) AS n, max(us) - min(us) AS span_us FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL",
    "trace_payload": "SELECT event_id, substring(props, 1, 1200) AS preview, CASE WHEN event_type = 'error' THEN substring(props, 1, 500) END AS error, json_extract_string(props, '$.k') AS k FROM events",
    "role_balance": "SELECT conv_id, count(*) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY 1",
}
