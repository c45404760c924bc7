"""Ingest on streams, and what built-in windows, sessions and joins say of them; rules with state of their own are in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.logs import auth_events


def auth_stream(spark: SparkSession, path: str, *, year: int) -> DataFrame:
    """Events of auth logs as files arrive in a folder."""
    lines = spark.readStream.format("text").load(path)
    return auth_events(lines.select(F.col("value").alias("line"), F.lit(path).alias("source")), year=year)


def as_corr_events(events: DataFrame) -> DataFrame:
    """Parsed log events as rows of correlation."""
    kind = F.when(F.col("action") == "ssh_login_failed", "auth_fail").when(F.col("action") == "ssh_login_success", "auth_success").when(F.col("action") == "sudo_command", "sudo")
    user = F.when(F.col("action") == "sudo_command", F.col("actor")).otherwise(F.col("target"))
    return events.select("ts", kind.alias("event_type"), F.coalesce(F.col("metadata")["src_ip"], F.lit("unknown")).alias("source_ip"), user.alias("username"), F.col("host").alias("hostname"))


def failure_windows(events: DataFrame, *, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes", fails: int = 5) -> DataFrame:
    """Failures and distinct users of an address by sliding window."""
    rows = events.where("event_type = 'auth_fail'").withWatermark("ts", late).groupBy(F.window("ts", window, slide), "source_ip")
    counted = rows.agg(F.count("*").alias("fails"), F.approx_count_distinct("username").alias("users"))
    return counted.where(F.col("fails") >= fails).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "source_ip", "fails", "users")


def activity_sessions(events: DataFrame, *, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches of activity of a host; what lies between two is a silence longer than the gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "hostname").agg(F.count("*").alias("events"))
    return rows.select("hostname", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def login_then_sudo(events: DataFrame, *, window_s: int = 600, late: str = "10 minutes") -> DataFrame:
    """Logins joined with sudo commands of the same user within the window, both sides with watermarks."""
    a = events.where("event_type = 'auth_success'").select(F.col("ts").alias("login_ts"), F.col("username").alias("user_a"), "source_ip").withWatermark("login_ts", late)
    b = events.where("event_type = 'sudo'").select(F.col("ts").alias("sudo_ts"), F.col("username").alias("user_b")).withWatermark("sudo_ts", late)
    return a.join(b, F.expr(f"user_a = user_b AND sudo_ts >= login_ts AND sudo_ts <= login_ts + INTERVAL {window_s} SECONDS")).select(F.col("user_a").alias("username"), "source_ip", "login_ts", "sudo_ts")
