"""Log text to events: seq, ts, source, host, category, severity, actor, target, action, raw, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shapes of lines, which the log formats set.
STAMP = r"^([A-Z][a-z]{2}\s+\d+\s+\d\d:\d\d:\d\d)\s+(\S+)\s+"
SSH_FAILED = STAMP + r"sshd\[\d+\]:\s+Failed password for (?:invalid user )?(\S+) from (\S+)(?: port (\d+))?"
SSH_ACCEPTED = STAMP + r"sshd\[\d+\]:\s+Accepted \S+ for (\S+) from (\S+)(?: port (\d+))?"
SUDO = STAMP + r"sudo:\s+(\S+)\s*:\s*.*COMMAND=(.+)$"

COMPACT = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{4}))\s+(.+)$"
ADDRESS = r"((?:\d{1,3}\.){3}\d{1,3})"
MAC_FAILED = [rf"(?i)Authentication failed for user (\S+)(?: from {ADDRESS})?", rf"(?i)Failed password for (?:invalid user )?(\S+) from {ADDRESS}"]
MAC_ACCEPTED = [rf"(?i)Authenticated user (\S+)(?: from {ADDRESS})?", rf"(?i)Accepted (?:password|publickey) for (\S+) from {ADDRESS}"]
MAC_SUDO = r"(?i)sudo\[\d+\]:\s+(\S+)\s+:\s+.*USER=(\S+)\s+;\s+COMMAND=(.+)"
PLIST = r"(/(?:System/)?Library/(?:LaunchAgents|LaunchDaemons)/\S+\.plist)"
MAC_LOADED = rf"(?i)(?:service loaded|bootstrap succeeded|loaded)\s*:?\s*{PLIST}"
MAC_UNLOADED = rf"(?i)(?:bootout|service unloaded|unloaded)\s*:?\s*{PLIST}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and source (file name) of text files; bytes that are no UTF-8 become replacement marks."""
    rows = spark.read.format("text").load(path)
    return rows.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source"))


def part(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def syslog_time(stamp: Column, year: int) -> Column:
    """A time without year, in the year given."""
    return F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), F.regexp_replace(stamp, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))


def _metadata(**values: Column) -> Column:
    """The values that are there, by name."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def auth_events(lines: DataFrame, *, year: int) -> DataFrame:
    """Failed and accepted SSH logins and sudo commands; other lines are dropped."""
    line = F.col("line")

    def shaped(pattern: str, category: str, severity: str, action: str, *, sudo: bool = False) -> Column:
        """What the line says if it has that shape; a text that is missing is empty."""
        group = lambda n: F.regexp_extract(line, pattern, n)
        none = F.lit("")
        values = {"category": F.lit(category), "severity": F.lit(severity), "action": F.lit(action), "actor": group(3 if sudo else 4), "target": F.lit("root") if sudo else group(3), "port": none if sudo else group(5), "command": group(4) if sudo else none}
        return F.when(line.rlike(pattern), F.struct(*(v.alias(k) for k, v in values.items())))

    found = F.coalesce(shaped(SSH_FAILED, "authentication", "medium", "ssh_login_failed"), shaped(SSH_ACCEPTED, "authentication", "low", "ssh_login_success"), shaped(SUDO, "privilege_escalation", "medium", "sudo_command", sudo=True))
    rows = lines.withColumn("f", found).where("f is not null")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    ip = F.when(F.col("f.category") == "authentication", F.col("f.actor"))
    return rows.select(
        syslog_time(F.regexp_extract(line, STAMP, 1), year).alias("ts"), "source", F.regexp_extract(line, STAMP, 2).alias("host"), "f.category", "f.severity", text("f.actor").alias("actor"), text("f.target").alias("target"), "f.action", line.alias("raw"),
        _metadata(src_ip=ip, src_port=text("f.port"), command=text("f.command")).alias("metadata"),
    )


def of_user(events: DataFrame, user: str) -> DataFrame:
    return events.where((F.col("target") == user) | ((F.col("action") == "sudo_command") & (F.col("actor") == user)))


def compact_time(stamp: Column) -> Column:
    """Date and time with Z or +hhmm, fraction or not, as UTC; null if it is none."""
    iso = F.regexp_replace(F.regexp_replace(stamp, r"([+-]\d{2})(\d{2})$", "$1:$2"), " ", "T")
    return iso.try_cast("timestamp")


def mac_events(lines: DataFrame) -> DataFrame:
    """Unified-log text: the first kind that fits of failed and successful logins, sudo, launchd load and unload."""
    line, message = F.rtrim("line"), F.regexp_extract(F.rtrim("line"), COMPACT, 2)
    rows = lines.withColumn("ts", compact_time(F.regexp_extract(line, COMPACT, 1))).where("ts is not null")
    shapes = [("authentication", "medium", "macos_authentication_failure", p) for p in MAC_FAILED]
    shapes += [("authentication", "info", "macos_authentication_success", p) for p in MAC_ACCEPTED]
    shapes += [("privilege_escalation", "high", "macos_sudo_execution", MAC_SUDO), ("system", "high", "macos_launchd_persistence_loaded", MAC_LOADED), ("system", "high", "macos_launchd_persistence_unloaded", MAC_UNLOADED)]
    shape = F.coalesce(*(F.when(message.rlike(p), k) for k, (*_, p) in enumerate(shapes)))
    rows = rows.select("ts", "source", line.alias("raw"), message.alias("message"), shape.alias("shape")).where("shape is not null")

    def of(value) -> Column:
        """A value of the shape that fits; none for the others."""
        out = F.lit(None).cast("string")
        for k, x in enumerate(shapes):
            v = value(*x)
            out = out if v is None else F.when(F.col("shape") == k, v).otherwise(out)
        return out

    def group(n: int, *kinds: str):
        return of(lambda category, _severity, _action, p: part(F.col("message"), p, n) if category in kinds else None)

    actor = F.coalesce(group(2, "authentication"), group(1, "privilege_escalation"))
    target = F.coalesce(group(1, "authentication", "system"), group(2, "privilege_escalation"))
    return rows.select(
        "ts", "source", F.lit(None).cast("string").alias("host"), of(lambda c, *_: F.lit(c)).alias("category"), of(lambda _c, v, *_: F.lit(v)).alias("severity"), actor.alias("actor"), target.alias("target"),
        of(lambda _c, _s, a, _p: F.lit(a)).alias("action"), "raw", _metadata(command=F.trim(group(3, "privilege_escalation")), parser=F.lit("macos_unified_log")).alias("metadata"),
    )
