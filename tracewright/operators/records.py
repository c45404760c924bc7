"""Validation and projection of records: artifact events, case ids, containers, evidence manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalar import masked

REQUIRED = ("timestamp", "host", "source", "artifact_type", "event_id", "raw_data")
INSPECT = "ARRAY<STRUCT<Name: STRING, Config: STRUCT<Image: STRING, User: STRING, Env: ARRAY<STRING>>, State: STRUCT<Running: BOOLEAN>, HostConfig: STRUCT<Privileged: BOOLEAN, ReadonlyRootfs: BOOLEAN, CapAdd: ARRAY<STRING>, CapDrop: ARRAY<STRING>, SecurityOpt: ARRAY<STRING>, PidMode: STRING, NetworkMode: STRING>, Mounts: ARRAY<STRUCT<Type: STRING, Source: STRING, Destination: STRING, Mode: STRING, RW: BOOLEAN>>>>"


def with_missing(events: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Adds missing: the required fields that are absent or null."""
    gone = [F.when(F.col(c).isNull() if c in events.columns else F.lit(True), F.lit(c)) for c in required]
    return events.withColumn("missing", F.filter(F.array(*gone), lambda x: x.isNotNull()))


def valid(events: DataFrame, required: tuple[str, ...] = REQUIRED, *, strict: bool = False) -> DataFrame:
    rows = with_missing(events, required)
    if strict:
        checked = F.when(F.size("missing") > 0, F.raise_error(F.concat(F.lit("missing fields: "), F.array_join("missing", ", "))).cast("boolean")).otherwise(F.lit(True))
        return rows.where(checked).drop("missing")
    return rows.where(F.size("missing") == 0).drop("missing")


def rejects(events: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    return with_missing(events, required).where(F.size("missing") > 0)


def valid_case_id(case_id: Column) -> Column:
    """Not blank and a single path segment."""
    c = F.trim(case_id)
    return F.coalesce((c != "") & ~c.isin(".", "..") & ~c.rlike(r"[/\\]"), F.lit(False))


def attack_tags(events: DataFrame) -> Column:
    """Tags of all tag fields, arrays or comma texts, trimmed, without repetition, in order."""
    parts = []
    for name in ("attack_tags", "attack_techniques", "mitre_attack", "tags"):
        if name in events.columns:
            listed = dict(events.dtypes)[name].startswith("array")
            empty = F.array().cast("array<string>")
            parts.append(F.coalesce(F.col(name).cast("array<string>") if listed else F.split(name, ","), empty))
    trimmed = F.transform(F.concat(*parts) if parts else F.array().cast("array<string>"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(trimmed, lambda t: t.isNotNull() & (t != "")))


def inspected(containers: DataFrame) -> DataFrame:
    """container_id and the first element of inspect_json; invalid JSON leaves it empty."""
    return containers.select("container_id", F.get(F.from_json("inspect_json", INSPECT), 0).alias("i"))


def container_identity(containers: DataFrame) -> DataFrame:
    return inspected(containers).select("container_id", F.regexp_replace("i.Name", "^/+", "").alias("name"), F.col("i.Config.Image").alias("image"), F.coalesce("i.State.Running", F.lit(False)).alias("running"))


def security_context(containers: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    h = "i.HostConfig."
    return inspected(containers).select(
        "container_id", F.coalesce(h + "Privileged", F.lit(False)).alias("privileged"), F.coalesce(h + "ReadonlyRootfs", F.lit(False)).alias("read_only_rootfs"), F.coalesce(h + "CapAdd", empty).alias("cap_add"), F.coalesce(h + "CapDrop", empty).alias("cap_drop"),
        F.coalesce(h + "SecurityOpt", empty).alias("security_opt"), F.coalesce(h + "PidMode", F.lit("")).alias("pid_mode"), F.coalesce(h + "NetworkMode", F.lit("")).alias("network_mode"), F.coalesce("i.Config.User", F.lit("")).alias("user"),
        F.coalesce(F.exists(h + "SecurityOpt", lambda o: o.contains("no-new-privileges")), F.lit(False)).alias("no_new_privileges"),
    )


def masked_env(containers: DataFrame) -> DataFrame:
    return inspected(containers).select("container_id", F.transform(F.coalesce("i.Config.Env", F.array().cast("array<string>")), masked).alias("env"))


def mounts(containers: DataFrame) -> DataFrame:
    return inspected(containers).select("container_id", F.explode("i.Mounts").alias("m")).select("container_id", *(F.col(f"m.{f}").alias(f.lower()) for f in ("Type", "Source", "Destination", "Mode", "RW")))


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    """Per container: bytes, artifacts collected and failed."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return artifacts.groupBy("container_id").agg(F.sum("size_bytes").alias("total_bytes"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))


def first_artifact(artifacts: DataFrame, kind: str) -> DataFrame:
    return artifacts.where(F.col("artifact_type") == kind).groupBy("container_id").agg(F.min_by("content", "seq").alias("content"))


def manifest_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the manifest that are missing or have another hash; files beside it do not matter."""
    f = files.select(F.col("path").alias("fpath"), F.col("sha256").alias("actual"))
    return manifest.join(f, F.col("path") == F.col("fpath"), "left").where(F.col("actual").isNull() | (F.col("actual") != F.col("sha256"))).select("path", "sha256", "actual")


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest_mismatches(manifest, files).agg((F.count("*") == 0).alias("ok"), F.count("*").alias("mismatches"))
