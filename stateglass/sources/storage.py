"""Storage options as Spark settings.

Paths on object stores are read like any other path; only the settings of the
Hadoop file system differ. The connector jars must be on the class path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Option names and the settings they stand for.
S3_SETTINGS = {
    "aws.region": "fs.s3a.endpoint.region",
    "aws.endpoint": "fs.s3a.endpoint",
    "aws.path-style-access": "fs.s3a.path.style.access",
    "aws.access-key-id": "fs.s3a.access.key",
    "aws.secret-access-key": "fs.s3a.secret.key",
}
GCS_SETTINGS = {
    "gcs.project": "fs.gs.project.id",
    "gcs.credentials": "fs.gs.auth.service.account.json.keyfile",
}
PROFILE_PROVIDER = "software.amazon.awssdk.auth.credentials.ProfileCredentialsProvider"
DEFAULT_REGION = "us-east-1"


def storage_options(options: Mapping[str, str], environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Read options, to be passed to a reader or set as ``spark.hadoop.*``.

    Keys are given in pairs. A region not given comes from ``environ``. The file
    system takes the name of a profile from the variable ``AWS_PROFILE`` only, so
    ``environ`` must have it there.
    """
    known = {**S3_SETTINGS, **GCS_SETTINGS}
    unknown = set(options) - set(known) - {"aws.profile"}
    if unknown:
        raise ValueError(f"unknown storage options: {', '.join(sorted(unknown))}")
    settings = {known[k]: v for k, v in options.items() if k in known and v}
    pair = {"fs.s3a.access.key", "fs.s3a.secret.key"}
    if len(pair & set(settings)) == 1:
        raise ValueError("an access key and its secret are given together")
    profile = options.get("aws.profile")
    if profile and profile != (environ or {}).get("AWS_PROFILE", "default"):
        raise ValueError(f"set AWS_PROFILE={profile} for the driver and the executors")
    if profile:
        settings["fs.s3a.aws.credentials.provider"] = PROFILE_PROVIDER
    if any(k.startswith("aws.") for k in options):
        region = (environ or {}).get("AWS_DEFAULT_REGION", DEFAULT_REGION)
        settings.setdefault("fs.s3a.endpoint.region", region)
    return settings


def hadoop_conf(options: Mapping[str, str], environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """The same as session settings, e.g. for ``SparkSession.builder.config``."""
    return {f"spark.hadoop.{k}": v for k, v in storage_options(options, environ).items()}


def hadoop_path(uri: str) -> str:
    """``s3://`` paths are served by the s3a file system."""
    return "s3a://" + uri.removeprefix("s3://") if uri.startswith("s3://") else uri


def setting_rows(rows: DataFrame, options: Mapping[str, Column]) -> DataFrame:
    """``rows`` once per Spark setting, with ``setting`` and ``value``.

    ``options`` are columns by option name; an option that a row has not makes no
    setting, and a region that it has not is the default one.
    """
    known = {**S3_SETTINGS, **GCS_SETTINGS}
    unknown = set(options) - set(known)
    if unknown:
        raise ValueError(f"unknown storage options: {', '.join(sorted(unknown))}")
    columns = {known[name]: column.cast("string") for name, column in options.items()}
    if any(name.startswith("aws.") for name in options):
        region = S3_SETTINGS["aws.region"]
        columns[region] = F.coalesce(columns.get(region, F.lit(None)), F.lit(DEFAULT_REGION))
    pairs = [F.struct(F.lit(name).alias("setting"), value.alias("value")) for name, value in columns.items()]
    return rows.select(*[f"`{c}`" for c in rows.columns], F.inline(F.array(*pairs))).filter("value IS NOT NULL")


def hadoop_path_column(uri: Column) -> Column:
    """``hadoop_path`` of a column."""
    return F.regexp_replace(uri, "^s3://", "s3a://")
