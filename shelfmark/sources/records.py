"""Record files: JSON objects of ``model``, ``pk`` and ``fields``.

A file may mix models with different fields, so ``fields`` is read as raw JSON text
and typed per model afterwards; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = "model string, pk bigint, fields string"

# The fields of each known model.
MODEL_FIELDS = {
    "people.Profile": (
        "date_joined timestamp, email string, first_name string, groups array<string>, "
        "is_active boolean, is_staff boolean, is_superuser boolean, last_login timestamp, "
        "last_name string, password string, user_permissions array<string>, username string"
    ),
    "oauth2_provider.application": (
        "skip_authorization boolean, created timestamp, updated timestamp, algorithm string, "
        "redirect_uris string, name string, authorization_grant_type string, "
        "client_type string, client_id string, client_secret string, user array<string>"
    ),
    "tastypie.apikey": "user bigint, key string, created timestamp",
    "sites.site": "domain string, name string",
    "monitoring.host": "active boolean, ip string, name string",
    "monitoring.service": (
        "name string, url string, notes string, last_check timestamp, active boolean, "
        "host bigint, check_interval string, service_type bigint"
    ),
    "django_celery_beat.intervalschedule": "every bigint, period string",
    "django_celery_beat.crontabschedule": (
        "minute string, hour string, day_of_week string, day_of_month string, "
        "month_of_year string"
    ),
    "django_celery_beat.periodictasks": "last_update timestamp",
    "django_celery_beat.periodictask": (
        "name string, task string, interval bigint, crontab bigint, solar bigint, args string, "
        "kwargs string, queue string, exchange string, routing_key string, expires timestamp, "
        "enabled boolean, last_run_at timestamp, total_run_count bigint, "
        "date_changed timestamp, description string"
    ),
}

# Microseconds and zone, so that a time survives the round trip. A zone-less time is UTC
# by our reading, so it is written with a zone too.
_WRITE_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "timeZone": "UTC",
}


def read_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    array_files: bool = False,
    positions: bool = False,
) -> DataFrame:
    """Records with ``fields`` as JSON text; malformed input stops the job.

    ``array_files`` reads files that are one JSON array. Such a file is read by one
    task, which suits seed files; large data comes as one record per line and splits.

    ``positions`` adds ``position``: ordered like the records within their file,
    whichever way the file was split. A block is read in order by one task, and blocks
    are told apart by where they start.
    """
    reader = spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST")
    records = reader.option("multiLine", array_files).json(paths)
    if positions:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        records = records.select("*", place.alias("position"))
    return records


def _as_read(kind: T.DataType) -> T.DataType:
    """Times are read as text first, because two spellings meet in one column."""
    return T.StringType() if isinstance(kind, T.TimestampType) else kind


def parse_time(text: Column) -> Column:
    """ISO time with a zone, or without one and then taken as UTC."""
    zoned = text.endswith("Z") | text.rlike(r"[+\-]\d{2}:?\d{2}$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).cast("timestamp")


def _schema_of(model: str, fields: str | T.StructType | None) -> T.StructType:
    schema = fields if fields is not None else MODEL_FIELDS[model]
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _as_read(f.dataType)) for f in schema.fields])


def _typed_columns(schema: T.StructType) -> list[Column]:
    return [
        (
            parse_time(F.col(f"fields.`{f.name}`"))
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"fields.`{f.name}`")
        ).alias(f.name)
        for f in schema.fields
    ]


def typed(records: DataFrame, model: str, fields: str | T.StructType | None = None) -> DataFrame:
    """The records of one model with typed columns next to ``pk``."""
    schema = _schema_of(model, fields)
    parsed = F.from_json("fields", _text_schema(schema), {"mode": "FAILFAST"})
    extra = [c for c in records.columns if c not in ("model", "pk", "fields")]
    one = records.where(F.col("model") == model).select("pk", *extra, parsed.alias("fields"))
    return one.select("pk", *extra, *_typed_columns(schema))


def read_model(
    spark: SparkSession, path: str, model: str, fields: str | T.StructType | None = None
) -> DataFrame:
    """Typed records of one model from a folder that :func:`write_records` split by model.

    Only the folder of that model is read, and its lines are parsed once.
    """
    schema = _schema_of(model, fields)
    whole = T.StructType.fromDDL("model string, pk bigint").add("fields", _text_schema(schema))
    lines = spark.read.schema(whole).option("mode", "FAILFAST").json(path)
    return lines.where(F.col("model") == model).select("pk", *_typed_columns(schema))


def fields_json(*values: Column | str) -> Column:
    """Named columns as the JSON text of ``fields``, nulls kept, times in UTC."""
    return F.to_json(F.struct(*values), _WRITE_OPTIONS)


def to_records(
    df: DataFrame, model: str, pk: str = "pk", fields: Sequence[str] | None = None
) -> DataFrame:
    """Rows of one table as ``model``, ``pk`` and ``fields`` (JSON text, nulls kept)."""
    names = fields if fields is not None else [c for c in df.columns if c != pk]
    return df.select(
        F.lit(model).alias("model"),
        F.col(pk).cast("bigint").alias("pk"),
        fields_json(*[f"`{c}`" for c in names]).alias("fields"),
    )


def record_lines(records: DataFrame) -> DataFrame:
    """Records as one JSON line each, next to their model."""
    head = F.to_json(F.struct("model", "pk"), {"ignoreNullFields": "false"})
    line = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"fields":'), F.col("fields"), F.lit("}"))
    return records.select("model", line.alias("value"))


def write_arrays(records: DataFrame, path: str, file: Column, mode: str = "errorifexists") -> None:
    """Write records as JSON array files, one folder for each value of ``file``.

    An array is made and read by one task: ``file`` has to bound the records of a value.
    """
    numbered = records.withColumn("file", file)
    head = F.to_json(F.struct("model", "pk"), {"ignoreNullFields": "false"})
    line = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"fields":'), F.col("fields"), F.lit("}"))
    arrays = numbered.groupBy("file").agg(F.array_join(F.collect_list(line), ",\n").alias("items"))
    value = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    arrays.select("file", value.alias("value")).write.mode(mode).partitionBy("file").text(path)


def write_records(
    records: DataFrame, path: str, mode: str = "errorifexists", by_model: bool = False
) -> None:
    """Write records, one per line, so that the output splits when read.

    ``by_model`` gives every model a folder of its own, without a shuffle.
    """
    lines = record_lines(records)
    if by_model:
        lines.write.mode(mode).partitionBy("model").text(path)
    else:
        lines.select("value").write.mode(mode).text(path)
