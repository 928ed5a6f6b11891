"""Checksums of files and tables, and their comparison with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Times with every digit and in UTC; the defaults would cut them to milliseconds.
_TEXT_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timeZone": "UTC",
}


def row_text(df: DataFrame, *columns: str) -> Column:
    """The named columns (all by default) as JSON text with nulls kept."""
    return F.to_json(F.struct(*[f"`{c}`" for c in columns or df.columns]), _TEXT_OPTIONS)


def row_digest(df: DataFrame, *columns: str) -> Column:
    """md5 of the row text, so that any row can stand for an artefact."""
    return F.md5(row_text(df, *columns))


def table_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """Row count and the sum of the first 32 bits of each row digest.

    Independent of row order and partitioning. The two halves are summed apart as
    64-bit numbers, which holds for 2**47 rows, and put together as a decimal.
    """
    bits = F.conv(F.substring(row_digest(df, *columns), 1, 8), 16, 10).cast("bigint")
    sums = df.select(bits.alias("bits")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.shiftright("bits", 16)).alias("high"),
        F.sum(F.col("bits").bitwiseAND(65535)).alias("low"),
    )
    total = F.col("high").cast("decimal(19,0)") * F.lit(65536).cast("decimal(5,0)") + F.col("low")
    return sums.select("n", F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("fingerprint"))


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """``md5`` and ``path`` as the lines that checksum tools write and read."""
    path = F.col("path")
    escaped = F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    mark = F.when(path.rlike(r"[\\\n]"), F.lit("\\")).otherwise(F.lit(""))
    return manifest.select(F.concat(mark, "md5", F.lit("  "), escaped).alias("value"))


def parse_manifest_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``md5`` and ``path`` of checksum lines: digits, a blank, then a blank, a star or nothing.

    A backslash before the digits says that line ends and backslashes in the name are
    written with one. Comment lines are passed over. A line of any other shape keeps a null
    md5 and its whole text as path, so that it shows up as missing rather than vanish.
    """
    shape = r"^\\?([0-9a-fA-F]{32}) [ *]?(.+)$"
    line = F.col(column)
    good = line.rlike(shape)
    written = F.regexp_extract(line, shape, 2)
    # No name holds the character 0, which stands for a backslash meanwhile.
    name = F.replace(written, F.lit("\\\\"), F.lit("\0"))
    name = F.replace(F.replace(name, F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    path = F.when(line.startswith("\\"), name).otherwise(written)
    return lines.where((line != "") & ~line.startswith("#")).select(
        F.when(good, path).otherwise(line).alias("path"),
        F.when(good, F.lower(F.regexp_extract(line, shape, 1))).alias("md5"),
    )


def verify_manifest(
    actual: DataFrame,
    manifest: DataFrame,
    *,
    path: str = "path",
    md5: str = "md5",
    unlisted: bool = True,
) -> DataFrame:
    """Status per manifest line: ``ok``, ``mismatch`` or ``missing``.

    ``actual`` has each path once; the manifest may repeat a path, and every line gets
    its verdict. With ``unlisted`` the paths that no line names are added.

    Two one-sided joins rather than a full outer one: Spark can split a crowded key
    there, and the second reads no checksum, so no file is hashed for it.
    """
    found = actual.select(F.col(path), F.col(md5).alias("actual_md5"), F.lit(True).alias("present"))
    status = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("actual_md5") == F.col(md5), "ok")
        .otherwise("mismatch")
    )
    verdicts = manifest.join(found, path, "left").select(path, status.alias("status"))
    if not unlisted:
        return verdicts
    listed = manifest.select(path).distinct()
    extra = actual.select(path).join(listed, path, "left_anti")
    return verdicts.unionByName(extra.select(path, F.lit("unlisted").alias("status")))


def gate(verdicts: DataFrame) -> DataFrame:
    """One row: counts by status and whether every listed path is right.

    Unlisted files are reported and do not close the gate. An empty manifest does.
    """
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    sums = verdicts.agg(
        of("ok").alias("ok"),
        of("mismatch").alias("mismatch"),
        of("missing").alias("missing"),
        of("unlisted").alias("unlisted"),
    )
    passed = (F.col("ok") > 0) & (F.col("mismatch") == 0) & (F.col("missing") == 0)
    return sums.withColumn("passed", passed)
