"""Records from files that are one JSON array each, read in ranges.

A text reader cuts the files at closing braces, so every task reads a range of bytes and a
piece is no longer than the text up to the next brace. Whether a brace closes a record depends
on all that comes before it: on being inside a string, and on the depth of brackets. Each piece
is summed up without that knowledge: does it flip the string state, and how far does it change
the depth if it begins outside a string, and if it begins inside one. These sums are combined
along each range, then along the ranges of a file by one row each, which gives every piece its
true state. A record ends where a piece ends outside strings at the depth of the array; its
pieces are then put together, wherever they were read. An empty file has no records.

A brace cannot follow an open escape (no JSON escape ends in a brace), so a piece never begins
inside one. What does not fit stops the job: text between records, a file that ends inside a
record, unbalanced brackets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.session import fresh_dir
from shelfmark.sources.records import RECORD_SCHEMA, record_lines

CUT = "}"
#: Depth inside the array and outside its records.
INSIDE = 1


def _outside_change(parts: Column, first: int) -> Column:
    """Change of depth in every second part of a piece cut at its quotes."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")
    opened = F.length(outside) - F.length(F.regexp_replace(outside, r"[{\[]", ""))
    closed = F.length(outside) - F.length(F.regexp_replace(outside, r"[}\]]", ""))
    return (opened - closed).cast("bigint")


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Pieces with their place and what they change; all but a file's last get their brace back."""
    read = spark.read.option("lineSep", CUT).text(paths)
    placed = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    return placed.select("*", parts.alias("parts")).select(
        "file",
        "block",
        "row",
        "value",
        (F.size("parts") - 1).cast("bigint").alias("quotes"),
        # The brace that the reader took away counts with what it follows.
        _outside_change(F.col("parts"), 0).alias("from_outside"),
        _outside_change(F.col("parts"), 1).alias("from_inside"),
    )


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def record_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, record (its number in the file) and value (its text) of every record."""
    # Written, so that pieces are read and numbered once.
    pieces = _stored(_pieces(spark, paths), "array-pieces")
    in_block = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")

    # The string state: quotes before a piece, in its block and in the blocks before.
    quotes = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("n"), F.max("row").alias("last"))
    from_end = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block")))
    quotes = quotes.select(
        "file", "block", "last", F.coalesce(F.sum("n").over(blocks_before), none).alias("quotes_before"), (from_end == 1).alias("last_block")
    )
    sums = pieces.drop("value")
    known = sums.join(quotes, ["file", "block"]).withColumn(
        "inside", (F.coalesce(F.sum("quotes").over(in_block), none) + F.col("quotes_before")) % 2
    )
    # A brace was cut off every piece but the last of a file; outside a string it closes something.
    cut = ~(F.col("last_block") & (F.col("row") == F.col("last")))
    ends_inside = (F.col("inside") + F.col("quotes")) % 2 == 1
    change = F.when(F.col("inside") == 1, F.col("from_inside")).otherwise(F.col("from_outside")) - (cut & ~ends_inside).cast("bigint")
    known = _stored(
        known.select("file", "block", "row", change.alias("change"), ends_inside.alias("ends_inside"), cut.alias("cut")),
        "array-states",
    )

    # The depth, and from it the ends of records.
    depths = known.groupBy("file", "block").agg(F.sum("change").alias("n"))
    depths = depths.select("file", "block", F.coalesce(F.sum("n").over(blocks_before), none).alias("depth_before"))
    up_to = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    deep = known.join(depths, ["file", "block"]).withColumn("depth", F.col("depth_before") + F.sum("change").over(up_to))
    end = F.col("cut") & ~F.col("ends_inside") & (F.col("depth") == INSIDE)
    deep = deep.withColumn("end", end.cast("bigint"))
    counts = deep.groupBy("file", "block").agg(F.sum("end").alias("n"))
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(blocks_before), none).alias("records_before"))
    numbered = deep.join(counts, ["file", "block"]).withColumn(
        "record", F.col("records_before") + F.coalesce(F.sum("end").over(in_block), none)
    )

    # Put together, in the order of the file.
    text = F.concat("value", F.when(F.col("cut"), CUT).otherwise(""))
    texts = numbered.join(pieces.select("file", "block", "row", "value"), ["file", "block", "row"])
    gathered = texts.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", text.alias("text")))).alias("parts"),
        F.max("end").alias("whole"),
        F.max(F.struct("block", "row", "depth", "ends_inside"))["depth"].alias("depth"),
        F.max(F.struct("block", "row", "depth", "ends_inside"))["ends_inside"].alias("ends_inside"),
    )
    joined = F.array_join(F.transform("parts", lambda part: part["text"]), "")
    return _checked(gathered.select("file", "record", joined.alias("text"), "whole", "depth", "ends_inside"))


def _checked(records: DataFrame) -> DataFrame:
    """Records without what stands before them; the rest of a file has to be its end."""
    lead = F.when(F.col("record") == 0, F.regexp_extract("text", r"^\s*\[\s*(?=\{)", 0)).otherwise(
        F.regexp_extract("text", r"^\s*,\s*(?=\{)", 0)
    )
    rest = (F.col("depth") == 0) & ~F.col("ends_inside") & F.when(
        F.col("record") == 0, F.col("text").rlike(r"^\s*(\[\s*\]\s*)?$")
    ).otherwise(F.col("text").rlike(r"^\s*\]\s*$"))
    broken = F.raise_error(F.concat(F.lit("no array of records: "), "file"))
    value = (
        F.when((F.col("whole") == 1) & (lead != ""), F.substring("text", F.length(lead) + 1, F.length("text")))
        .when((F.col("whole") == 0) & rest, F.lit(None).cast("string"))
        .otherwise(broken)
    )
    return records.select("file", "record", value.alias("value")).where("value IS NOT NULL")


def read_array_records(spark: SparkSession, paths: str | Sequence[str], *, positions: bool = False) -> DataFrame:
    """Records of array files of any size, ``fields`` as JSON text; malformed input stops the job.

    ``positions`` adds ``position``, ordered like the records within their file.
    """
    texts = record_texts(spark, paths)
    parsed = texts.select("file", "record", F.from_json("value", RECORD_SCHEMA, {"mode": "FAILFAST"}).alias("r"))
    place = [F.struct("file", "record").alias("position")] if positions else []
    return parsed.select("r.model", "r.pk", "r.fields", *place)


def write_array_file(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write all records as one array, a record per line, streamed through one task into one file."""
    line = record_lines(records).select(F.lit(1).alias("part"), F.concat(F.lit(","), "value").alias("value"))
    spark = records.sparkSession
    ends = spark.range(2).select(F.when(F.col("id") == 0, 0).otherwise(2).alias("part"), F.when(F.col("id") == 0, "[").otherwise("]").alias("value"))
    lines = line.unionByName(ends).coalesce(1).sortWithinPartitions("part", "value")
    # No comma before the first record.
    before = F.lag("part").over(Window.orderBy("part", "value"))
    bare = F.when((F.col("part") == 1) & (before == 0), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    lines.select(bare.alias("value")).write.mode(mode).text(path)
