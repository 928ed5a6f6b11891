"""Selection by tables of name patterns and of folders, however many.

A list of a few patterns is one expression (``selection``); a table of them is joined. The start
and the end of a name count as characters. The text between two wildcards of a pattern is a run
that every match holds, or, beyond eight characters, so many of its runs; a run is as long as the
sizes allow (``SIZES``) and stands for itself by its hash. Names are taken apart into runs of
all sizes once, for the number of times each occurs. A pattern first asks for one of its runs,
the longest that is not among the commonest; when no name holds it the pattern matches nothing
and is gone, after one exchange. What is left is filed under the rarest of all its runs, its
anchor. Names meet patterns by equality of anchors, and only what meets is tested. Patterns
without wildcards are runs as any others, and those of nothing but wildcards ask for a length.
Names take part once, however often they occur, and so do the patterns that are left; an anchor
that many names hold is left to Spark's skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.retention import BELOW, BEYOND, covered_by_intervals
from shelfmark.session import fresh_dir

START, END, GAP = "\x02", "\x03", "\x01"
CLASS = r"\[!?\]?[^\]]*\]"
# Sizes of runs; one of the next smaller size and its neighbours cover a text between two sizes.
SIZES = (1, 2, 3, 4, 6, 8)
# The run a pattern first asks for is one of those that begin so many characters apart; it is none
# of so many of the commonest, which the driver gets, whatever the number of names.
STEP, COMMONEST = 4, 1024


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def glob_regex(glob: Column) -> Column:
    """Regular expression of a shell-style pattern; an unclosed bracket stands for itself."""

    def piece(token: Column) -> Column:
        body = F.substring(token, 2, F.length(token) - 2)
        negated = body.startswith("!")
        inner = F.regexp_replace(F.when(negated, F.substring(body, F.lit(2), F.length(body))).otherwise(body), r"([^\p{L}\p{N}-])", r"\\$1")
        return (
            F.when(token == "*", ".*")
            .when(token == "?", ".")
            .when(F.length(token) > 2, F.concat(F.lit("["), F.when(negated, "^").otherwise(""), inner, F.lit("]")))
            .when(token.rlike(r"^[\p{L}\p{N}]"), token)
            .otherwise(F.concat(F.lit("\\"), token))
        )

    tokens = F.regexp_extract_all(glob, F.lit(f"(?s){CLASS}|."), F.lit(0))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, piece), ""), F.lit(r"\z"))


def _name_runs(name: Column) -> Column:
    """All runs of a name, by their hashes."""
    padded = F.concat(F.lit(START), name, F.lit(END))

    def of(size: int) -> Column:
        places = F.when(F.length(padded) >= size, F.sequence(F.lit(1), F.length(padded) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.substring(padded, i, F.lit(size))))

    return F.concat(*[of(size) for size in SIZES])


def _pattern_runs(glob: Column, step: int = 1) -> Column:
    """Runs that every match of a pattern holds, as (size, run): of each text between wildcards those of the greatest size."""
    gaps = F.replace(F.replace(glob, F.lit("*"), F.lit(GAP)), F.lit("?"), F.lit(GAP))
    gaps = F.when(glob.contains("["), F.regexp_replace(glob, f"(?s){CLASS}|[*?]", GAP)).otherwise(gaps)
    pieces = F.filter(F.split(F.concat(F.lit(START), gaps, F.lit(END)), GAP), lambda piece: piece != "")

    def sized(piece: Column) -> Column:
        size = F.lit(SIZES[0])
        for least in SIZES[1:]:
            size = F.when(F.length(piece) >= least, least).otherwise(size)
        return F.struct(piece.alias("piece"), size.alias("size"))

    def of(sized: Column) -> Column:
        piece, size = sized["piece"], sized["size"]
        places = F.sequence(F.lit(1), F.length(piece) - size + 1, F.lit(step))
        return F.transform(places, lambda i: F.struct(size.alias("size"), F.xxhash64(F.substring(piece, i, size)).alias("run")))

    return F.flatten(F.transform(F.transform(pieces, sized), of))


def _anchored(names: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct patterns whose runs are all held by names: (pattern, run) with their anchor, and those of nothing but wildcards."""
    counts = _stored(names.select(F.explode(_name_runs(F.col("name"))).alias("run")).groupBy("run").agg(F.count("*").alias("n")), "name-runs")
    common = [r.run for r in counts.orderBy(F.desc("n")).limit(COMMONEST).collect()]
    # Any run would do here; a rare one leaves the fewest patterns.
    rare = f"r.run NOT IN ({', '.join(f'{run}L' if run > -(2**63) else 'CAST(-9223372036854775808 AS BIGINT)' for run in common)})" if common else "true"
    asked = patterns.select("pattern", _pattern_runs(F.col("pattern"), STEP).alias("runs"))
    # Every pattern has runs; without coalesce() Spark would find them once more to test that.
    asked = asked.select("pattern", F.expr(f"coalesce(array_max(transform(runs, r -> named_struct('rare', {rare}, 'size', r.size, 'run', r.run))).run, 0L)").alias("run"))
    left = _stored(asked.join(counts.select("run"), "run", "left_semi").select("pattern").distinct(), "patterns")

    bare = F.col("pattern").rlike(r"\A[*?]+\z")
    runs = left.where(~bare).select("pattern", F.explode(F.array_distinct(_pattern_runs(F.col("pattern"))["run"])).alias("run"))
    rarest = runs.join(counts, "run", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("anchor"))
    return _stored(rarest.where("anchor.n > 0").select("pattern", F.col("anchor.run").alias("run")), "anchors"), left.where(bare)


def _meetings(names: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, pattern) of the names that hold a pattern's anchor."""
    held = names.select("id", F.explode(F.array_distinct(_name_runs(F.col("name")))).alias("run"))
    return held.join(_stored(anchors.select("run").distinct(), "anchor-runs"), "run", "left_semi").join(anchors, "run").select("id", "pattern")


def _named(names: DataFrame) -> DataFrame:
    """(id, name) of the distinct names, in files enough for all cores: few bytes of names are many runs."""
    distinct = names.select("name").where("name IS NOT NULL").distinct().repartition(names.sparkSession.sparkContext.defaultParallelism * 2)
    return _stored(distinct.select(F.monotonically_increasing_id().alias("id"), "name"), "names")


def matched_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct ``name`` that equal or glob at least one ``pattern``; nulls match nothing."""
    names = _named(names)
    anchors, bare = _anchored(names, patterns.select("pattern").where("pattern IS NOT NULL"))

    # Nothing but wildcards: a length, or a least length.
    lengths = bare.select(F.length(F.regexp_replace("pattern", r"\*", "")).alias("length"), F.col("pattern").contains("*").alias("open"))
    least = lengths.where("open").agg(F.min("length")).first()[0]
    by_length = names.join(lengths.where(~F.col("open")).select("length").distinct(), F.length("name") == F.col("length"), "left_semi").select("name")
    if least is not None:
        by_length = by_length.unionByName(names.where(F.length("name") >= least).select("name"))

    tested = _meetings(names, anchors).withColumn("regex", glob_regex(F.col("pattern"))).join(names, "id")
    met = tested.where(F.expr("name = pattern OR name RLIKE regex")).select("name")
    return by_length.unionByName(met).distinct()


def included_by(df: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """Rows whose name matches a pattern of the table."""
    return _by_name(df, column, patterns, "left_semi")


def not_excluded_by(df: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """Rows whose name matches no pattern of the table; a null name is not excluded."""
    return _by_name(df, column, patterns, "left_anti")


def _by_name(df: DataFrame, column: str, patterns: DataFrame, how: str) -> DataFrame:
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    own = F.col(names[df.columns.index(column)])
    matched = matched_names(rows.select(own.alias("name")), patterns).withColumnRenamed("name", "matched")
    kept = rows.join(matched, own == F.col("matched"), how)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)])


def outside_folders(df: DataFrame, column: str, folders: DataFrame) -> DataFrame:
    """Rows whose path is none of the ``folder`` of the table and lies below none; a null path is kept."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    own = F.col(names[df.columns.index(column)])

    def key(path: Column) -> Column:
        return F.replace(F.regexp_replace(path, "/+$", ""), F.lit("/"), F.lit(BELOW))

    given = folders.select(key(F.col("folder")).alias("key")).where("key IS NOT NULL").distinct()
    listed = rows.where(own.isNotNull()).select("*", key(own).alias("key"), F.lit(None).cast("string").alias("reach"), F.lit(True).alias("listed"))
    both = listed.unionByName(
        given.select("key", F.concat("key", F.lit(BEYOND)).alias("reach"), F.lit(False).alias("listed")), allowMissingColumns=True
    )
    kept = covered_by_intervals(both).where(F.col("listed") & ~F.col("covered")).select(*names).unionByName(rows.where(own.isNull()))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)])
