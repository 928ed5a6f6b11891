"""Small tables that the tests of this folder share."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


#: Names that operators use or might use for columns of their own, and names with dots.
CLASHING = (
    "n_words", "spans", "ids", "features", "key", "kept", "probability", "a.b", "text.a", "rules", "found", "whole", "turn", "row",
    "c0", "c1", "bpe", "fp", "root", "__rules", "__found", "__pii", "__digits", "__row", "__whole", "__n", "__bpe",
)


def documents(spark, texts, first=0):
    """Texts in order as documents; ids count from ``first``."""
    rows = [(first + i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(None, None), (1, ""), (1, ""), (2, " \n\t "), (None, "one"), (3, long), (4, long), (4, long), (5, "é ß 中 x")]
    plain = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for name in CLASHING:
        plain = plain.withColumn(name, F.lit(f"{name}!"))
    return plain


def others_kept(before, after):
    """Whether columns are the same, and those with clashing names keep their values in every row."""
    return after.columns == before.columns and all(r[name] == f"{name}!" for r in after.collect() for name in CLASHING)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    """Rows of a result by id."""
    return {r["doc_id"]: r for r in df.collect()}
