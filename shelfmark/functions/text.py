"""Text, label and JSON expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as true, in any case.
TRUE_TEXTS = ("yes", "true", "t", "1")


def text_to_bool(value: Column) -> Column:
    """True for the known true texts; anything else, empty and null included, is false."""
    return F.coalesce(F.lower(value).isin(*TRUE_TEXTS), F.lit(False))


def _replacement(text: str) -> str:
    """Quote a literal for the replacement side of ``regexp_replace``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def _element_pattern(tag: str) -> str:
    # Only the first "tag>" that is followed by text counts; \A keeps it to one hit.
    return rf"(?s)\A(.*?{re.escape(tag)}>)[^<]+"


def spare_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def rewrite_elements(df: DataFrame, column: str, values: Mapping[str, str]) -> DataFrame:
    """Put new text after the first ``tag>`` of each tag, in the given order.

    All or nothing per row: if one tag has no text to replace, the row keeps its
    whole content. A missing tag turns the draft null, and null stays null.
    Each step is a projection of its own so that no draft is computed twice.
    """
    draft = spare_name(df, "draft")
    out = df.withColumn(draft, F.col(column))
    for tag, text in values.items():
        pattern = _element_pattern(tag)
        new = F.regexp_replace(F.col(draft), pattern, "$1" + _replacement(text))
        out = out.withColumn(draft, F.when(F.col(draft).rlike(pattern), new))
    return out.withColumn(column, F.coalesce(F.col(draft), F.col(column))).drop(draft)


def rewrite_documents(
    df: DataFrame, column: str, document: Column, values: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """The same with tags and texts of their own for each document; other rows stay."""
    own = spare_name(df, "own")
    out = df.withColumn(own, document)
    for name, texts in values.items():
        kept = spare_name(out, "kept")
        out = rewrite_elements(out.withColumn(kept, F.col(column)), column, texts)
        chosen = F.when(F.col(own) == name, F.col(column)).otherwise(F.col(kept))
        out = out.withColumn(column, chosen).drop(kept)
    return out.drop(own)


class Rule(NamedTuple):
    """Replace every ``find`` by ``put``."""

    find: str
    put: str
    any_case: bool = False


def apply_rules(value: Column, rules: Sequence[Rule]) -> Column:
    """Literal rules, applied everywhere in the text, one after the other."""
    for rule in rules:
        if rule.any_case:
            value = F.regexp_replace(
                value, "(?iu)" + re.escape(rule.find), _replacement(rule.put)
            )
        else:
            value = F.replace(value, F.lit(rule.find), F.lit(rule.put))
    return value


def relabel_items(items: Column, names: Mapping[str, str], field: str = "label") -> Column:
    """Map exact values of one field inside an array of structs; others stay."""

    def one(item: Column) -> Column:
        label = item.getField(field)
        mapped = label
        for old, new in names.items():
            mapped = F.when(label == old, F.lit(new)).otherwise(mapped)
        return item.withField(field, mapped)

    return F.transform(items, one)


def split_lines(df: DataFrame, column: str, line: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of a newline list; a null list gives no row."""
    return df.select(*keep, F.explode(F.split(F.col(column), "\n")).alias(line))


def json_items(value: Column) -> Column:
    """JSON array text to an array of element texts."""
    return F.from_json(value, "array<string>")


def json_entries(value: Column) -> Column:
    """JSON object text to a map of member texts."""
    return F.from_json(value, "map<string,string>")


def json_member(value: Column, name: str) -> Column:
    """One top-level member of a JSON object text."""
    return F.get_json_object(value, f"$['{name}']")
