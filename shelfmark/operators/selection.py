"""Row selection: by app, name, data time, path prefix and kind."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Comparison signs of a data-time filter.
COMPARISONS = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
}


def comma_list(text: str | None) -> list[str]:
    """Entries of a comma list without blanks around them."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


# -- apps ---------------------------------------------------------------------

def in_apps(model: Column, apps: Sequence[str]) -> Column:
    """True where the label before the first dot of ``model`` is listed."""
    return F.split_part(model, F.lit("."), F.lit(1)).isin(*apps)


# -- names with globs -----------------------------------------------------------

def _glob_class(body: str) -> str:
    negated = body.startswith("!")
    body = body[1:] if negated else body
    safe = "".join(c if c.isalnum() or c == "-" else "\\" + c for c in body)
    return f"[{'^' if negated else ''}{safe}]"


def _glob_regex(glob: str) -> str:
    """Regular expression of one shell-style name pattern."""
    pieces = re.findall(r"\[!?\]?[^\]]*\]|.", glob, flags=re.S)
    known = {"*": ".*", "?": "."}
    return "".join(
        known.get(p) or (_glob_class(p[1:-1]) if len(p) > 2 else re.escape(p)) for p in pieces
    )


def matches_names(name: Column, patterns: Iterable[str]) -> Column:
    """True where ``name`` equals or globs one of the patterns.

    Plain names, ``x*``, ``*x`` and ``*x*`` become comparisons that a Parquet
    scan can use to skip row groups; the rest share one regular expression.
    """
    exact, hard, tests = [], [], []
    for glob in patterns:
        core = glob.strip("*")
        if not re.search(r"[*?\[]", glob):
            exact.append(glob)
        elif re.search(r"[*?\[]", core):
            hard.append(glob)
        elif core == "":
            tests.append(name.isNotNull())
        elif glob == core + "*":
            tests.append(name.startswith(core))
        elif glob == "*" + core:
            tests.append(name.endswith(core))
        elif glob == f"*{core}*":
            tests.append(name.contains(core))
        else:
            hard.append(glob)
    if exact:
        tests.append(name.isin(*exact))
    if hard:
        tests.append(name.rlike(r"(?s)\A(?:" + "|".join(map(_glob_regex, hard)) + r")\z"))
    return reduce(or_, tests, F.lit(False))


def included(name: Column, patterns: Sequence[str]) -> Column:
    """Include filter; no pattern means no restriction."""
    return matches_names(name, patterns) if patterns else F.lit(True)


def not_excluded(name: Column, patterns: Sequence[str]) -> Column:
    """Exclude filter; a null name is not excluded."""
    return name.isNull() | ~matches_names(name, patterns) if patterns else F.lit(True)


# -- data time ------------------------------------------------------------------

def parse_time_filter(spec: str) -> tuple[str, datetime]:
    """``{sign} {ISO time}`` to its parts; anything else is refused."""
    found = re.fullmatch(r"\s*(<=|>=|<|>|=)\s*(\d{4}-\d{2}-\d{2}(?:[T ]\S+)?)\s*", spec)
    if not found:
        raise ValueError(f"not a data-time filter: {spec!r}")
    when = datetime.fromisoformat(found[2])
    if when.tzinfo is not None:
        when = when.astimezone(timezone.utc).replace(tzinfo=None)
    return found[1], when


def time_literal(kind: T.DataType, when: datetime) -> Column:
    """A UTC instant as a literal of the column's own type, so that it is pushed down.

    A date stands for its midnight; the literal keeps its time of day and the date is widened.
    """
    if when.tzinfo is not None:
        when = when.astimezone(timezone.utc).replace(tzinfo=None)
    text = when.isoformat(sep=" ")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.lit(text).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.lit(text + "Z").cast("timestamp")
    raise TypeError(f"not a time column: {kind.simpleString()}")


def data_time_matches(df: DataFrame, column: str, spec: str) -> Column:
    sign, when = parse_time_filter(spec)
    return COMPARISONS[sign](F.col(column), time_literal(df.schema[column].dataType, when))


# -- paths and kinds --------------------------------------------------------------

def outside_paths(path: Column, excluded: Sequence[str]) -> Column:
    """False for a listed path and everything below it; a null path is kept."""
    tests = []
    for prefix in excluded:
        prefix = prefix.rstrip("/")
        tests += [path == prefix, path.startswith(prefix + "/")]
    return path.isNull() | ~reduce(or_, tests) if tests else F.lit(True)


def of_kinds(kind: Column, **enabled: bool) -> Column:
    """Toggles: ``of_kinds(col, vector=True, raster=False)`` drops the disabled kinds only.

    A toggle says nothing about kinds that it does not name, nor about a null kind.
    """
    disabled = [name for name, on in enabled.items() if not on]
    return kind.isNull() | ~kind.isin(*disabled) if disabled else F.lit(True)


def browse(df: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    """The resources of one kind."""
    return df.where(F.col(column) == kind)


def select_layers(
    df: DataFrame,
    *,
    include: str | None = None,
    exclude: str | None = None,
    data_time: str | None = None,
    exclude_paths: str | None = None,
    vector: bool = True,
    raster: bool = True,
    name: str = "name",
    kind: str = "kind",
    time: str = "data_time",
    path: str = "path",
) -> DataFrame:
    """All layer filters of a snapshot in one pass; exclude wins over include."""
    test = of_kinds(F.col(kind), vector=vector, raster=raster)
    test &= included(F.col(name), comma_list(include))
    test &= not_excluded(F.col(name), comma_list(exclude))
    if data_time:
        test &= data_time_matches(df, time, data_time)
    if exclude_paths:
        test &= outside_paths(F.col(path), comma_list(exclude_paths))
    return df.where(test)
