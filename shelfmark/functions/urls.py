"""URL and path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ports that a public URL leaves out, and the port that means https.
DEFAULT_PORTS = ("80", "443")
HTTPS_PORT = "443"

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_AUTHORITY = _SCHEME + r"//([^/?#]*)"
_PATH = _SCHEME + r"(?://[^/?#]*)?([^?#]*)"


def _host_and_port(url: Column) -> Column:
    """Authority without user information, which ends at the last ``@``."""
    return F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "")


def url_host(url: Column) -> Column:
    """Lower-case host name; null where the URL has none. Brackets of IPv6 are dropped."""
    authority = _host_and_port(url)
    bracketed = F.nullif(F.regexp_extract(authority, r"^\[([^\]]*)\]", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(authority, r"^([^:\[\]]*)", 1), F.lit(""))
    return F.lower(F.coalesce(bracketed, plain))


def url_port(url: Column) -> Column:
    """Port as int; null where absent, not a number or above 65535."""
    port = F.regexp_extract(_host_and_port(url), r":([0-9]+)$", 1).try_cast("int")
    return F.when(port <= 65535, port)


def url_path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(url, _PATH, 1)


def url_last_part(url: Column) -> Column:
    """Text after the last slash of the path, without ``;`` parameters."""
    return F.regexp_extract(url_path(url), r"([^/;]*)(?:;[^/]*)?$", 1)


def public_url(host: Column, port: Column) -> Column:
    """``https`` on port 443, otherwise ``http``; ports 80 and 443 are not printed."""
    port = port.cast("string")
    hidden = port.isNull() | (port == "") | port.isin(*DEFAULT_PORTS)
    return F.concat(
        F.when(port == HTTPS_PORT, F.lit("https://")).otherwise(F.lit("http://")),
        host,
        F.when(hidden, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.lit("/"),
    )


def with_trailing_slash(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def relative_stem(path: Column, folder: str | Column, extension: str = ".zip") -> Column:
    """Name below ``folder`` without its extension; null for a path outside the folder."""
    base = F.concat(F.lit(folder) if isinstance(folder, str) else folder, F.lit("/"))
    below = F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))
    cut = F.substring(below, F.lit(1), F.length(below) - len(extension))
    return F.when(F.endswith(below, F.lit(extension)), cut).otherwise(below)


# -- base URL rewrite over whole records ------------------------------------

def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.keyType) or _holds_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    return False


def _rewritten(value: Column, kind: T.DataType, source: str, target: str) -> Column:
    if isinstance(kind, T.StringType):
        return F.replace(value, F.lit(source), F.lit(target))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _rewritten(x, kind.elementType, source, target))
    if isinstance(kind, T.MapType):
        if _holds_text(kind.valueType):
            value = F.transform_values(value, lambda _, x: _rewritten(x, kind.valueType, source, target))
        if _holds_text(kind.keyType):
            value = F.transform_keys(value, lambda k, _: _rewritten(k, kind.keyType, source, target))
        return value
    for field in kind.fields:
        if _holds_text(field.dataType):
            inner = _rewritten(value.getField(field.name), field.dataType, source, target)
            value = value.withField(f"`{field.name}`", inner)
    return value


def _mentions(value: Column, kind: T.DataType, source: str) -> Column:
    if isinstance(kind, T.StringType):
        found = F.contains(value, F.lit(source))
    elif isinstance(kind, T.ArrayType):
        found = F.exists(value, lambda x: _mentions(x, kind.elementType, source))
    elif isinstance(kind, T.MapType):
        keys = T.ArrayType(kind.keyType), F.map_keys(value)
        values = T.ArrayType(kind.valueType), F.map_values(value)
        found = F.lit(False)
        for of, part in (keys, values):
            if _holds_text(of):
                found = found | _mentions(part, of, source)
    else:
        found = F.lit(False)
        for field in kind.fields:
            if _holds_text(field.dataType):
                found = found | _mentions(value.getField(field.name), field.dataType, source)
    return F.coalesce(found, F.lit(False))


def mentions_url(df: DataFrame, source: str) -> Column:
    """True where any text of the row, nested text included, holds ``source``."""
    found = F.lit(False)
    for field in df.schema.fields:
        if _holds_text(field.dataType):
            found = found | _mentions(F.col(f"`{field.name}`"), field.dataType, source)
    return found


def rewrite_base_url(
    df: DataFrame, source: str, target: str, changed: str | None = None
) -> DataFrame:
    """Replace the literal ``source`` by ``target`` in every text of every row.

    One projection, nested arrays, structs, map keys and map values included. Two keys of
    a map that become one stop the job unless ``spark.sql.mapKeyDedupPolicy`` says which wins. With
    ``changed`` a flag column of that name tells which rows held the source.
    """
    if not source:
        raise ValueError("the source address is empty")
    columns = [
        _rewritten(F.col(f"`{f.name}`"), f.dataType, source, target).alias(f.name)
        if _holds_text(f.dataType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    if changed:
        columns.append(mentions_url(df, source).alias(changed))
    return df.select(*columns)
