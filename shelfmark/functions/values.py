"""Network, time and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The port used when a container exposes none.
FALLBACK_PORT = "80"
# First and last second of the years 1 to 9999.
FIRST_EPOCH = -62135596800
LAST_EPOCH = 253402300799
SECONDS_PER_DAY = 86400

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def is_ipv4(address: Column) -> Column:
    """Dotted quad without leading zeros; null is false."""
    return F.coalesce(address.rlike(_IPV4), F.lit(False))


def port_number(key: Column) -> Column:
    """``8000/tcp`` to ``8000``."""
    return F.split_part(key, F.lit("/tcp"), F.lit(1))


def exposed_port(keys: Column) -> Column:
    """Port of the last key of an array; the fallback for an empty or null array."""
    return F.coalesce(port_number(F.try_element_at(keys, F.lit(-1))), F.lit(FALLBACK_PORT))


def exposed_port_of_json(ports: Column) -> Column:
    """The same for a JSON object text whose member names are the keys."""
    return exposed_port(F.json_object_keys(ports))


def utc_instant(df: DataFrame, column: str) -> Column:
    """A time column as an instant; a zone-less time is UTC, whatever the session zone.

    In a UTC session that is a plain cast. Elsewhere a cast would go by local time, so
    the instant is put together from its parts.
    """
    value = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return value
    if not isinstance(kind, T.TimestampNTZType):
        raise TypeError(f"not a time column: {kind.simpleString()}")
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z"):
        return value.cast("timestamp")
    minute = F.unix_date(value.cast("date")).cast("bigint") * 1440 + F.hour(value) * 60 + F.minute(value)
    micros = F.extract(F.lit("SECOND"), value) * 1_000_000
    return F.timestamp_micros(minute * 60_000_000 + micros.cast("bigint"))


def iso_millis(ts: Column) -> Column:
    """ISO time in UTC cut to milliseconds, with a ``Z``; a zone-less time is UTC.

    The session zone plays no part: an instant is taken apart by arithmetic, a zone-less
    time by its text.
    """
    millis = F.unix_millis(ts.cast("timestamp"))
    of_day = F.pmod(millis, F.lit(1000 * SECONDS_PER_DAY))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((millis - of_day) / (1000 * SECONDS_PER_DAY)).cast("int"))

    def digits(unit: int, most: int, width: int) -> Column:
        return F.lpad(F.floor(F.pmod(of_day, F.lit(most)) / unit).cast("string"), width, "0")

    instant = F.concat(
        day.cast("string"), F.lit("T"), digits(3_600_000, 86_400_000, 2), F.lit(":"), digits(60_000, 3_600_000, 2),
        F.lit(":"), digits(1000, 60_000, 2), F.lit("."), digits(1, 1000, 3), F.lit("Z"),
    )
    text = ts.cast("string")
    zoneless = F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."),
        F.rpad(F.substring(text, 21, 3), 3, "0"), F.lit("Z"),
    )
    return F.when(F.typeof(ts) == "timestamp_ntz", zoneless).otherwise(instant)


def compact_time(epoch_text: Column) -> Column:
    """Epoch seconds as text to UTC ``yyyyMMddHHmmss``; null for anything else.

    Days and seconds of the day are taken apart by arithmetic: faster than a formatter,
    and the session zone plays no part.
    """
    seconds = epoch_text.try_cast("bigint")
    safe = F.when(seconds.between(FIRST_EPOCH, LAST_EPOCH), seconds)
    of_day = F.pmod(safe, F.lit(SECONDS_PER_DAY))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((safe - of_day) / SECONDS_PER_DAY).cast("int"))
    hours = F.floor(of_day / 3600)
    minutes = F.floor(F.pmod(of_day, F.lit(3600)) / 60)
    clock = hours * 10000 + minutes * 100 + F.pmod(of_day, F.lit(60))
    return F.concat(
        F.replace(day.cast("string"), F.lit("-"), F.lit("")), F.lpad(clock.cast("string"), 6, "0")
    )


def duration_seconds(text: Column) -> Column:
    """``HH:MM:SS`` to seconds; null for any other shape."""
    def part(i: int) -> Column:
        return F.regexp_extract(text, r"^(\d+):([0-5]\d):([0-5]\d)$", i).try_cast("bigint")

    return part(1) * 3600 + part(2) * 60 + part(3)
