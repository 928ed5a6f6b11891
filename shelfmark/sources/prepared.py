"""Records a deployment prepares from its own settings, at table scale.

One row of settings becomes one record. The fixed fields are those a fresh
installation starts with; everything else is a column of the input.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.urls import url_host
from shelfmark.functions.values import iso_millis
from shelfmark.operators.selection import time_literal
from shelfmark.sources.records import fields_json

# Fixed values of a new application record.
APPLICATION_DEFAULTS = {
    "skip_authorization": True,
    "algorithm": "RS256",
    "authorization_grant_type": "authorization-code",
    "client_type": "confidential",
}
# Fixed values of a new service record.
SERVICE_DEFAULTS = {
    "notes": "",
    "last_check": "1970-01-01 00:00:00",
    "active": True,
    "check_interval": "00:01:00",
}
# Fixed values of a new administrator record.
ADMIN_DEFAULTS = {
    "first_name": "",
    "last_name": "",
    "is_active": True,
    "is_staff": True,
    "is_superuser": True,
}


def _records(df: DataFrame, model: str, pk: Column, fields: dict[str, Column]) -> DataFrame:
    return df.select(
        F.lit(model).alias("model"),
        pk.cast("bigint").alias("pk"),
        fields_json(*[value.alias(name) for name, value in fields.items()]).alias("fields"),
    )


def _literals(values: dict) -> dict[str, Column]:
    return {name: F.lit(value) for name, value in values.items()}


def site_records(df: DataFrame, pk: Column, url: Column) -> DataFrame:
    """A site per row; domain and name are both the host of its URL."""
    host = url_host(url)
    return _records(df, "sites.site", pk, {"domain": host, "name": host})


def application_records(
    df: DataFrame,
    pk: Column,
    *,
    name: Column,
    site_url: Column,
    redirect_path: str,
    client_id: Column,
    client_secret: Column,
    owner: Column,
    created: Column,
) -> DataFrame:
    """An application that may sign users in; the owner is a natural key."""
    fields = _literals(APPLICATION_DEFAULTS) | {
        "created": iso_millis(created),
        "updated": iso_millis(created),
        "redirect_uris": F.concat(site_url, F.lit(redirect_path)),
        "name": name,
        "client_id": client_id,
        "client_secret": client_secret,
        "user": F.array(owner),
    }
    return _records(df, "oauth2_provider.application", pk, fields)


def host_records(df: DataFrame, pk: Column, *, name: Column, ip: Column) -> DataFrame:
    """A monitored host."""
    return _records(df, "monitoring.host", pk, {"active": F.lit(True), "ip": ip, "name": name})


def service_records(
    df: DataFrame, pk: Column, *, name: Column, url: Column, host: Column, service_type: Column
) -> DataFrame:
    """A monitored service that has never been checked; host and type are references."""
    fields = _literals(SERVICE_DEFAULTS) | {
        "name": name,
        "url": url,
        "host": host.cast("bigint"),
        "service_type": service_type.cast("bigint"),
    }
    return _records(df, "monitoring.service", pk, fields)


def admin_records(
    df: DataFrame, pk: Column, *, username: Column, email: Column, password: Column, now: datetime
) -> DataFrame:
    """An administrator who joined and signed in at ``now``; the password comes hashed."""
    stamp = iso_millis(time_literal(T.TimestampNTZType(), now))
    fields = _literals(ADMIN_DEFAULTS) | {
        "date_joined": stamp,
        "last_login": stamp,
        "email": email,
        "groups": F.array().cast("array<string>"),
        "user_permissions": F.array().cast("array<string>"),
        "password": password,
        "username": username,
    }
    return _records(df, "people.Profile", pk, fields)
