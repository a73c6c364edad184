"""Dates of uncertain precision, percentages, instants, addresses and content hashes."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import ipaddress
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels that mean "no date".
NO_DATE = ("", "unknown", "tba", "n/a", "na", "未定", "未知", "待定")


def fuzzy_date(text: Column) -> Column:
    """struct(date, precision, label): day, month or year filled up to a date, else unknown."""
    label = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    day, month, year = label.rlike(r"^\d{4}-\d{2}-\d{2}$"), label.rlike(r"^\d{4}-\d{2}$"), label.rlike(r"^\d{4}$")
    padded = F.when(day, label).when(month, F.concat(label, F.lit("-01"))).when(year, F.concat(label, F.lit("-01-01")))
    date = F.when(~F.lower(label).isin(*NO_DATE), F.try_to_date(padded, "yyyy-MM-dd"))
    precision = F.when(date.isNull(), "unknown").when(day, "day").when(month, "month").otherwise("year")
    return F.struct(F.date_format(date, "yyyy-MM-dd").alias("date"), precision.alias("precision"), label.alias("label"))


def round_to_millis(ts: Column) -> Column:
    """A timestamp rounded half up to milliseconds, as storage with three digits keeps it."""
    return F.timestamp_millis(F.floor((F.unix_micros(ts) + 500) / 1000).cast("long"))


def percent(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double")))).cast("int")


def confidence(value: Column, fallback: float = 0.0) -> Column:
    """A share from 0 to 1; values over 1 are percentages; what is no number falls back."""
    v = value.cast("double")
    v = F.when(v.isNull() | F.isnan(v), F.lit(fallback)).when(v > 1, v / 100).otherwise(v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of values in order; null differs from the empty text."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no spare blanks; null where the text is no JSON."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def hmac_sha256(text: Column, secret: str) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else _hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest())

    return run(text)


@F.pandas_udf(T.StringType())
def network_prefix(addresses: pd.Series) -> pd.Series:
    """The /24 of an IPv4 and the /64 of an IPv6 address; null for anything else."""

    def one(x):
        try:
            a = ipaddress.ip_address((x or "").strip())
            return str(ipaddress.ip_network((a, 24 if a.version == 4 else 64), strict=False))
        except ValueError:
            return None

    return addresses.map(one)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes as 8 hex digits."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(x):
            h = 0x811C9DC5
            for b in (x or "").encode():
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            return f"{h:08x}"

        return texts.map(one)

    return run(text)
