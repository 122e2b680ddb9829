"""Keyed pseudonyms that rotate every UTC day."""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (base64url, concat_bytes, hmac_sha256, hmac_with_pads, key_pads,
                              length_prefixed, micros, utc_day, utf8)

DOMAIN_LABEL = "evidentry:offline:v2:domain"
DAY_LABEL = "evidentry:offline:v2:day"
DIRECT_REFERENCES = ("subject_ref", "session_ref")


def _field(value: str) -> bytes:
    raw = value.encode()
    return struct.pack(">Q", len(raw)) + raw


def domain_key(key: bytes, dataset: str, pilot: str, label: str = DOMAIN_LABEL) -> bytes:
    """One key per (dataset, pilot)."""
    message = _field(label) + _field(dataset) + _field(pilot)
    return hmac.new(key, message, hashlib.sha256).digest()


def domain_id(domain: bytes) -> str:
    import base64

    digest = hashlib.sha256(domain).digest()[:12]
    return base64.urlsafe_b64encode(digest).decode().rstrip("=")


def day_key_table(df: DataFrame, domain: bytes, label: str = DAY_LABEL) -> DataFrame:
    """Pads of every distinct `_day` of `df`: one HMAC per calendar day that occurs.

    Days are few, but their number is not assumed: they are a distributed table, and Spark
    broadcasts it in the join only if it is small.
    """
    def pads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [hmac.new(domain, _field(label) + _field(day), hashlib.sha256).digest() for day in pdf["_day"]]
            both = [key_pads(k) for k in keys]
            yield pd.DataFrame({"_day": pdf["_day"], "_inner": [p[0] for p in both], "_outer": [p[1] for p in both]})

    days = df.select("_day").filter("_day IS NOT NULL").distinct()
    return days.mapInPandas(pads, "_day string, _inner binary, _outer binary")


def pseudonymise(df: DataFrame, key: bytes, dataset: str, pilot: str,
                 domain_label: str = DOMAIN_LABEL, day_label: str = DAY_LABEL) -> DataFrame:
    """Replace `subject_ref` / `session_ref` by daily `subject_id` / `session_id`.

    A row without a time has no day and thus no key: it stays, with NULL ids. Split such rows
    off first (`without_day`) where they must not pass.
    """
    domain = domain_key(key, dataset, pilot, domain_label)
    df = df.withColumn("_day", utc_day(micros("observed_at")))
    df = df.join(day_key_table(df, domain, day_label), "_day", "left")

    def pseudonym(kind: str, *refs: str) -> Column:
        message = concat_bytes(F.lit(bytearray(_field(kind))), *[length_prefixed(r) for r in refs])
        return base64url(hmac_with_pads(F.col("_inner"), F.col("_outer"), message))

    has_session = F.coalesce(F.col("session_ref"), F.lit("")) != ""
    return df.withColumns({
        "subject_id": pseudonym("subject", "subject_ref"),
        "session_id": F.when(has_session, pseudonym("session", "subject_ref", "session_ref")),
    }).drop("_day", "_inner", "_outer", *DIRECT_REFERENCES)


def without_day(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a time, quarantine of the others with reason `time`)."""
    known = F.col("observed_at").isNotNull()
    return df.filter(known), df.filter(~known).withColumn("reason", F.lit("time"))


def assert_no_direct_refs(df: DataFrame) -> DataFrame:
    """`df` itself, or an error when a direct reference column is left (any depth)."""
    def names(schema, prefix="") -> list[str]:
        out = []
        for f in schema.fields:
            out.append(f.name)
            inner = getattr(f.dataType, "elementType", f.dataType)
            if hasattr(inner, "fields"):
                out += names(inner)
        return out

    left = set(names(df.schema)) & set(DIRECT_REFERENCES)
    if left:
        raise ValueError(f"direct references in output: {sorted(left)}")
    return df


def derive_key(master: bytes, label: str) -> bytes:
    """Purpose-bound key of a master key."""
    return hmac.new(master, label.encode(), hashlib.sha256).digest()


def session_key(session: Column | str, key: bytes) -> Column:
    """Log key of a session: 16 bytes of HMAC-SHA256 as base64url (22 characters)."""
    digest = hmac_sha256(key, utf8(session))
    return base64url(F.unhex(F.substring(F.hex(digest), 1, 32)))
