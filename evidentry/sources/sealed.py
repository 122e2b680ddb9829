"""Authenticated encryption of records as a binary column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AAD_LABEL = "evidentry:sealed:v1"


def _aad(source: Column, seq: Column, label: str) -> Column:
    """The record's position is authenticated, so records cannot be moved or swapped."""
    return F.concat_ws("|", F.lit(label), source, seq.cast("string"))


def encrypt_records(df: DataFrame, key: bytes, source: str = "source", seq: str = "seq",
                    label: str = AAD_LABEL) -> DataFrame:
    """(source, seq, sealed): AES-GCM of every row with a fresh random nonce.

    `seq` counts 0, 1, 2 ... within `source`; gaps are found when decrypting.
    """
    body = F.to_json(F.struct(*[c for c in df.columns if c not in (source, seq)]),
                     {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    sealed = F.aes_encrypt(body.cast("binary"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"),
                           F.lit(bytearray()), _aad(F.col(source), F.col(seq), label))
    return df.select(source, seq, sealed.alias("sealed"))


def decrypt_records(df: DataFrame, key: bytes, schema: str, source: str = "source", seq: str = "seq",
                    label: str = AAD_LABEL) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): a wrong key, changed bytes or a moved record is rejected."""
    plain = F.try_aes_decrypt(F.col("sealed"), F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"),
                              _aad(F.col(source), F.col(seq), label))
    opened = df.withColumn("_plain", plain.cast("string"))
    rows = opened.filter("_plain IS NOT NULL").select(
        source, seq, F.from_json("_plain", schema, {
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}).alias("_r")).select(source, seq, "_r.*")
    return rows, opened.filter("_plain IS NULL").select(source, seq)


def check_counters(df: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """(source, records, contiguous): seq must be exactly 0 .. records-1.

    A source of distinct positions is contiguous when its range equals its count, so
    no source has to be sorted.
    """
    distinct = df.groupBy(source, seq).agg(F.count(F.lit(1)).alias("_n"))
    return distinct.groupBy(source).agg(
        F.sum("_n").cast("long").alias("records"),
        ((F.max("_n") == 1) & (F.min(seq) == 0) & (F.max(seq) == F.count(F.lit(1)) - 1)).alias("contiguous"))
