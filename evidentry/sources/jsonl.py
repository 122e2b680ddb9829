"""Strict JSON Lines: unknown fields, duplicate keys, blank lines and trailing values fail."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeline import stored
from ..schemas import LOCAL_INPUT


class _Rejected(ValueError):
    pass


def _no_duplicates(pairs):
    seen = dict(pairs)
    if len(seen) != len(pairs):
        raise _Rejected("duplicate_key")
    return seen


def _no_constant(name):
    raise _Rejected("invalid_json")


def _conforms(kind: T.DataType) -> Callable[[object], str | None]:
    """A check that gives the first difference between a parsed value and the schema."""
    if isinstance(kind, T.StructType):
        fields = {f.name: _conforms(f.dataType) for f in kind.fields}

        def struct(value):
            if value is None:
                return None
            if not isinstance(value, dict):
                return "wrong_type"
            if not value.keys() <= fields.keys():
                return "unknown_field"
            for k, v in value.items():
                problem = fields[k](v)
                if problem is not None:
                    return problem
            return None
        return struct
    if isinstance(kind, T.ArrayType):
        element = _conforms(kind.elementType)

        def array(value):
            if value is None:
                return None
            return next((p for v in value if (p := element(v))), None) if isinstance(value, list) else "wrong_type"
        return array
    if isinstance(kind, T.BooleanType):
        types, never = bool, ()
    elif isinstance(kind, T.IntegralType):
        types, never = int, bool
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        types, never = (int, float), bool
    else:
        types, never = str, ()
    return lambda value: None if value is None or (isinstance(value, types) and not isinstance(value, never)) else "wrong_type"


def strict_reason(line: Column, schema: T.StructType) -> Column:
    """Why a text line is not exactly one object of `schema`, else NULL.

    The built-in JSON functions ignore unknown fields and trailing text, so this one
    check runs in Python, on Arrow batches of the text column only.
    """
    @F.pandas_udf("string")
    def check(lines: pd.Series) -> pd.Series:
        decode = json.JSONDecoder(object_pairs_hook=_no_duplicates, parse_constant=_no_constant).decode
        conforms = _conforms(schema)

        def one(text: str) -> str | None:
            if text is None or not text.strip():
                return "blank_line"
            try:
                value = decode(text)
            except _Rejected as e:
                return str(e)
            except (ValueError, RecursionError):
                return "invalid_json"
            return conforms(value) if isinstance(value, dict) else "wrong_type"
        return lines.map(one)

    return check(line)


MAX_LINE_BYTES = 1 << 20


def parse_strict(lines: DataFrame, schema: str, column: str = "value",
                 max_line_bytes: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, quarantine with `reason` and the raw text).

    Lines above `max_line_bytes` are not parsed; they go to quarantine whole, as `line_too_long`.
    The lines are checked and parsed once, and both results read what was written of it.
    """
    kind = T._parse_datatype_string(schema)
    long = F.octet_length(column) > max_line_bytes
    checked = strict_reason(F.when(~F.coalesce(long, F.lit(False)), F.col(column)), kind)
    marked = lines.withColumn("reason", F.when(long, F.lit("line_too_long")).otherwise(checked))
    good = F.col("reason").isNull()
    read = stored(marked.withColumns({"_r": F.when(good, F.from_json(column, kind)), column: F.when(~good, F.col(column))}), "strict-lines")
    rest = [c for c in lines.columns if c != column]
    return read.filter(good).select(*rest, "_r.*"), read.filter(~good).select(*lines.columns, "reason")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their input position.

    A split of a file is read in order by one task, so (`source`, `line_no`) orders all
    lines: `source` is the file with the split's offset, `line_no` rises within it.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"))
    return raw.select(
        F.concat("_f", F.lit("#"), F.lpad(F.col("_o").cast("string"), 20, "0")).alias("source_split"),
        F.monotonically_increasing_id().alias("line_no"),
        "value")


def read_evidence_jsonl(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) of local evidence in JSON Lines, contract included.

    Quarantine has the reason and, for lines that are no record at all, their text (`value`);
    records that break the contract are given back as JSON in the same column.
    """
    from ..operators.contracts import LOCAL_INPUT_VERSION, validate_evidence

    parsed, broken = parse_strict(read_lines(spark, path), LOCAL_INPUT)
    valid, bad = validate_evidence(parsed, version or LOCAL_INPUT_VERSION)
    keep = ["source_split", "line_no", "reason"]
    fields = [c for c in bad.columns if c not in keep]
    return valid, broken.select(*keep, "value").unionByName(
        bad.select(*keep, F.to_json(F.struct(*fields)).alias("value")))
