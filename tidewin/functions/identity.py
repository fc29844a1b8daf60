"""Fingerprints of JSON values and files, and seeds derived from them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(value: object) -> str:
    """SHA-256 of the value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def seed_for(seed: int, *identity: object) -> int:
    """An unsigned 64-bit seed from a base seed and an identity."""
    return int(fingerprint([seed, *identity])[:16], 16)


def seed_column(text: Column) -> Column:
    """The same from a column that holds the JSON text, as decimal text (it may exceed a signed long)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)


def file_digests(files: DataFrame) -> DataFrame:
    """path and SHA-256 of a `binaryFile` frame."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose digest differs or that are on one side only."""
    both = before.withColumnRenamed("sha256", "_a").join(after.withColumnRenamed("sha256", "_b"), "path", "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path")
