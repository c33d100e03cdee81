"""Codecs side by side on a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as cf

CODECS = ("zstd", "gzip", "brotli", "lz4")


def savings(raw: Column, packed: Column) -> Column:
    """Percent saved; negative where compression enlarges, 0 for empty input."""
    return F.when(raw > 0, (1 - packed / raw) * 100).otherwise(F.lit(0.0))


def compare_codecs(df: DataFrame, key: str, col: str, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """A row per input row and codec: key, codec, raw_len, packed_len, savings, best (of the row, ties to all)."""
    b = F.col(col).cast("binary")
    wide = df.select(key, F.octet_length(b).cast("long").alias("raw_len"), *(F.octet_length(cf.compress(b, c)).cast("long").alias(f"len_{c}") for c in codecs))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(f"len_{c}").alias("packed_len")) for c in codecs))).alias("x")
    least = F.least(*(f"len_{c}" for c in codecs))
    return wide.select(key, "raw_len", least.alias("least"), each).select(key, "x.codec", "raw_len", "x.packed_len", savings(F.col("raw_len"), F.col("x.packed_len")).alias("savings"), (F.col("x.packed_len") == F.col("least")).alias("best"))
