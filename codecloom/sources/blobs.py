"""Compressed blobs as rows: read from files, decompressed by detected format, written as chunks or as files of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as cf


def read_compressed(spark: SparkSession, path: str, glob: str | None = None, on_error: str = "raise") -> DataFrame:
    """path, length, format, content (decompressed) of each file. A row inflates in one task; see ``stream_codec`` for larger ones."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select("path", "length", cf.detect_format("content").alias("format"), cf.decompress("content", on_error=on_error).alias("content"))


def to_chunks(df: DataFrame, id_col: str, col: str, size: int) -> DataFrame:
    """id, seq, chunk: a binary column cut into pieces of ``size`` bytes; an empty or null value gives one empty chunk."""
    if size < 1:
        raise ValueError("size must be at least 1")
    b = F.coalesce(F.col(col).cast("binary"), F.lit(b""))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(b) / size) - 1).cast("long")
    cut = df.select(F.col(id_col).alias("id"), b.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    return cut.select("id", "seq", F.substring("b", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("chunk"))


def cut_chunks(df: DataFrame, size: int) -> DataFrame:
    """id, seq, chunk: chunks cut into pieces of ``size`` bytes, in the same order (seq below 2 ** 31); no stream is joined."""
    pieces = to_chunks(df.withColumn("key", F.struct("id", "seq")), "key", "chunk", size)
    return pieces.select("id.id", (F.shiftleft("id.seq", 32) + F.col("seq")).alias("seq"), "chunk")


def from_chunks(df: DataFrame, id_col: str = "id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """id, data: each stream's chunks joined in order. A stream must fit a row, in hex digits too; see ``stream_digests`` for one of any length."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("seq"), F.col(chunk_col).alias("chunk"))))
    # joined as hex digits: joining binaries one by one would copy the first ones again with each
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["chunk"])), ""))
    return df.groupBy(F.col(id_col).alias("id")).agg(joined.alias("data"))


def write_compressed_lines(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """A text column to gzip files by Spark's own writer. Its deflate and lz4 files have other wire formats, so only gzip is taken."""
    if codec != "gzip":
        raise ValueError("only gzip files of Spark's writer share the codecs' wire format")
    df.write.option("compression", "gzip").text(path)
