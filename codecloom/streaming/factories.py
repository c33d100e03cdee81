"""A stream transform per codec and direction: ``make(level)`` or ``make(max_output_size)`` gives a function of chunk rows.

    zip_stream = gzip_compress_stream(9)
    packed = zip_stream(df, "id", "seq", "chunk")

On a streaming DataFrame (columns id, seq, chunk, last) the same function is called with the DataFrame alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .chunks import _context, stream_codec, stream_codec_streaming

Transform = Callable[..., DataFrame]


def _transform(codec: str, direction: str, **how) -> Transform:
    _context(codec, direction, how.get("level"), how.get("max_output_size"), how.get("dictionary"))  # bad arguments raise here

    def run(df: DataFrame, id_col: str = "id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
        if df.isStreaming:
            return stream_codec_streaming(df, codec, direction, **how)
        return stream_codec(df, id_col, seq_col, chunk_col, codec, direction, **how)

    return run


def gzip_compress_stream(level: int | None = None) -> Transform:
    return _transform("gzip", "compress", level=level)


def gzip_decompress_stream(max_output_size=None) -> Transform:
    return _transform("gzip", "decompress", max_output_size=max_output_size)


def deflate_compress_stream(level: int | None = None) -> Transform:
    return _transform("deflate", "compress", level=level)


def deflate_decompress_stream(max_output_size=None) -> Transform:
    return _transform("deflate", "decompress", max_output_size=max_output_size)


def zstd_compress_stream(level: int | None = None) -> Transform:
    return _transform("zstd", "compress", level=level)


def zstd_decompress_stream(max_output_size=None) -> Transform:
    return _transform("zstd", "decompress", max_output_size=max_output_size)


def brotli_compress_stream(quality: int | None = None) -> Transform:
    return _transform("brotli", "compress", level=quality)


def brotli_decompress_stream(max_output_size=None) -> Transform:
    return _transform("brotli", "decompress", max_output_size=max_output_size)


def lz4_compress_stream() -> Transform:
    return _transform("lz4", "compress")


def lz4_decompress_stream(max_output_size=None) -> Transform:
    return _transform("lz4", "decompress", max_output_size=max_output_size)


def zstd_compress_dict_stream(dictionary: bytes, level: int | None = None) -> Transform:
    return _transform("zstd", "compress", level=level, dictionary=dictionary)


def zstd_decompress_dict_stream(dictionary: bytes, max_output_size=None) -> Transform:
    return _transform("zstd", "decompress", max_output_size=max_output_size, dictionary=dictionary)


def brotli_compress_dict_stream(dictionary: bytes, quality: int | None = None) -> Transform:
    """Raises NotImplementedError: no library at hand offers brotli with a dictionary."""
    return _transform("brotli", "compress", level=quality, dictionary=dictionary)


def brotli_decompress_dict_stream(dictionary: bytes, max_output_size=None) -> Transform:
    """Raises NotImplementedError: no library at hand offers brotli with a dictionary."""
    return _transform("brotli", "decompress", max_output_size=max_output_size, dictionary=dictionary)


def decompress_stream(max_output_size=None) -> Transform:
    """By detected format, once four bytes have come."""
    return _transform("auto", "decompress", max_output_size=max_output_size)
