"""Codecs as Column expressions over Arrow batches.

Null in, null out. A literal argument out of range raises where the Column is built; bad data fails the task. ``on_error="null"``
gives null for a bad row instead, ``on_error="result"`` a struct (ok, value, error).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..kernels import codecs, header
from ..kernels.limits import LEVELS, CodecError, capacity_of, level_of

BINARY = T.BinaryType()
HEADER = T.StructType(
    [T.StructField("filename", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("comment", T.StringType()), T.StructField("os", T.IntegerType()), T.StructField("extra", BINARY)]
)
#: Rows of a batch that are Python objects at once.
SLICE = 64
_ARROW = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}
_HEADER = pa.struct([("filename", pa.string()), ("mtime", pa.int64()), ("comment", pa.string()), ("os", pa.int32()), ("extra", pa.binary())])


def _bytes(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("binary")


def _apply(kernel: Callable[..., Any], cols: list[Column], kind: T.DataType = BINARY, on_error: str = "raise", once: bool = False) -> Column:
    """``kernel`` over rows: null if the first argument is. ``once`` keeps the optimizer from moving or repeating the call."""
    if on_error not in ("raise", "null", "result"):
        raise ValueError("on_error must be raise, null or result")
    arrow = _HEADER if kind == HEADER else _ARROW[kind.simpleString()]
    result = on_error == "result"
    out = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", kind), T.StructField("error", T.StringType())]) if result else kind
    arrow_out = pa.struct([("ok", pa.bool_()), ("value", arrow), ("error", pa.string())]) if result else arrow

    def one(args: tuple) -> Any:
        if args[0] is None:
            return None
        try:
            value = kernel(*args)
        except (CodecError, ValueError) as e:
            if on_error == "raise":
                raise
            return {"ok": False, "value": None, "error": str(e)} if result else None
        return {"ok": True, "value": value, "error": None} if result else value

    def run(*arrays: pa.Array) -> pa.Array:
        # a few rows at a time are Python objects, whose freed memory the next ones take; a batch's would leave the heap in holes
        parts = [pa.array([one(args) for args in zip(*(a.slice(k, SLICE).to_pylist() for a in arrays), strict=True)], arrow_out) for k in range(0, len(arrays[0]), SLICE)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else pa.array([], arrow_out)

    # type hints tell Spark what kind of function it is
    def one_column(a: pa.Array) -> pa.Array:
        return run(a)

    def two_columns(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def three_columns(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    udf = F.arrow_udf((one_column, two_columns, three_columns)[len(cols) - 1], out)
    return (udf.asNondeterministic() if once else udf)(*cols)


def compress(col: Column | str, codec: str, level: int | None = None, on_error: str = "raise", once: bool = False) -> Column:
    kernel, level = codecs.COMPRESS[codec], level_of(codec, level)
    return _apply((lambda b: kernel(b)) if level is None else (lambda b: kernel(b, level)), [_bytes(col)], on_error=on_error, once=once)


def decompress_as(col: Column | str, codec: str, capacity=None, on_error: str = "raise") -> Column:
    kernel, cap = codecs.DECOMPRESS[codec], capacity_of(capacity)
    return _apply((lambda b: kernel(b)) if cap is None else (lambda b: kernel(b, cap)), [_bytes(col)], on_error=on_error)


def decompress(col: Column | str, capacity=None, on_error: str = "raise") -> Column:
    """By the detected format: zstd, gzip, lz4 or brotli."""
    cap = capacity_of(capacity)
    return _apply(lambda b: codecs.auto_decompress(b, cap), [_bytes(col)], on_error=on_error)


def gzip_compress(col, level=None, on_error="raise"):
    return compress(col, "gzip", level, on_error)


def gzip_decompress(col, on_error="raise"):
    return decompress_as(col, "gzip", None, on_error)


def gzip_decompress_with_capacity(col, capacity, on_error="raise"):
    return decompress_as(col, "gzip", capacity, on_error)


def deflate_compress(col, level=None, on_error="raise"):
    return compress(col, "deflate", level, on_error)


def deflate_decompress(col, on_error="raise"):
    return decompress_as(col, "deflate", None, on_error)


def deflate_decompress_with_capacity(col, capacity, on_error="raise"):
    return decompress_as(col, "deflate", capacity, on_error)


def zstd_compress(col, level=None, on_error="raise"):
    return compress(col, "zstd", level, on_error)


def zstd_decompress(col, on_error="raise"):
    return decompress_as(col, "zstd", None, on_error)


def zstd_decompress_with_capacity(col, capacity, on_error="raise"):
    return decompress_as(col, "zstd", capacity, on_error)


def brotli_compress(col, quality=None, on_error="raise"):
    return compress(col, "brotli", quality, on_error)


def brotli_decompress(col, on_error="raise"):
    return decompress_as(col, "brotli", None, on_error)


def brotli_decompress_with_capacity(col, capacity, on_error="raise"):
    return decompress_as(col, "brotli", capacity, on_error)


def lz4_compress(col, on_error="raise"):
    return compress(col, "lz4", None, on_error)


def lz4_decompress(col, on_error="raise"):
    return decompress_as(col, "lz4", None, on_error)


def lz4_decompress_with_capacity(col, capacity, on_error="raise"):
    return decompress_as(col, "lz4", capacity, on_error)


def zstd_compress_with_dict(col, dictionary: bytes, level=None, on_error="raise"):
    """The dictionary travels with the function; it is bounded by the size it was trained to."""
    level = level_of("zstd", level)
    return _apply(lambda b: codecs.zstd_compress(b, level, dictionary), [_bytes(col)], on_error=on_error)


def zstd_decompress_with_dict(col, dictionary: bytes, on_error="raise"):
    return _apply(lambda b: codecs.zstd_decompress(b, None, dictionary), [_bytes(col)], on_error=on_error)


def zstd_decompress_with_dict_with_capacity(col, dictionary: bytes, capacity, on_error="raise"):
    cap = capacity_of(capacity)
    return _apply(lambda b: codecs.zstd_decompress(b, cap, dictionary), [_bytes(col)], on_error=on_error)


def _no_brotli_dictionary(*_args, **_kw):
    raise NotImplementedError("brotli with a dictionary: no library at hand offers it")


brotli_compress_with_dict = brotli_decompress_with_dict = brotli_decompress_with_dict_with_capacity = _no_brotli_dictionary


def detect_format(col: Column | str) -> Column:
    """zstd, gzip, lz4, brotli or unknown. Magic bytes are compared natively; only rows without any go to a decoder."""
    b = _bytes(col)
    head = F.hex(F.substring(b, 1, 4))
    magic = F.when(head == "28B52FFD", "zstd").when(head.startswith("1F8B"), "gzip").when(head == "04224D18", "lz4")
    probe = _apply(lambda x: "brotli" if codecs.is_brotli(x) else "unknown", [F.when(magic.isNull(), b)], T.StringType())
    return F.when(b.isNotNull(), F.coalesce(magic, probe))


def crc32(col: Column | str, initial: Column | int | None = None) -> Column:
    """IEEE CRC-32; ``initial`` is the checksum of what came before."""
    b = _bytes(col)
    if initial is None:
        return F.crc32(b)
    import zlib

    return _apply(lambda x, y: zlib.crc32(x, y or 0), [b, initial if isinstance(initial, Column) else F.lit(initial).cast("bigint")], T.LongType())


def gzip_compress_with_header(col, filename: Column | str | None = None, mtime: Column | int | None = None, level=None, on_error="raise"):
    """``filename`` is a Column or a literal name; ``mtime`` whole seconds."""
    level = level_of("gzip", level)
    name = filename if isinstance(filename, Column) else F.lit(filename).cast("string")
    time = mtime if isinstance(mtime, Column) else F.lit(mtime).cast("bigint")
    return _apply(lambda b, f, m: header.compress_with_header(b, f, m, level), [_bytes(col), name, time], on_error=on_error)


def gzip_read_header(col, on_error="raise"):
    """Struct of filename, mtime, comment, os, extra. Nothing is inflated, and of large values only the first 128 KiB travel, unless the header goes on behind them."""
    b = _bytes(col)
    large = F.octet_length(b) > 1 << 17
    prefix = F.substring(b, 1, 1 << 17)
    goes_on = _apply(lambda x: "yes" if header.goes_on(x) else "no", [F.when(large, prefix)], T.StringType()) == "yes"
    return _apply(header.read_header, [F.when(large & ~goes_on, prefix).otherwise(b)], HEADER, on_error)


def version() -> Column:
    return F.lit(__version__)


#: Functions whose asynchronous twins are the same expression: Spark's tasks already run off the caller's thread.
ASYNC = [
    f"{c}_{f}"
    for c in (*LEVELS, "lz4")
    for f in ("compress", "decompress", "decompress_with_capacity", *(("compress_with_dict", "decompress_with_dict", "decompress_with_dict_with_capacity") if c in ("zstd", "brotli") else ()))
] + ["decompress"]
for _name in ASYNC:
    globals()[f"{_name}_async"] = globals()[_name]
