"""One value in, one value out: compression and decompression of byte strings, run over Arrow batches inside tasks.

Thin calls of zlib, zstandard and Arrow's codecs, with the checks that these leave out: output caps, empty input, several members.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
import zstandard

from .limits import MAX_OUTPUT, SizeLimitError, failed

RAW, GZIP = -15, 31
#: The first bytes of each format.
MAGIC = {"zstd": b"\x28\xb5\x2f\xfd", "gzip": b"\x1f\x8b", "lz4": b"\x04\x22\x4d\x18"}


def _deflate(data: bytes, level: int, wbits: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, wbits)
    return c.compress(data) + c.flush()


def gzip_compress(data: bytes, level: int = 6) -> bytes:
    return _deflate(data, level, GZIP)


def deflate_compress(data: bytes, level: int = 6) -> bytes:
    return _deflate(data, level, RAW)


def gzip_decompress(data: bytes, cap: int = MAX_OUTPUT) -> bytes:
    """All members, one after another; empty input is an error."""
    if not data:
        raise failed("gzip decompress", "unexpected end of file")
    out = bytearray()
    while data:
        d = zlib.decompressobj(GZIP)
        try:
            out += d.decompress(data, cap + 1 - len(out))
        except zlib.error as e:
            raise failed("gzip decompress", e) from None
        if len(out) > cap:
            raise SizeLimitError("gzip decompress", cap)
        if not d.eof:
            raise failed("gzip decompress", "unexpected end of file")
        data = d.unused_data
    return bytes(out)


def deflate_decompress(data: bytes, cap: int = MAX_OUTPUT) -> bytes:
    """Raw deflate; empty input gives empty output."""
    if not data:
        return b""
    d = zlib.decompressobj(RAW)
    try:
        out = d.decompress(data, cap + 1)
    except zlib.error as e:
        raise failed("deflate decompress", e) from None
    if len(out) > cap:
        raise SizeLimitError("deflate decompress", cap)
    if not d.eof:
        raise failed("deflate decompress", "unexpected end of file")
    return out


@lru_cache(maxsize=16)
def _zstd_compressor(level: int, dictionary: bytes | None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary is not None else None)


@lru_cache(maxsize=16)
def _zstd_decompressor(dictionary: bytes | None) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary is not None else zstandard.ZstdDecompressor()


#: Most that zstd makes of four bytes: a block of one repeated byte.
_ZSTD_BLOCK = 1 << 17


def inflate_zstd(d: zstandard.ZstdDecompressionObj, data: bytes, cap: int, out: bytearray) -> bytes:
    """Appends what ``d`` makes of ``data`` to ``out``, up to the frame's end or a little beyond ``cap`` bytes; gives back what follows the frame.

    The object cannot be told a size, so it is fed slices that cannot hold much more than there is room for.
    """
    at, view = 0, memoryview(data)
    while at < len(data) and not d.eof and len(out) <= cap:
        size = max(64, min(1 << 16, (cap - len(out)) * 4 // _ZSTD_BLOCK))
        out += d.decompress(view[at : at + size])
        at += size
    return d.unused_data + bytes(view[at:]) if d.eof else b""


def zstd_compress(data: bytes, level: int = 3, dictionary: bytes | None = None) -> bytes:
    return _zstd_compressor(level, dictionary).compress(data)


def zstd_decompress(data: bytes, cap: int | None = None, dictionary: bytes | None = None) -> bytes:
    """Frames one after another; the cap is the output buffer's size, so going over it is the codec's own error.

    Without a cap the first frame's header sizes the buffer, from 1024 bytes to MAX_OUTPUT.
    """
    context = "zstd decompress with dict" if dictionary is not None else "zstd decompress"
    if not data:
        return b""
    try:
        size = zstandard.get_frame_parameters(data).content_size
        known = size not in (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
        if cap is None:
            cap = max(1024, min(size, MAX_OUTPUT) if known else MAX_OUTPUT)
        if known and size > cap:
            raise failed(context, "Destination buffer is too small")
        out = bytearray()
        while data:
            d = _zstd_decompressor(dictionary).decompressobj()
            data = inflate_zstd(d, data, cap, out)
            if len(out) > cap:
                raise failed(context, "Destination buffer is too small")
            if not d.eof:
                raise failed(context, "Src size is incorrect")
        return bytes(out)
    except zstandard.ZstdError as e:
        raise failed(context, e) from None


#: Bytes that an Arrow decoder is asked for at once.
_STEP = 1 << 16


def _arrow_decompress(codec: str, data: bytes, cap: int) -> bytes:
    """Read in steps and as buffers: read() allots all that it is asked for, and never frees that where the decoder fails."""
    out = bytearray()
    try:
        with pa.CompressedInputStream(pa.BufferReader(data), codec) as r:
            while len(out) <= cap:
                part = r.read_buffer(min(_STEP, cap + 1 - len(out)))
                if not part.size:
                    break
                out += part
    except (OSError, pa.ArrowException) as e:
        raise failed(f"{codec} decompress", e) from None
    if len(out) > cap:
        raise SizeLimitError(f"{codec} decompress", cap)
    return bytes(out)


def brotli_compress(data: bytes, level: int = 6) -> bytes:
    return pa.Codec("brotli", compression_level=level).compress(data, asbytes=True)


def brotli_decompress(data: bytes, cap: int = MAX_OUTPUT) -> bytes:
    if not data:
        raise failed("brotli decompress", "unexpected end of file")
    return _arrow_decompress("brotli", data, cap)


def lz4_compress(data: bytes) -> bytes:
    """LZ4 frame format."""
    return pa.Codec("lz4").compress(data, asbytes=True)


def lz4_decompress(data: bytes, cap: int = MAX_OUTPUT) -> bytes:
    if not data:
        return b""
    return _arrow_decompress("lz4", data, cap)


def is_brotli(data: bytes) -> bool:
    """Whether a brotli decoder yields a byte."""
    try:
        with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as r:
            return bool(data) and bool(r.read_buffer(1).size)
    except (OSError, pa.ArrowException):
        return False


def detect(data: bytes) -> str:
    for name, magic in MAGIC.items():
        if data.startswith(magic):
            return name
    return "brotli" if is_brotli(data) else "unknown"


def auto_decompress(data: bytes, cap: int | None = None) -> bytes:
    """By the detected format; raw deflate cannot be detected."""
    kind = detect(data)
    if kind == "unknown":
        raise failed("decompress", "unable to detect compression format; expected zstd, gzip, brotli, or lz4")
    return DECOMPRESS[kind](data) if cap is None else DECOMPRESS[kind](data, cap)


COMPRESS = {"gzip": gzip_compress, "deflate": deflate_compress, "zstd": zstd_compress, "brotli": brotli_compress, "lz4": lz4_compress}
DECOMPRESS = {"gzip": gzip_decompress, "deflate": deflate_decompress, "zstd": zstd_decompress, "brotli": brotli_decompress, "lz4": lz4_decompress}
