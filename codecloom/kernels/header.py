"""gzip headers (RFC 1952): written with a name and a time, read without inflating."""

from __future__ import annotations

import struct
import zlib

from .codecs import deflate_compress
from .limits import CodecError, failed

FHCRC, FEXTRA, FNAME, FCOMMENT = 2, 4, 8, 16
UNKNOWN_OS = 255


def compress_with_header(data: bytes, filename: str | None = None, mtime: int | None = None, level: int = 6) -> bytes:
    name = filename.encode() if filename is not None else b""
    if b"\0" in name:
        raise ValueError("gzip filename must not hold a null byte")
    extra = 2 if level == 9 else 4 if level == 1 else 0
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, FNAME if filename is not None else 0, mtime or 0, extra, UNKNOWN_OS)
    return head + (name + b"\0" if filename is not None else b"") + deflate_compress(data, level) + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def read_header(data: bytes) -> dict:
    """filename, mtime, comment, os, extra of the first member."""
    if len(data) < 10 or data[:2] != b"\x1f\x8b" or data[2] != 8:
        raise failed("gzip read header", "invalid gzip header")
    flags, mtime, os = data[3], *struct.unpack_from("<I", data, 4), data[9]
    at = 10
    extra = None
    if flags & FEXTRA:
        if len(data) < at + 2 or len(data) < at + 2 + (n := struct.unpack_from("<H", data, at)[0]):
            raise failed("gzip read header", "unexpected end of file")
        extra, at = data[at + 2 : at + 2 + n], at + 2 + n
    texts = []
    for flag in (FNAME, FCOMMENT):
        if flags & flag:
            end = data.find(b"\0", at)
            if end < 0:
                raise failed("gzip read header", "unexpected end of file")
            texts.append(data[at:end].decode("utf-8", "replace"))
            at = end + 1
        else:
            texts.append(None)
    if flags & FHCRC and len(data) < at + 2:
        raise failed("gzip read header", "unexpected end of file")
    return {"filename": texts[0], "mtime": mtime, "comment": texts[1], "os": os, "extra": extra}


def goes_on(prefix: bytes) -> bool:
    """Whether a gzip header doesn't end within the first bytes of a value."""
    try:
        read_header(prefix)
    except CodecError as e:
        return str(e).endswith("unexpected end of file")
    return False
