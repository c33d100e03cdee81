"""Codec state over an ordered sequence of chunks: transform each, then finish. Small wrappers of the libraries' own stream objects.

``total`` counts the output of a decompressor against its cap over all chunks. After finish every call raises.
"""

from __future__ import annotations

import io
import zlib

import pyarrow as pa
import zstandard

from ..kernels import codecs
from ..kernels.limits import SizeLimitError, StreamFinishedError, failed, level_of, max_output_of

CONCATENABLE = ("gzip", "zstd", "lz4")


class Context:
    def __init__(self, name: str):
        self.name, self.done = name, False

    def _open(self) -> None:
        if self.done:
            raise StreamFinishedError(self.name)

    def transform(self, chunk: bytes) -> bytes:
        self._open()
        return self._transform(chunk)

    def flush(self) -> bytes:
        self._open()
        return self._flush()

    def finish(self) -> bytes:
        self._open()
        out = self._finish()
        self.done = True
        return out

    def _flush(self) -> bytes:
        return b""


class DeflateCompress(Context):
    """gzip or raw deflate."""

    def __init__(self, codec: str, level: int | None = None):
        super().__init__(f"{codec} compress context")
        self.z = zlib.compressobj(level_of(codec, level), zlib.DEFLATED, codecs.GZIP if codec == "gzip" else codecs.RAW)

    def _transform(self, chunk):
        return self.z.compress(chunk)

    def _flush(self):
        return self.z.flush(zlib.Z_SYNC_FLUSH)

    def _finish(self):
        return self.z.flush()


class ZstdCompress(Context):
    def __init__(self, level: int | None = None, dictionary: bytes | None = None):
        super().__init__("zstd compress context")
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary is not None else None
        self.z = zstandard.ZstdCompressor(level_of("zstd", level), dict_data=d).compressobj()

    def _transform(self, chunk):
        return self.z.compress(chunk)

    def _flush(self):
        return self.z.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)

    def _finish(self):
        return self.z.flush()


class _Sink(io.RawIOBase):
    """What a compressing stream has written since it was last emptied."""

    def __init__(self):
        self.held = bytearray()

    def writable(self):
        return True

    def write(self, data):
        self.held += data
        return len(data)

    def drain(self) -> bytes:
        out, self.held = bytes(self.held), bytearray()
        return out


class ArrowCompress(Context):
    """brotli at Arrow's own quality, or an LZ4 frame, through Arrow's output stream: what it has written leaves with each chunk."""

    def __init__(self, codec: str):
        super().__init__(f"{codec} compress context")
        self.sink = _Sink()
        self.stream = pa.CompressedOutputStream(pa.PythonFile(self.sink, mode="w"), codec)

    def _transform(self, chunk):
        self.stream.write(chunk)
        return self.sink.drain()

    def _flush(self):
        self.stream.flush()
        return self.sink.drain()

    def _finish(self):
        out = self.sink
        out.close = lambda: None  # closing the stream closes its file, which has to be read first
        self.stream.close()
        return out.drain()


class BrotliCompress(Context):
    """brotli at a given quality: Arrow's output stream takes none, so the input is held until the end."""

    def __init__(self, level: int):
        super().__init__("brotli compress context")
        self.level, self.held = level_of("brotli", level), bytearray()

    def _transform(self, chunk):
        self.held += chunk
        return b""

    def _finish(self):
        return codecs.brotli_compress(bytes(self.held), self.level)


class Decompress(Context):
    """Any codec but raw concatenations of brotli; gzip members and zstd frames follow one another."""

    def __init__(self, codec: str, max_output_size=None, dictionary: bytes | None = None):
        super().__init__(f"{codec} decompress context")
        self.codec, self.cap, self.dictionary = codec, max_output_of(max_output_size), dictionary
        self.total, self.held, self.z, self.any = 0, bytearray(), None, False

    def _new(self):
        if self.codec == "zstd":
            d = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary is not None else None
            return zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        return zlib.decompressobj(codecs.GZIP if self.codec == "gzip" else codecs.RAW)

    def _counted(self, out: bytes) -> bytes:
        self.total += len(out)
        if self.total > self.cap:
            raise SizeLimitError(f"{self.codec} decompress", self.cap)
        return out

    def _transform(self, chunk):
        if self.codec in ("brotli", "lz4"):
            self.held += chunk
            return b""
        out, data = bytearray(), bytes(chunk)
        try:
            while data:
                self.z = self.z or self._new()
                self.any = True
                rest = b""
                if self.codec == "zstd":
                    rest = codecs.inflate_zstd(self.z, data, self.cap - self.total, out)
                else:
                    out += self.z.decompress(data, self.cap + 1 - self.total - len(out))
                if self.total + len(out) > self.cap:
                    raise SizeLimitError(f"{self.codec} decompress", self.cap)
                if not self.z.eof:
                    break
                data = {"zstd": rest, "deflate": b""}.get(self.codec, self.z.unused_data)
                self.z = None
        except (zlib.error, zstandard.ZstdError) as e:
            raise failed(f"{self.codec} decompress", e) from None
        return self._counted(bytes(out))

    def _flush(self):
        if self.codec not in ("brotli", "lz4") or not self.held:
            return b""
        data, self.held = bytes(self.held), bytearray()
        return self._counted(codecs.DECOMPRESS[self.codec](data, self.cap - self.total))

    def _finish(self):
        out = self._flush()
        if self.z is not None:
            raise failed(f"{self.codec} decompress", "unexpected end of file")
        return out


class AutoDecompress(Context):
    """Waits for four bytes, or the end, then decompresses by what they say; raw deflate is not offered."""

    def __init__(self, max_output_size=None):
        super().__init__("decompress context")
        self.limit, self.inner, self.held = max_output_size, None, bytearray()
        max_output_of(max_output_size)

    def _start(self) -> bytes:
        data = bytes(self.held)
        kind = codecs.detect(data)
        if kind == "unknown":
            raise failed("decompress", "unable to detect compression format from stream data")
        self.inner = Decompress(kind, self.limit)
        return self.inner.transform(data)

    def _transform(self, chunk):
        if self.inner:
            return self.inner.transform(chunk)
        self.held += chunk
        # brotli has no magic, so its few first bytes do not tell: it is recognised at the end
        known = any(self.held.startswith(m) for m in codecs.MAGIC.values())
        return self._start() if known and len(self.held) >= 4 else b""

    def _finish(self):
        out = b""
        if not self.inner:
            if not self.held:
                return b""
            out = self._start()
        return out + self.inner.finish()


def compressor(codec: str, level: int | None = None, dictionary: bytes | None = None) -> Context:
    if dictionary is not None and codec != "zstd":
        raise NotImplementedError(f"{codec} with a dictionary: no library at hand offers it")
    if codec in ("gzip", "deflate"):
        return DeflateCompress(codec, level)
    if codec == "zstd":
        return ZstdCompress(level, dictionary)
    return BrotliCompress(level) if codec == "brotli" and level is not None else ArrowCompress(codec)


def decompressor(codec: str, max_output_size=None, dictionary: bytes | None = None) -> Context:
    if dictionary is not None and codec != "zstd":
        raise NotImplementedError(f"{codec} with a dictionary: no library at hand offers it")
    return AutoDecompress(max_output_size) if codec == "auto" else Decompress(codec, max_output_size, dictionary)
