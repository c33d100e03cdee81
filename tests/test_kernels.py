"""Codecs, limits and headers as plain functions; other libraries read what they write."""

import gzip
import io
import math
import random
import zlib

import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from codecloom.kernels import codecs, header, limits
from codecloom.streaming import contexts

rng = random.Random(7)
PAYLOADS = {
    "empty": b"",
    "one_byte": b"\x2a",
    "repeat_1k": b"a" * 1024,
    "pattern_1m": bytes(i % 256 for i in range(1 << 20)),
    "repeat_10k": b"x" * 10_000,
    "random_1k": rng.randbytes(1024),
    "edge_text": b"some text of twenty-six b." * 100,
}
ALL = list(codecs.COMPRESS)


@pytest.mark.parametrize("codec", ALL)
@pytest.mark.parametrize("name", PAYLOADS)
def test_round_trip(codec, name):
    data = PAYLOADS[name]
    assert codecs.DECOMPRESS[codec](codecs.COMPRESS[codec](data)) == data


def test_other_libraries_read_it():
    data = PAYLOADS["edge_text"]
    assert gzip.decompress(codecs.gzip_compress(data)) == data
    assert zlib.decompress(codecs.deflate_compress(data), -15) == data
    assert pa.Codec("zstd").decompress(codecs.zstd_compress(data), len(data), asbytes=True) == data
    assert pa.CompressedInputStream(io.BytesIO(codecs.brotli_compress(data)), "brotli").read() == data
    assert codecs.zstd_decompress(pa.Codec("zstd").compress(data, asbytes=True)) == data
    assert codecs.gzip_decompress(gzip.compress(data)) == data


@pytest.mark.parametrize(
    "codec, level, ok",
    [("zstd", v, ok) for v, ok in ((-131073, 0), (-131072, 1), (-1, 1), (0, 1), (1, 1), (22, 1), (23, 0))]
    + [(c, v, ok) for c in ("gzip", "deflate") for v, ok in ((-1, 0), (0, 1), (9, 1), (10, 0), (100, 0))]
    + [("brotli", v, ok) for v, ok in ((0, 1), (11, 1), (12, 0))],
)
def test_levels(codec, level, ok):
    if ok:
        data = PAYLOADS["edge_text"]
        assert codecs.DECOMPRESS[codec](codecs.COMPRESS[codec](data, limits.level_of(codec, level))) == data
    else:
        with pytest.raises(ValueError, match="must be between"):
            limits.level_of(codec, level)


def test_level_zero_of_zstd_is_its_default():
    data = PAYLOADS["edge_text"]
    assert codecs.zstd_compress(data, limits.level_of("zstd", 0)) == codecs.zstd_compress(data, 3)


@pytest.mark.parametrize("value", [-1, math.nan, math.inf, 1.5, 1.8e308])
def test_bad_capacity(value):
    with pytest.raises(ValueError, match="capacity must be a non-negative integer"):
        limits.capacity_of(value)


@pytest.mark.parametrize("value", [math.nan, math.inf, -math.inf, -1])
def test_bad_output_cap(value):
    with pytest.raises(ValueError, match="maxOutputSize must be a positive finite number"):
        limits.max_output_of(value)
    assert limits.max_output_of(0) == 0 and limits.max_output_of(2.9) == 2 and limits.max_output_of(None) == limits.MAX_OUTPUT


@pytest.mark.parametrize("codec", ALL)
def test_caps(codec):
    data = b"a" * 2048
    packed = codecs.COMPRESS[codec](data)
    assert codecs.DECOMPRESS[codec](packed, 2048) == data
    with pytest.raises(limits.CodecError, match="Destination buffer is too small" if codec == "zstd" else "exceeded maximum size of 1024 bytes"):
        codecs.DECOMPRESS[codec](packed, 1024)
    assert codecs.DECOMPRESS[codec](codecs.COMPRESS[codec](b""), 0) == b""


@pytest.mark.parametrize("codec, ok", [("zstd", 1), ("deflate", 1), ("lz4", 1), ("gzip", 0), ("brotli", 0)])
def test_empty_input(codec, ok):
    if ok:
        assert codecs.DECOMPRESS[codec](b"") == b""
    else:
        with pytest.raises(limits.CodecError):
            codecs.DECOMPRESS[codec](b"")


@pytest.mark.parametrize("codec", ALL)
def test_truncated_and_foreign(codec):
    packed = codecs.COMPRESS[codec](PAYLOADS["edge_text"])
    with pytest.raises(limits.CodecError):
        codecs.DECOMPRESS[codec](packed[: len(packed) // 2])
    with pytest.raises(limits.CodecError):
        codecs.DECOMPRESS[codec](b"This is plain text, and no compressed data at all.")


@pytest.mark.parametrize("codec", ["gzip", "zstd", "brotli", "deflate"])
@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_decoders_only_raise_their_error(codec, data):
    try:
        codecs.DECOMPRESS[codec](data, 1 << 20)
    except limits.CodecError:
        pass


def test_members_and_frames():
    assert codecs.gzip_decompress(codecs.gzip_compress(b"Part1") + codecs.gzip_compress(b"Part2")) == b"Part1Part2"
    assert codecs.zstd_decompress(codecs.zstd_compress(b"Hello") + codecs.zstd_compress(b" World")) == b"Hello World"


def test_detect():
    data = PAYLOADS["edge_text"]
    for codec in ("zstd", "gzip", "lz4", "brotli"):
        packed = codecs.COMPRESS[codec](data)
        assert codecs.detect(packed) == codec and codecs.auto_decompress(packed) == data
    assert codecs.detect(b"") == "unknown"
    assert codecs.detect(b"\x1f\x8b") == "gzip"
    with pytest.raises(limits.CodecError, match="unable to detect compression format"):
        codecs.auto_decompress(b"")


@pytest.mark.parametrize("filename, mtime, level", [("a.txt", None, 6), (None, 1_700_000_000, 6), ("b.txt", 5, 9), (None, None, 1)])
def test_header(filename, mtime, level):
    packed = header.compress_with_header(b"data", filename, mtime, level)
    got = header.read_header(packed)
    assert (got["filename"], got["mtime"], got["comment"], got["extra"]) == (filename, mtime or 0, None, None)
    assert gzip.decompress(packed) == b"data" and header.read_header(packed[:40])["filename"] == filename


def test_header_fields_and_errors():
    raw = b"\x1f\x8b\x08\x1c" + (7).to_bytes(4, "little") + b"\x00\x03" + b"\x02\x00ab" + b"n\xff\0" + b"c\0"
    assert header.read_header(raw) == {"filename": "n�", "mtime": 7, "comment": "c", "os": 3, "extra": b"ab"}
    for bad in (b"", b"\x1f\x8b", b"plain text here", raw[:-1]):
        with pytest.raises(limits.CodecError):
            header.read_header(bad)


@pytest.mark.parametrize("codec", ALL)
@pytest.mark.parametrize("size", [1, 64, 65536])
def test_contexts(codec, size):
    data = PAYLOADS["edge_text"] if size == 1 else PAYLOADS["pattern_1m"]
    ctx = contexts.compressor(codec)
    packed = b"".join(ctx.transform(data[k : k + size]) + (ctx.transform(b"") if k == size else b"") for k in range(0, len(data), size)) + ctx.finish()
    assert codecs.DECOMPRESS[codec](packed) == data
    for kind in (codec, "auto") if codec != "deflate" else (codec,):
        back = contexts.decompressor(kind)
        assert b"".join(back.transform(packed[k : k + size]) for k in range(0, len(packed), size)) + back.finish() == data
    for call in (lambda: ctx.transform(b"x"), ctx.flush, ctx.finish):
        with pytest.raises(limits.StreamFinishedError, match="already finished"):
            call()


@pytest.mark.parametrize("codec", ALL)
def test_context_cap_counts_all_chunks(codec):
    packed = codecs.COMPRESS[codec](b"B" * 4096)
    ctx = contexts.decompressor(codec, 100)
    with pytest.raises(limits.SizeLimitError, match="exceeded maximum size of 100 bytes"):
        for k in range(len(packed)):
            ctx.transform(packed[k : k + 1])
        ctx.finish()


def test_auto_context():
    assert contexts.decompressor("auto").finish() == b""
    ctx = contexts.decompressor("auto")
    with pytest.raises(limits.CodecError, match="unable to detect compression format from stream data"):
        ctx.transform(b"plain text"), ctx.finish()


def test_dictionary():
    samples = [b'{"id":%d,"name":"user %d","email":"u%d@example.com","active":true}' % (i, i, i) for i in range(300)]
    trained = zstandard.train_dictionary(4096, samples).as_bytes()
    one = samples[7]
    packed = codecs.zstd_compress(one, 3, trained)
    assert len(packed) < len(codecs.zstd_compress(one)) and codecs.zstd_decompress(packed, None, trained) == one
    ctx = contexts.compressor("zstd", 3, trained)
    assert codecs.zstd_decompress(ctx.transform(one) + ctx.finish(), None, trained) == one
    with pytest.raises(NotImplementedError):
        contexts.compressor("brotli", dictionary=trained)


def test_zstd_bomb_is_stopped_at_its_cap():
    """A frame without a size in its header that inflates to 4 GB, against a cap of some bytes: memory stays small."""
    import resource



    press = zstandard.ZstdCompressor(3).compressobj()
    bomb = b"".join([press.compress(bytes(1 << 20)) for _ in range(4000)] + [press.flush()])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with pytest.raises(limits.CodecError, match="Destination buffer is too small"):
        codecs.zstd_decompress(bomb, 1000)
    with pytest.raises(limits.SizeLimitError):
        contexts.decompressor("zstd", 5000).transform(bomb)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 * 1024


@pytest.mark.parametrize("codec", ["brotli", "lz4"])
def test_streams_emit_before_their_end(codec):
    import os


    data = b"".join(os.urandom(1 << 14) + b"again and again " * 2000 for _ in range(40))
    ctx = contexts.compressor(codec)
    parts = [ctx.transform(data[k : k + 50_000]) for k in range(0, len(data), 50_000)]
    early = b"".join(parts) + ctx.flush()
    assert len(early) > 200_000
    assert codecs.DECOMPRESS[codec](early + ctx.finish()) == data
    empty = contexts.compressor(codec)
    done = contexts.decompressor(codec)
    assert done.transform(empty.finish()) + done.finish() == b""


def test_zstd_frames_in_small_chunks():

    data = bytes(range(256)) * 5000
    two = codecs.zstd_compress(b"abc") + codecs.zstd_compress(data)
    ctx = contexts.decompressor("zstd")
    assert b"".join([*(ctx.transform(two[k : k + 777]) for k in range(0, len(two), 777)), ctx.finish()]) == b"abc" + data
    assert codecs.zstd_decompress(two, 1 << 24) == b"abc" + data


@pytest.mark.parametrize("codec", ["brotli", "lz4"])
def test_failed_decoding_keeps_no_memory(codec):
    import re
    import sys

    def held() -> int:
        with open("/proc/self/status") as f:
            return int(re.search(r"VmSize:\s+(\d+)", f.read())[1]) // 1024

    half = codecs.COMPRESS[codec](PAYLOADS["random_1k"])[:500]
    before = held()
    for _ in range(100):
        with pytest.raises(limits.CodecError):
            codecs.DECOMPRESS[codec](half)
    assert held() - before < 1024  # MB; each took 256 of them
    codecs.is_brotli(b"\xff" * 50)
    blocks = sys.getallocatedblocks()
    for _ in range(5000):
        assert not codecs.is_brotli(b"\xff" * 50)
    assert sys.getallocatedblocks() - blocks < 2500


@pytest.mark.parametrize("codec", ["brotli", "lz4"])
def test_decoding_in_steps_at_their_edges(codec):
    for n in (codecs._STEP - 1, codecs._STEP, codecs._STEP + 1, 2 * codecs._STEP):
        data = rng.randbytes(n)
        packed = codecs.COMPRESS[codec](data)
        assert codecs.DECOMPRESS[codec](packed) == codecs.DECOMPRESS[codec](packed, n) == data
        with pytest.raises(limits.SizeLimitError):
            codecs.DECOMPRESS[codec](packed, n - 1)
