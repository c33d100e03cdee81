"""Chunk streams: rows (stream, seq, chunk) through one codec context per stream, in batch and in Structured Streaming."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .contexts import CONCATENABLE, Context, compressor, decompressor


def _context(codec: str, direction: str, level, max_output_size, dictionary) -> Context:
    if direction == "compress":
        return compressor(codec, level, dictionary)
    if direction != "decompress":
        raise ValueError("direction must be compress or decompress")
    return decompressor(codec, max_output_size, dictionary)


def stream_codec(df: DataFrame, id_col: str, seq_col: str, chunk_col: str, codec: str, direction: str, level=None, max_output_size=None, dictionary: bytes | None = None) -> DataFrame:
    """id, seq, chunk: the non-empty output chunks of each stream, numbered from 0; one empty chunk of a stream that has none.

    Rows are dealt by stream and sorted, then pass through a task one batch at a time: only codec state is held, but brotli
    at a given quality holds its whole input, and brotli and LZ4 decompression the whole compressed stream, until its end. (A stream is sequential by nature; many streams run in parallel.) ``codec`` may be ``auto`` to decompress.
    A null chunk counts as empty. Bad arguments raise here.
    """
    _context(codec, direction, level, max_output_size, dictionary)
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.col(chunk_col).cast("binary").alias("chunk"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ctx, n = None, None, 0
        first = True

        def out(key, chunks: list[bytes], end: bool = False):
            nonlocal n
            chunks = [c for c in chunks if c] or ([b""] if end and not n else [])
            rec = pa.RecordBatch.from_arrays([pa.array([key] * len(chunks), key_type), pa.array(range(n, n + len(chunks)), pa.int64()), pa.array(chunks, pa.binary())], names=["id", "seq", "chunk"])
            n += len(chunks)
            return rec

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            held: list[bytes] = []
            for key, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if first or key != now:
                    if not first:
                        yield out(now, [*held, ctx.finish()], end=True)
                        held = []
                    first, now, n = False, key, 0
                    ctx = _context(codec, direction, level, max_output_size, dictionary)
                held.append(ctx.transform(chunk or b""))
            yield out(now, held)
        if not first:
            yield out(now, [ctx.finish()], end=True)

    dealt = rows.repartition("id").sortWithinPartitions("id", "seq")
    return dealt.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("seq", T.LongType()), T.StructField("chunk", T.BinaryType())]))


def _carried(df: DataFrame, id_col: str, seq_col: str, chunk_col: str, fields: list[T.StructField], new: Callable, add: Callable, values: Callable) -> DataFrame:
    """A row per stream: a state carried from chunk to chunk in order, so a stream of any length takes the memory of a batch."""
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.col(chunk_col).cast("binary").alias("chunk"))
    names = ["id", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, now, state, kind = True, None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            keys, *cols = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *map(pa.array, cols)], names=names)

        for b in batches:
            kind, done = b.column(0).type, []
            for key, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if first or key != now:
                    if not first:
                        done.append((now, *values(state)))
                    first, now, state = False, key, new()
                state = add(state, chunk or b"")
            if done:
                yield out(done)
        if not first:
            yield out([(now, *values(state))])

    return rows.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(run, T.StructType([rows.schema["id"], *fields]))


def chained_crc32(df: DataFrame, id_col: str, seq_col: str, chunk_col: str) -> DataFrame:
    """id, crc: the checksum of each stream's chunks in order, carried from chunk to chunk."""
    return _carried(df, id_col, seq_col, chunk_col, [T.StructField("crc", T.LongType())], int, lambda crc, chunk: zlib.crc32(chunk, crc), lambda crc: (crc,))


def stream_digests(df: DataFrame, id_col: str = "id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """id, digest, length: MD5 (hex) and bytes of each stream's chunks in order, carried from chunk to chunk."""

    def add(state, chunk: bytes):
        state[0].update(chunk)
        return state[0], state[1] + len(chunk)

    fields = [T.StructField("digest", T.StringType()), T.StructField("length", T.LongType())]
    return _carried(df, id_col, seq_col, chunk_col, fields, lambda: (hashlib.md5(), 0), add, lambda state: (state[0].hexdigest(), state[1]))


class _FrameCompressor(StatefulProcessor):
    """A complete member or frame per stream and micro-batch: codec objects do not fit a state store, and readers take members one after another.
    Raw deflate is one stream of blocks: a micro-batch's blocks end at a byte, refer to none before, and the last one is marked at the end row."""

    def __init__(self, codec: str, level, dictionary: bytes | None):
        self.codec, self.level, self.dictionary = codec, level, dictionary

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "seq long, frames long, ended boolean")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seq, frames, ended = self.last.get() if self.last.exists() else (-(2**63), 0, False)
        if ended:
            raise RuntimeError(f"stream {key[0]} already finished")
        if int(pdf["seq"].iloc[0]) <= seq:
            raise ValueError(f"stream {key[0]}: chunks out of order")
        ctx = compressor(self.codec, self.level, self.dictionary)
        over = bool(pdf["last"].any())
        body = [ctx.transform(c) for c in pdf["chunk"] if c is not None]
        out = b"".join([*body, ctx.flush() if self.codec == "deflate" and not over else ctx.finish()])
        self.last.update((int(pdf["seq"].iloc[-1]), frames + 1, over))
        yield pd.DataFrame({"id": [key[0]], "seq": [frames], "chunk": [out]})

    def close(self) -> None: ...


class _Buffered(StatefulProcessor):
    """Holds a stream's chunks until its end row comes, then runs them through one context."""

    def __init__(self, make):
        self.make = make

    def init(self, handle) -> None:
        self.chunks = handle.getListState("chunks", "seq long, chunk binary")
        self.ended = handle.getValueState("ended", "yes boolean")

    def handleInputRows(self, key, rows, timerValues):
        if self.ended.exists():
            raise RuntimeError(f"stream {key[0]} already finished")
        over = False
        for pdf in rows:
            for seq, chunk, last in zip(pdf["seq"], pdf["chunk"], pdf["last"], strict=True):
                self.chunks.appendValue((int(seq), chunk if chunk is not None else b""))
                over = over or bool(last)
        if over:
            ctx = self.make()
            out = b"".join([*(ctx.transform(bytes(c)) for _, c in sorted(self.chunks.get(), key=lambda x: x[0])), ctx.finish()])
            self.chunks.clear()
            self.ended.update((True,))
            yield pd.DataFrame({"id": [key[0]], "seq": [0], "chunk": [out]})

    def close(self) -> None: ...


def stream_codec_streaming(df: DataFrame, codec: str, direction: str, level=None, max_output_size=None, dictionary: bytes | None = None) -> DataFrame:
    """The same on a streaming DataFrame with columns id, seq, chunk, last (true on a stream's end row).

    gzip, zstd and lz4 emit a member or frame per micro-batch, deflate its blocks. brotli, and all decompression, are held until the end row.
    Rows after it raise, so what is kept of an ended stream is one short row, for ever. Needs the RocksDB state store.
    """
    _context(codec, direction, level, max_output_size, dictionary)
    if direction == "compress" and codec in (*CONCATENABLE, "deflate"):
        processor: StatefulProcessor = _FrameCompressor(codec, level, dictionary)
    else:
        processor = _Buffered(lambda: _context(codec, direction, level, max_output_size, dictionary))
    schema = T.StructType([df.schema["id"], T.StructField("seq", T.LongType()), T.StructField("chunk", T.BinaryType())])
    return df.select("id", "seq", "chunk", "last").groupBy("id").transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")
