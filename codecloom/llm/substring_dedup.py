"""Removal of repeated passages by difference-cover anchors.

A window of 13 words repeats if its words also start at some place in a document with a smaller id. Anchors of 7 words are hashed only
where the position modulo 7 is 0, 1 or 3. These residues are a difference cover: any two offsets have a common shift of at most 6 that
puts both on covered positions, so two equal windows of 7 + 6 words always share an anchor that both documents hashed,
wherever they stand. With ``window`` words in general, the anchor has ``window - 6`` words.

1. Documents are written as blocks (a few MB of text each, compressed), the unit that all later steps read. A written table
   keeps blocks the same when an executor is lost.
2. Each block sends its distinct anchor hashes to hash buckets, as sorted arrays; a bucket answers each block with a bit per anchor: does
   another document have it. A hash sent 32 bits wide may answer yes wrongly, which costs work and nothing else.
3. Blocks extend: a window is a candidate if it holds a shared anchor. Candidates' full 13-word hashes (64 bits, in buckets dealt by an
   independent hash) go out with the block's least document id, and a bit comes back: has a document with a smaller id the window.
4. Blocks mark the words covered by repeated windows and hash what is left.

A passage that a third of all documents share is one entry per block in its bucket. Windows are judged on the input, not on what is left.

Results in odd cases: a null or wordless text has 0 words and keeps the empty string. A document shorter than the window loses nothing.
Null ids count as larger than any other and as equal to each other. Rows that repeat an id do not take words from each other. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .words import WordHashes, run_hashes

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 3_000_000
#: Text bytes whose anchors or windows meet in one bucket.
BUCKET_BYTES = 64_000_000
NO_ID = np.iinfo(np.int64).max

_BLOCK = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())]
)
_SENT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("least", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])


def _blocker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    pack = zstandard.ZstdCompressor(3)
    ids: list = []
    texts: list[bytes] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary())],
            names=_BLOCK.names,
        )

    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            raw = (t.as_py() or "").encode()
            if ids and (held + len(raw) > BLOCK_BYTES or len(ids) >= 20_000):
                yield out()
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(i.as_py()), texts.append(raw)
            held += len(raw)
    if ids:
        yield out()


class Block:
    """A block's documents as one array of word hashes; positions count through all documents."""

    def __init__(self, ids: list, sizes: list, texts: bytes, hashes: WordHashes):
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(texts) if sum(sizes) else b""
        at = 0
        self.words: list[list[bytes]] = []
        for n in sizes:
            self.words.append(raw[at : at + n].split())
            at += n
        self.ids = ids
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        self.w = np.concatenate([hashes.of(w) for w in self.words]) if len(ids) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.place = np.arange(len(self.w)) - self.starts[self.doc] if len(self.w) else np.zeros(0, np.int64)
        self.key = np.array([NO_ID if i is None else i for i in ids], np.int64)

    def fits(self, width: int) -> np.ndarray:
        """Where a run of ``width`` words starts within its document; as long as the hashes of runs."""
        n = max(0, len(self.w) - width + 1)
        return self.place[:n] + width <= self.n[self.doc[:n]]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Covered positions and their anchor hashes."""
        width = window - PERIOD + 1
        h = run_hashes(self.w, width)
        at = np.flatnonzero(self.fits(width) & np.isin(self.place[: len(h)] % PERIOD, COVER))
        return at, h[at]

    def candidates(self, window: int, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and bucket hashes of windows that hold a shared anchor."""
        h = run_hashes(self.w, window, seed=1)
        seen = np.zeros(len(self.w) + 1, np.int64)
        seen[at[shared] + 1] = 1
        seen = np.cumsum(seen)
        start = np.arange(len(h))
        hit = np.flatnonzero(self.fits(window) & (seen[start + PERIOD] > seen[start]))
        return hit, h[hit], run_hashes(self.w, window, seed=2)[hit] if len(hit) else h[hit]


def _anchor_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of an anchor's hash in one sortable number."""
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of each run of a sorted array."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges], [*edges, len(bucket)], strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _distinct_anchors(blk: Block, h: np.ndarray, at: np.ndarray, buckets: int):
    """Sorted distinct keys, whether two documents of the block have each, and each anchor's place among them."""
    keys, inverse = np.unique(_anchor_keys(h, buckets), return_inverse=True)
    doc = blk.key[blk.doc[at]]
    low = np.full(len(keys), NO_ID)
    high = np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, doc)
    np.maximum.at(high, inverse, doc)
    return keys, low < high, inverse


def _distinct_windows(blk: Block, hit: np.ndarray, h: np.ndarray, deal: np.ndarray, buckets: int):
    """Distinct windows sorted by (bucket, hash): bucket, hash, least document id, and each candidate's place among them."""
    bucket = (deal % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    b, k = bucket[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(order), np.int64)
    inverse[order] = group
    least = np.full(int(new.sum()), NO_ID)
    np.minimum.at(least, inverse, blk.key[blk.doc[hit]])
    return b[new], k[new], least, inverse


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, dict]]:
    hashes = WordHashes()
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1).to_pylist()[0]
            yield one["block"], Block(one["ids"], one["sizes"], one["texts"], hashes), one


def _send(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=_SENT.names)


def _send_anchors(window: int, buckets: int):
    def run(batches):
        for number, blk, _ in _blocks(batches):
            at, h = blk.anchors(window)
            keys, _own, _inv = _distinct_anchors(blk, h, at, buckets)
            low = keys.astype(np.uint32)
            yield _send([(b, number, low[s].tobytes(), None) for b, s in _runs((keys >> np.uint64(32)).astype(np.int64))])

    return run


def _bits(answers: list | None) -> dict[int, np.ndarray]:
    return {a["bucket"]: np.unpackbits(np.frombuffer(a["bits"], np.uint8)).astype(bool) for a in answers or ()}


def _apply(runs: Iterator[tuple[int, slice]], n: int, bits: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(n, bool)
    for b, s in runs:
        if b in bits:
            out[s] = bits[b][: s.stop - s.start]
    return out


def _shared(blk: Block, window: int, buckets: int, answers: list | None):
    at, h = blk.anchors(window)
    keys, own, inverse = _distinct_anchors(blk, h, at, buckets)
    known = own | _apply(_runs((keys >> np.uint64(32)).astype(np.int64)), len(keys), _bits(answers))
    return at, known[inverse] if len(at) else np.zeros(0, bool)


def _send_windows(window: int, buckets: int):
    def run(batches):
        for number, blk, row in _blocks(batches):
            hit, h, deal = blk.candidates(window, *_shared(blk, window, buckets, row["answers"]))
            b, k, least, _ = _distinct_windows(blk, hit, h, deal, buckets)
            yield _send([(x, number, k[s].tobytes(), least[s].tobytes()) for x, s in _runs(b)])

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    """A bit per key of each block: another block has it too."""
    keys = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    return _answers(table, [np.isin(k, twice, assume_unique=True) for k in keys])


def _answer_windows(table: pa.Table) -> pa.Table:
    """A bit per key of each block: a smaller document elsewhere has the window."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    least = [np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()]
    every, low = np.concatenate(keys), np.concatenate(least)
    order = np.lexsort((low, every))
    every, low = every[order], low[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    every, low = every[new], low[new]
    return _answers(table, [low[np.searchsorted(every, k)] < m for k, m in zip(keys, least, strict=True)])


def _answers(table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.table([table.column("block"), table.column("bucket"), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], names=_ANSWER.names)


def _finish(window: int, buckets: int):
    def run(batches):
        for _, blk, row in _blocks(batches):
            hit, h, deal = blk.candidates(window, *_shared(blk, window, buckets, row["answers"]))
            b, _k, least, inverse = _distinct_windows(blk, hit, h, deal, buckets)
            elsewhere = _apply(_runs(b), len(least), _bits(row["found"]))
            gone = hit[(blk.key[blk.doc[hit]] > least[inverse]) | elsewhere[inverse]] if len(hit) else hit
            edge = np.zeros(len(blk.w) + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)  # a window ends within its document
            lost = np.cumsum(edge)[:-1] > 0
            removed = np.zeros(len(blk.ids), np.int64)
            np.add.at(removed, blk.doc[lost], 1)
            text = []
            for d, words in enumerate(blk.words):
                if removed[d]:
                    keep = ~lost[blk.starts[d] : blk.starts[d + 1]]
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blk.ids, pa.int64()), pa.array(blk.n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in text]), pa.array([t.decode() for t in text]) if row["keep"] else pa.nulls(len(text), pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """A row per input row: id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by spaces; null if declined)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    blocks = scratch.write(plain.mapInArrow(_blocker, _BLOCK), "blocks", codec="uncompressed")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    gathered = lambda answers, name: answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))  # noqa: E731  a block's own bits
    sent = blocks.mapInArrow(_send_anchors(window, buckets), _SENT)
    first = scratch.write(gathered(sent.groupBy("bucket").applyInArrow(_answer_anchors, _ANSWER), "answers"), "answers")
    again = blocks.join(first, "block", "left").mapInArrow(_send_windows(window, buckets), _SENT)
    second = scratch.write(gathered(again.groupBy("bucket").applyInArrow(_answer_windows, _ANSWER), "found"), "found")
    whole = blocks.join(first.join(second, "block", "left"), "block", "left").withColumn("keep", F.lit(with_text))
    return whole.mapInArrow(_finish(window, buckets), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
