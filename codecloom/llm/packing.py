"""Lexical retrieval packing: windows filled with the neighbours that BM25 finds for their seed.

1. Every text is tokenised once, in the scan, and cut: its full windows are sequences of their own, what is left is a fragment. Pieces
   are written.
2. Document frequencies of all token ids over all fragments: a vector as long as the vocabulary (a bounded broadcast).
3. Fragments are dealt to the shards of the index by what they say: ordered by their rarest terms (rarest first, those that one
   fragment alone has left out) and range-partitioned, so that relatives meet in one shard whatever the number of shards. Fragments that
   share all these terms are ordered by place, so a large group of them is cut into as many shards as it fills.
4. Each shard holds about ``SHARD_TOKENS`` tokens whatever the corpus. A task builds its inverted index (token id to postings with
   BM25 weights) and packs greedily: all terms of the seed are looked up, and its unused neighbours fill the window, best first, those
   that fit whole before one that is cut at the window's end; what is cut off seeds the next window. Only a shard's last window is
   not full.

The retrieval terms are token ids: they need no second parsing and bound the frequency table. Ids that more than a sixteenth of all fragments
hold are stop words and retrieve nothing.

Results in odd cases: null and empty texts are documents of one id, the end mark. Null document ids stay null and repeated rows are packed as rows of
their own. A text of any length, and any run of one character, is cut into as many windows as it fills; a special token's string is that token. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

WINDOW = 2048
#: Tokens of fragments per shard; a shard's index and pieces stay within some tens of MB.
SHARD_TOKENS = 1_500_000
#: Rarest terms by which fragments are dealt to shards.
LEADING = 3
#: A term in more than one of so many fragments is a stop word.
STOP = 16
#: Characters of a text that the encoder is given at once, about; it fails on runs of a million blanks.
LONG = 100_000
K1, B = 1.2, 0.75
END = 1
#: Sequence numbers of full windows start here; those of shards stay below.
FULL = 1 << 62

_encoders: dict = {}


def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The byte-level BPE as tiktoken encoding; one per worker. Gives the ids of the tokenizers file with the same vocabulary."""
    if ranks_path not in _encoders:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _encoders[ranks_path]


def public_vocabulary() -> dict:
    """Arguments of ``encoder`` for the public 50k byte-level vocabulary; its special token is read as one where a text holds it."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": (("<|endoftext|>", 50256),)}


#: Where a text can be cut and no pre-token is: before a blank or line break that follows no white space.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def spans(text: str, pattern: regex.Pattern, special: regex.Pattern, start: int = 0) -> Iterator[tuple[int, int, bool]]:
    """From, to, and whether it is a special token, of each pre-token of ``text`` from ``start`` on. Special tokens come first, then what lies between."""
    at = start
    for m in special.finditer(text, start):
        yield from ((a, b, False) for a, b in map(regex.Match.span, pattern.finditer(text, at, m.start())))
        yield m.start(), m.end(), True
        at = m.end()
    yield from ((a, b, False) for a, b in map(regex.Match.span, pattern.finditer(text, at)))


def special_pattern(special: tuple[tuple[str, int], ...]) -> regex.Pattern:
    return regex.compile("|".join(regex.escape(s) for s, _ in special) or r"(?!)")


def encode(text: str, vocabulary: dict) -> list[int]:
    """Ids of a text of any kind. Longer ones are cut at safe places; a run that has none is split and merged pre-token by pre-token."""
    enc = encoder(**vocabulary)
    if len(text) <= LONG:
        return enc.encode(text, allowed_special="all")
    out: list[int] = []
    at = 0
    while at < len(text):
        cut = _SAFE.search(text, at + LONG)
        part = text[at : cut.start() if cut else len(text)]
        at += len(part)
        if len(part) <= 2 * LONG:
            out += enc.encode(part, allowed_special="all")
            continue
        ids = dict(vocabulary["special"])
        for a, b, whole in spans(part, regex.compile(vocabulary["pattern"]), special_pattern(vocabulary["special"])):
            if whole:
                out.append(ids[part[a:b]])
            else:
                out += enc._encode_single_piece(part[a:b])
    return out


def _kind(enc):
    """Type of the ids in tables between the steps: 16 bits where the vocabulary allows."""
    return np.uint16 if max(enc.n_vocab, END + 1) <= 1 << 16 else np.uint32


_PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "crc")] + [T.StructField("ids", T.BinaryType()), T.StructField("place", T.LongType())]
)


def _cutter(vocabulary: dict, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(**vocabulary)
        kind = _kind(enc)
        place = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                rows, owner = [], []
                for k, t in enumerate(b.column(1)):
                    ids = np.array([*encode(t.as_py() or "", vocabulary), END], np.uint32)
                    for s in range(0, len(ids), window):
                        part = ids[s : s + window]
                        # full windows are done with: their ids travel only if the caller wants them
                        travels = with_ids or len(part) < window
                        rows.append((s, len(part), len(ids), zlib.crc32(part.tobytes()), part.astype(kind).tobytes() if travels else None, place))
                        owner.append(k)
                        place += 1
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *(pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True))], names=["id", *_PIECE.names])

    return run


_ARROW = [pa.field(n, pa.int64()) for n in ("start", "length", "doc_tokens", "crc")] + [pa.field("ids", pa.binary()), pa.field("place", pa.int64())]


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch's fragments, and where each fragment's begin."""
    parts = [x.as_py() for x in column]
    size = np.array([len(x) for x in parts], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.cumsum(size) - size


def _frequencies(kind, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                ids, starts = _flat(whole.column(0).slice(at, 256), kind)
                # fragment and id in one number, so that one sort finds the distinct ones of all
                key = np.repeat(np.arange(len(starts), dtype=np.int64), np.diff([*starts, len(ids)])) * size + ids
                key.sort()
                total += np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] % size, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "df"])

    return run


def _dealer(frequencies, kind):
    """The rows with their key: the LEADING rarest terms that other fragments have too, in one sortable number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = frequencies.value
        none = (1 << 20) - 1
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
        rank[df < 2] = none
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, starts = _flat(b.column(b.num_columns - 1), kind)
                left = rank.take(ids)
                size = np.diff([*starts, len(ids)])
                key = np.zeros(len(starts), np.int64)
                for _ in range(LEADING):
                    least = np.minimum.reduceat(left, starts)
                    key = key << 20 | least
                    left = np.where(left == np.repeat(least, size), none, left)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], names=[*b.schema.names, "key"])

    return run


class Shard:
    """Inverted index over fragments, and the greedy packing of them."""

    def __init__(self, fragments: list[np.ndarray], idf: np.ndarray, mean: float):
        self.fragments = fragments
        self.sizes = np.array([len(x) for x in fragments], np.int64)
        n = len(fragments)
        terms, docs, weights = [], [], []
        self.terms = []
        for d, ids in enumerate(fragments):
            t, tf = np.unique(ids, return_counts=True)
            found = idf[t] > 0
            t, tf = t[found], tf[found]
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            terms.append(t), docs.append(np.full(len(t), d, np.int32)), weights.append(w.astype(np.float32))
            self.terms.append(t)
        t = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        order = np.argsort(t, kind="stable")
        t = t[order]
        self.docs, self.weights = np.concatenate(docs)[order] if n else t, np.concatenate(weights)[order] if n else t
        self.ends = np.searchsorted(t, np.arange(len(idf) + 1))
        self.unused = np.ones(n, bool)

    def neighbours(self, seed: int) -> Iterator[np.ndarray]:
        """All unused fragments that share a term with the seed, best BM25 score first, ties by place: the first dozens, then the others."""
        t = self.terms[seed]
        first, size = self.ends[t], self.ends[t + 1] - self.ends[t]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        score = np.bincount(self.docs.take(at), self.weights.take(at), minlength=len(self.unused))
        score[~self.unused] = 0
        top = np.flatnonzero(score)
        if len(top) > 64:
            near = score[top] >= np.partition(score[top], len(top) - 64)[len(top) - 64]
            parts = top[near], top[~near]
        else:
            parts = (top,)
        for part in parts:
            yield part[np.argsort(-score[part], kind="stable")]

    def windows(self, size: int) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (fragment, from, to) that fill windows; every id in exactly one."""
        at, cut = 0, None  # cut: a fragment with its first id not yet packed
        n = len(self.fragments)
        while True:
            if cut is None:
                while at < n and not self.unused[at]:
                    at += 1
                if at == n:
                    return
                cut = (at, 0)
                self.unused[at] = False
            seed, start = cut
            cut = None
            out = [(seed, start, len(self.fragments[seed]))]
            room = size - (len(self.fragments[seed]) - start)
            passed = []
            for ranked in self.neighbours(seed) if room else ():
                passed.append(ranked)
                left, place = self.sizes[ranked], 0
                while room:  # the best neighbour that fits whole, as long as there is one
                    fits = np.flatnonzero(left[place:] <= room)
                    if not len(fits):
                        break
                    place += int(fits[0]) + 1
                    d = int(ranked[place - 1])
                    self.unused[d] = False
                    out.append((d, 0, len(self.fragments[d])))
                    room -= len(self.fragments[d])
                if not room:
                    break
            waiting = iter(np.concatenate(passed)) if passed and room else iter(())
            while room:  # then the best that does not is cut; without one, the next fragment in order comes
                d = next((int(x) for x in waiting if self.unused[x]), -1)
                if d < 0:
                    while at < n and not self.unused[at]:
                        at += 1
                    if at == n:
                        break
                    d = at
                self.unused[d] = False
                take = min(room, len(self.fragments[d]))
                out.append((d, 0, take))
                room -= take
                if take < len(self.fragments[d]):
                    cut = (d, take)
            yield out


def _packer(frequencies, kind, n_docs: int, mean: float, window: int, with_ids: bool, names: list[str]):
    def packed(table: pa.Table, idf: np.ndarray, first_number: int) -> tuple[pa.RecordBatch, int]:
        first = table.column("start").to_numpy()
        frags = [np.frombuffer(x, kind).astype(np.uint32) for x in table.column("ids").to_pylist()]
        # row of the table, start, length, sequence, offset, crc, ids
        out = []
        number = first_number
        for pieces in Shard(frags, idf, mean).windows(window):
            at = 0
            for d, a, b in pieces:
                raw = frags[d][a:b].tobytes()
                out.append((d, first[d] + a, b - a, number, at, zlib.crc32(raw), raw if with_ids else None))
                at += b - a
            number += 1
        row, start, length, seq, offset, sums, ids = zip(*out, strict=True)
        row = pa.array(row, pa.int64())
        long = [pa.array(x, pa.int64()) for x in (start, length)]
        cols = [table.column("id").take(row).combine_chunks(), *long, table.column("doc_tokens").take(row).combine_chunks(), *(pa.array(x, pa.int64()) for x in (sums, seq, offset))]
        return pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] if with_ids else [])], names=names), number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        df = frequencies.value
        idf = np.where(df * STOP > max(n_docs, 8 * STOP), 0.0, np.log1p((n_docs - df + 0.5) / (df + 0.5)))
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        tokens = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                held.append(b)
                tokens += int(b.column(b.schema.get_field_index("length")).to_numpy().sum())
                if tokens >= SHARD_TOKENS:
                    out, number = packed(pa.Table.from_batches(held), idf, number)
                    yield out
                    held, tokens = [], 0
        if held:
            yield packed(pa.Table.from_batches(held), idf, number)[0]

    return run


def _widener(kind, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = [np.frombuffer(x.as_py(), kind).astype(np.uint32).tobytes() for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(wide, pa.binary())], names=names)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: dict | None = None, with_ids: bool = True) -> DataFrame:
    """A row per piece: id, start, length, doc_tokens, crc, sequence_id, offset, and ids (little-endian unsigned 32 bit) unless declined."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    vocabulary = vocabulary or public_vocabulary()
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    pieces = scratch.write(plain.mapInArrow(_cutter(vocabulary, window, with_ids), T.StructType([plain.schema["id"], *_PIECE.fields])), "pieces")
    fragments = pieces.where(F.col("length") < window)
    n, total = fragments.agg(F.count("*"), F.sum("length")).first()
    enc = encoder(**vocabulary)
    kind, size = _kind(enc), max(enc.n_vocab, END + 1)
    df = np.zeros(size, np.int64)
    for term, count in fragments.select("ids").mapInArrow(_frequencies(kind, size), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # bounded by the vocabulary
        df[term] = count
    frequencies = spark.sparkContext.broadcast(df)
    rows = fragments.select("id", "start", "length", "doc_tokens", "place", "ids")
    keyed = scratch.write(rows.mapInArrow(_dealer(frequencies, kind), T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])), "keyed")
    shards = max(1, -(-(total or 0) // SHARD_TOKENS))
    dealt = keyed.repartitionByRange(shards, "key", "place").sortWithinPartitions("key", "place")
    fields = [T.StructField(c, T.LongType()) for c in ("id", "start", "length", "doc_tokens", "crc", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    fields[0] = T.StructField("id", plain.schema["id"].dataType)
    names = [f.name for f in fields]
    run = _packer(frequencies, kind, n, (total or 1) / max(1, n), window, with_ids, names)
    packed = dealt.mapInArrow(run, T.StructType(fields))
    # full windows are not shuffled; their sequences are numbered by place, above all shards' numbers
    number = (F.lit(FULL).cast("long") + F.col("place")).alias("sequence_id")
    full = pieces.where(F.col("length") == window).select("id", "start", "length", "doc_tokens", "crc", number, F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
    if with_ids:
        full = full.mapInArrow(_widener(kind, names), T.StructType(fields))
    return full.unionByName(packed)
