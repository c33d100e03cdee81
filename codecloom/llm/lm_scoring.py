"""Scoring texts with a logistic context-mixing model over bits, learned from the corpus.

A byte (or the end of the text) is spelled as a path in a binary tree chosen by the two bytes before it, where they are frequent, or else by the one
before it (a Huffman tree of the training counts), so that few decisions are left per byte. Each decision is predicted by the tree's own counts and in four hashed
contexts: the last 2, 4 and 6 bytes, and the whole word read so far (lower-cased). A gate (how sure the longest contexts are) selects the
weights that mix the predictions in the logistic domain, and an adaptive map per gate corrects the mixed probability.

Learning runs on Spark over all training documents, in passes that each leave a written table:

1. Counts of tokens (for the base score) and of bytes behind two others (for the trees): partial counts per task, then an aggregation.
2. Counts of decisions per hashed slot: each task sums its documents into a fixed table (bytes that are equal in a context are gathered by sorting
   and spelled once) and sends it in compressed chunks; chunks add
   up in rounds of at most ``FAN_IN``. Slots grow with the square root of the training bytes, up to ``MOST_BITS`` per context: the memory
   that a worker gives to the model is the bound (``table_bits``). Beyond it contexts share slots.
3. One of ``MIX_FOLD`` training documents is kept out of those counts at first. They are read online, in steps of ``BATCH`` decisions: each step is
   predicted, then moves the gate's weights, the predictors' states and the correction counts together. Tasks' weights are averaged by their number of
   decisions, their correction counts are summed. Then those documents are counted too, so that the frozen tables cover all training documents.

Scoring is one further pass with the frozen model: a text's score depends on that text and the model alone. A worker remembers the costs of bytes
that it has scored in the same contexts, in a memo of fixed size, which changes no digit. The base score needs
each token's count: the most frequent tokens, ``HEAD`` at most, are broadcast, the rest are joined by token, so no token is a hot key.

Results in odd cases: a null text counts as empty: one token, the end mark. Null ids are training documents (the empty string's
checksum leaves 0). Repeated rows are learned from and scored one by one. Without training documents base counts are 0 and the
model is uniform. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

FOLDS, HELD_OUT = 7, 2
MIX_FOLD = 16
#: log2 of the slots per hashed context (2, 4, 6 bytes; word) at 2 ** 29 training bytes; every factor of four adds one. Least that is added, and the bound.
BASE_BITS, BASE_BYTES = (20, 22, 23, 23), 29
LEAST_ADDED, MOST_BITS = -1, 24
#: log2 of the slots among which a context deals its decisions: few, so that those of a byte lie side by side in memory.
NEAR_BITS = (20, 6, 5, 5)
CHUNK = 1 << 16
#: Tables that are added up in one place.
FAN_IN = 64
HEAD = 1 << 17
END = 256
PAD = 6
#: Two bytes have a tree of their own where they stand before more than one in so many training bytes, which bounds the trees.
TREE_SHARE = 4096
#: Bytes that are worked on at once, and decisions per step of the online training.
BLOCK, BATCH = 1 << 15, 2048
#: Letters that are gathered before they are counted, and log2 of those whose costs a worker remembers.
GATHER, MEMO_BITS = 1 << 22, 22
_NONE = np.uint64((1 << 64) - 1)
#: Inputs of the mixing: the byte before, then the hashed contexts. Units: predictions 1/16, weights 1/256, levels STEP.
INPUTS = 1 + len(BASE_BITS)
GATES, LEVELS, STEP = 18, 65, 0.25
START, RATE, MOVE = 0.25, 0.3, 0.05

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Each tree node's own bits, by which it takes its slot among a context's.
_NODES = (np.arange(512, dtype=np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
_R = np.uint64(0x2545F4914F6CDD1D)
_R_INV = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_powers: list[np.ndarray] = []
_SPACE = np.isin(np.arange(256), (0, 9, 10, 11, 12, 13, 32))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FLUSH = 400_000


def table_bits(n_bytes: int) -> tuple[int, ...]:
    """log2 of the slots per hashed context for so many training bytes."""
    more = max(LEAST_ADDED, (max(n_bytes, 1).bit_length() - 1 - BASE_BYTES) // 2)
    return tuple(min(MOST_BITS, b + more) for b in BASE_BITS)


def offsets(bits: tuple[int, ...]) -> tuple[list[int], int]:
    """Where each context's slots begin in the one table, the largest first (so that a begin shares no bits with a place), and their number."""
    at, out = 0, [0] * len(bits)
    for k in sorted(range(len(bits)), key=lambda k: -bits[k]):
        out[k] = at
        at += 1 << bits[k]
    return out, at


class _Places:
    """Slots as indices, in memory that is taken once: pages of large temporaries would be mapped and cleared for every block."""

    def __init__(self):
        self.held = np.empty(0, np.intp)

    def of(self, slots: np.ndarray) -> np.ndarray:
        if len(self.held) < slots.size:
            self.held = np.empty(slots.size + (slots.size >> 2), np.intp)
        at = self.held[: slots.size].reshape(slots.shape)
        np.copyto(at, slots)
        return at


class Trees:
    """Paths of symbols in each tree: decision nodes, bits and what the tree's counts predict, flat; and the tree of each two bytes."""

    def __init__(self, pairs: np.ndarray, more: dict[int, np.ndarray] | None = None):
        """``pairs``: counts of the 257 symbols behind each byte; ``more``: behind two bytes, the last one times 256 plus the one before it."""
        more = more or {}
        self.tree = np.repeat(np.arange(256, dtype=np.int32), 256)
        self.tree[list(more)] = np.arange(256, 256 + len(more))
        counts = np.concatenate([pairs, *(x[None] for x in more.values())]).astype(np.float64)
        self.length, self.start = (np.zeros((len(counts), 257), np.int32) for _ in range(2))
        steps: list[int] = []
        hints: list[int] = []
        for tree, w in enumerate(counts):
            w = w + max(w.sum(), 1) * 1e-6 / 257  # symbols never seen here can be spelled too
            heap = [(x, s) for s, x in enumerate(w.tolist())]
            heapq.heapify(heap)
            above: dict[int, tuple[int, int]] = {}  # of each node: the one above, and the step down from there
            hint: dict[int, int] = {}
            node = 257
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                above[a[1]], above[b[1]] = (node, (node - 257) << 1), (node, (node - 257) << 1 | 1)
                hint[node - 257] = round(max(-127.0, min(127.0, 16 * math.log(b[0] / a[0]))))
                heapq.heappush(heap, (a[0] + b[0], node))
                node += 1
            for s in range(257):
                path = []
                at = s
                while at in above:
                    at, step = above[at]
                    path.append(step)
                self.length[tree, s], self.start[tree, s] = len(path), len(steps)
                steps += path[::-1]
                hints += [hint[p >> 1] for p in path[::-1]]
        self.steps, self.hints = np.array(steps, np.int16), np.array(hints, np.int8)
        self.length, self.start = self.length.ravel(), self.start.ravel()


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the word hash's base, and of its inverse; those that a block needs are kept."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_R, _R_INV):
            p = np.full(max(n, 2 * BLOCK), base)
            p[0] = 1
            made.append(np.cumprod(p))
        if n > 2 * BLOCK:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


class Letters:
    """The bytes and ends of a block of texts, each with all that its decisions depend on; padding lies between texts."""

    def __init__(self, texts: list[bytes]):
        # eight bytes to look back into, then each text with a place for its end, and padding between texts
        raw = bytes(8) + bytes(PAD + 1).join(texts) + b"\0"
        n = len(raw) - 8
        s = np.frombuffer(raw, np.uint8, n, 8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(size + PAD) - PAD - 1
        self.first, self.ends = ends - size + 1, ends
        self.padding = (ends[:-1, None] + 1 + np.arange(PAD)).ravel()
        past = np.ndarray((n,), "<u8", raw, 0, (1,)).copy()  # the eight bytes before each place, the last one on top
        # the whole word so far, lower-cased: differences of a running polynomial
        begin = np.zeros(n, np.int64)
        np.maximum.accumulate(_SPACE.take(s[:-1]) * np.arange(1, n), out=begin[1:])
        power, back = _powers_of(n)
        run = np.zeros(n + 1, np.uint64)
        terms = np.frombuffer(raw.translate(_LOWER), np.uint8, n, 8) + np.uint64(1)
        terms *= power
        np.cumsum(terms, out=run[1:])
        self.word = run[:-1] - run.take(begin, mode="clip")
        self.word *= back.take(begin, mode="clip")
        self.word ^= past >> np.uint64(56) << np.uint64(56)
        #: the six bytes before, the last one on top, and nine bits for the symbol
        past >>= np.uint64(16)
        past <<= np.uint64(9)
        past |= s
        past[ends] |= np.uint64(END)  # these bytes are 0
        self.near = past


def _contexts(near: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the hashed contexts hash: the last 2, 4 and 6 bytes, the word."""
    return near >> np.uint64(41), near >> np.uint64(25), near >> np.uint64(9), word


def _hashed(context: np.ndarray, k: int, bits: tuple[int, ...]) -> np.ndarray:
    """The slot that context number ``k`` begins from, of ``1 << bits[k]``."""
    h = context + np.uint64(1)
    h *= _M[k]
    h >>= np.uint64(64 - bits[k])
    return h


class Events:
    """The decisions of a block of texts: the bit, the tree's hint, the slot in each hashed context (a row per decision), and where each text's decisions begin.

    With ``counted``, instead of the slot the place among counts, two to a slot: twice the slot, and the bit; and no hints.
    """

    def __init__(self, texts: list[bytes], trees: Trees, bits: tuple[int, ...], counted: bool = False):
        x = Letters(texts)
        slots = {k: _hashed(c, k, bits) for k, c in enumerate(_contexts(x.near, x.word))}
        self._spell(x.near >> np.uint64(41), x.near & np.uint64(511), slots, trees, bits, counted, x.padding)
        self.of_text = self.of_letter.take(x.first)

    @classmethod
    def of(cls, two: np.ndarray, symbol: np.ndarray, slots: dict[int, np.ndarray], trees: Trees, bits: tuple[int, ...], counted: bool = False) -> Events:
        """The decisions of letters, whatever texts they are from, in some contexts: two bytes before, symbol, slots by the context's number."""
        ev = cls.__new__(cls)
        ev._spell(two, symbol, slots, trees, bits, counted)
        return ev

    def _spell(self, two, symbol, slots, trees, bits, counted, padding=()) -> None:
        at = trees.tree.take(two.view(np.int64), mode="clip") * 257
        at += symbol.view(np.int64)
        self.many = many = trees.length.take(at, mode="clip")
        many[padding,] = 0
        total = np.cumsum(many)
        self.of_letter = total - many
        # the letter that each decision belongs to, and its place in the trees' paths
        owner = np.repeat(np.arange(len(many)), many)
        path = (trees.start.take(at, mode="clip") - self.of_letter).take(owner, mode="clip")
        path += np.arange(len(path))
        step = trees.steps.take(path, mode="clip")
        self.hint = None if counted else trees.hints.take(path, mode="clip")
        # a letter's place in each context, for each of its decisions; the node picks the slot
        context = np.empty((len(many), len(slots)), np.uint32)
        node = np.empty((len(_NODES) << 1, len(slots)), np.uint32)  # a row per step down
        begin = offsets(bits)[0]
        for j, (k, slot) in enumerate(slots.items()):
            np.add(slot, np.uint64(begin[k]), out=context[:, j], casting="unsafe")
            node[::2, j] = node[1::2, j] = _NODES >> np.uint32(32 - min(bits[k], NEAR_BITS[k]))
        if counted:
            context <<= 1
            node <<= 1
            node[1::2] |= 1
        self.slots = context.take(owner, axis=0, mode="clip")
        self.slots ^= node.take(step, axis=0, mode="clip")
        self.bit = step & 1


class Memo:
    """Letters met before and their costs, each at the one place that its hash picks; a later one takes an earlier one's place.

    Letters are compared as a whole, so what is found is exact. ``1 << MEMO_BITS`` places, 24 bytes each, bound it.
    """

    def __init__(self):
        # two whole numbers as one item, which moves at once; it is never computed with
        self.letters = np.full(2 << MEMO_BITS, np.iinfo(np.uint64).max).view(np.complex128)  # no letter: its symbol would be 511
        self.costs = np.zeros(1 << MEMO_BITS)

    def find(self, x: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each letter as an item, its place, and which are not there."""
        pair = np.empty((len(x.near), 2), np.uint64)
        pair[:, 0], pair[:, 1] = x.near, x.word
        at = x.near * _M[0]
        at += x.word * _M[1]
        at >>= np.uint64(64 - MEMO_BITS)
        at = at.view(np.int64)
        item = pair.ravel().view(np.complex128)
        same = self.letters.take(at, mode="clip").view(np.uint64) == pair.ravel()
        return item, at, np.flatnonzero(same.view(np.uint16) != 0x0101)

    def keep(self, item: np.ndarray, at: np.ndarray, cost: np.ndarray) -> None:
        self.letters[at], self.costs[at] = item, cost  # of two at one place the last one stays, in both


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts, about BLOCK bytes at a time; a longer text comes alone."""
    for b in batches:
        held, texts, first = 0, [], 0
        for k, t in enumerate(b.column(column)):
            raw = (t.as_py() or "").encode()
            if texts and held + len(raw) > BLOCK:
                yield b.slice(first, len(texts)), texts
                held, texts, first = 0, [], k
            texts.append(raw)
            held += len(raw)
        if texts:
            yield b.slice(first, len(texts)), texts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how many there are of each. Sorts in place."""
    keys.sort()
    begin = np.flatnonzero(keys[1:] != keys[:-1])
    begin += 1
    begin = np.concatenate([[0], begin, [len(keys)]])
    return keys[begin[:-1]], np.diff(begin)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token and count; the end mark is the empty token; keys that begin with a blank hold a symbol behind two bytes."""
    words: Counter = Counter()
    triples = None

    def out() -> pa.RecordBatch:
        rec = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], names=["token", "c"])
        words.clear()
        return rec

    for _, texts in _blocks(batches, 0):
        for raw in texts:
            words.update(raw.lower().split())
        words[b""] += len(texts)
        # every byte and end behind the two bytes before it; a text begins behind two zeros
        s = np.frombuffer(b"\0\0" + b"\0\0".join(texts) + b"\0", np.uint8).astype(np.int32)
        symbol = ((s[1:-1] << 8) + s[:-2]) * 257 + s[2:]
        ends = np.cumsum(np.array([len(t) + 2 for t in texts])) - 2
        symbol[ends] += END
        if triples is None:
            triples = np.zeros(257 << 16, np.uint32)
        found, n = _distinct(np.delete(symbol, ends[:-1] + 1))
        triples[found] += n.astype(np.uint32)
        if len(words) > _FLUSH:
            yield out()
    yield out()
    if triples is not None:
        found = np.flatnonzero(triples)
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([b" " + k.to_bytes(4, "big") for k in part.tolist()], pa.binary()), pa.array(triples[part].astype(np.int64))], names=["token", "c"])


class Counts:
    """Counts of decisions in their slots. Letters are gathered, GATHER at a time; those that are equal in a context are spelled once there."""

    #: Contexts that are spelled together, after the last of them, which tells the others.
    TOGETHER = ((0, 1), (2,), (3,))

    def __init__(self, trees: Trees, bits: tuple[int, ...]):
        self.trees, self.bits = trees, bits
        self.table = np.zeros(2 * offsets(bits)[1], np.uint32)
        self.places = _Places()
        self.gathered: list[list[np.ndarray]] = [[] for _ in self.TOGETHER]
        self.held = 0

    def add(self, texts: list[bytes]) -> None:
        x = Letters(texts)
        contexts = _contexts(x.near, x.word)
        spelling = contexts[0] << np.uint64(9)
        spelling |= x.near & np.uint64(511)
        for ks, gathered in zip(self.TOGETHER, self.gathered, strict=True):
            # the slot, which puts the table's places in order, then the two bytes before and the symbol
            keys = _hashed(contexts[ks[-1]], ks[-1], self.bits)
            keys <<= np.uint64(25)
            keys |= spelling
            keys[x.padding] = _NONE
            gathered.append(keys)
        self.held += len(spelling)
        if self.held >= GATHER:
            self._flush()

    def _flush(self) -> None:
        for ks, gathered in zip(self.TOGETHER, self.gathered, strict=True):
            keys = np.concatenate(gathered)
            gathered.clear()
            keys, n = _distinct(keys)
            if keys[-1] == _NONE:
                keys, n = keys[:-1], n[:-1]
            for a in range(0, len(keys), BLOCK):
                self._spell(ks, keys[a : a + BLOCK], n[a : a + BLOCK])
        self.held = 0

    def _spell(self, ks: tuple[int, ...], keys: np.ndarray, n: np.ndarray) -> None:
        two = keys >> np.uint64(9) & np.uint64(0xFFFF)
        slots = {k: _hashed(two, k, self.bits) if k == 0 else keys >> np.uint64(25) for k in ks}
        ev = Events.of(two, keys & np.uint64(511), slots, self.trees, self.bits, True)
        n = np.repeat(n.astype(np.uint32), ev.many)
        for at in self.places.of(ev.slots.T):
            np.add.at(self.table, at, n)

    def total(self) -> np.ndarray:
        if self.held:
            self._flush()
        return self.table


def _chunk_counter(trees, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        counts = None
        for _, texts in _blocks(batches, 0):
            counts = counts or Counts(trees.value, bits)
            counts.add(texts)
        if counts:
            press = zstandard.ZstdCompressor(1)
            parts = counts.total().reshape(-1, 2 * CHUNK)
            for i in np.flatnonzero(parts.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((i, pa.int64()), (TaskContext.get().partitionId(), pa.int64()), (press.compress(parts[i].tobytes()), pa.binary()))], names=["chunk", "task", "counts"])

    return run


def _sum_of(table: pa.Table) -> np.ndarray:
    import zstandard

    total = np.zeros(2 * CHUNK, np.uint64)
    for x in table.column("counts"):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8)
        total += raw.view(np.uint32 if len(raw) == 8 * CHUNK else np.uint64)
    return total


def _add_chunks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The chunks of a group as one; the group's number stands for its tasks."""
    import zstandard

    total = _sum_of(table)
    small = total.astype(np.uint32) if int(total.max()) < 1 << 32 else total
    return pa.table({"chunk": [key[0].as_py()], "task": [key[1].as_py()], "counts": [zstandard.ZstdCompressor(1).compress(small.tobytes())]})


def _stretch(table: pa.Table) -> pa.Table:
    """Counts to predictions: the logit of the estimate, in sixteenths, one signed byte per slot."""
    n = _sum_of(table).reshape(-1, 2).astype(np.float64)
    logit = np.log(n[:, 1] + 0.4) - np.log(n[:, 0] + 0.4)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "logit": pa.array([np.clip(np.rint(logit * 16), -127, 127).astype(np.int8).tobytes()], pa.binary())})


#: Sureness of a signed byte: 0 never seen or balanced, 1 seen about once, 2 more.
_SURE = np.array([0 if abs(x) < 6 else 1 if abs(x) < 22 else 2 for x in np.arange(256).astype(np.uint8).view(np.int8).astype(int)], np.int16)
#: Probability that a signed byte of sixteenths stands for.
_SIGMA = 1 / (1 + np.exp(-np.arange(256).astype(np.uint8).view(np.int8) / 16))
#: How far such a prediction moves when the bit is 0, then when it is 1.
_MOVES = (MOVE * (np.array([[0], [1]]) - _SIGMA)).astype(np.float32).ravel()
#: Inputs that the gate looks at: 4 bytes, 6 bytes, the word.
_FOUR, _SIX, _WORD = 2, 3, 4


#: The gate, in parts by two hashed predictions that lie side by side in a row: the last 2 and 4 bytes, the last 6 and the word.
_HALVES = np.arange(1 << 16, dtype="<u2").view(np.uint8).reshape(-1, 2)
_GATE_FOUR = _SURE.take(_HALVES[:, _FOUR - 1]) * np.int16(3)
_GATE_SIX_WORD = (_SURE.take(_HALVES[:, _SIX - 3]) > 0) * np.int16(9) + _SURE.take(_HALVES[:, _WORD - 3])


def _gate(got: np.ndarray) -> np.ndarray:
    """Of rows of hashed predictions."""
    halves = got.view("<u2")
    gate = _GATE_FOUR.take(halves[:, 0])
    gate += _GATE_SIX_WORD.take(halves[:, 1])
    return gate


def _key(gate: np.ndarray, hint: np.ndarray, got: np.ndarray, weights: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """gate, quantised mixed logit and bit as one number. ``weights``: GATES x INPUTS in 1/256; whole numbers, so that every machine agrees."""
    half, unit = LEVELS // 2, int(STEP * 16 * 256)
    z = weights[:, 0].take(gate)
    z *= hint
    terms = weights[:, 1:].take(gate, axis=0)
    terms *= got
    for k in range(INPUTS - 1):
        z += terms[:, k]
    z += unit // 2
    z >>= unit.bit_length() - 1  # a power of two
    np.clip(z, -half, half, out=z)
    z += half
    z += gate * np.int32(LEVELS)
    z += z
    z += bit
    return z


class Model:
    """The frozen model: trees, table of predictions, weights per gate (in 1/256), and costs after correction."""

    def __init__(self, trees: Trees, bits: tuple[int, ...], table: np.ndarray, weights: np.ndarray | None = None, costs: np.ndarray | None = None):
        self.trees, self.bits, self.table = trees, bits, table
        self.weights = np.full((GATES, INPUTS), round(START * 256), np.int32) if weights is None else np.rint(weights * 256).astype(np.int32)
        self.costs = costs
        self.memo: Memo | None = None  # a worker's tasks share it

    def _cost(self, ev: Events) -> np.ndarray:
        got = self.table.take(ev.slots, mode="wrap")  # nothing is out of bounds; modes that need not raise are faster
        return self.costs.take(_key(_gate(got), ev.hint, got, self.weights, ev.bit), mode="clip")

    def decisions(self, texts: list[bytes]) -> tuple[np.ndarray, Events]:
        """log10 probability of each decision's bit."""
        ev = Events(texts, self.trees, self.bits)
        return self._cost(ev), ev

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability. A letter's cost is taken from the memo where that has it, which changes no digit."""
        x = Letters(texts)
        memo = self.memo = self.memo or Memo()
        item, at, new = memo.find(x)
        cost = memo.costs.take(at, mode="clip")
        for a in range(0, len(new), BLOCK):
            some = new[a : a + BLOCK]
            near = x.near.take(some, mode="clip")
            contexts = _contexts(near, x.word.take(some, mode="clip"))
            ev = Events.of(contexts[0], near & np.uint64(511), {k: _hashed(c, k, self.bits) for k, c in enumerate(contexts)}, self.trees, self.bits)
            cost[some] = c = np.add.reduceat(self._cost(ev), ev.of_letter)
            memo.keep(item.take(some, mode="clip"), at.take(some, mode="clip"), c)
        # the padding between texts is left out, so that a text adds up the same wherever it stands
        return np.add.reduceat(cost, np.stack([x.first, x.ends + 1], axis=1).ravel()[:-1])[::2]


class Online:
    """Weights, predictor states and correction counts that learn from one step of decisions after another."""

    def __init__(self, model: Model):
        self.table = model.table.astype(np.float32) / 16  # logits
        self.w = model.weights / 256
        self.hist = np.zeros(GATES * LEVELS * 2, np.int64)
        self.seen = 0

    def learn(self, hint: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> None:
        held = self.table.take(slots, mode="wrap")
        held *= 16
        np.rint(held, out=held)
        got = np.clip(held, -127, 127, out=held).astype(np.int8)
        gate = _gate(got)
        self.hist += np.bincount(_key(gate, hint, got, np.rint(self.w * 256).astype(np.int32), bit), minlength=len(self.hist))
        x = np.empty((INPUTS, len(bit)))
        np.divide(hint, 16, out=x[0])
        np.divide(got.T, 16, out=x[1:])
        z = sum(w.take(gate, mode="clip") * v for w, v in zip(self.w.T, x, strict=True))
        miss = bit - 1 / (1 + np.exp(-z))
        n = np.bincount(gate, minlength=GATES)[:, None]
        gradient = np.stack([np.bincount(gate, miss * v, minlength=GATES) for v in x], axis=1) / np.maximum(n, 1)
        self.w += RATE * np.minimum(n / 64, 1) * gradient
        # each predictor by its own error
        moves = _MOVES.take(got.view(np.uint8) + (bit << 8)[:, None], mode="clip")
        np.add.at(self.table, slots.ravel().astype(np.intp), moves.ravel())
        self.seen += len(bit)


def _mixer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        online = None
        for _, texts in _blocks(batches, 0):
            online = online or Online(m)
            ev = Events(texts, m.trees, m.bits)
            for a in range(0, len(ev.bit), BATCH):
                online.learn(ev.hint[a : a + BATCH], ev.slots[a : a + BATCH], ev.bit[a : a + BATCH])
        if online:
            total = np.concatenate([online.w.ravel() * online.seen, online.hist.astype(np.float64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array([float(online.seen)] * len(total))], names=["k", "total", "seen"])

    return run


def _costs(hist: np.ndarray) -> np.ndarray:
    """log10 probability of each bit per gate and level: a quarter the mixed logit, the rest what the map has learned of it."""
    z = np.tile((np.arange(LEVELS) - LEVELS // 2) * STEP, GATES)
    n = hist.reshape(-1, 2)
    prior = 1 / (1 + np.exp(-z))
    learned = (n[:, 1] + 8 * prior) / (n.sum(axis=1) + 8)
    learned = np.clip(learned, 1e-5, 1 - 1e-5)
    z = (z + 3 * (np.log(learned) - np.log1p(-learned))) / 4
    return np.stack([-np.logaddexp(0, z), -np.logaddexp(0, -z)], axis=1).ravel() / math.log(10)


def _scorer(model, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = model.value
        known = head.value
        place = TaskContext.get().partitionId() << 33
        for b, texts in _blocks(batches, 2):
            score = m.scores(texts)
            n_tokens, base, hits, tails, tfs = [], [], [], [], []
            for raw in texts:
                words = raw.lower().split()
                words.append(b"")
                c = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
                rare = c == 0
                n_rare = int(np.count_nonzero(rare))
                tail = Counter(compress(words, rare.tolist())) if n_rare else {}
                n_tokens.append(len(words)), hits.append(len(words) - n_rare)
                base.append(float(np.log10(c + 1).sum()))  # 0 for the rare
                tails.append(list(tail)), tfs.append(list(tail.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(place, place + len(texts)), pa.int64()), b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    pa.array(tails, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=_SCORED,
            )
            place += len(texts)

    return run


_SCORED = ["place", "id", "held_out", "n_tokens", "hits", "base", "score", "tail", "tf"]


_SENT = "chunk long, task long, counts binary"


def _added(docs: DataFrame, counting, scratch: Scratch, name: str) -> DataFrame:
    """Sums of the chunks that ``counting`` makes of the documents, in rounds of at most FAN_IN tables each."""
    sent, k = docs.select("text").mapInArrow(counting, _SENT), 0
    while True:
        group = F.floor(F.col("task") / FAN_IN).alias("g")
        now = scratch.write(sent.groupBy("chunk", group).applyInArrow(_add_chunks, _SENT), f"{name}{k}")
        if k:
            scratch.drop(sent)
        if (now.agg(F.max("task")).first()[0] or 0) < FAN_IN:
            return now
        sent, k = now, k + 1


def _predictions(sums: DataFrame, bits: tuple[int, ...], scratch: Scratch, name: str) -> np.ndarray:
    """The table of predictions that the sums of all chunks give."""
    table = np.zeros(offsets(bits)[1], np.int8)
    logits = scratch.write(sums.groupBy("chunk").applyInArrow(_stretch, "chunk long, logit binary"), name)
    for chunk, logit in logits.toLocalIterator():  # bounded by MOST_BITS
        table[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(logit, np.int8)
    scratch.drop(logits)
    return table


def _trees(triples: DataFrame) -> tuple[Trees, int]:
    """The trees that counts (k, c) of symbols behind two bytes give, and the number of symbols."""
    pairs = np.zeros(256 * 257, np.int64)
    behind = F.floor(F.col("k") / 257)
    for k, c in triples.groupBy((F.floor(F.col("k") / (257 * 256)) * 257 + F.col("k") % 257).alias("k")).agg(F.sum("c")).collect():  # at most a row per byte and symbol
        pairs[k] = c
    whole = int(pairs.sum())
    frequent = triples.groupBy(behind.alias("two")).agg(F.sum("c").alias("n")).where(F.col("n") > whole // TREE_SHARE).select("two")  # fewer than TREE_SHARE
    frequent = [r.two for r in frequent.collect() if not _SPACE[r.two >> 8]]  # words begin in one tree
    more = {two: np.zeros(257, np.int64) for two in sorted(frequent)}
    for k, c in triples.where(behind.isin(frequent)).collect() if more else ():
        more[k // 257][k % 257] = c
    return Trees(pairs.reshape(256, 257), more), whole


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits (the same as total bits)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "lm")
    check = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    plain = docs.select(docs[id_col].alias("id"), (check % FOLDS == HELD_OUT).alias("held_out"), docs[text_col].cast("string").alias("text"), check.alias("crc"))
    train = plain.where(~F.col("held_out"))
    mixing = F.floor(F.col("crc") / FOLDS) % MIX_FOLD == 0

    counted = scratch.write(train.select("text").mapInArrow(_count_tokens, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    pair = F.substring("token", 1, 1) == F.lit(b" ")
    trees, n_bytes = _trees(counted.where(pair).select(F.conv(F.hex(F.substring("token", 2, 4)), 16, 10).cast("long").alias("k"), "c"))
    vocabulary = counted.where(~pair)
    n_train, n_distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts by eighths of a power of two: a few hundred rows tell from which count on there are at most HEAD tokens
    eighth = F.floor(F.log2("c") * 8)
    many, least = 0, 1 << 62
    for e, k in sorted(((r[0], r[1]) for r in vocabulary.groupBy(eighth).count().collect()), reverse=True):
        many += k
        if many > HEAD:
            break
        least = e
    head = {bytes(r["token"]): r["c"] for r in vocabulary.where(eighth >= least).collect()}  # at most HEAD rows

    bits = table_bits(n_bytes)
    counting = _chunk_counter(sc.broadcast(trees), bits)
    some = _added(train.where(~mixing), counting, scratch, "some")
    first = sc.broadcast(Model(trees, bits, _predictions(some, bits, scratch, "logits0")))
    mixed = train.where(mixing).select("text").mapInArrow(_mixer(first), "k long, total double, seen double").groupBy("k").agg(F.sum("total").alias("t"), F.sum("seen").alias("s")).collect()
    flat, seen = np.zeros(GATES * INPUTS + GATES * LEVELS * 2), 0.0
    for k, t, s in mixed:
        flat[k], seen = t, s
    weights = flat[: GATES * INPUTS].reshape(GATES, INPUTS) / seen if seen else None
    first.unpersist()
    # the weights are fitted: now the documents that fitted them join the counts
    rest = _added(train.where(mixing), counting, scratch, "rest")
    model = Model(trees, bits, _predictions(some.unionByName(rest), bits, scratch, "logits"), weights, _costs(flat[GATES * INPUTS :]))
    scratch.drop(some, rest)

    parts = T.StructType(
        [T.StructField("place", T.LongType()), plain.schema["id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "hits"))]
        + [*(T.StructField(c, T.DoubleType()) for c in ("base", "score")), T.StructField("tail", T.ArrayType(T.BinaryType())), T.StructField("tf", T.ArrayType(T.LongType()))]
    )
    scored = scratch.write(plain.select("id", "held_out", "text").mapInArrow(_scorer(sc.broadcast(model), sc.broadcast(head)), parts), "scored")
    rare = scored.select("place", F.explode(F.arrays_zip("tail", "tf")).alias("x")).select("place", F.col("x.tail").alias("token"), F.col("x.tf").alias("tf"))
    rare = rare.join(vocabulary, "token").groupBy("place").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log"))
    out = scored.join(rare, "place", "left")
    share = math.log10(n_train + n_distinct + 1)
    return out.select(
        "id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(share)).alias("base_score"), "score", (-F.col("score") * F.lit(math.log2(10))).alias("bits"),
    )
