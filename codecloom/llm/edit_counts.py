"""Edit-aware token counts: a segment tree over pre-tokens per document, updated where edits touch it.

A leaf of a document's tree stands for about ``LEAF`` consecutive pre-tokens and holds their characters and tokens; inner nodes hold sums.
An edit finds its leaves by descending the tree, re-splits from one leaf before it until a pre-token boundary falls on an old leaf boundary
behind it, counts the tokens of those pre-tokens alone, and adds the differences along the paths to the root. Splitting looks ahead no further than
a special token is long and never back, so a boundary that both texts share makes everything behind it equal.

``build_trees`` writes nothing itself; its rows (id, text, chars, tokens, and all other columns) are the store that a caller keeps.
``apply_edits`` takes such rows with an array column of edits and gives the rows after them. Neither shuffles: a document's text, tree
and edits are one row.

Results in odd cases: a null text counts as empty, with no tokens. A special token's string is one token, as in ``packing``, also where an
edit makes or breaks it. Runs of one character may be of any length. Positions and lengths beyond the text are cut to it, null edits or fields
count as no edit, 0 or the empty string. Edits apply in the order of the array, each to the text the one before left. Repeated rows are documents of
their own. An empty table gives no rows. Extra columns pass through ``build_trees`` and ``apply_edits``, which fail only if a column is
called as one of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import encoder, public_vocabulary, spans, special_pattern

LEAF = 32
EDITS = "array<struct<pos:bigint,drop:bigint,insert:string>>"


class Counter(dict):
    """Tokens of a pre-token; bounded, starts anew when full."""

    def __init__(self, vocabulary: dict, most: int = 300_000):
        super().__init__()
        self.enc, self.most = encoder(**vocabulary), most
        self.pattern, self.special = regex.compile(vocabulary["pattern"]), special_pattern(vocabulary["special"])
        self.names = {name for name, _ in vocabulary["special"]}

    def __missing__(self, piece: str) -> int:
        # a pre-token needs no splitting, and the encoder's own would fail on long runs
        n = 1 if piece in self.names else len(self.enc._encode_single_piece(piece))
        if len(piece) <= 200:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n

    def words(self, text: str) -> list[str]:
        if self.special.search(text):
            return [text[a:b] for a, b, _ in spans(text, self.pattern, self.special)]
        return self.pattern.findall(text)


class Tree:
    """chars and tokens: sums in heap order, the root at 1, the leaves in the last half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.cap = len(chars) // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        cap = 1
        while cap < len(chars):
            cap *= 2
        out = []
        for leaves in (chars, tokens):
            sums = np.zeros(2 * cap, np.int64)
            sums[cap : cap + len(leaves)] = leaves
            at = cap
            while at > 1:
                sums[at // 2 : at] = sums[at : 2 * at].reshape(-1, 2).sum(axis=1)
                at //= 2
            out.append(sums)
        return cls(*out)

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` (the last leaf with any if beyond) and where it starts."""
        node, start = 1, 0
        pos = min(pos, int(self.chars[1]) - 1)
        while node < self.cap:
            node *= 2
            if pos >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.cap, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.cap
        dc, dt = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node and (dc or dt):
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2


def plant(text: str, counter: Counter) -> Tree:
    pieces = counter.words(text)
    chars, tokens = [], []
    for k in range(0, len(pieces), LEAF):
        part = pieces[k : k + LEAF]
        chars.append(sum(map(len, part)))
        tokens.append(sum(map(counter.__getitem__, part)))
    return Tree.of(chars or [0], tokens or [0])


def edit(text: str, tree: Tree, pos: int, drop: int, insert: str, counter: Counter) -> tuple[str, Tree, int]:
    """Text and tree after one edit, and the characters that were split again."""
    pos = max(0, min(pos, len(text)))
    end = min(len(text), pos + max(0, drop))
    new = text[:pos] + insert + text[end:]
    if not text or not new:
        return new, plant(new, counter), len(new)
    first, start = tree.leaf_at(max(0, pos - 1))
    while first > 0 and pos - start < 4 * LEAF:  # boundary context: at least a leaf of characters that the edit leaves alone
        first -= 1
        start -= int(tree.chars[tree.cap + first])
    last, stop = tree.leaf_at(max(end - 1, 0))
    stop += int(tree.chars[tree.cap + last])
    shift = len(new) - len(text)
    leaves = tree.cap
    cuts, counts = [start], []
    behind = last + 1
    for a, b, _ in spans(new, counter.pattern, counter.special, start):
        counts.append(counter[new[a:b]])
        cuts.append(b)
        while behind < leaves and stop + shift < b:
            stop += int(tree.chars[tree.cap + behind])
            behind += 1
        if b == stop + shift and b >= pos + len(insert):
            break
    if len(counts) > 4 * LEAF * (behind - first):  # leaves would grow too large
        return new, plant(new, counter), len(new)
    sums = np.concatenate([[0], np.cumsum(counts)]) if counts else np.zeros(1, np.int64)
    share = np.linspace(0, len(counts), behind - first + 1).round().astype(int)
    for leaf, a, b in zip(range(first, behind), share[:-1], share[1:], strict=True):
        tree.set(leaf, cuts[b] - cuts[a], int(sums[b] - sums[a]))
    return new, tree, cuts[-1] - start


def _planter(vocabulary: dict, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                trees = [plant(t.as_py() or "", counter) for t in b.column(b.schema.get_field_index("text"))]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([getattr(t, c).astype(np.int32).tobytes() for t in trees], pa.binary()) for c in ("chars", "tokens"))], names=names)

    return run


def build_trees(docs: DataFrame, text_col: str = "text", vocabulary: dict | None = None) -> DataFrame:
    """The rows with ``text`` as it was and their trees: chars, tokens (32-bit sums in heap order)."""
    docs = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    names = [*docs.columns, "chars", "tokens"]
    return docs.mapInArrow(_planter(vocabulary or public_vocabulary(), names), T.StructType([*docs.schema.fields, T.StructField("chars", T.BinaryType()), T.StructField("tokens", T.BinaryType())]))


def _editor(vocabulary: dict, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                col = {n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names) if n in ("text", "chars", "tokens", "edits")}
                texts, trees, before, after, work = [], [], [], [], []
                for text, chars, tokens, edits in zip(col["text"], col["chars"], col["tokens"], col["edits"], strict=True):
                    text = text or ""
                    tree = Tree(np.frombuffer(chars, np.int32).astype(np.int64), np.frombuffer(tokens, np.int32).astype(np.int64))
                    before.append(int(tree.tokens[1]))
                    done = 0
                    for e in edits or ():
                        if e is not None:
                            text, tree, n = edit(text, tree, e["pos"] or 0, e["drop"] or 0, e["insert"] or "", counter)
                            done += n
                    texts.append(text), trees.append(tree), after.append(int(tree.tokens[1])), work.append(done)
                new = {"text": pa.array(texts, pa.string()), **{c: pa.array([getattr(t, c).astype(np.int32).tobytes() for t in trees], pa.binary()) for c in ("chars", "tokens")}}
                cols = [new.get(n, b.column(k)) for k, n in enumerate(b.schema.names) if n != "edits"]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (before, after, work))], names=names)

    return run


def apply_edits(store: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """Rows of ``build_trees`` with a column ``edits`` (EDITS), after them: text, chars, tokens are new, edits gives way to tokens_before,
    tokens_after and chars_split."""
    rows = store.withColumn("edits", F.col("edits").cast(EDITS))
    fields = [f for f in rows.schema.fields if f.name != "edits"] + [T.StructField(c, T.LongType()) for c in ("tokens_before", "tokens_after", "chars_split")]
    return rows.mapInArrow(_editor(vocabulary or public_vocabulary(), [f.name for f in fields]), T.StructType(fields))
