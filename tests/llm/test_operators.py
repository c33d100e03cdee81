"""Each operator against a plain version of what it promises, over odd rows and over a small table of documents."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codecloom.llm import edit_counts, exact_dedup, licences, lm_scoring, mixing, near_dedup, packing, quality, quotations, substring_dedup
from tests.llm.conftest import BASE, SCHEMA

DATA = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def sample_rows(sample):
    return [(r.doc_id, r.text) for r in sample.collect()]


# packing


def check_packing(pieces, texts, window):
    """texts: multiset of (id, text)."""
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in texts:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        got[p.id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.crc
    assert got == want
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total, tok


def test_packing_odd_rows(docs, rows):
    pieces = packing.pack(docs, window=64).collect()
    check_packing(pieces, [(r[0], r[1]) for r in rows], 64)


def test_packing_ids_and_padding(sample, sample_rows):
    pieces = packing.pack(sample).collect()
    padding, tok = check_packing(pieces, sample_rows, packing.WINDOW)
    assert padding < 0.02
    texts = dict(sample_rows)
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.id].append((p.start, bytes(p.ids)))
    for i, parts in by.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(parts)), np.uint32).tolist()
        assert ids == [*tok.encode(texts[i], add_special_tokens=False).ids, 1]


def test_packing_neighbours_are_related():
    idf = np.ones(100)
    frags = [np.array(x, np.uint32) for x in ([1, 2, 3, 4], [50, 51], [1, 2, 3], [60, 61])]
    first = next(iter(packing.Shard(frags, idf, 3.0).windows(7)))
    assert [d for d, _, _ in first] == [0, 2]


def test_packing_any_text():
    """Texts of any length and kind have the ids of the tokenizers library."""
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary, mark = packing.public_vocabulary(), "<|endoftext|>"
    for t in (" " * 2_000_000, "a" * 2_000_000, "x\n" * 1000 + "\n" * 1_000_000, "a" + " " * 1_200_000 + mark + " " * 300_000 + "z", (" " + mark + "  x" + mark) * 20_000, "é漢 ́ab's 12 \x1c\x85 " * 30_000):
        assert packing.encode(t, vocabulary) == tok.encode(t, add_special_tokens=False).ids


def test_packing_cuts_where_ids_cannot_change(monkeypatch):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    vocabulary, rng = packing.public_vocabulary(), random.Random(8)
    pool = [" ", "  ", "a", "b ", "\n", "é漢", "́", "1", "'s", "'", "<|endoftext|>", "<|", "|>", "#", "\t", "\x85", "\x1c", "\u2003", "endoftext"]
    for size in (5, 20) * 100:
        monkeypatch.setattr(packing, "LONG", size)
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(200)))
        assert packing.encode(t, vocabulary) == tok.encode(t, add_special_tokens=False).ids


def test_packing_long_runs(spark):
    docs = spark.createDataFrame([(1, " " * 1_500_000), (2, "b" * 1_500_000), (3, "end")], "doc_id long, text string")
    got = packing.pack(docs, with_ids=False).groupBy("id").agg(F.sum("length").alias("n")).collect()
    assert {r.id: r.n for r in got} == {1: 1_500_001, 2: len(packing.encode("b" * 1_500_000, packing.public_vocabulary())) + 1, 3: 2}


def test_packing_brings_relatives_together(spark, monkeypatch):
    """With many shards, texts on one subject meet in windows far more often than at random."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 4_000)
    rng = random.Random(6)
    common = [f" {w}" for w in "the of and to in is was for on that with as it at by from or an be this which are".split()]
    letters = "bcdfghjklmnpqrstvwxz"
    subjects = [[f" {rng.choice(letters)}{rng.choice('aeiou')}{rng.choice(letters)}{rng.choice('aeiou')}{rng.choice(letters)}" for _ in range(12)] for _ in range(40)]
    rows = [(k, "".join(rng.choice(subjects[k % 40] if rng.random() < 0.4 else common) for _ in range(40))) for k in range(1200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=512, with_ids=False).collect()
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p.id % 40)
    assert len({w >> 33 for w in windows}) > 5

    def alike(groups):
        return sum(a == b for g in groups for a, b in zip(g, g[1:], strict=False)) / sum(len(g) - 1 for g in groups)

    assert alike([w for w in windows.values() if len(w) > 1]) > 0.3  # 1 in 40 at random


def test_packing_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string")
    assert sorted((str(r.id), r.length) for r in packing.pack(docs).collect()) == [("None", 2), ("a", 3)]


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


# scores


def test_scores_base(sample, sample_rows):
    got = {r.id: r for r in lm_scoring.score_texts(sample).collect()}
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in sample_rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert -math.inf < r.score < 0
    size = {i: len((t or "").encode()) for i, t in sample_rows}
    bits = sum(got[i].bits for i in size if held[i]) / sum(size[i] for i in size if held[i])
    assert bits < 3.2  # below 8 bits a byte by far, on texts it never saw


def some_model(seed):
    rng = np.random.default_rng(seed)
    trees, bits = lm_scoring.Trees(rng.integers(0, 50, (256, 257)), {ord("b") << 8 | ord("a"): rng.integers(0, 9, 257), 0: rng.integers(0, 9, 257)}), lm_scoring.table_bits(0)
    table = rng.integers(-60, 60, lm_scoring.offsets(bits)[1]).astype(np.int8)
    return lm_scoring.Model(trees, bits, table, costs=lm_scoring._costs(np.zeros(lm_scoring.GATES * lm_scoring.LEVELS * 2)))


def test_scores_are_probabilities():
    """Over all symbols the model's probabilities add up to 1 in any context."""
    model = some_model(0)

    def before_end(text):
        cost, _ = model.decisions([text])
        two = bytes(2) + text
        return 10 ** cost[: len(cost) - model.trees.length[model.trees.tree[two[-1] << 8 | two[-2]] * 257 + lm_scoring.END]].sum()

    for before in (b"", b"ab"):
        # the probability of a text that goes on with s is that of its bytes without its end mark
        total = 10 ** model.scores([before])[0] + sum(before_end(before + bytes([s])) for s in range(256))
        assert total == pytest.approx(before_end(before), rel=1e-6)


def test_scores_do_not_depend_on_the_batch():
    model = some_model(1)
    texts = [b"", b"one two", "é漢 THREE".encode(), b"\n\n"]
    assert model.scores(texts) == pytest.approx([model.scores([t])[0] for t in texts])


def test_places_among_counts():
    texts = [b"", b"a few words and then some more", b"\xff\x00 \n\n", b"x" * 3000]
    pairs = np.random.default_rng(3).integers(0, 50, (256, 257))
    trees = lm_scoring.Trees(pairs, {ord("e") << 8 | ord("h"): pairs[7]})
    plain, counted = (lm_scoring.Events(texts, trees, (20, 21, 19, 22), x) for x in (False, True))
    assert (counted.slots == 2 * plain.slots + plain.bit[:, None].astype(np.uint32)).all()
    assert (counted.bit == plain.bit).all() and (counted.of_text == plain.of_text).all()
    places = lm_scoring._Places()
    for part in (plain.slots[:50], plain.slots, plain.slots[:7]):
        assert (places.of(part.T) == part.T).all() and places.held.dtype == np.intp


def test_letters_that_come_again_are_spelled_once(monkeypatch):
    """Scores and counts are those of every single letter, but equal letters' decisions are made once while the memo or the gathered block has them."""
    texts = [b"", b"one two three one two three", "é漢 THREE".encode(), b"\0\0 \n\n", b"x" * 300, b"one two three one two three"]
    spelled, spell = [0], lm_scoring.Events._spell
    monkeypatch.setattr(lm_scoring.Events, "_spell", lambda ev, two, *rest: (spelled.append(len(two)), spell(ev, two, *rest))[1])
    model = some_model(4)
    whole = [model.decisions([t])[0].sum() for t in texts]
    for places in (0, 3, 12):
        monkeypatch.setattr(lm_scoring, "MEMO_BITS", places + 1)
        model.memo = None
        first = model.scores(texts)
        assert first == pytest.approx(whole)
        assert (first == np.concatenate([model.scores([t]) for t in texts])).all()  # to the last digit, however much the memo holds
    spelled.clear()
    assert (model.scores(texts[1:2] * 3) == first[1]).all() and sum(spelled) == 0
    plain = lm_scoring.Events(texts, model.trees, model.bits, True)
    want = np.zeros(2 * lm_scoring.offsets(model.bits)[1], np.uint32)
    np.add.at(want, plain.slots.ravel(), np.uint32(1))
    for gather in (1, 40, 1 << 20):
        monkeypatch.setattr(lm_scoring, "GATHER", gather)
        counts = lm_scoring.Counts(model.trees, model.bits)
        spelled.clear()
        for t in texts:
            counts.add([t])
        counts.add(texts[:3])
        counts.add(texts[3:])
        assert (counts.total() == 2 * want).all()
    assert sum(spelled) < 0.25 * len(lm_scoring.Counts.TOGETHER) * 2 * sum(len(t) + 1 for t in texts)


def test_scores_tell_whole_words_apart():
    """Words that share their length and last eight bytes are contexts of their own."""
    trees = lm_scoring.Trees(np.ones((256, 257)))
    one, two, folded = (lm_scoring.Events([t], trees, (20, 20, 20, 20)) for t in (b"in abcdefgh12345678x", b"in hgfedcba12345678x", b"in ABCDEFGH12345678x"))
    at = trees.length[ord("x") * 257 + lm_scoring.END] + 1  # a decision within the last byte
    assert one.slots[-at, 3] != two.slots[-at, 3] and one.slots[-at, 3] == folded.slots[-at, 3]
    assert one.slots[-at, 2] == two.slots[-at, 2]


def test_table_sizes_follow_the_corpus():
    sizes = [sum(lm_scoring.table_bits(1 << k)) for k in range(20, 60)]
    assert sizes == sorted(sizes) and len(set(sizes)) > 4 and max(lm_scoring.table_bits(1 << 60)) == lm_scoring.MOST_BITS


# fixed values: multipliers of the hashed contexts, of the tree nodes, and of the word's running hash
MULTIPLIERS, NODE, WORD_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 0x9E3779B1, 0x2545F4914F6CDD1D


class PlainModel:
    """The context-mixing model one bit at a time, over dictionaries."""

    def __init__(self, docs):
        crc = {i: zlib.crc32(str(i).encode()) for i, _ in docs}
        train = [(i, t) for i, t in docs if crc[i] % 7 != 2]
        fold = [t for i, t in train if crc[i] // 7 % lm_scoring.MIX_FOLD == 0]
        rest = [t for i, t in train if crc[i] // 7 % lm_scoring.MIX_FOLD]
        pairs, more = np.zeros((256, 257), np.int64), collections.defaultdict(lambda: np.zeros(257, np.int64))
        for _, t in train:
            for a, b, c in zip(b"\0\0" + t, b"\0" + t, [*t, 256], strict=False):
                pairs[b, c] += 1
                more[b << 8 | a][c] += 1
        n = int(pairs.sum())
        self.trees = lm_scoring.Trees(pairs, {k: x for k, x in sorted(more.items()) if x.sum() > n // lm_scoring.TREE_SHARE and k >> 8 not in b" \t\n\v\f\r"})
        self.bits = lm_scoring.table_bits(n)
        self.counts = collections.defaultdict(lambda: [0, 0])
        for t in rest:
            self.count(t)
        self.states = {}
        self.weights = [[lm_scoring.START] * lm_scoring.INPUTS for _ in range(lm_scoring.GATES)]
        self.hist = collections.Counter()
        decisions = [d for t in fold for d in self.decisions(t)]
        for k in range(0, len(decisions), lm_scoring.BATCH):
            self.learn(decisions[k : k + lm_scoring.BATCH])
        for t in fold:
            self.count(t)

    def decisions(self, text):
        """(bit, hint, slots) of each decision, in order."""
        full = bytes(8) + text
        for k in range(len(text) + 1):
            past = full[k : k + 8]
            begin = k
            while begin and full[7 + begin] not in b" \t\n\v\f\r":
                begin -= 1
            word = 0
            for j, c in enumerate(text[begin:k].lower()):
                word = (word + (c + 1) * pow(WORD_BASE, j, 1 << 64)) % (1 << 64)
            word ^= past[-1] << 56
            symbol = text[k] if k < len(text) else 256
            at = int(self.trees.tree[past[-1] << 8 | past[-2]]) * 257 + symbol
            for p in range(self.trees.start[at], self.trees.start[at] + self.trees.length[at]):
                step = int(self.trees.steps[p])
                salt = ((step >> 1) + 1) * NODE % (1 << 32)
                slots = []
                for c, m, b, near in zip((*(int.from_bytes(past[-n:], "little") for n in (2, 4, 6)), word), MULTIPLIERS, self.bits, lm_scoring.NEAR_BITS, strict=True):
                    slots.append((((c + 1) * m % (1 << 64)) >> (64 - b)) ^ (salt >> (32 - min(b, near))))
                yield step & 1, int(self.trees.hints[p]), slots

    def count(self, text):
        for bit, _, slots in self.decisions(text):
            for k, s in enumerate(slots):
                self.counts[k, s][bit] += 1

    def frozen(self, k, s):
        zero, one = self.counts.get((k, s), (0, 0))
        return max(-127, min(127, round(16 * (math.log(one + 0.4) - math.log(zero + 0.4)))))

    def gate(self, got):
        sure = [0 if abs(x) < 6 else 1 if abs(x) < 22 else 2 for x in got]
        return 3 * sure[1] + sure[3] + 9 * (sure[2] > 0)

    def level(self, weights, gate, inputs):
        z = sum(round(256 * w) * x for w, x in zip(weights[gate], inputs, strict=True))
        return max(-(lm_scoring.LEVELS // 2), min(lm_scoring.LEVELS // 2, (z + 512) // 1024))

    def learn(self, decisions):
        moves, gradient, n = collections.Counter(), collections.defaultdict(float), collections.Counter()
        for bit, hint, slots in decisions:
            got = [max(-127, min(127, round(16 * float(self.states.setdefault((k, s), np.float32(self.frozen(k, s) / 16)))))) for k, s in enumerate(slots)]
            g = self.gate(got)
            self.hist[g, self.level(self.weights, g, [hint, *got]), bit] += 1
            x = [v / 16 for v in (hint, *got)]
            miss = bit - 1 / (1 + math.exp(-sum(w * v for w, v in zip(self.weights[g], x, strict=True))))
            n[g] += 1
            for k, v in enumerate(x):
                gradient[g, k] += miss * v
            for k, s in enumerate(slots):
                moves[k, s] += lm_scoring.MOVE * (bit - 1 / (1 + math.exp(-x[k + 1])))
        for (g, k), v in gradient.items():
            self.weights[g][k] += lm_scoring.RATE * min(n[g] / 64, 1) * v / n[g]
        for key, v in moves.items():
            self.states[key] += np.float32(v)

    def score(self, text):
        total = 0.0
        for bit, hint, slots in self.decisions(text):
            got = [self.frozen(k, s) for k, s in enumerate(slots)]
            g = self.gate(got)
            level = self.level(self.weights, g, [hint, *got])
            z, seen = level * lm_scoring.STEP, [self.hist[g, level, b] for b in (0, 1)]
            p = min(1 - 1e-5, max(1e-5, (seen[1] + 8 / (1 + math.exp(-z))) / (sum(seen) + 8)))
            z = (z + 3 * math.log(p / (1 - p))) / 4
            total -= math.log10(1 + math.exp(-z if bit else z))
        return total


def test_scores_equal_the_plain_model(spark, monkeypatch):
    """Every score to the last digits, learned and scored one bit at a time; steps small enough for several of them."""
    monkeypatch.setattr(lm_scoring, "BATCH", 100)
    monkeypatch.setattr(lm_scoring, "MIX_FOLD", 4)
    monkeypatch.setattr(lm_scoring, "TREE_SHARE", 60)
    rng = random.Random(7)
    words = ["The", "the", "of", "Zürich", "alpha", "beta-gamma", "x1", "漢字", "abcdefghijkl"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "\n", ", "]) for _ in range(rng.randrange(25)))) for k in range(60)]
    rows += [(60, None), (61, "")]
    plain = PlainModel([(i, (t or "").encode()) for i, t in rows])
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.score == pytest.approx(plain.score((texts[r.id] or "").encode()), rel=1e-9)


def test_scores_beat_word_counts_at_scale(spark):
    """On texts it never saw the model takes fewer bits than the base score does."""
    got = lm_scoring.score_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")).where("held_out")
    model, base = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert model > base


def test_scores_count_the_mixing_documents(spark, monkeypatch):
    """Documents that train the mixing are in the tables when texts are scored."""
    docs = spark.createDataFrame([(k, f"{BASE} {k}") for k in range(60)], "doc_id long, text string")

    def total():
        return sum(r.bits for r in lm_scoring.score_texts(docs).collect())

    monkeypatch.setattr(lm_scoring, "MIX_FOLD", 1 << 40)
    counted = total()
    monkeypatch.setattr(lm_scoring, "MIX_FOLD", 1)
    assert total() < 1.5 * counted


def test_scores_odd_rows(docs, rows, empty):
    got = lm_scoring.score_texts(docs).collect()
    assert len(got) == len(rows)
    assert {r.n_tokens for r in got if r.id in (4, 5, 6)} == {1}
    assert lm_scoring.score_texts(empty).count() == 0


# passages


def plain_substrings(rows, window):
    key = lambda i: (i is None, i)
    least = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x not in least or key(i) < key(least[x]):
                least[x] = i
    out = []
    for i, t in rows:
        w = split(t)
        lost = [False] * len(w)
        for k in range(len(w) - window + 1):
            if key(least[tuple(w[k : k + window])]) < key(i):
                lost[k : k + window] = [True] * window
        kept = b" ".join(x for x, y in zip(w, lost, strict=True) if not y)
        out.append((i, len(w), sum(lost), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_substrings_odd_rows(docs, rows, empty):
    got = sorted(map(tuple, substring_dedup.dedup_substrings(docs).collect()), key=str)
    assert got == plain_substrings([(r[0], r[1]) for r in rows], 13)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substrings_random_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i % 90, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, substring_dedup.dedup_substrings(df, window=9).collect()), key=str)
    assert got == plain_substrings(rows, 9)


def test_difference_cover():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert all(any((i + h) % p in cover and (j + h) % p in cover for h in range(p)) for i in range(p) for j in range(p))


# quality


def plain_counts(text):
    w = split(text)
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = set()
    for k in range(len(w) - 2):
        if grams[tuple(w[k : k + 3])] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(docs, rows, spark, sample, sample_rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for df, pairs in ((docs, [(r[0], r[1]) for r in rows]), (sample, sample_rows)):
        got = sorted((tuple(r[c] for c in ("id", *quality.COUNTS[:5], "base_failed")) for r in quality.quality_verdicts(df, labels).collect()), key=str)
        want = []
        for i, t in pairs:
            c = plain_counts(t)
            want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        assert got == sorted(want, key=str)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.3), (3, 50, 0.05), (7, 9, 0.5), (40, 1000, 0.05)):
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert quality.binomial_tail(5, 5, 0.1) == 1


def test_quality_rejects_junk_and_keeps_clean(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(4000):
        bad = i % 5 == 0
        text = " ".join(word() + ("###$$$" if bad else "") for _ in range(60))
        rows.append((i, text, "en"))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.quality_verdicts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.id for r in got.where("kept").collect()}
    assert kept == {i for i in range(4000) if i % 5}
    # too few labels certify nothing
    few = quality.quality_verdicts(docs, spark.createDataFrame(labels[:50], "doc_id long, quality int, toxic int"))
    assert few.where("not kept").count() == 0


def plain_verdicts(features, labels, folds):
    """kept by id. features: rows with id, stratum and COUNTS; labels: (id, quality); folds: id to a or b."""
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = min(good.get(i, 1), int(q > 0))

    def cells(r):
        share = [(r.n_symbols, r.word_chars), (r.n_dup_lines, r.n_lines), (r.n_repeat_words, r.n_words), (r.n_upper, r.n_words)]
        return [min(quality.GRID, math.ceil(a / b * quality.GRID - 1e-9)) if b else 0 for a, b in share]

    def failed(r):
        return r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words

    seen = collections.defaultdict(list)
    for r in features:
        if r.id in good and not failed(r):
            for rule, c in enumerate(cells(r)):
                seen[r.stratum, rule].append((c, good[r.id], folds[r.id]))
    best = {}
    for key, rows in seen.items():
        worth = max((sum(c > cut and not g and f == "a" for c, g, f in rows) - quality.PRICE * sum(c > cut and g and f == "a" for c, g, f in rows), cut) for cut in range(quality.GRID + 1))
        if worth[0] > 0:
            best[key] = worth[1]
    cuts = {}
    for (stratum, rule), least in best.items():
        certify = [c for c, g, f in seen[stratum, rule] if g and f == "b"]
        alpha = quality.ALPHA / sum(s == stratum for s, _ in best)
        for cut in range(quality.GRID, least - 1, -1):
            k, n = sum(c > cut for c in certify), len(certify)
            if sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > quality.DELTA / len(best):
                break
            cuts[stratum, rule] = cut
    return {r.id: not failed(r) and not any(c > cuts.get((r.stratum, rule), quality.GRID) for rule, c in enumerate(cells(r))) for r in features}


def check_verdicts(got, docs, labels):
    fold = F.when(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(100)) < quality.SELECT, "a").otherwise("b").alias("fold")
    folds = {r.doc_id: r.fold for r in docs.select("doc_id", fold).collect()}
    want = plain_verdicts(got, [(r.doc_id, r.quality) for r in labels.collect()], folds)
    assert {r.id: r.kept for r in got} == want
    return want


def test_quality_verdicts_equal_the_plain_selection(spark):
    for sf in ("sf0.001", "sf0.1"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        want = check_verdicts(quality.quality_verdicts(docs, labels).collect(), docs, labels)
    kept = {r.doc_id for r in quality.quality_filter(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, k in want.items() if k}


def test_quality_filter_keeps_columns(docs, empty, spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_filter(docs, labels)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 2, 3, 7, None]
    assert quality.quality_filter(empty, labels).count() == 0
    assert quality.quality_filter(docs, labels.limit(0)).count() == 6


# exact copies


def test_exact_groups(docs, rows, empty):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    kept = collections.Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r.sha))
        ids = [i for i in groups[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[text]))
        kept[text] += r.kept
    assert kept == dict.fromkeys(groups, 1)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_rows(docs, rows):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r.text or "" for r in got) == sorted({r[1] or "" for r in rows})
    assert {r.doc_id for r in got if r.text == BASE} == {2}


def test_exact_hashes_survivors_only(spark):
    """Whole texts are hashed where another row has the length and the prefix, and nowhere else."""
    from codecloom.llm.common import Scratch

    same = "x" * 70
    texts = [f"length {k:03d}" + "y" * k for k in range(100)] + [f"{k:03d}" + "z" * 200 for k in range(50)] + [same + "a", same + "b", same + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = exact_dedup.refine(docs, Scratch(spark, "t")).collect()
    assert {r.id for r in rows if r.sha is not None} >= {150, 151, 152} and sum(r.sha is not None for r in rows) < 10
    assert sum(r.prefix is not None for r in rows) < 70
    got = exact_dedup.exact_groups(docs, hash_all=False)
    assert {r.id for r in got.where("not kept").collect()} == {150}


def test_exact_dedup_doubtful_rows(spark, monkeypatch):
    """A filter that says yes to everything, and rows that share id and length."""
    from codecloom.llm import common

    monkeypatch.setattr(common.BitFilter, "_at", lambda self, *cols: F.lit(0).cast("long"))
    rows = [(1, "aa", 7), (1, "ab", 7), (2, "aa", 7), (2, "aa", 8), (3, "cc", 9), (None, "aa", 1), (None, "q", 2), (None, "r", 3), (4, None, 5), (5, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own long")
    got = exact_dedup.exact_dedup(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str)
    assert kept == sorted([(1, "ab"), (2, "aa"), (3, "cc"), (None, "q"), (None, "r"), (5, "")], key=str)


# edits


def test_edits_equal_recounting():
    vocabulary = packing.public_vocabulary()
    counter = edit_counts.Counter(vocabulary)
    rng = random.Random(3)
    pool = ["<|endoftext|>", "<|end", "oftext|>", "", " ", "\n", "x", "'s", " word", "   \n\n ", "é漢", "12 345", BASE[:500], " \t" * 40, "a" * 900]
    for start in ("", "a", " ", BASE, BASE * 3 + "  \n", " " * 300):
        text, tree = start, edit_counts.plant(start, counter)
        for _ in range(40):
            pos, drop, insert = rng.randrange(len(text) + 2), rng.choice([0, 1, 7, 60, 2000]), rng.choice(pool)
            new, tree, _ = edit_counts.edit(text, tree, pos, drop, insert, counter)
            assert new == text[:pos] + insert + text[pos + drop :]
            text = new
            assert (tree.tokens[1], tree.chars[1]) == (len(packing.encode(text, vocabulary)), len(text))


def test_edits_of_long_runs():
    vocabulary = packing.public_vocabulary()
    counter = edit_counts.Counter(vocabulary)
    for text in (" " * 1_200_000, "a" * 500_000):
        new, tree, _ = edit_counts.edit(text, edit_counts.plant(text, counter), 400_000, 3, "<|endoftext|>", counter)
        assert tree.tokens[1] == len(packing.encode(new, vocabulary))


def test_edits_touch_little():
    counter = edit_counts.Counter(packing.public_vocabulary())
    text = " ".join(f"w{k}" for k in range(50_000))
    tree = edit_counts.plant(text, counter)
    _, _, split_again = edit_counts.edit(text, tree, 100_000, 5, "new words", counter)
    assert split_again < 2_000


def test_edits_on_tables(docs, rows, empty):
    edits = F.array(F.struct(F.lit(3).alias("pos"), F.lit(2).alias("drop"), F.lit("new").alias("insert")), F.lit(None))
    trees = edit_counts.build_trees(docs)
    out = edit_counts.apply_edits(trees.withColumn("edits", edits))
    assert set(docs.columns) < set(out.columns)
    ids = lambda t: packing.encode(t, packing.public_vocabulary())
    got = sorted(((r.doc_id, r.tokens_before, r.tokens_after) for r in out.collect()), key=str)
    want = [(r[0], len(ids(t := r[1] or "")), len(ids(t[:3] + "new" + t[5:]))) for r in rows]
    assert got == sorted(want, key=str)
    assert edit_counts.apply_edits(edit_counts.build_trees(empty).withColumn("edits", edits)).count() == 0


# quotations


def test_quotations(spark):
    rows = [
        (1, 0, "Hello there,\nhow are you?", "a"),
        (1, 1, "Ann wrote:\n> Hello there,\n> how are   YOU?\n\nFine.", "b"),
        (1, 2, "> > Hello there,\n> > how are you?\n> Fine.\nGood.", "c"),
        (1, 3, "> never said\nWell.", None),
        (1, 4, None, "x"),
        (2, 0, "> how are you?", "x"),
        (None, 0, "> Hello", "x"),
        (2, 1, "", "x"),
    ]
    out = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, text string, level string"))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(got) == len(rows)
    assert [got[1, t].own_text for t in range(5)] == ["Hello there,\nhow are you?", "Fine.", "Good.", "Well.", ""]
    assert [got[1, t].parent_order for t in range(5)] == [None, 0, 1, None, None]
    assert [(got[1, t].root_order, got[1, t].depth) for t in range(3)] == [(0, 0), (0, 1), (0, 2)]
    assert [got[1, t].max_level for t in range(4)] == [0, 1, 2, 1]
    assert got[1, 2].n_quotes == 2 and got[2, 0].parent_order is None
    assert got[1, 0].level == "a"
    assert quotations.link_quotations(out.select("conv_id", "turn", "text").limit(0)).count() == 0
    again = quotations.link_quotations(out)
    assert again.columns == out.columns and again.where("turn = 1").first().depth == 1


def test_quotations_in_part(spark):
    """One paragraph of a longer message, one re-wrapped, one line, and a reply between quotations; positions in conversations."""
    first = "Hello all,\n\nthe build fails on\nMonday mornings.\n\nShould we move it?\nOr drop it?"
    rows = [
        (1, 1, first),
        (1, 2, "They wrote:\n> the build fails\n> on Monday mornings.\n\nSame here."),
        (1, 3, "They wrote:\n> Hello all,\n\nHi.\n\n> Or drop it?\nNo."),
        (1, 4, "> Same here.\n\nThen say more."),
        (1, 5, "Another matter."),
        (1, 6, "> nobody wrote this\n\nReally?"),
        (2, 7, "> Or drop it?\nAnother thread."),
    ]
    got = {r.turn: r for r in quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert {k: (r.parent_order, r.root_order, r.depth, r.position) for k, r in got.items()} == {
        1: (None, 1, 0, 1), 2: (1, 1, 1, 2), 3: (1, 1, 1, 3), 4: (2, 1, 2, 4), 5: (None, 5, 0, 1), 6: (None, 6, 0, 1), 7: (None, 7, 0, 1),
    }


def test_quotations_of_many_levels(spark):
    """16,000 lines of alternating levels are parsed in time proportional to their number."""
    text = "\n".join("> " * (1 + k % 2) + f"line {k}" for k in range(16_000))
    began = time.monotonic()
    got = quotations.link_quotations(spark.createDataFrame([(1, 1, "line 7"), (1, 2, text)], "conv_id long, turn long, text string")).where("turn = 2").first()
    assert (got.n_quotes, got.parent_order) == (16_000, 1) and time.monotonic() - began < 60


# mixing


def test_targets_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, "e": 0, None: 700}
    names = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while free and rest > 1e-9:
        share = rest / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        over = {s for s in free if target[s] >= 2 * sizes[s]}
        rest = sum(target[s] - 2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2.0 * sizes[s]
        free -= over
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(target)


def plain_rates(cells, target, cap=mixing.CAP, slack=mixing.SLACK):
    """Rates by source and class, by descending the dual one coordinate at a time; cells: words by (source, class)."""
    sources, classes = sorted(target), sorted({k for _, k in cells})
    words = sum(cells.values())
    goal = {k: sum(n for (_, c), n in cells.items() if c == k) / words * sum(target.values()) for k in classes}
    lam, mu = dict.fromkeys(sources, 0.0), dict.fromkeys(classes, 0.0)

    def zero(f):
        a, b = -60.0, 60.0
        for _ in range(100):
            m = (a + b) / 2
            a, b = (m, b) if f(m) < 0 else (a, m)
        return (a + b) / 2

    def rate(x):
        return min(cap, math.exp(x))

    for _ in range(400):
        for s in sources:
            lam[s] = zero(lambda x, s=s: sum(cells.get((s, k), 0) * rate(x + mu[k]) for k in classes) - target[s])
        for k in classes:
            mu[k] = zero(lambda x, k=k: sum(cells.get((s, k), 0) * rate(lam[s] + x) for s in sources) - goal[k] + slack * goal[k] * x)
    return {c: rate(lam[c[0]] + mu[c[1]]) for c in cells}


def length_class(size):
    return sum(size >= e for e in mixing.EDGES)


def check_mixing(got, targets_too=True):
    """got: rows of mix_rates. Rates against the plain version, copies, and how near each source comes."""
    name = lambda s: "~" if s is None else s
    cells = collections.Counter()
    target = {name(r.source): r.target for r in got}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
        cells[name(r.source), length_class(r.size)] += r.size
    want = plain_rates(cells, target)
    for r in got:
        if r.size:
            assert r.rate == pytest.approx(want[name(r.source), length_class(r.size)], abs=2e-5)
    for s in target:
        part = [r for r in got if name(r.source) == s]
        # rows with one id and text are decided together
        alike = collections.Counter()
        for r in part:
            alike[r.id, r.size] += r.size
        assert abs(sum(r.taken for r in part) - target[s]) <= max(alike.values()) / 2 + 1e-3


def test_mixing(docs, rows, sample, empty):
    for df in (docs, sample):
        got = mixing.mix_rates(df).collect()
        check_mixing(got)
        again = sorted(map(str, mixing.mix_rates(df.repartition(2)).collect()))
        assert again == sorted(map(str, got))
    assert len({(r.source, r.rate) for r in got}) > len({r.source for r in got})  # rates differ within a source
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id = 7").count() == next(r.copies for r in mixing.mix_rates(docs).where("id = 7").collect())
    assert mixing.mix_rates(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_null_ids_and_many_sources(spark, monkeypatch):
    """Null ids are told apart by their texts; a plan that is too long to broadcast; a column called as one of the operator's."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    rng = random.Random(11)
    rows = [(None, " ".join(f"w{k}" for _ in range(rng.choice([20, 90, 300]))) + f" {k}", f"s{k % 3 if k % 2 else 4}", k) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    got = mixing.mix_rates(docs).collect()
    check_mixing(got)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)


# licences


def plain_licences(text):
    best = {}
    lines = (text or "").split("\n")
    units = list(enumerate(lines))
    import re

    at = 0
    for block in re.split(r"\n[ \t\r]*\n", text or ""):
        if "\n" in block:
            units.append((at, block))
        at += block.count("\n") + 2
    for line, unit in units:
        g = licences._grams(unit)
        for name, template in licences.TEMPLATES.items():
            t = licences._grams(template)
            dice = 2 * len(g & t) / (len(g) + len(t)) if g else 0
            if dice >= licences.THRESHOLD and (name not in best or (dice, -line) > (best[name][1], -best[name][0])):
                best[name] = (line, dice)
    return {(n, a, round(b, 9)) for n, (a, b) in best.items()}


def test_licences(spark, docs, empty):
    mit = licences.TEMPLATES["mit-permission"]
    broken = mit.replace(", ", ",\n", 3)
    texts = ["x\n" + broken + "\n\nend", "Released UNDER the mit license", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY NC 4.0", "nothing here", None, "", mit[:80], "* " + licences.TEMPLATES["gpl-3.0-notice"] + " *"]
    # a block that also stands within an earlier, longer one, behind several empty lines; white space in empty lines
    texts += ["\n\n \t\n" + broken + "\n" + "many other words here\n" * 60 + "\n \n\n\n" + broken + "\r\n\n" + broken, "\x01 7\x01\n" + broken + "\n8\x01\n"]
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.id, r.licence, r.line, round(r.dice, 9)) for r in got} == {(i, *x) for i, t in enumerate(texts) for x in plain_licences(t)}
    assert {"mit-permission", "mit", "cc-by-nc-4.0", "gpl-3.0-notice"} <= {r.licence for r in got}
    assert licences.scan_licences(docs).count() == 0 and licences.scan_licences(empty).count() == 0


def test_licences_within_longer_text(spark):
    """Notices inside a line, and wrapped in a comment block whose blank lines carry marks; windows against all windows."""
    words = licences.TEMPLATES["mit-permission"].split(" ")
    wrapped = "\n".join("# " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    texts = [
        "first\n(c) 2020 Foo. Released under the MIT License. See LICENSE for details.",
        "#!/bin/sh\n# Copyright (c) 2020 Foo and many others who wrote this file over the years\n#\n" + wrapped + "\n#\n# " + " ".join(f"other{k} words" for k in range(60)),
        "Released under the licence that MIT has, not the License.",
    ]
    got = {(r.id, r.licence): (r.line, r.dice) for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, text in enumerate(texts):
        w, lines = [], []
        for k, line in enumerate(text.split("\n")):
            w += (own := licences.words_of(line))
            lines += [k] * len(own)
        for name, template in licences.TEMPLATES.items():
            t = licences._grams(template)
            best = max(((2 * len((g := set(zip(w[a:b], w[a + 1 : b], strict=False))) & t) / (len(g) + len(t)), -a) for a in range(len(w)) for b in range(a + 2, min(len(w), a + 2 * len(t)) + 1)), default=(0, 0))
            if best[0] >= licences.THRESHOLD:
                want[i, name] = (lines[-best[1]], best[0])
    assert {(0, "mit"), (1, "mit-permission")} <= set(want) and got == want
    assert got[0, "mit"] == (1, 1.0) and got[1, "mit-permission"] == (3, 1.0)


def test_licences_from_a_table(spark):
    table = spark.createDataFrame([("house", "Use it as you like, but do not sell the house wine."), ("", None), (None, "no name here")], "name string, text string")
    docs = spark.createDataFrame([(1, "Hello.\nUse it as you like but do not sell the house wine\n"), (2, licences.TEMPLATES["mit"])], "doc_id long, text string")
    got = licences.scan_licences(docs, templates=licences.templates_of(table)).collect()
    assert [(r.id, r.licence, r.line, r.dice) for r in got] == [(1, "house", 1, 1.0)]


def test_licence_key_words_lose_nothing():
    """Any unit at the threshold holds a key word: checked for every template with its key-word bigrams taken out."""
    keys = licences.key_words(licences.THRESHOLD)
    for text in licences.TEMPLATES.values():
        g = licences._grams(text)
        rest = {p for p in g if not any(k in p for k in keys)}
        assert 2 * len(rest) / (len(g) + len(rest)) < licences.THRESHOLD


# near copies


def plain_near(rows, width, percent):
    """Components over (id, text) rows, by comparing all pairs of classes."""
    sets = [((), i) if not (w := (t or "").encode().lower().split()) else (frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))), i) for i, t in rows]
    parent = {i: i for _, i in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (s, i) in enumerate(sets):
        for t, j in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), top(i) if i is not None else None) for s, i in sets), key=str)


def near_rows(df, **how):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, **how).collect()), key=str)


def test_near_odd_rows(docs, rows, empty):
    for width in (4, 5):
        assert near_rows(docs, width=width) == plain_near([(r[0], r[1]) for r in rows], width, 80)
    assert near_dedup.near_groups(empty).count() == 0
    out = near_dedup.near_dedup(docs.withColumn("row", F.lit(1)).withColumn("__gone", F.lit(2)))
    assert out.columns == [*docs.columns, "row", "__gone"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 10, 11, 4, 5, 6, 7, 8, None, None]


def test_near_string_ids_and_a_bucket_of_many_components(spark, monkeypatch):
    """Texts that share half of their words: buckets whose members are not alike, and groups linked through one another."""
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    monkeypatch.setattr(near_dedup, "LEAD_LOAD", 10)
    monkeypatch.setattr(near_dedup, "HOT", 3)
    rng = random.Random(9)
    shared, rows = [f"s{k}" for k in range(60)], []
    for g in range(12):
        own = [f"g{g}w{k}" for k in range(40)]
        for _ in range(8):
            copy = shared + own
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            rows.append((f"d{len(rows):03d}", " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert near_rows(df, width=4) == plain_near(rows, 4, 80)


def test_near_registers_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    for n in (6, 30, 300, 3000):
        share = []
        for _ in range(40):
            u = rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
            c = round(0.8 * n)
            x, y = (near_dedup.registers(np.unique(v)) for v in (u[: c + (n - c) // 2], np.concatenate([u[:c], u[c + (n - c) // 2 :]])))
            share.append((x == y).mean())
            assert (x == y).sum() >= near_dedup.least_matches(80) and (x == y).reshape(near_dedup.BANDS, -1).all(axis=1).any()
        assert abs(np.mean(share) - c / n) < 0.02


def test_near_rows_sent(spark, monkeypatch):
    """A bucket of 3,000 members that are all one group but for a few: what is given out does not grow with its square."""
    from codecloom.llm.common import Scratch

    sent = []
    real = Scratch.write

    def count(self, df, name, *a):
        out = real(self, df, name, *a)
        sent.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "write", count)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 60 - k % 3], f"own{k}", *base[60 - k % 3 :]])) for k in range(3000)]
    rows += [(3000 + k, " ".join([*base[:25], *(f"x{rng.random()}" for _ in range(30))])) for k in range(5)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert got.where("component_id = 0").count() == 3000
    assert max(n for _, n in sent) < 60 * 3005


def test_near_groups_of_edited_copies(spark, monkeypatch):
    """A large group whose members are linked through one another, spread over several chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    monkeypatch.setattr(near_dedup, "TASK_ROWS", 200)
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(120)]
        for i in range(60):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(len(copy))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert near_rows(df, width=5) == plain_near(rows, 5, 80)


def test_components(spark):
    from codecloom.llm.common import Scratch

    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (4, 1), *((k, k + 1) for k in range(100, 140))]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "t").collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((8, 9, 10), 8), **dict.fromkeys(range(100, 141), 100)}


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    got = out.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.id: docs[r.id].text for r in quality.quality_verdicts(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("kept").collect()}
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    unique = sorted((i, t) for t, i in last.items())
    stay = [(i, t) for i, t in unique if (i, i) in {(a, c) for a, _, c in plain_near(unique, 5, 80)}]
    mixed = mixing.mix_rates(spark.createDataFrame([(i, t, docs[i].source) for i, t in stay], SCHEMA.split(", lang")[0] + ", source string")).collect()
    copies = {r.id: r.copies for r in mixed if r.copies}
    tokens = collections.Counter()
    for p in got:
        tokens[p.doc_id] += p.length
    assert tokens == {i: n * (len(packing.encode(docs[i].text, packing.public_vocabulary())) + 1) for i, n in copies.items()}
