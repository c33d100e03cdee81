"""MinHash near-deduplication on HyperMinHash sketches.

1. Sketch: a document's shingles (distinct runs of ``width`` words, A-Z lower-cased) are hashed once; the hash's top bits deal them to
   288 buckets, and each bucket keeps the smallest of the other bits as a 16-bit register: 6 bits of leading zeros, 10 of mantissa. A bucket without any
   shingle takes the register of the filled bucket that comes first in an order of its own (densification), so that two texts' registers agree with
   the probability of their similarity also where texts are short. Documents with equal shingle sets fall into one class first,
   so that copies cost nothing further.
2. Banding: 48 bands of 6 registers. Two texts of similarity 0.8 share no band with probability (1 - 0.8 ** 6) ** 48, 1 in 2 million;
   registers that collide only add candidates.
3. Stars: in each bucket of equal bands every member is compared with one leader, the member that meets most others over all bands (the original, in
   a group of edited copies). Pairs whose sizes exclude the threshold, or whose collision-corrected estimate lies six standard
   errors below it, go; the rest are verified on the full shingle sets (64-bit hashes), and components of the links are found. A leader's sketch and set are
   given out in as many parts as it has thousands of members, so no leader's pairs meet in one task.
4. Remainder: where a bucket's members now lie in several components, those outside its largest component are compared with all
   members of other components, in chunks of ``CHUNK`` by ``CHUNK`` dealt over tasks, likeliest first, until they are joined
   or all have been verified. Members of the largest component are not compared with each other. No pair of rows is ever emitted, and nothing is capped.
5. Components by alternating large-star and small-star contraction, each round a written table; nodes with very many neighbours are joined by broadcast.

Results in odd cases: a null, empty or wordless text has no shingles and links with nothing. With fewer words than ``width`` the
whole sequence is the one shingle. Rows without an id link with nothing and stay. Repeated rows share an id and so a component;
texts that share an id are one node where both stand for their class. Ids may be of any type that has an order. An empty table gives no rows. Extra columns are kept by
``near_dedup`` only, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, Scratch
from .words import WordHashes, mix64, run_hashes

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Members of a bucket that are compared with as many others in one task; rows and bytes that such a task takes in, about.
CHUNK, TASK_ROWS, TASK_BYTES = 256, 8_000, 24_000_000
#: A leader is given out once per so many meetings; a node with more neighbours than HOT is joined by broadcast (there are few such nodes).
LEAD_LOAD, HOT = 20_000, 1_000_000
#: Rank of each bucket in the order in which an empty bucket asks for a register.
_ASKS = mix64(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).astype(np.uint32).reshape(REGISTERS, REGISTERS)


def shingles(raw: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = raw.lower().split()  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    w = hashes.of(words)
    return np.unique(run_hashes(w, min(width, len(w)), seed=0 if len(w) >= width else len(w)))


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a set of sorted 64-bit hashes, not empty: per bucket leading zeros and mantissa of the smallest 32-bit value."""
    bucket = (values >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)  # sorted, as the values are
    starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    filled = bucket[starts].astype(np.int64)
    v = np.maximum(np.minimum.reduceat(values & np.uint64(0xFFFFFFFF), starts), np.uint64(1))
    length = np.frexp(v.astype(np.float64))[1].astype(np.uint64)
    after = v << (np.uint64(65) - length)  # the bits behind the leading one
    own = (((np.uint64(32) - length) << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype(np.uint16)
    if len(filled) == REGISTERS:
        return own
    out = np.empty(REGISTERS, np.uint16)
    out[filled] = own
    empty = np.ones(REGISTERS, bool)
    empty[filled] = False
    out[empty] = own[_ASKS[empty][:, filled].argmin(axis=1)]
    return out


def _sketcher(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingles((t.as_py() or "").encode(), width, hashes) for t in b.column(1)]
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = []
                for s in sets:  # 128 bits of the set
                    keys.append(np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(len(s))).sum(dtype=np.uint64)]).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array([registers(x).tobytes() if len(x) else b"" for x in sets], pa.binary())], names=["id", "n", "key", "sketch"])

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (shingles), key (of the set), sketch; a row per input row."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = plain.schema["id"].dataType
    return plain.mapInArrow(_sketcher(width), T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.BinaryType())]))


def least_matches(percent: int) -> float:
    """Equal registers below which a pair of the wanted similarity is six standard errors out; chance collisions count as equal."""
    collide = 2.0**-MANTISSA / 3  # two values of like size: 1/3 for the same leading zeros, then the mantissa
    t = percent / 100
    return REGISTERS * (collide + (1 - collide) * (t - 6 * np.sqrt(t * (1 - t) / REGISTERS)))


def _estimator(percent: int):
    @F.pandas_udf(T.BooleanType())
    def plausible(a, b):
        import pandas as pd

        x, y = (np.frombuffer(b"".join(c), np.uint16).reshape(-1, REGISTERS) for c in (a, b))
        return pd.Series((x == y).sum(axis=1) >= least_matches(percent))

    return plausible


def _set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles((t.as_py() or "").encode(), width, hashes).tobytes() for t in b.column(1)], pa.binary())], names=["id", "set"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verifier(percent: int):
    @F.pandas_udf(T.BooleanType())
    def linked(a, b):
        import pandas as pd

        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], dtype="bool")

    return linked


def _chunk_pairs(percent: int, names: list[str]):
    """Links between members of different components, for every pair of chunks in the table (h, kind, i, j): those on its left with those on its right."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("h", "kind", "i", "j", "rep")])
        h, kind, i, j, n, band, is_left, is_right = (table.column(k).to_numpy(zero_copy_only=False) for k in ("h", "kind", "i", "j", "n", "band", "left", "right"))
        rep, comp = (table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in ("rep", "comp"))
        sketch, sets = table.column("sketch").to_pylist(), table.column("set").to_pylist()
        new = np.zeros(len(h), bool)
        for x in (h, kind, i, j):
            new[1:] |= x[1:] != x[:-1]
        edges = np.flatnonzero(new)
        out = []
        for a, b in zip([0, *edges], [*edges, len(h)], strict=True):
            left, right = np.flatnonzero(is_left[a:b]) + a, np.flatnonzero(is_right[a:b]) + a
            out += _links(left, right, rep, comp, n, sketch, sets, int(band[a]), percent)
        u, v = zip(*out, strict=True) if out else ([], [])
        ids = table.column("rep").combine_chunks()
        return pa.table([ids.take(pa.array(u, pa.int64())), ids.take(pa.array(v, pa.int64()))], names=names)

    return run


def _links(left, right, rep, comp, n, sketch, sets, band: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows whose links join the components; ``rep`` and ``comp`` as numbers."""
    if not len(left) or not len(right):
        return []
    x, y = (np.frombuffer(b"".join(sketch[k] for k in side), np.uint16).reshape(-1, REGISTERS) for side in (left, right))
    least = least_matches(percent)
    pairs = []
    for k, own in enumerate(left):
        maybe = np.flatnonzero((comp[right] != comp[own]) & (100 * np.minimum(n[right], n[own]) >= percent * np.maximum(n[right], n[own])))
        if len(maybe):
            same = y[maybe] == x[k]
            count = same.sum(axis=1)
            near = count >= least
            for q, m, r in zip(maybe[near], count[near], same[near], strict=True):
                # a pair is dealt with in the first band that it shares
                if rep[own] != rep[right[q]] and int(r.reshape(BANDS, ROWS).all(axis=1).argmax()) == band:
                    pairs.append((-int(m), own, right[q]))
    joined: dict[int, int] = {}

    def top(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    out = []
    for _, p, q in sorted(pairs):
        a, b = top(int(comp[p])), top(int(comp[q]))
        if a != b and similar(np.frombuffer(sets[p], np.uint64), np.frombuffer(sets[q], np.uint64), percent):
            joined[a] = b
            out.append((int(p), int(q)))
    return out


def _with_least(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """The edges (u, v) with m of ``least`` (u, m, c: neighbours of u). There are at most two edges in HOT nodes with more neighbours than that."""
    if few:
        return edges.join(least.drop("c"), "u")
    hot = F.broadcast(least.where(F.col("c") > HOT).drop("c"))
    cold = edges.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.where(F.col("c") <= HOT).drop("c"), "u")
    return cold.unionByName(edges.join(hot, "u"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its least node) of distinct (u, v) edges; nodes without edges are absent."""
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    state = None
    for k in range(200):
        had, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if had == state:
            break
        few = 2 * state[0] <= HOT
        # large star: larger neighbours go to the least neighbour; small star: so do the smaller ones
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("c"))
        large = _with_least(both, least, few).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _with_least(large, least, few).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, now = now, scratch.write(small.where(F.col("u") > F.col("v")).distinct(), f"{name}-{k}")
        scratch.drop(before)
    else:
        raise RuntimeError("components did not settle in 200 rounds")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _bands(reps: DataFrame) -> DataFrame:
    """h, band, rep: a row per band."""
    part = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("sketch"), b * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("h")))
    return reps.select("rep", F.explode(part).alias("x")).select("x.h", "x.band", "rep")


def near_links(docs: DataFrame, reps: DataFrame, scratch: Scratch, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """u, v: verified links that connect whatever is linked among the class representatives (rep, n, sketch)."""
    rows = _bands(reps)
    shared = rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    live = scratch.write(rows.join(shared, "h"), "buckets")
    meets = live.groupBy("rep").agg(F.sum("k").alias("meets"))
    members = live.join(meets, "rep")
    lead = members.groupBy("h").agg(F.max(F.struct("meets", "rep")).alias("t")).select("h", F.col("t.rep").alias("lead"), F.ceil(F.col("t.meets") / LEAD_LOAD).alias("parts"))
    pairs = live.join(lead, "h").where(F.col("rep") != F.col("lead"))
    # two texts may lead each other in different buckets: one of them does
    pairs = pairs.groupBy(F.least("rep", "lead").alias("x"), F.greatest("rep", "lead").alias("y")).agg(F.max(F.struct("lead", "rep", "parts")).alias("p"))
    pairs = pairs.select("p.rep", "p.lead", F.pmod(F.xxhash64("p.rep"), F.col("p.parts")).alias("part"))
    pairs = scratch.write(pairs, "pairs")
    side = reps.select("rep", "n", "sketch")

    def of_leads(pairs: DataFrame, table: DataFrame, key: str, **columns: str) -> DataFrame:
        """Rows of ``table`` for every leader and part that occurs."""
        given = table.select(F.col(key).alias("lead"), *(F.col(c).alias(n) for n, c in columns.items()))
        return pairs.select("lead", "part").distinct().join(given, "lead")

    near = pairs.join(side, "rep").join(of_leads(pairs, side, "rep", lead_n="n", lead_sketch="sketch"), ["lead", "part"])
    near = near.where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")).where(_estimator(percent)("sketch", "lead_sketch")).select("rep", "lead", "part")
    near = scratch.write(near, "near")
    # full sets of every text that shares a bucket
    ends = live.select(F.col("rep").alias("end")).distinct()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(ends, F.col("id") == F.col("end"), "left_semi")
    kind = reps.schema["rep"].dataType
    sets = scratch.write(texts.mapInArrow(_set_maker(width), T.StructType([T.StructField("id", kind), T.StructField("set", T.BinaryType())])).dropDuplicates(["id", "set"]), "sets")
    full = near.join(sets.withColumnRenamed("id", "rep"), "rep").join(of_leads(near, sets, "id", lead_set="set"), ["lead", "part"])
    stars = scratch.write(full.where(_verifier(percent)("set", "lead_set")).select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct(), "stars")
    scratch.drop(pairs, near)
    comps = components(stars, scratch, "star").withColumnRenamed("node", "rep")
    rest = scratch.write(live.join(comps, "rep", "left").select("h", "band", "rep", F.coalesce("component", "rep").alias("comp")), "rest")
    scratch.drop(live)
    # a bucket whose members are all in one component, or that has no members but its leader and another, is done
    sizes = rest.groupBy("h", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("k")).where("c < k and k > 2")
    open_ = open_.select("h", "main", F.ceil(F.col("c") / CHUNK).cast("int").alias("mains"), F.ceil((F.col("k") - F.col("c")) / CHUNK).cast("int").alias("others"))
    rest = rest.join(open_, "h")
    in_main = F.col("comp") == F.col("main")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(in_main, F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # what the members weigh, each as often as it is given out
    times = F.when(in_main, F.col("others")).otherwise(F.col("mains") + F.col("others"))
    load = rest.join(reps.select("rep", "n"), "rep").agg(F.sum(times), F.sum(times * (8 * F.col("n") + 2 * REGISTERS))).first()
    if not load[0]:
        return stars
    tasks = max(-(-load[0] // TASK_ROWS), -(-load[1] // TASK_BYTES))
    yes, no = F.lit(True), F.lit(False)

    def given(kind: int, i: Column, j: Column, left: Column, right: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))

    def each(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)

    own = F.col("own")
    # the largest component's chunks stand on the left of each chunk of others, and the others against one another
    among = each("others", lambda o: given(1, F.least(own, o), F.greatest(own, o), own <= o, own >= o))
    places = F.when(in_main, each("others", lambda o: given(0, own, o, yes, no))).otherwise(F.concat(each("mains", lambda o: given(0, o, own, no, yes)), among))
    rest = rest.select("h", "band", "rep", "comp", F.explode(places).alias("x")).select("h", "band", "rep", "comp", "x.*")
    rest = rest.join(side, "rep").join(sets.withColumnRenamed("id", "rep"), "rep").withColumn("task", F.pmod(F.xxhash64("h", "kind", "i", "j"), F.lit(tasks)))
    more = scratch.write(rest.groupBy("task").applyInArrow(_chunk_pairs(percent, ["u", "v"]), T.StructType([T.StructField("u", kind), T.StructField("v", kind)])), "more")
    scratch.drop(sets)
    return stars.unionByName(more)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row per input row: id, n_shingles, component_id, kept (id is the component's)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.write(sketches(docs, id_col, text_col, width), "sketches")
    classes = scratch.write(rows.where("n > 0 and id is not null").groupBy("key", "n").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch")), "classes")
    links = near_links(docs, classes, scratch, id_col, text_col, width, percent)
    comp = classes.select("key", "n", "rep")
    comp = comp.join(components(links, scratch, "all").withColumnRenamed("node", "rep"), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("component"))
    # copies of one class may be a third of all rows: each class is given out in as many places as there are salts
    salts = 16
    comp = comp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    thin = rows.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    out = thin.join(comp, ["key", "n", "salt"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that stay, one document of each group, with all their columns. Rows are told to stay or go in the scan, by bit filters over the ids; only those
    that both filters hold are moved."""
    scratch = Scratch(docs.sparkSession, "near")
    groups = scratch.write(near_groups(docs, id_col, text_col, **how).select("id", "kept"), "groups")
    gone = BitFilter(groups.where("not kept").select("id").distinct(), ["id"], scratch, "gone-bits")
    doubt = scratch.write(gone.mark(groups.where("kept").select("id").distinct(), "looks_gone", "id").where("looks_gone").select("id"), "doubt")
    stay = BitFilter(doubt, ["id"], scratch, "stay-bits")
    asked = gone.mark(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id")), "maybe_gone", "id")
    open_ = stay.mark(asked.where("maybe_gone"), "maybe_stays", "id").where("maybe_stays")
    told = open_.join(doubt, open_["id"].eqNullSafe(doubt["id"]), "left_semi").select("row")
    return asked.where("not maybe_gone").select("row").unionByName(told).select("row.*")
