"""Mixing sources to target weights by entropy balancing.

A document's rate is an exponential tilt, ``min(cap, exp(dual of its source + dual of its length class))``: the rates nearest to 1 in
word-weighted relative entropy among those that give every source its target number of words and keep each length class's share of
all words as it was. Sources differ in their documents' lengths, so targets alone would shift the mix towards the lengths
of the sources that gain. The sources' constraints hold exactly; those of the classes give way where the cap leaves no room, at a price
(``SLACK``). The convex dual is minimised by damped Newton steps over the classes' duals: the sources' are eliminated, each in closed
form given the classes', and enter the Hessian by their Schur complement. A step is a Spark job over one row per source (its words by
class, which one pass over the documents yields); the driver sees a gradient and a Hessian as large as the number of classes.

Rates become whole copies: every document gets ``floor(rate)`` copies, and within a source those first in the order of a
digest of their id and text over the rate's fraction get one more (a likelier one comes sooner), up to the number of words that is still
owed. That cut-off is found by distributed selection: sums per bucket of that order, then the rows of the one bucket that holds the cut. Only a table with one row per source
is joined to the documents, broadcast if it is small and else with its rows given out several times, so a source with a third of all rows
is no hot key, and equal documents are decided alike on every run.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; they share ``share`` times all sizes; none may exceed ``cap``
times its source's size, and the excess is shared anew by weight until none does.

Results in odd cases: a null or wordless text has size 0 and takes 0. Null sources are a source of their own; null ids are told apart by their texts.
Repeated rows (one id and one text) are rows of their own with the same decision, so a source comes as near its target as the words of the
rows that are decided together. An empty table gives no rows. Extra columns are kept by ``mix`` only, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, n_words

#: Weights by a source's place, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Words at which the next length class begins.
EDGES = (65, 257, 1025, 4097)
CLASSES = len(EDGES) + 1
#: How far a class may leave its share: a dual of 1 stands for this share of its goal.
SLACK = 0.25
#: Bits of the digest, of the order of the extra copies, and buckets of that order per source.
DIGEST_BITS, ORDER_BITS, BUCKET_BITS = 52, 54, 12
#: Newton stops once no class is further from its goal, relatively to all words.
TOLERANCE, STEPS = 1e-10, 60
#: A plan of more sources than this is not broadcast.
BROADCAST_ROWS, SALTS = 50_000, 32


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size) rows. Works on one row per source.

    A capped source has its bound, the others their weight times one level; sorted by bound over weight, the level at
    which the shares add up is found by running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("w", w).withColumn("bound", F.lit(cap) * F.col("source_size")).withColumn("all", F.lit(share) * F.sum("source_size").over(every))
    order = Window.orderBy((F.col("bound") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if this source and all with a larger bound are free; the first source that it leaves free sets it
    by = by.withColumn("level", (F.col("all") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("w").over(after))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", F.first(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.col("level")), ignorenulls=True).over(whole))
    return by.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("bound")), F.col("bound")).alias("target"))


def cell_rates(n: np.ndarray, target: np.ndarray, mu: np.ndarray, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sources (rows of ``n``: words by class): rates by class, which classes are below the cap, and the source's part of the dual.

    With the classes' duals given, a source's own dual has a closed form for each set of capped classes, and those sets are the prefixes
    in the order of the classes' duals: the first prefix that leaves the rest below the cap is the one.
    """
    order = np.argsort(-mu, kind="stable")
    m, e = n[:, order], np.exp(mu[order])
    capped = np.concatenate([np.zeros((len(n), 1)), np.cumsum(m, axis=1)], axis=1) * cap  # words of the first k classes, capped
    mass = np.concatenate([np.cumsum((m * e)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(n), 1))], axis=1)  # of the others, tilted
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = (target[:, None] - capped) / mass
        fits = (scale[:, :-1] * e <= cap) & (mass[:, :-1] > 0)
    full = target >= cap * n.sum(axis=1) * (1 - 1e-12)
    k = np.where(fits.any(axis=1) & ~full, fits.argmax(axis=1), len(mu))
    scale = np.where(k < len(mu), np.take_along_axis(scale, k[:, None], axis=1)[:, 0], 0.0)
    free = np.arange(len(mu)) >= k[:, None]
    rates = np.where(free, scale[:, None] * e, cap)
    with np.errstate(divide="ignore"):
        dual = np.log(np.where(scale > 0, scale, 1.0))
    x = dual[:, None] + mu[order]
    value = np.where(free, rates, cap * (1 + x - math.log(cap)))
    value = (m * value).sum(axis=1) - target * np.where(k < len(mu), dual, 0.0)
    back = np.argsort(order, kind="stable")
    return rates[:, back], (free & (scale > 0)[:, None])[:, back], value


def _stepper(mu: np.ndarray, cap: float):
    """Sums over a task's sources: value, words by class, Hessian; in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros(1 + CLASSES + CLASSES * CLASSES)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES).astype(np.float64)
            rates, free, value = cell_rates(n, b.column(1).to_numpy(zero_copy_only=False), mu, cap)
            own = n * rates
            a = np.where(free, own, 0.0)
            all_ = a.sum(axis=1)
            hessian = np.diag(a.sum(axis=0)) - (a / np.where(all_ > 0, all_, 1)[:, None]).T @ a
            out += np.concatenate([[value.sum()], own.sum(axis=0), hessian.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tolist()], pa.list_(pa.float64()))], names=["task", "sums"])

    return run


def balance(cells: DataFrame, cap: float = CAP, slack: float = SLACK) -> np.ndarray:
    """Duals of the length classes. ``cells``: n (words by class) and target of each source, a written table."""
    all_, *by_class = cells.agg(F.sum("target"), *(F.sum(F.col("n")[k].cast("double")) for k in range(CLASSES))).first()
    mu = np.zeros(CLASSES)
    if not all_ or not sum(by_class):
        return mu
    goal = np.array(by_class) / sum(by_class) * all_

    def at(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual, gradient and Hessian; tasks are summed in order, so that reruns agree."""
        rows = cells.select("n", "target").mapInArrow(_stepper(mu, cap), "task long, sums array<double>").collect()  # a short row per task
        sums = sum((np.array(r.sums) for r in sorted(rows)), np.zeros(1 + CLASSES + CLASSES**2))
        value = sums[0] - goal @ mu + slack / 2 * (goal @ mu**2)
        return value, sums[1 : 1 + CLASSES] - goal + slack * goal * mu, sums[1 + CLASSES :].reshape(CLASSES, CLASSES) + slack * np.diag(goal)

    value, gradient, hessian = at(mu)
    used = goal > 0
    for _ in range(STEPS):
        if np.abs(gradient).max() <= TOLERANCE * all_:
            return mu
        step = np.zeros(CLASSES)
        step[used] = -np.linalg.solve(hessian[np.ix_(used, used)], gradient[used])
        size, slope = 1.0, float(gradient @ step)
        while True:
            new = at(mu + size * step)
            # near the minimum the dual's digits are used up; there the gradient decides
            if new[0] <= value + 1e-4 * size * slope or np.abs(new[1]).max() < 0.5 * np.abs(gradient).max():
                break
            size /= 2
            if size < 1e-6:
                raise RuntimeError("Newton's line search failed")
        mu = mu + size * step
        value, gradient, hessian = new
    raise RuntimeError(f"Newton did not converge in {STEPS} steps")


def _rater(mu: np.ndarray, cap: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(b.schema.get_field_index("n")).flatten().to_numpy(zero_copy_only=False).reshape(-1, CLASSES).astype(np.float64)
            rates = cell_rates(n, b.column(b.schema.get_field_index("target")).to_numpy(zero_copy_only=False), mu, cap)[0]
            rates = np.minimum(cap, np.round(rates, 9))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates.tolist(), pa.list_(pa.float64()))], names=names)

    return run


def _length_class(size: Column) -> Column:
    return sum(((size >= e).cast("int") for e in EDGES), F.lit(0))


def _order(digest: Column, rate: Column) -> Column:
    """Place of a document among those of its source that may get one more copy; null if its rate is whole."""
    part = rate - F.floor(rate)
    return F.when(part > 0, F.least(F.floor(digest / part), F.lit((1 << ORDER_BITS) - 1)).cast("long"))


def _digest(key: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), text), 64 - DIGEST_BITS)


def _with_plan(rows: DataFrame, plan: DataFrame, n_plan: int, source: str, digest: str) -> DataFrame:
    """``rows`` with the columns of their source's plan row (``p_source`` and others)."""
    if n_plan <= BROADCAST_ROWS:
        return rows.join(F.broadcast(plan), rows[source].eqNullSafe(plan["p_source"]))
    salted = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("r_salt", F.pmod(F.xxhash64(digest), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows[source].eqNullSafe(salted["p_source"]) & (rows["r_salt"] == salted["p_salt"]))


def source_plan(sized: DataFrame, scratch: Scratch, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, slack: float = SLACK) -> tuple[DataFrame, int]:
    """A row per source: p_source, source_size, target, rates (by class), cut (a document gets one more copy if its order is at most cut); and their number.

    ``sized``: source, size, digest; a written table.
    """
    sums = sized.groupBy("source", _length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("size"))
    sums = scratch.write(sums, "sums")
    n = F.array(*(F.coalesce(F.sum(F.when(F.col("class") == k, F.col("size"))), F.lit(0)) for k in range(CLASSES)))
    cells = sums.groupBy(F.col("source").alias("p_source")).agg(n.alias("n"))
    cells = cells.join(targets(sums, share, cap, weights), F.col("p_source").eqNullSafe(F.col("source"))).select("p_source", "source_size", "target", "n")
    cells = scratch.write(cells.orderBy("p_source"), "cells")
    mu = balance(cells, cap, slack)
    rated = cells.mapInArrow(_rater(mu, cap, [*cells.columns, "rates"]), T.StructType([*cells.schema.fields, T.StructField("rates", T.ArrayType(T.DoubleType()))]))
    whole = sum((F.col("n")[k] * F.floor(F.col("rates")[k]) for k in range(CLASSES)), F.lit(0))
    plan = scratch.write(rated.select("p_source", "source_size", "target", "rates", (F.col("target") - whole).alias("owed")), "rates")
    count = plan.count()

    ordered = _with_plan(sized, plan, count, "source", "digest").select("p_source", "size", _order(F.col("digest"), F.col("rates")[_length_class(F.col("size"))]).alias("order")).where("order is not null and size > 0")
    shift = ORDER_BITS - BUCKET_BITS
    ordered = ordered.withColumn("bucket", F.shiftright("order", shift))
    buckets = ordered.groupBy("p_source", "bucket").agg(F.sum("size").alias("own"))
    buckets = buckets.withColumn("upto", F.sum("own").over(Window.partitionBy("p_source").orderBy("bucket")))
    buckets = buckets.alias("s").join(plan.select("p_source", "owed").alias("p"), F.col("s.p_source").eqNullSafe(F.col("p.p_source"))).select("p.p_source", "owed", "bucket", "upto", (F.col("upto") - F.col("own")).alias("below"))
    # the first bucket whose sum reaches what is owed holds the cut; beyond the last one everything is taken
    first = buckets.where(F.col("upto") >= F.col("owed")).groupBy("p_source").agg(F.min_by(F.struct("bucket", "below", "owed"), "bucket").alias("b")).select("p_source", "b.*")
    first = scratch.write(first, "first")
    inside = ordered.alias("d").join(first.alias("f"), F.col("d.p_source").eqNullSafe(F.col("f.p_source")) & (F.col("d.bucket") == F.col("f.bucket"))).select("f.p_source", "d.order", "d.size", "f.below", "f.owed")
    tied = inside.groupBy("p_source", "order").agg(F.sum("size").alias("own"), F.first("below").alias("below"), F.first("owed").alias("owed"))
    tied = tied.withColumn("upto", F.col("below") + F.sum("own").over(Window.partitionBy("p_source").orderBy("order")))
    # a row is taken if that brings the source nearer to its target
    cut = tied.where((F.col("upto") + (F.col("upto") - F.col("own"))) / 2 <= F.col("owed")).groupBy("p_source").agg(F.max("order").alias("cut"))
    edge = first.select("p_source", (F.shiftleft(F.col("bucket"), shift) - 1).alias("edge"))
    out = plan.alias("p").join(edge.alias("b"), F.col("p.p_source").eqNullSafe(F.col("b.p_source")), "left").join(cut.alias("c"), F.col("p.p_source").eqNullSafe(F.col("c.p_source")), "left")
    everything = F.lit((1 << ORDER_BITS) - 1)
    out = out.select("p.p_source", "source_size", "target", "rates", F.when(F.col("owed") <= 0, F.lit(-1).cast("long")).otherwise(F.coalesce("c.cut", "b.edge", everything)).alias("cut"))
    return scratch.write(out, "plan"), count


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = docs[text_col].cast("string")
    return [docs[source_col].alias("source"), n_words(text).alias("size"), _digest(docs[id_col], text).alias("digest")]


def _copies() -> Column:
    rate = F.col("rates")[_length_class(F.col("size"))]
    return (F.floor(rate) + F.coalesce(_order(F.col("digest"), rate) <= F.col("cut"), F.lit(False)).cast("long")).cast("long")


def mix_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row per input row: id, source, size, source_size, target, rate, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(docs.select(docs[id_col].alias("id"), *_sized(docs, id_col, text_col, source_col)), "sized")
    plan, count = source_plan(sized, scratch, **how)
    both = _with_plan(sized, plan, count, "source", "digest")
    both = both.select("id", "source", "size", "source_size", "target", F.col("rates")[_length_class(F.col("size"))].alias("rate"), _copies().alias("copies"))
    return both.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents with all their columns, each as many times as its copies."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.write(docs.select(*_sized(docs, id_col, text_col, source_col)), "sized")
    plan, count = source_plan(sized, scratch, **how)
    scratch.drop(sized)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_sized(docs, id_col, text_col, source_col))
    out = _with_plan(keyed, plan, count, "source", "digest").select("row", _copies().alias("copies")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k")).select("row.*")
