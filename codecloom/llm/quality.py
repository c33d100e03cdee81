"""Risk-controlled quality thresholds.

Every document gets counts over its whole text and from them four ratios, each a rule "reject above a cut-off". Labelled
documents choose the cut-offs, per stratum (language) and rule:

1. A hash of the id deals the labelled documents into a selection fold and a certification fold.
2. Selection: the cut-off that rejects most low-quality documents, a good one rejected counting as ``PRICE`` bad ones missed. A rule that
   catches nothing, or no more than it costs, is not used.
3. Certification: from the loosest cut-off towards the selected one, each must show, by the exact binomial tail on the good documents
   of the other fold, that its false-rejection rate is at most ``alpha`` over the rules selected in its stratum, at level ``delta``
   over all rules selected. The test stops at the first cut-off that fails (fixed-sequence testing, so the grid costs no
   correction); strata and rules are Bonferroni corrected, over those the selection fold chose, which the certification fold does not
   know. With probability ``1 - delta``, no stratum loses more than ``alpha`` of its good documents to the rules.

A stratum with too few labels to certify anything keeps all that passes the base rule. Counts and thresholds cover all documents and
labels. Features are one pass of Arrow batches with no shuffle; histograms of labelled documents are the only thing aggregated.

Results in odd cases: a null text has no words and fails the base rule. A null stratum is a stratum. Null ids match no label. A
document labelled more than once counts as bad if any label says so; null labels are ignored. Repeated rows get the same verdict.
Empty tables give no rows; without labels no rule is used. Extra columns are kept by ``quality_filter``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, Scratch

RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "shout_ratio")
ALPHA, DELTA, PRICE = 0.05, 0.1, 20.0
#: Cut-offs are multiples of 1 / GRID; a ratio falls into the cell of the least cut-off that keeps it.
GRID = 100
#: Of a hundred labelled documents, so many select; the others certify.
SELECT = 30
#: The base rule.
LEAST_WORDS, MOST_REPEATS = 50, 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeat_words(words: list[bytes]) -> int:
    """Words lying in a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v == n:
        return 0
    pairs = a[:-1] * v + a[1:]
    if v > 2_000_000:  # v ** 3 would not fit 63 bits
        pairs, v = np.unique(pairs, return_inverse=True)[1], len(ids)
    key = pairs[:-1] * v + a[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8")
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols = len(_SYMBOLS.findall(text))
    upper = sum(w.isupper() for w in text.split() if len(w) > 1)
    return len(words), chars, symbols, dup, repeat_words(words), lines, upper


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *keep, text = b.columns
        got = np.array([counts(t.as_py()) for t in text], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*keep, text, *(pa.array(got[:, i]) for i in range(len(COUNTS)))], names=[*b.schema.names, *COUNTS])


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a bigint column per name of COUNTS behind its columns; ``text`` is its last column."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    assert df.columns[-1] == text
    return df.mapInArrow(_count_batches, schema)


def _ratios() -> dict:
    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return dict(zip(RULES, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "n_words")), strict=True))


def _cell(ratio):
    """Index of the least cut-off that keeps the ratio: the rule rejects at every smaller one."""
    return F.least(F.ceil(ratio * GRID - 1e-9), F.lit(GRID)).cast("int")


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly, by the continued fraction of the incomplete beta function."""
    if n <= 0 or k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's method for its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def _tails(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)], dtype="float64")


def thresholds(labelled: DataFrame, scratch: Scratch, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and, per rule, the cut-off in grid cells (null: not used).

    ``labelled``: id, stratum, good (boolean) and COUNTS, of documents that the base rule keeps. One row per stratum and rule and
    cell is the most that is gathered.
    """
    fold = F.when(F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(100)) < SELECT, F.lit("a")).otherwise(F.lit("b"))
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), _cell(r).alias("cell")) for i, r in enumerate(_ratios().values()))))
    hist = labelled.select("stratum", "good", fold.alias("fold"), cells.alias("c")).groupBy("stratum", F.col("c.rule").alias("rule"), F.col("c.cell").alias("cell"))
    hist = hist.agg(*(F.count_if((F.col("good") == g) & (F.col("fold") == f)).alias(n) for n, g, f in (("good_a", True, "a"), ("bad_a", False, "a"), ("good_b", True, "b"))))
    every = hist.select("stratum", "rule").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    full = every.alias("e").join(hist.alias("h"), F.col("e.stratum").eqNullSafe(F.col("h.stratum")) & (F.col("e.rule") == F.col("h.rule")) & (F.col("e.cell") == F.col("h.cell")), "left")
    full = full.select("e.*", *(F.coalesce(F.col(f"h.{c}"), F.lit(0)).alias(c) for c in ("good_a", "bad_a", "good_b")))
    one = Window.partitionBy("stratum", "rule")
    above = one.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a cut-off rejects the cells beyond it
    tests = full.select(
        "stratum", "rule", "cell",
        *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"out_{c}") for c in ("good_a", "bad_a", "good_b")),
        F.sum("good_b").over(one).alias("n_b"),
    )
    # of equal worth the loosest
    worth = F.col("out_bad_a") - PRICE * F.col("out_good_a")
    tests = tests.withColumn("best", F.max(F.struct(worth.alias("worth"), F.col("cell").alias("cell"))).over(one)).where("best.worth > 0")
    tests = tests.withColumn("rules", F.size(F.collect_set("rule").over(Window.partitionBy("stratum"))))
    tests = scratch.write(tests, "tests")  # a row per stratum, rule and cell
    selected = max(1, tests.select("stratum", "rule").distinct().count())
    tail = _tails(F.col("out_good_b"), F.col("n_b"), F.lit(alpha) / F.col("rules"))
    tests = tests.withColumn("fails", (tail > delta / selected).cast("int"))
    # the tightest cut-off at or above the selected one such that it and all looser ones pass
    tests = tests.withColumn("failed", F.sum("fails").over(one.orderBy(F.col("cell").desc())))
    chosen = tests.where((F.col("failed") == 0) & (F.col("cell") >= F.col("best.cell"))).groupBy("stratum", "rule").agg(F.min("cell").alias("cut"))
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == i, F.col("cut"))).alias(f"cut_{r}") for i, r in enumerate(RULES)))


def labelled_docs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the features (id, ...) that are labelled and pass the base rule, with good."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good")).withColumnRenamed("doc_id", "label_id")
    return features.where(~base_failed()).join(good, features["id"] == good["label_id"]).drop("label_id")


def rejects() -> Column:
    """Whether any rule that is in use rejects; over COUNTS and the cut-offs."""
    out = F.lit(False)
    for name, ratio in _ratios().items():
        out = out | F.coalesce(_cell(ratio) > F.col(f"cut_{name}"), F.lit(False))
    return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """A row per input row: id, stratum, COUNTS, base_failed, kept, and the cut-offs of its stratum."""
    scratch = Scratch(docs.sparkSession, "quality")
    plain = docs.select(docs[id_col].alias("id"), docs[stratum_col].cast("string").alias("stratum"), docs[text_col].cast("string").alias("text"))
    features = scratch.write(with_counts(plain, "text").drop("text"), "features")
    cuts = scratch.write(thresholds(labelled_docs(features, labels), scratch, **risk), "cuts").withColumnRenamed("stratum", "cut_stratum")
    both = features.join(cuts, features["stratum"].eqNullSafe(cuts["cut_stratum"]), "left").drop("cut_stratum")
    return both.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejects())


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """The rows that are kept, with all their columns.

    Features of labelled documents set the cut-offs; a second pass counts each document and applies them on the spot, so no verdict
    has to be joined back to a text. Which documents may be labelled is asked of a bit filter over the labels' ids: texts are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    wanted = scratch.write(labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("string").alias("label")).distinct(), "labels")
    plain = docs.select(docs[id_col].alias("id"), docs[stratum_col].cast("string").alias("stratum"), docs[text_col].cast("string").alias("text"))
    maybe = BitFilter(wanted, ["label"], scratch, "label-bits").mark(plain, "maybe", F.col("id").cast("string")).where("maybe").select("id", "stratum", "text")
    features = scratch.write(with_counts(maybe, "text").drop("text"), "features")
    cuts = scratch.write(thresholds(labelled_docs(features, labels), scratch, **risk), "cuts").withColumnRenamed("stratum", "cut_stratum")
    scratch.drop(features, wanted)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[stratum_col].cast("string").alias("stratum"), docs[text_col].cast("string").alias("text"))
    both = with_counts(whole, "text")
    both = both.join(cuts, both["stratum"].eqNullSafe(cuts["cut_stratum"]), "left")
    return both.where(~base_failed() & ~rejects()).select("row.*")
