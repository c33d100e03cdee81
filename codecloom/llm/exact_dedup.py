"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. Lengths of all texts; those that occur twice or more go into a bit filter.
2. Rows whose length passes it are hashed over their first ``PREFIX`` code points; (length, prefix) pairs that occur twice or more
   go into a second filter.
3. Only rows that pass both are read whole and hashed with SHA-256. They are grouped by length, prefix hash and full hash; a false yes of a filter is
   a group of one.

Filters are bitmaps of bounded size, asked in the scan, so texts are never shuffled to be hashed. ``exact_dedup`` finds the rows to drop in the same
way: those that no filter holds stay where they are, and only rows that it cannot tell from a row that stays (false answers, rows
repeated with one id and text) are moved and compared.

Results in odd cases: a null text counts as ''. Null ids lose against any id; in a group of null ids keep_id is null and
one row stays. Rows repeated with the same id and text form a group of which one row stays. An empty table gives no rows.
Extra columns are ignored by ``exact_groups`` and kept by ``exact_dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, Scratch

#: Code points of a text that the second step hashes.
PREFIX = 64
#: A group's row is given out this many times, so that a group holding much of the table is joined in as many places.
SALTS = 16


def _length(text: Column | str) -> Column:
    return F.octet_length(text).cast("long")


def _prefix(text: Column | str) -> Column:
    return F.xxhash64(F.substring(text, 1, PREFIX))


def _sha(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def refine(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """A row per input row: id, length, prefix, twin (others may have its length and prefix) and sha, null unless twin or ``hash_all``."""
    plain = _plain(docs, id_col, text_col)
    twice = F.count("*").alias("n")
    lengths = scratch.write(plain.groupBy(_length("text").alias("length")).agg(twice).where("n > 1").select("length"), "lengths")
    by_length = BitFilter(lengths, ["length"], scratch, "length-bits")
    seen = by_length.mark(plain.withColumn("length", _length("text")), "known", "length")
    prefixes = seen.where("known").groupBy("length", _prefix("text").alias("prefix")).agg(twice).where("n > 1").select("length", "prefix")
    prefixes = scratch.write(prefixes, "prefixes")
    by_prefix = BitFilter(prefixes, ["length", "prefix"], scratch, "prefix-bits")
    seen = by_prefix.mark(seen.withColumn("prefix", F.when(F.col("known"), _prefix("text"))), "also", "length", "prefix")
    twin = F.col("known") & F.col("also")
    rows = seen.select("id", "length", "prefix", twin.alias("twin"), F.when(twin | F.lit(hash_all), _sha("text")).alias("sha"))
    rows = scratch.write(rows, "rows")
    scratch.drop(lengths, prefixes)
    return rows


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = True) -> DataFrame:
    """A row per input row: id, length, prefix, sha (binary; without ``hash_all`` only of rows that had to be hashed), keep_id, group_size, kept."""
    return _groups(refine(docs, Scratch(docs.sparkSession, "exact"), id_col, text_col, hash_all))


def _groups(rows: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    alone = rows.where("not twin").select("id", "length", "prefix", "sha", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"))
    # rows that repeat id and text are one row with a count from here on
    twins = rows.where("twin").groupBy("id", "length", "prefix", "sha").agg(F.count("*").alias("m"))
    same = twins.groupBy("length", "prefix", "sha").agg(F.sum("m").alias("n"), F.max("id").alias("keep_id")).where("n > 1")
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    twins = twins.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    joined = twins.join(same, ["length", "prefix", "sha", "salt"], "left").select(
        "id", "length", "prefix", "sha", "m",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", one).alias("group_size"),
    )
    nth = F.explode(F.sequence(one, F.col("m"))).alias("nth")
    twins = joined.select("*", nth).select("id", "length", "prefix", "sha", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"))
    return alone.unionByName(twins)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows repeated with one id and text any one stays."""
    scratch = Scratch(docs.sparkSession, "exact")
    key = ["id", "length"]
    groups = scratch.write(_groups(refine(docs, scratch, id_col, text_col)).select(*key, "prefix", "sha", "kept"), "groups")
    gone = BitFilter(groups.where("not kept").select(*key).distinct(), key, scratch, "gone-bits")
    # rows that stay but look as if they went
    doubt = gone.mark(groups.where("kept"), "looks_gone", *key).where("looks_gone").drop("looks_gone")
    doubt = scratch.write(doubt, "doubt")
    stay = BitFilter(doubt.select(*key).distinct(), key, scratch, "stay-bits")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), _length(text).alias("length"), text.alias("text"))
    asked = gone.mark(whole, "maybe_gone", *key)
    sure = asked.where("not maybe_gone").select("row")
    open_ = stay.mark(asked.where("maybe_gone"), "maybe_stays", *key).where("maybe_stays")
    open_ = open_.select("row", "id", "length", _prefix("text").alias("own_prefix"), _sha("text").alias("own_sha"))
    # where a row that stays was not hashed, no row that goes has its length, or its length and prefix
    same = F.coalesce(F.col("own_prefix") == doubt["prefix"], F.lit(True)) & F.coalesce(F.col("own_sha") == doubt["sha"], F.lit(True))
    told = open_.join(doubt, open_["id"].eqNullSafe(doubt["id"]) & (open_["length"] == doubt["length"]) & same, "left_semi")
    return sure.unionByName(told.dropDuplicates(["id", "length", "own_sha"]).select("row")).select("row.*")
