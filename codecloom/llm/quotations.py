"""Quotation linking, in DataFrame operations only.

1. Each message is split into lines, a line's quote level is the number of its leading ``>``. Runs of lines of one level are
   passages; lines of level 0, without the attribution line ("... wrote:") that announces a quotation, are the message's own text.
2. Passages and own texts are normalised (quote marks off, lower case, runs of white space to one blank) and hashed.
3. Of the messages of a thread with one hash the earliest is the original: one row per thread and hash, so that a text that many
   messages share joins each passage once. A passage that is no earlier message's whole text is taken apart into paragraphs and lines,
   which are joined to the paragraphs and lines of own texts in the same way: its first paragraph that has an original counts, or else
   its first line. A message replies to the original of its first passage of the lowest level that has one.
4. Depth and root of the reply trees by pointer doubling, each round a written table. Within a thread, messages are ordered by root,
   then time: every message stands behind the one it answers, and ``position`` counts from 1 in the root's conversation.

Thread and order identify a message. Results in odd cases: null or empty texts have no passages and an empty own text, and nothing links to
them. A quotation of nothing in its thread, of only a part of a line, or only of later messages, links to nothing. Messages repeated with one thread and order are
rows of their own with the same links. Rows with a null thread or order link to nothing. An empty table gives no rows. Extra columns
pass through; a column called as one of the results gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Leading quote marks of a line, and the line that announces a quotation.
MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"^.{0,200}\bwrote:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_substr(line, F.lit(MARKS)), "[^>]", ""))


def parsed(text: Column) -> Column:
    """array of (level, line): each line's quote level, and the line without its marks."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.struct(F.coalesce(_level(x), F.lit(0)).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("line")))


def _own(marked: Column) -> Column:
    n = F.size(marked)
    kept = F.filter(
        F.transform(marked, lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), F.when(i + 1 < n, F.get(marked, i + 1)["level"]).otherwise(F.lit(0)).alias("next"))),
        lambda x: (x["level"] == 0) & ~((x["next"] > 0) & F.coalesce(x["line"].rlike(ATTRIBUTION), F.lit(False))),
    )
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\n+|\s+$", "")


def _passages(marked: Column) -> Column:
    """(level, at, text) of each run of quoted lines of one level. A run ends where the next one, of whatever level, starts."""
    n = F.size(marked)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(marked, i)["level"] != F.get(marked, i - 1)["level"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))

    def run(s: Column, e: Column) -> Column:
        level = F.get(marked, s)["level"]
        lines = F.when(level > 0, F.array_join(F.transform(F.slice(marked, s + 1, e - s), lambda x: x["line"]), "\n"))
        return F.struct(level.alias("level"), s.alias("at"), lines.alias("text"))

    return F.filter(F.zip_with(starts, ends, run), lambda p: F.coalesce(p["text"].rlike(r"\S"), F.lit(False)))


def _hash(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def _pieces(text: Column) -> Column:
    """(kind, at, hash) of each paragraph (kind 1) and each line (kind 2) that holds anything."""
    def cut(by: str, kind: int) -> Column:
        parts = F.transform(F.split(text, by), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.when(x.rlike(r"\S"), _hash(x)).alias("hash")))
        return F.filter(parts, lambda x: x["hash"].isNotNull())

    return F.concat(cut(r"\n[ \t\r]*\n", 1), cut("\n", 2))


def link_quotations(messages: DataFrame, thread_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The messages with all their columns, and own_text, n_quotes, max_level, parent_order, root_order, depth, position."""
    spark = messages.sparkSession
    scratch = Scratch(spark, "quotes")
    base = messages.select(F.struct(*[messages[c] for c in messages.columns]).alias("row"), messages[thread_col].alias("thread"), messages[order_col].alias("order"), parsed(messages[text_col].cast("string")).alias("marked"))
    base = base.select("row", "thread", "order", _own(F.col("marked")).alias("own_text"), F.when(F.exists("marked", lambda x: x["level"] > 0), _passages(F.col("marked"))).otherwise(F.expr("array()")).alias("passages"))
    base = scratch.write(base.withColumn("passages", F.col("passages").cast("array<struct<level:int,at:int,text:string>>")), "messages")
    originals = base.where("own_text <> ''").select("thread", _hash(F.col("own_text")).alias("hash"), "order").groupBy("thread", "hash").agg(F.min("order").alias("original"))
    quoted = base.select("thread", "order", F.explode("passages").alias("p")).select("thread", "order", "p.level", "p.at", "p.text", _hash(F.col("p.text")).alias("hash"))
    early = F.when(F.col("original") < F.col("order"), F.col("original"))
    whole = quoted.join(originals, ["thread", "hash"], "left").select("thread", "order", "level", "at", early.alias("original"), F.when(early.isNull(), F.col("text")).alias("text"))
    whole = scratch.write(whole, "whole")
    # passages that are no whole text, and the paragraphs and lines of own texts in their threads
    rest = whole.where(F.col("original").isNull() & F.col("thread").isNotNull())
    own = base.where("own_text <> ''").join(rest.select("thread").distinct(), "thread", "left_semi")
    own = own.select("thread", "order", F.explode(_pieces(F.col("own_text"))).alias("q")).groupBy("thread", "q.kind", "q.hash").agg(F.min("order").alias("original"))
    parts = rest.select("thread", "order", "level", "at", F.explode(_pieces(F.col("text"))).alias("q")).select("thread", "order", "level", "at", "q.kind", "q.place", "q.hash")
    parts = parts.join(own, ["thread", "kind", "hash"]).where(F.col("original") < F.col("order")).select("thread", "order", "level", "at", "kind", "place", "original")
    zero = F.lit(0).cast("int")
    links = whole.where("original is not null").select("thread", "order", "level", "at", zero.alias("kind"), zero.alias("place"), "original").unionByName(parts)
    links = links.groupBy("thread", "order").agg(F.min_by("original", F.struct("level", "at", "kind", "place")).alias("parent"))
    links = scratch.write(links, "links")
    # pointer doubling: anc is the message 'up' replies above; rows that have come to their root take no part in later rounds
    step = scratch.write(links.select("thread", "order", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("up"), F.lit(False).alias("done")), "up0")
    for k in range(1, 64):
        above = step.select(F.col("thread").alias("t"), F.col("order").alias("o"), F.col("anc").alias("next"), F.col("up").alias("more"))
        open_ = step.where("not done")
        joined = open_.join(above, (open_["thread"] == above["t"]) & (open_["anc"] == above["o"]), "left")
        moved = joined.select("thread", "order", F.coalesce("next", "anc").alias("anc"), (F.col("up") + F.coalesce("more", F.lit(0))).alias("up"), F.col("next").isNull().alias("done"))
        new = scratch.write(moved.unionByName(step.where("done")), f"up{k}")
        scratch.drop(step)
        step = new
        if not step.where("not done").take(1):
            break
    tree = links.join(step.select("thread", "order", "anc", "up"), ["thread", "order"]).select(F.col("thread").alias("t"), F.col("order").alias("o"), "parent", "anc", "up")
    out = base.join(tree, (base["thread"] == tree["t"]) & (base["order"] == tree["o"]), "left")
    own = ("own_text", "n_quotes", "max_level", "parent_order", "root_order", "depth", "position")
    return out.select(
        *(F.col("row")[c].alias(c) for c in messages.columns if c not in own), "own_text", F.size("passages").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.col("parent").alias("parent_order"), F.coalesce("anc", "order").alias("root_order"), F.coalesce("up", F.lit(0)).cast("long").alias("depth"),
        F.when(F.col("thread").isNotNull() & F.col("order").isNotNull(), F.rank().over(Window.partitionBy("thread", F.coalesce("anc", "order")).orderBy("order"))).cast("long").alias("position"),
    )


def with_quotations(turns: DataFrame) -> DataFrame:
    """Conversations as mail, of four kinds by the turn's number and its conversation's:

    0: the quoted turn before, below an attribution, and that behind the quoted one before it, one level deeper;
    1: the first line of the turn before, then the text; 2: the text between the last line of the turn before and the first of the one before that;
    3: no quotation.
    """
    before = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("t"))

    def quote(text: Column, marks: str) -> Column:
        return F.concat(F.lit(marks), F.regexp_replace(text, "\n", "\n" + marks))

    one = before.select(F.col("conv_id").alias("c1"), (F.col("turn") + 1).alias("n1"), F.col("t").alias("t1"))
    two = before.select(F.col("conv_id").alias("c2"), (F.col("turn") + 2).alias("n2"), F.col("t").alias("t2"))
    joined = turns.join(one, (turns["conv_id"] == one["c1"]) & (turns["turn"] == one["n1"]), "left").join(two, (turns["conv_id"] == two["c2"]) & (turns["turn"] == two["n2"]), "left")
    first, last = (lambda c: F.substring_index(c, "\n", 1)), (lambda c: F.substring_index(c, "\n", -1))
    t1, t2 = F.col("t1"), F.col("t2")
    kind = F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4))
    mail = (
        F.when(kind == 0, F.concat_ws("\n", F.when(t1.isNotNull(), F.lit("They wrote:")), quote(t2, "> > "), quote(t1, "> "), F.col("text")))
        .when(kind == 1, F.concat_ws("\n", quote(first(t1), "> "), F.col("text")))
        .when(kind == 2, F.concat_ws("\n", quote(last(t1), "> "), F.col("text"), quote(first(t2), "> ")))
        .otherwise(F.col("text"))
    )
    return joined.select("conv_id", "turn", "role", mail.alias("text"))
