"""What the operators share: the scratch folder, written intermediate tables, bit filters, words, and a deterministic order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (what bytes.split() takes for words too).
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of our own, in local mode only: elsewhere no
    folder that all executors share is known."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs a reread and not a recomputation.

    ``write`` returns the table read back; ``drop`` deletes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class BitFilter:
    """Which of a set of keys a row may hold, asked in the scan without moving the row: one bit per key in a bitmap that is broadcast.

    The bitmap takes ``PER_KEY`` bits per key, and at most ``MOST`` bits (32 MB) however many keys there are; a bit that is set by another
    key says yes wrongly, so a yes has to be checked and a no is certain.
    """

    PER_KEY, PAGE, MOST = 32, 1 << 15, 1 << 28

    def __init__(self, keys: DataFrame, cols: list[str], scratch: Scratch, name: str):
        self.bits = self.PAGE
        n = keys.count()
        while self.bits < self.PER_KEY * n and self.bits < self.MOST:
            self.bits *= 2
        at = self._at(*cols)
        pages = keys.select(F.floor(at / self.PAGE).alias("page"), (at % self.PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self.pages = scratch.write(pages, name).select(F.col("page").alias("__page"), F.col("bits").alias("__bits"))

    def _at(self, *cols: Column | str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.bits))

    def mark(self, df: DataFrame, name: str, *cols: Column | str) -> DataFrame:
        """``df`` with a boolean column ``name``: whether the key made of ``cols`` may be one of the set. ``df`` is of the caller's making, and has no column called __page, __bits or __at."""
        # a frame's own columns keep their names; those of the filter go at once
        asked = df.withColumn("__at", self._at(*cols))
        both = asked.join(F.broadcast(self.pages), F.floor(F.col("__at") / self.PAGE) == F.col("__page"), "left")
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__at") % self.PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # the powers of two stand for the shift by a column
        power = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (F.col("__at") % 8).cast("int") + 1)
        return both.withColumn(name, F.coalesce(byte.bitwiseAND(power) != 0, F.lit(False))).drop("__at", "__page", "__bits")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
