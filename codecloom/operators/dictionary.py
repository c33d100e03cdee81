"""zstd dictionaries trained from a column of samples, per table or per group.

Training needs its samples in one place. What is gathered is bounded by ``max_samples`` and ``max_bytes`` (parameters), and chosen by
a hash of the content, so the same table always trains the same dictionary.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.limits import MAX_DICTIONARY, capacity_of, failed

MAX_SAMPLES, MAX_SAMPLE_BYTES = 20_000, 64 * 1024 * 1024


def _train(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as e:
        raise failed("zstd dictionary training", e) from None


def _chosen(samples: DataFrame, keys: list[str], max_samples: int, max_bytes: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("data"), "data")
    ranked = samples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_samples)
    return ranked.withColumn("held", F.sum(F.octet_length("data")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("held") <= max_bytes)


def zstd_train_dictionary(df: DataFrame, col: Column | str, max_dict_size=None, max_samples: int = MAX_SAMPLES, max_bytes: int = MAX_SAMPLE_BYTES) -> bytes:
    """One dictionary for the table, as bytes on the driver."""
    size = MAX_DICTIONARY if max_dict_size is None else capacity_of(max_dict_size)
    c = F.col(col) if isinstance(col, str) else col
    data = df.select(c.cast("binary").alias("data")).where(F.octet_length("data") <= max_bytes).withColumn("h", F.xxhash64("data"))
    # lengths first: they tell how many samples fit max_bytes, and only those come
    lengths = data.select("h", F.octet_length("data").alias("n")).orderBy("h", "n").limit(max_samples).collect()
    held = fit = 0
    for row in lengths:
        held += row.n
        if held > max_bytes:
            break
        fit += 1
    last = lengths[fit - 1].h if fit else -(2**63)
    samples = [bytes(r.data) for r in data.where(F.col("h") <= last).orderBy("h", F.octet_length("data"), "data").limit(fit).collect()]
    return _train(samples, size)


zstd_train_dictionary_async = zstd_train_dictionary


def train_per_group(df: DataFrame, key: str, col: Column | str, max_dict_size=None, max_samples: int = 2_000, max_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """key, dictionary (null where the samples do not suffice). The rank limit is applied per task before rows move."""
    size = MAX_DICTIONARY if max_dict_size is None else capacity_of(max_dict_size)
    c = F.col(col) if isinstance(col, str) else col
    picked = _chosen(df.select(key, c.cast("binary").alias("data")).where("data is not null"), [key], max_samples, max_bytes)

    def run(table: pa.Table) -> pa.Table:
        try:
            got = _train([x.as_py() for x in table.column("data")], size)
        except Exception:  # noqa: BLE001  too few samples
            got = None
        return pa.table({key: table.column(key).slice(0, 1), "dictionary": pa.array([got], pa.binary())})

    from pyspark.sql import types as T

    return picked.select(key, "data").groupBy(key).applyInArrow(run, T.StructType([df.schema[key], T.StructField("dictionary", T.BinaryType())]))
