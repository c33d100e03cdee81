"""The scalar functions under SQL names, for spark.sql."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import codecs, header
from ..kernels.limits import CodecError
from .columns import _HEADER, HEADER


def register(spark: SparkSession) -> list[str]:
    """gzip_compress, gzip_decompress, ... for the five codecs, try_ twins that give null, decompress, detect_format, gzip_read_header."""
    names = []

    def add(name: str, kernel, arrow: pa.DataType, kind: T.DataType) -> None:
        def strict(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else kernel(x) for x in a.to_pylist()], arrow)

        def lenient(a: pa.Array) -> pa.Array:
            out = []
            for x in a.to_pylist():
                try:
                    out.append(None if x is None else kernel(x))
                except (CodecError, ValueError):
                    out.append(None)
            return pa.array(out, arrow)

        for prefix, f in (("", strict), ("try_", lenient)):
            spark.udf.register(prefix + name, F.arrow_udf(f, kind))
            names.append(prefix + name)

    for codec in codecs.COMPRESS:
        add(f"{codec}_compress", codecs.COMPRESS[codec], pa.binary(), T.BinaryType())
        add(f"{codec}_decompress", codecs.DECOMPRESS[codec], pa.binary(), T.BinaryType())
    add("auto_decompress", codecs.auto_decompress, pa.binary(), T.BinaryType())
    add("detect_format", codecs.detect, pa.string(), T.StringType())
    add("gzip_read_header", header.read_header, _HEADER, HEADER)
    return names
