"""Registered queries over the given tables, and the SQL that each must agree with.

Compressed bytes differ between library versions, so results hold what must not: digests and lengths of decoded data, formats, header
fields, checksums, statuses and decisions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as cf
from ..operators import compare, dictionary, negotiate
from ..sources import blobs
from ..streaming import chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CODECS = ("gzip", "deflate", "zstd", "brotli", "lz4")
DETECTED = ("zstd", "gzip", "lz4", "brotli")


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _text() -> Column:
    return F.col("text").cast("binary")


def _text_size() -> Column:
    return F.octet_length(_text()).cast("long")


def _add_round_trips() -> None:
    for codec in CODECS:

        def run(spark, sf_dir, codec=codec):
            packed = _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", cf.compress("text", codec).alias("z"))
            back = packed.select("doc_id", "z", cf.decompress_as("z", codec).alias("back"))
            return back.select("doc_id", F.md5("back").alias("digest"), F.octet_length("back").cast("long").alias("raw_len"), F.col("z").isNotNull().alias("packed"))

        query(f"{codec}_roundtrip", "SELECT doc_id, md5(text) AS digest, octet_length(encode(text))::BIGINT AS raw_len, text IS NOT NULL AS packed FROM documents")(run)

        def stream(spark, sf_dir, codec=codec):
            turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
            packed = chunks.stream_codec(turns, "conv_id", "turn", "text", codec, "compress")
            back = chunks.stream_codec(packed, "id", "seq", "chunk", codec, "decompress")
            return chunks.stream_digests(back).withColumnsRenamed({"id": "conv_id", "length": "raw_len"})

        query(
            f"stream_{codec}",
            "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, octet_length(encode(string_agg(text, '' ORDER BY turn)))::BIGINT AS raw_len FROM conversations GROUP BY conv_id",
        )(stream)


_add_round_trips()

#: Boundary levels.
LEVEL_SETS = {"zstd": (-7, 1, 3, 19), "gzip": (0, 1, 6, 9), "deflate": (0, 1, 6, 9), "brotli": (0, 3, 6, 9)}


def _add_levels() -> None:
    for codec, levels in LEVEL_SETS.items():

        def run(spark, sf_dir, codec=codec, levels=levels):
            docs = _read(spark, sf_dir, "documents", "doc_id", "text")
            # a task has one level: side by side, a worker holds a batch's texts once for each
            each = (docs.select("doc_id", _text_size().alias("raw_len"), F.lit(v).cast("int").alias("level"), F.md5(cf.decompress_as(cf.compress("text", codec, v), codec)).alias("digest")) for v in levels)
            return reduce(DataFrame.unionByName, each)

        rows = ", ".join(f"({v})" for v in levels)
        query(f"{codec}_levels", f"SELECT doc_id, octet_length(encode(text))::BIGINT AS raw_len, level::INTEGER AS level, md5(text) AS digest FROM documents, (VALUES {rows}) v(level)")(run)


_add_levels()

CAP = 1000


def _add_capacities() -> None:
    for codec in CODECS:

        def run(spark, sf_dir, codec=codec):
            docs = _read(spark, sf_dir, "documents", "doc_id", "text")
            out = docs.select("doc_id", cf.decompress_as(cf.compress("text", codec), codec, CAP, on_error="result").alias("r"))
            return out.select("doc_id", F.when(F.col("r.ok"), "ok").otherwise(F.col("r.error")).alias("status"), F.coalesce(F.octet_length("r.value"), F.lit(0)).cast("long").alias("len"))

        error = "zstd decompress failed: Destination buffer is too small" if codec == "zstd" else f"{codec} decompress exceeded maximum size of {CAP} bytes"
        size = "octet_length(encode(text))"
        query(f"{codec}_capacity", f"SELECT doc_id, CASE WHEN {size} <= {CAP} THEN 'ok' ELSE '{error}' END AS status, CASE WHEN {size} <= {CAP} THEN {size} ELSE 0 END::BIGINT AS len FROM documents")(run)


_add_capacities()


def _mixed(df: DataFrame, key: str, col: str) -> DataFrame:
    """Each row packed by one of the detectable codecs, in turn; rows of the others reach a codec as null."""
    turn = F.pmod(F.col(key), F.lit(len(DETECTED)))
    parts = [cf.compress(F.when(turn == i, F.col(col).cast("binary")), c) for i, c in enumerate(DETECTED)]
    return df.select(key, F.coalesce(*parts).alias("z"))


_TURN = "CASE doc_id % 4 WHEN 0 THEN 'zstd' WHEN 1 THEN 'gzip' WHEN 2 THEN 'lz4' ELSE 'brotli' END"


@query("detect_format", f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN text = '' AND doc_id % 4 = 3 THEN 'unknown' ELSE {_TURN} END AS format FROM documents")
def detect_format(spark, sf_dir):
    """An empty text packed by brotli yields no byte, by which that format is known."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return _mixed(docs, "doc_id", "text").select("doc_id", cf.detect_format("z").alias("format"))


@query("auto_decompress", "SELECT doc_id, CASE WHEN text <> '' OR doc_id % 4 <> 3 THEN md5(text) END AS digest FROM documents")
def auto_decompress(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return _mixed(docs, "doc_id", "text").select("doc_id", F.md5(cf.decompress("z", on_error="null")).alias("digest"))


@query("stream_auto", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def stream_auto(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    packed = None
    for i, codec in enumerate(("zstd", "gzip", "lz4", "brotli")):
        one = chunks.stream_codec(turns.where(F.pmod("conv_id", F.lit(4)) == i), "conv_id", "turn", "text", codec, "compress")
        packed = one if packed is None else packed.unionByName(one)
    back = chunks.stream_codec(packed, "id", "seq", "chunk", "auto", "decompress")
    return chunks.stream_digests(back).select(F.col("id").alias("conv_id"), "digest")


@query("stream_small_chunks", "SELECT page_id, md5(html) AS digest FROM pages")
def stream_small_chunks(spark, sf_dir):
    pieces = blobs.to_chunks(_read(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html", 64)
    packed = chunks.stream_codec(pieces, "id", "seq", "chunk", "zstd", "compress")
    back = chunks.stream_codec(blobs.cut_chunks(packed, 16), "id", "seq", "chunk", "zstd", "decompress")
    return chunks.stream_digests(back).select(F.col("id").alias("page_id"), "digest")


@query("gzip_header", "SELECT page_id, url AS filename, 1700000000 + page_id AS mtime, NULL::VARCHAR AS comment, 255 AS os, md5(html) AS digest FROM pages")
def gzip_header(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    packed = pages.select("page_id", cf.gzip_compress_with_header("html", F.col("url"), F.col("page_id") + 1_700_000_000).alias("z"))
    got = packed.select("page_id", cf.gzip_read_header("z").alias("h"), F.md5(cf.gzip_decompress("z")).alias("digest"))
    return got.select("page_id", "h.filename", "h.mtime", "h.comment", "h.os", "digest")


@query("gzip_concat", "SELECT page_id, md5(url || html) AS digest FROM pages")
def gzip_concat(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", F.md5(cf.gzip_decompress(F.concat(cf.gzip_compress("url"), cf.gzip_compress("html", 9)))).alias("digest"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length({h}) + 1, 2), lambda i: ('0x' || substr({h}, i, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, list_reduce([xor(a, b) & 255, 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))), 4294967295::BIGINT)"""


@query("crc32_text", f"SELECT p_partkey, {_CRC.format(h='hex(encode(p_name))')} AS crc FROM part")
def crc32_text(spark, sf_dir):
    return _read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", cf.crc32("p_name").alias("crc"))


@query("crc32_seeded", f"SELECT c_custkey, {_CRC.format(h='hex(encode(c_name || c_name))')} AS crc FROM customer")
def crc32_seeded(spark, sf_dir):
    return _read(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", cf.crc32("c_name", cf.crc32("c_name")).alias("crc"))


@query("crc32_chained", f"SELECT conv_id AS id, {_CRC.format(h='h')} AS crc FROM (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn))) AS h FROM conversations GROUP BY conv_id)")
def crc32_chained(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return chunks.chained_crc32(turns, "conv_id", "turn", "text")


def _events(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props").select("event_id", "event_type", "props", F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("record"))


@query("zstd_dict_roundtrip", "SELECT event_id, event_type, props FROM events")
def zstd_dict_roundtrip(spark, sf_dir):
    events = _events(spark, sf_dir)
    trained = dictionary.zstd_train_dictionary(events, "record")
    back = cf.zstd_decompress_with_dict(cf.zstd_compress_with_dict("record", trained), trained).cast("string")
    got = events.select(F.from_json(back, "event_id long, event_type string, props string").alias("r"))
    return got.select("r.*")


@query("zstd_dict_savings", "SELECT count(*) AS records, true AS smaller FROM events")
def zstd_dict_savings(spark, sf_dir):
    events = _events(spark, sf_dir)
    trained = dictionary.zstd_train_dictionary(events, "record")
    sizes = events.select(F.octet_length(cf.zstd_compress("record")).alias("plain"), F.octet_length(cf.zstd_compress_with_dict("record", trained)).alias("small"))
    return sizes.agg(F.count("*").alias("records"), (F.sum("small") < F.sum("plain")).alias("smaller"))


@query("zstd_dict_per_group", "SELECT event_type, count(*) AS records FROM events GROUP BY event_type")
def zstd_dict_per_group(spark, sf_dir):
    events = _events(spark, sf_dir)
    trained = dictionary.train_per_group(events, "event_type", "record", 16_384)
    return events.groupBy("event_type").agg(F.count("*").alias("records")).join(trained.where("dictionary is not null").select("event_type"), "event_type")


#: Request headers dealt to rows by id.
HEADERS = (
    "gzip, deflate, br",
    "zstd;q=0.5, gzip;q=1.0",
    "*",
    "*, zstd;q=0",
    "identity",
    "br;q=0, gzip;q=0.8",
    "",
    " GZIP ; q=0.3 , deflate",
    "deflate;q=0, *;q=0.1",
)
_HEADER_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADERS)) + " END"
#: What the server's order makes of each header.
_CHOICE = ("br", "zstd", "zstd", "br", None, "gzip", None, "gzip", "zstd")
_CHOICE_SQL = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN {'NULL' if c is None else repr(c)}" for i, c in enumerate(_CHOICE)) + " END"


def _header_of(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, HEADERS)), (F.pmod(F.col(key), F.lit(len(HEADERS))) + 1).cast("int"))


@query("negotiate", f"SELECT page_id, {_CHOICE_SQL}::VARCHAR AS encoding FROM pages")
def negotiate_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages", "page_id").select("page_id", negotiate.negotiate(_header_of("page_id")).alias("encoding"))


#: Types dealt to rows, and whether each compresses.
TYPES = (("text/html; charset=utf-8", True), ("application/json", True), ("image/png", False), ("application/vnd.api+json", True), ("IMAGE/SVG+XML", True), ("application/octet-stream", False), ("", False))


@query("compressible_type", "SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN {str(y).lower()}" for i, (_, y) in enumerate(TYPES)) + " END AS yes FROM pages")
def compressible_type(spark, sf_dir):
    kind = F.element_at(F.array(*(F.lit(t) for t, _ in TYPES)), (F.pmod("page_id", F.lit(len(TYPES))) + 1).cast("int"))
    return _read(spark, sf_dir, "pages", "page_id").select("page_id", negotiate.is_compressible_type(kind).alias("yes"))


@query(
    "append_vary",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Accept-Encoding' WHEN 1 THEN '*' WHEN 2 THEN 'origin, accept-encoding' ELSE url || ', Accept-Encoding' END AS vary FROM pages",
)
def append_vary(spark, sf_dir):
    vary = F.when(F.col("page_id") % 4 == 1, "*").when(F.col("page_id") % 4 == 2, "origin, accept-encoding").when(F.col("page_id") % 4 == 3, F.col("url"))
    return _read(spark, sf_dir, "pages", "page_id", "url").select("page_id", negotiate.append_vary(vary).alias("vary"))


@query(
    "compress_responses",
    f"""WITH p AS (SELECT page_id, html, octet_length(encode(html)) AS size, {_CHOICE_SQL} AS encoding, page_id % 5 = 0 AS head, page_id % 7 = 3 AS fixed FROM pages),
    d AS (SELECT *, CASE WHEN NOT head AND NOT fixed AND size >= 1024 THEN encoding END AS chosen FROM p)
    SELECT page_id, chosen::VARCHAR AS content_encoding, 'Accept-Encoding' AS vary, md5(html) AS digest FROM d""",
)
def compress_responses(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages", "page_id", "html")
    rows = pages.select(
        "page_id", F.when(F.col("page_id") % 5 == 0, "HEAD").otherwise("GET").alias("method"), _header_of("page_id").alias("accept_encoding"), F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("content_encoding"), F.when(F.col("page_id") % 7 == 3, "public, No-Transform").alias("cache_control"), F.lit(None).cast("string").alias("vary"), F.col("html").cast("binary").alias("body"),
    )
    sent = negotiate.compress_responses(rows)
    back = [cf.decompress_as(F.when(F.col("chosen") == e, F.col("body")), c) for e, c in negotiate.CODEC.items()]
    return sent.select("page_id", "content_encoding", "vary", F.md5(F.coalesce(*back, F.when(F.col("chosen").isNull(), F.col("body")))).alias("digest"))


@query("compress_ratio_by_lang", "SELECT lang, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS raw_bytes, true AS saves FROM documents GROUP BY lang")
def compress_ratio_by_lang(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "lang", "text")
    sizes = docs.select("lang", F.octet_length(_text()).cast("long").alias("raw"), F.octet_length(cf.zstd_compress("text")).cast("long").alias("z"))
    return sizes.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("raw").alias("raw_bytes"), (compare.savings(F.sum("raw"), F.sum("z")) > 0).alias("saves"))


@query("best_codec")
def best_codec(spark, sf_dir):
    return compare.compare_codecs(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


#: What each decoder makes of empty bytes.
@query("decode_empty", "SELECT doc_id, 'ok' AS zstd, 'gzip decompress failed: unexpected end of file' AS gzip, 'ok' AS deflate, 'brotli decompress failed: unexpected end of file' AS brotli, 'ok' AS lz4 FROM documents")
def decode_empty(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    got = docs.select("doc_id", *(cf.decompress_as(F.substring(_text(), 1, 0), c, on_error="result").alias(c) for c in ("zstd", "gzip", "deflate", "brotli", "lz4")))
    return got.select("doc_id", *(F.when(F.col(f"{c}.ok"), "ok").otherwise(F.col(f"{c}.error")).alias(c) for c in ("zstd", "gzip", "deflate", "brotli", "lz4")))


@query("truncated_fails", "SELECT doc_id, false AS zstd, false AS gzip, false AS deflate, false AS brotli, false AS lz4 FROM documents")
def truncated_fails(spark, sf_dir):
    """Half of a compressed text is refused by every decoder."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    packed = docs.select("doc_id", *(cf.compress("text", c).alias(c) for c in CODECS))
    return packed.select("doc_id", *(cf.decompress_as(F.substring(c, F.lit(1), (F.octet_length(c) / 2).cast("int")), c, on_error="null").isNotNull().alias(c) for c in ("zstd", "gzip", "deflate", "brotli", "lz4")))
