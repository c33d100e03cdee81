"""Columns, streams, negotiation and the registered queries against their SQL."""

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codecloom import __version__
from codecloom.functions import columns as cf
from codecloom.functions.sql import register
from codecloom.operators import compare, dictionary, negotiate
from codecloom.plans import catalog
from codecloom.sources import blobs
from codecloom.streaming import chunks

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    assert rows
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        cols = want.columns
        assert sorted(cols) == sorted(got.columns)
        assert rows == sorted(map(str, (tuple(r[cols.index(c)] for c in sorted(cols)) for r in want.fetchall())))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_arguments_raise_where_the_column_is_built(spark):
    with pytest.raises(ValueError, match="between 0 and 9"):
        cf.gzip_compress("x", 10)
    with pytest.raises(ValueError, match="capacity"):
        cf.lz4_decompress_with_capacity("x", -1)
    with pytest.raises(NotImplementedError):
        cf.brotli_compress_with_dict("x", b"d")


def test_null_in_null_out_and_errors(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk that is no gzip"))], "k int, b binary")
    got = {r.k: r for r in df.select("k", cf.gzip_decompress("b", "null").alias("n"), cf.gzip_decompress("b", "result").alias("r"), cf.zstd_compress("b").alias("z")).collect()}
    assert got[1].n is None and got[1].r is None and got[1].z is None
    assert got[2].n is None and not got[2].r.ok and got[2].r.error.startswith("gzip decompress failed")
    with pytest.raises(Exception, match="gzip decompress failed"):
        df.select(cf.gzip_decompress("b")).collect()


def test_async_twins_and_version(spark):
    assert len(cf.ASYNC) == 22 and all(getattr(cf, f"{n}_async") is getattr(cf, n) for n in cf.ASYNC)
    assert dictionary.zstd_train_dictionary_async is dictionary.zstd_train_dictionary
    assert spark.range(1).select(cf.version()).first()[0] == __version__


def test_crc32(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"123456789"),)], "b binary")
    assert [r[0] for r in df.select(cf.crc32("b")).collect()] == [0, 0xCBF43926]
    assert df.select(cf.crc32("b", zlib.crc32(b"abc")).alias("c")).collect()[1].c == zlib.crc32(b"abc123456789")


def test_sql_names(spark):
    names = register(spark)
    assert "try_zstd_decompress" in names
    got = spark.sql("SELECT CAST(gzip_decompress(gzip_compress(CAST('abc' AS BINARY))) AS STRING) AS a, try_gzip_decompress(CAST('abc' AS BINARY)) AS b, detect_format(lz4_compress(CAST('abc' AS BINARY))) AS c").first()
    assert tuple(got) == ("abc", None, "lz4")


def test_detect_compares_magic_natively(spark):
    df = spark.createDataFrame([(bytearray(b"\x28\xb5\x2f\xfdrest"),), (bytearray(b"\x1f\x8b"),), (bytearray(b"\x04\x22\x4d\x18"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(cf.detect_format("b")).collect()] == ["zstd", "gzip", "lz4", "unknown", None]


@pytest.mark.parametrize(
    "header, want",
    [
        (None, None), ("", None), ("gzip", "gzip"), ("gzip, br", "br"), ("gzip;q=0.1, deflate", "gzip"), ("*", "zstd"), ("*;q=0", None), ("*, zstd;q=0", "br"), ("zstd;q=0, *", "br"), ("identity", None),
        ("GZIP", "gzip"), ("  gzip  ;  q=0.5 ", "gzip"), ("br;q=0", None), ("gzip;q=x", "gzip"), ("gzip;v=1;q=0", None), (",,", None), ("deflate;q=0.9,gzip;q=0.9", "gzip"),
    ],
)
def test_negotiate(spark, header, want):
    df = spark.createDataFrame([(header,)], "h string")
    assert df.select(negotiate.negotiate("h")).first()[0] == want


def test_negotiate_order_and_parse(spark):
    df = spark.createDataFrame([("br;q=0.2, gzip, zstd;q=0.9",)], "h string")
    assert df.select(negotiate.negotiate("h", ("gzip", "br"))).first()[0] == "gzip"
    assert [(e.name, e.quality) for e in df.select(negotiate.parse_accept_encoding("h")).first()[0]] == [("gzip", 1.0), ("zstd", 0.9), ("br", 0.2)]


def test_types_and_vary(spark):
    kinds = {"text/plain": True, "TEXT/HTML; x=1": True, "application/json": True, "image/svg+xml": True, "application/ld+json": True, "image/png": False, "": False, None: False}
    df = spark.createDataFrame(list(kinds.items()), "t string, want boolean")
    assert all(a == b for a, b in df.select(negotiate.is_compressible_type("t"), "want").collect())
    vary = {None: "Accept-Encoding", "": "Accept-Encoding", "*": "*", "Origin": "Origin, Accept-Encoding", "accept-ENCODING, x": "accept-ENCODING, x"}
    df = spark.createDataFrame(list(vary.items()), "v string, want string")
    assert all(a == b for a, b in df.select(negotiate.append_vary("v"), "want").collect())


def test_responses(spark):
    body = b"hello world, " * 200
    base = {"method": "GET", "accept_encoding": "gzip", "content_type": "text/plain", "content_encoding": None, "cache_control": None, "vary": None, "body": bytearray(body)}
    cases = [{}, {"method": "HEAD"}, {"content_type": "image/png"}, {"content_encoding": "br"}, {"cache_control": "no-transform"}, {"body": bytearray(b"x" * 1023)}, {"body": bytearray(b"x" * 1024)}, {"accept_encoding": None}, {"accept_encoding": "lz4"}]
    rows = [{"k": k, **base, **c} for k, c in enumerate(cases)]
    schema = "k int, method string, accept_encoding string, content_type string, content_encoding string, cache_control string, vary string, body binary"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r.k: r for r in negotiate.compress_responses(df).collect()}
    assert [k for k in got if got[k].chosen] == [0, 6] and zlib.decompress(got[0].body, 31) == body
    assert got[3].content_encoding == "br" and bytes(got[2].body) == body and {r.vary for r in got.values()} == {"Accept-Encoding"}
    fast = {r.k: r.vary for r in negotiate.compress_responses(df, flavor="fastify").collect()}
    assert fast[1] is None and fast[7] == "Accept-Encoding"
    express = {r.k: r.vary for r in negotiate.compress_responses(df, flavor="express").collect()}
    assert express[7] is None and express[0] == "Accept-Encoding"
    only = negotiate.compress_responses(df, negotiate.Policy(encodings=("deflate", "gzip"), threshold=0, level={"gzip": 9}, filter=F.col("k") == 5)).where("chosen is not null").collect()
    assert [r.k for r in only] == [5]


def test_compare_codecs(spark):
    df = spark.createDataFrame([(1, "a" * 5000), (2, "")], "k int, t string")
    got = compare.compare_codecs(df, "k", "t").collect()
    assert len(got) == 8 and all(r.savings > 90 for r in got if r.k == 1) and {r.savings for r in got if r.k == 2} == {0.0}
    assert all(r.best == (r.packed_len == min(x.packed_len for x in got if x.k == r.k)) for r in got)


def test_sources(spark, tmp_path):
    from codecloom.kernels import codecs

    for codec in ("gzip", "zstd", "lz4", "brotli"):
        (tmp_path / f"{codec}.bin").write_bytes(codecs.COMPRESS[codec](codec.encode() * 50))
    got = {r.format: bytes(r.content) for r in blobs.read_compressed(spark, str(tmp_path), "*.bin").collect()}
    assert got == {c: c.encode() * 50 for c in ("gzip", "zstd", "lz4", "brotli")}
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "k int, t string")
    pieces = blobs.to_chunks(df, "k", "t", 3)
    assert sorted((r.id, r.seq, bytes(r.chunk)) for r in pieces.collect()) == [(1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g"), (2, 0, b""), (3, 0, b"")]
    assert {r.id: bytes(r.data) for r in blobs.from_chunks(pieces).collect()} == {1: b"abcdefg", 2: b"", 3: b""}
    blobs.write_compressed_lines(spark.createDataFrame([("x",)], "v string"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == "x"


def test_stream_digests(spark):
    """Streams of many chunks over batches, null and empty ones, a null id, chunks out of order, and pieces of chunks."""
    import hashlib

    data = {1: [b"x%d" % k for k in range(30_000)], 2: [b"", None], 3: [b"abc" * 50_000], None: [b"n", b"o"]}
    df = spark.createDataFrame([(k, s, None if c is None else bytearray(c)) for k, v in data.items() for s, c in reversed(list(enumerate(v)))], "k long, s long, c binary").repartition(3)
    whole = {k: b"".join(c or b"" for c in v) for k, v in data.items()}
    want = {k: (hashlib.md5(v).hexdigest(), len(v)) for k, v in whole.items()}
    assert {r.id: (r.digest, r.length) for r in chunks.stream_digests(df, "k", "s", "c").collect()} == want
    pieces = blobs.cut_chunks(df.where("k <> 1").toDF("id", "seq", "chunk"), 7)
    assert pieces.where("octet_length(chunk) > 7").isEmpty()
    assert {r.id: (r.digest, r.length) for r in chunks.stream_digests(pieces).collect()} == {k: v for k, v in want.items() if k in (2, 3)}
    assert chunks.stream_digests(df.limit(0), "k", "s", "c").count() == 0


def test_stream_factories(spark):
    from codecloom.streaming import factories as sf

    rows = [(k, s, bytearray(f"{k}:{s};".encode() * 30)) for k in (1, 2) for s in range(4)] + [(3, 0, None)]
    df = spark.createDataFrame(rows, "id long, seq long, chunk binary").repartition(3)
    whole = {k: b"".join(bytes(c) for i, _, c in rows if i == k and c) for k in (1, 2)}
    trained = dictionary.zstd_train_dictionary(spark.createDataFrame([(f'{{"id":{i},"name":"user {i}"}}',) for i in range(400)], "s string"), "s", 2048)
    pairs = [(sf.gzip_compress_stream(1), sf.gzip_decompress_stream()), (sf.deflate_compress_stream(), sf.deflate_decompress_stream(10_000)), (sf.zstd_compress_stream(), sf.decompress_stream()),
             (sf.brotli_compress_stream(4), sf.brotli_decompress_stream()), (sf.lz4_compress_stream(), sf.lz4_decompress_stream()), (sf.zstd_compress_dict_stream(trained), sf.zstd_decompress_dict_stream(trained))]
    for pack, unpack in pairs:
        got = {r.id: bytes(r.data) for r in blobs.from_chunks(unpack(pack(df))).collect()}
        assert got == whole | {3: b""}
    with pytest.raises(ValueError, match="maxOutputSize"):
        sf.decompress_stream(-1)
    for make in (sf.brotli_compress_dict_stream, sf.brotli_decompress_dict_stream):
        with pytest.raises(NotImplementedError):
            make(b"d")
    with pytest.raises(Exception, match="exceeded maximum size of 10 bytes"):
        sf.gzip_decompress_stream(10)(sf.gzip_compress_stream()(df)).collect()


@pytest.mark.parametrize("codec, how", [("zstd", "compress"), ("gzip", "compress"), ("deflate", "compress"), ("brotli", "compress"), ("zstd", "decompress")])
def test_structured_streaming(spark, tmp_path, codec, how):
    """Chunks come in three files, one per micro-batch; the end row in the last."""
    from codecloom.kernels import codecs

    parts = {k: [f"{k}-{b} ".encode() * 40 for b in range(3)] for k in (1, 2)}
    whole = {k: b"".join(v) for k, v in parts.items()}
    if how == "decompress":
        parts = {k: [(z := codecs.COMPRESS[codec](v))[: len(z) // 3], z[len(z) // 3 : len(z) // 2], z[len(z) // 2 :]] for k, v in whole.items()}
    schema = "id long, seq long, chunk binary, last boolean"
    source = tmp_path / "in"
    for b in range(3):
        spark.createDataFrame([(k, b, bytearray(parts[k][b]), b == 2) for k in parts], schema).coalesce(1).write.mode("append").parquet(str(source))
        for f in os.listdir(source):
            os.utime(source / f, (b + 1, b + 1)) if f.endswith(".parquet") and os.path.getmtime(source / f) > 100 else None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = chunks.stream_codec_streaming(stream, codec, how)
    name = f"out_{codec}_{how}"
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.id: bytes(r.data) for r in blobs.from_chunks(spark.table(name)).collect()}
    if how == "compress":
        got = {k: codecs.DECOMPRESS[codec](v) for k, v in got.items()}
    assert got == whole


def test_gzip_header_of_any_length(spark):
    """A name and comment beyond the first 128 KiB, a large value with a short header, and headers that never end."""
    import struct

    def member(name: bytes, comment: bytes, rest: bytes) -> bytes:
        return struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 8 | 16, 7, 0, 3) + name + b"\0" + comment + b"\0" + rest

    long = b"n" * 100_000, b"c" * 100_000
    values = [member(*long, b"data"), member(b"n", b"c", bytes(200_000)), member(b"n" * 300_000, b"", b"")[:250_000], b"x" * 200_000, None]
    df = spark.createDataFrame(list(enumerate(values)), "k long, z binary")
    got = [r.h for r in df.orderBy("k").select(cf.gzip_read_header("z", on_error="result").alias("h")).collect()]
    assert (got[0].value.filename, got[0].value.comment) == tuple(x.decode() for x in long)
    assert (got[1].value.filename, got[1].value.comment, got[1].value.mtime) == ("n", "c", 7)
    assert [h.error for h in got[2:4]] == ["gzip read header failed: unexpected end of file", "gzip read header failed: invalid gzip header"] and got[4] is None


def test_batches_pass_in_slices(spark):
    n = 5 * cf.SLICE + 3
    rows = [(k, None if k % 7 == 0 else b"junk" if k % 5 == 0 else zlib.compress(str(k).encode(), wbits=31)) for k in range(n)]
    df = spark.createDataFrame(rows, "k long, z binary").coalesce(1)
    got = df.select("k", cf.gzip_decompress("z", "null").alias("b")).collect()
    assert [(r.k, r.b and bytes(r.b)) for r in got] == [(k, None if z in (None, b"junk") else str(k).encode()) for k, z in rows]
    assert df.limit(0).select(cf.gzip_decompress("z")).collect() == []


@pytest.mark.parametrize("name", [f"{c}_levels" for c in catalog.LEVEL_SETS])
def test_levels_hold_one_output_at_a_time(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
