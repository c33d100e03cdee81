"""Content negotiation and response compression over tables of responses; decisions are native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as cf

#: Server preference, threshold in bytes, exact types that compress, and the codec of each encoding name.
ENCODINGS = ("zstd", "br", "gzip", "deflate")
THRESHOLD = 1024
COMPRESSIBLE = (
    "application/json",
    "application/javascript",
    "application/xml",
    "application/xhtml+xml",
    "application/rss+xml",
    "application/atom+xml",
    "application/graphql-response+json",
    "image/svg+xml",
)
CODEC = {"zstd": "zstd", "br": "brotli", "gzip": "gzip", "deflate": "deflate"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_accept_encoding(header: Column | str) -> Column:
    """array<struct<name, quality>>, highest quality first, equals in the order given; empty for a null header."""
    parts = F.filter(F.transform(F.split(F.coalesce(_col(header), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    def entry(x: Column, place: Column) -> Column:
        given = F.regexp_extract(x, r";\s*q=(\d+(?:\.\d+)?)\s*(?:;|$)", 1)
        q = F.when(given != "", given.cast("double")).otherwise(F.lit(1.0))
        return F.struct((-q).alias("order"), place.alias("place"), F.lower(F.trim(F.substring_index(x, ";", 1))).alias("name"), q.alias("quality"))

    return F.transform(F.array_sort(F.transform(parts, entry)), lambda e: F.struct(e["name"].alias("name"), e["quality"].alias("quality")))


def client_accepts(header: Column | str, preferred: Sequence[str] = ENCODINGS) -> Column:
    """Names that the client takes: those with q > 0; ``*`` adds every preferred one that is not refused by name."""
    entries = parse_accept_encoding(header)
    named = F.transform(F.filter(entries, lambda e: (e["quality"] > 0) & (e["name"] != "*")), lambda e: e["name"])
    star = F.exists(entries, lambda e: (e["name"] == "*") & (e["quality"] > 0))

    def allowed(name: Column) -> Column:
        first = F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(1))
        return first.isNull() | (first["quality"] > 0)

    added = F.filter(F.array(*map(F.lit, preferred)), allowed)
    return F.when(star, F.array_union(named, added)).otherwise(F.array_distinct(named))


def negotiate(header: Column | str, preferred: Sequence[str] = ENCODINGS) -> Column:
    """The first encoding of the server's order that the client takes; null if there is none or no header."""
    takes = client_accepts(header, preferred)
    return F.try_element_at(F.filter(F.array(*map(F.lit, preferred)), lambda p: F.array_contains(takes, p)), F.lit(1))


def is_compressible_type(content_type: Column | str) -> Column:
    t = F.lower(F.trim(F.element_at(F.split(F.coalesce(_col(content_type), F.lit("")), ";"), 1)))
    return t.startswith("text/") | t.isin(*COMPRESSIBLE) | t.endswith("+json") | t.endswith("+xml")


def append_vary(vary: Column | str) -> Column:
    v = _col(vary)
    return (
        F.when(v.isNull() | (v == ""), F.lit("Accept-Encoding")).when(F.trim(v) == "*", F.lit("*")).when(F.contains(F.lower(v), F.lit("accept-encoding")), v).otherwise(F.concat(v, F.lit(", Accept-Encoding")))
    )


@dataclass
class Policy:
    """encodings in order of preference, threshold in bytes (smaller bodies are sent as they are), levels by encoding, an extra filter."""

    encodings: Sequence[str] = ENCODINGS
    threshold: int = THRESHOLD
    level: dict[str, int] = field(default_factory=dict)
    filter: Column | None = None


def should_skip(policy: Policy, content_encoding: str = "content_encoding", cache_control: str = "cache_control", content_type: str = "content_type") -> Column:
    """Already encoded, not to be transformed, refused by the filter, or of a type that does not compress."""
    skip = (F.coalesce(F.col(content_encoding), F.lit("")) != "") | F.contains(F.lower(F.coalesce(F.col(cache_control), F.lit(""))), F.lit("no-transform")) | ~is_compressible_type(content_type)
    return skip if policy.filter is None else skip | ~F.coalesce(policy.filter, F.lit(False))


def compress_responses(df: DataFrame, policy: Policy | None = None, flavor: str = "hono") -> DataFrame:
    """Responses with body, content_encoding and vary as they are sent, and ``chosen`` (the encoding used, null if none).

    Columns read: method, accept_encoding, content_type, content_encoding, cache_control, vary, body. A body that fails to
    compress is sent as it is. Rows that are skipped reach the codecs as null, so that they cost nothing there. Vary is set
    on every response (flavor hono), on all but HEAD (fastify), or where an encoding was negotiated (express).
    """
    policy = policy or Policy()
    if flavor not in ("hono", "fastify", "express"):
        raise ValueError("flavor must be hono, fastify or express")
    body = F.col("body").cast("binary")
    head = F.upper(F.coalesce(F.col("method"), F.lit("GET"))) == "HEAD"
    wanted = F.when(~head, negotiate("accept_encoding", policy.encodings))
    chosen = F.when(~should_skip(policy) & (F.octet_length(body) >= policy.threshold), wanted)
    varies = {"hono": F.lit(True), "fastify": ~head, "express": ~head & wanted.isNotNull()}[flavor]
    out = df.withColumns({"__wanted": wanted, "__chosen": chosen, "__vary": F.when(varies, append_vary("vary")).otherwise(F.col("vary"))})
    packed = [cf.compress(F.when(F.col("__chosen") == e, F.col("body").cast("binary")), CODEC[e], policy.level.get(e), "null", once=True) for e in policy.encodings]
    out = out.withColumn("__packed", F.coalesce(*packed))
    done = F.col("__packed").isNotNull()
    out = out.withColumns({"body": F.coalesce("__packed", F.col("body").cast("binary")), "content_encoding": F.when(done, F.col("__chosen")).otherwise(F.col("content_encoding")), "vary": F.col("__vary"), "chosen": F.when(done, F.col("__chosen"))})
    return out.drop("__wanted", "__chosen", "__vary", "__packed")
