"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_counts, exact_dedup, licences, lm_scoring, mixing, near_dedup, packing, quality, quotations, substring_dedup

from .common import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score_texts(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), with_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), *quality.COUNTS[:5], "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op6_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets three edits: words moved into a place that its id picks, a replacement in the middle, a line at the end."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(text).cast("long")
    place = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), size + 1)
    edits = F.array(*(F.struct(pos.alias("pos"), F.lit(drop).cast("long").alias("drop"), insert.alias("insert")) for pos, drop, insert in ((place, 12, F.substring(text, 1, 40)), (F.floor(size / 2), 5, F.concat(F.lit(" edit "), F.col("doc_id").cast("string"))), (size + 100, 0, F.lit("\nEnd.")))))
    store = Scratch(spark, "trees").write(edit_counts.build_trees(_read(spark, sf_dir, "documents").select("doc_id", "text")), "store")
    out = edit_counts.apply_edits(store.withColumn("edits", edits))
    return out.select("doc_id", "tokens_before", "tokens_after", "chars_split", F.length("text").cast("long").alias("n_chars_after"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = quotations.with_quotations(_read(spark, sf_dir, "conversations"))
    out = quotations.link_quotations(mail)
    return out.select("conv_id", "turn", "role", F.md5(F.col("own_text").cast("binary")).alias("own_md5"), "n_quotes", "max_level", F.col("parent_order").alias("parent_turn"), F.col("root_order").alias("root_turn"), "depth", "position")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan_licences(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "licence", "line", F.round("dice", 9).alias("dice"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_rates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_groups(_read(spark, sf_dir, "documents"), width=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lexical_packing,
        op2_context_mixing_scores,
        op3_difference_cover_dedup,
        op4_quality_rules,
        op5_exact_dedup,
        op6_edit_aware_token_counts,
        op7_quotation_linking,
        op8_entropy_mixing,
        op9_licence_scan,
        op10_hyperminhash_near_dedup,
    )
}

def _licence_sql() -> str:
    rows = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in licences.TEMPLATES.items())
    words = r"list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
        WITH t AS (SELECT name, {grams} AS b FROM (SELECT name, {words.format("body")} AS w FROM (VALUES {rows}) v(name, body))),
        cut AS (SELECT doc_id, row_number() OVER () AS r, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS b FROM documents),
        blocks AS (SELECT doc_id, unit, coalesce(sum(length(unit) - length(replace(unit, chr(10), '')) + 2) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line
            FROM (SELECT doc_id, r, unnest(b) AS unit, unnest(range(0, len(b))) AS k FROM cut)),
        units AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents
            UNION ALL SELECT doc_id, unit, line FROM blocks WHERE contains(unit, chr(10))),
        g AS (SELECT doc_id, line, {grams} AS a FROM (SELECT doc_id, line, {words.format("unit")} AS w FROM units) WHERE len(w) BETWEEN 2 AND 400),
        s AS (SELECT doc_id, name AS licence, line, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM g, t WHERE 2 * least(len(a), len(b)) >= {licences.THRESHOLD} * (len(a) + len(b)))
        SELECT doc_id, licence, line::BIGINT AS line, round(dice, 9) AS dice FROM s WHERE dice >= {licences.THRESHOLD}
        QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, line) = 1"""


_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "op9_licence_scan": _licence_sql(),
    "op7_quotation_linking": rf"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, {_NORMAL.format("text")} AS norm, (turn + conv_id) % 4 AS kind FROM conversations),
        p AS (SELECT c.*, p1.text AS t1, p2.text AS t2 FROM c
              LEFT JOIN c p1 ON p1.conv_id = c.conv_id AND p1.turn = c.turn - 1 LEFT JOIN c p2 ON p2.conv_id = c.conv_id AND p2.turn = c.turn - 2),
        q AS (SELECT conv_id, turn, unnest(CASE kind WHEN 0 THEN [{{'level': 2, 'spot': 1, 'text': t2}}, {{'level': 1, 'spot': 2, 'text': t1}}]
                  WHEN 1 THEN [{{'level': 1, 'spot': 0, 'text': split_part(t1, chr(10), 1)}}]
                  WHEN 2 THEN [{{'level': 1, 'spot': 0, 'text': split_part(t1, chr(10), -1)}}, {{'level': 1, 'spot': 3, 'text': split_part(t2, chr(10), 1)}}] ELSE [] END, recursive := true) FROM p),
        quoted AS (SELECT *, {_NORMAL.format("text")} AS norm FROM q WHERE regexp_matches(coalesce(text, ''), '\S')),
        o AS (SELECT conv_id, norm, min(turn) AS original FROM c WHERE norm <> '' GROUP BY ALL),
        whole AS (SELECT quoted.*, CASE WHEN original < turn THEN original END AS original FROM quoted LEFT JOIN o USING (conv_id, norm)),
        parts AS (SELECT conv_id, turn, 2 AS kind, unnest(string_split(regexp_replace(text, '^\n+|\s+$', '', 'g'), chr(10))) AS part FROM c
            UNION ALL SELECT conv_id, turn, 1, unnest(regexp_split_to_array(regexp_replace(text, '^\n+|\s+$', '', 'g'), '\n[ \t\r]*\n')) FROM c),
        po AS (SELECT conv_id, kind, {_NORMAL.format("part")} AS norm, min(turn) AS original FROM parts WHERE regexp_matches(part, '\S') GROUP BY ALL),
        w AS (SELECT conv_id, turn, level, spot, 2 AS kind, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS place FROM whole WHERE original IS NULL
            UNION ALL SELECT conv_id, turn, level, spot, 1, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')), unnest(range(len(regexp_split_to_array(text, '\n[ \t\r]*\n')))) FROM whole WHERE original IS NULL),
        l AS (SELECT conv_id, turn, level, spot, 0 AS kind, 0 AS place, original FROM whole WHERE original IS NOT NULL
            UNION ALL SELECT w.conv_id, turn, level, spot, w.kind, place, original FROM w JOIN po ON po.conv_id = w.conv_id AND po.kind = w.kind AND po.norm = {_NORMAL.format("w.part")} WHERE regexp_matches(part, '\S') AND original < turn),
        best AS (SELECT conv_id, turn, original AS parent FROM l QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, spot, kind, place) = 1),
        m AS (SELECT p.conv_id, p.turn, p.role, p.text, p.kind, best.parent, coalesce(s.n, 0) AS n_quotes, coalesce(s.level, 0) AS max_level FROM p LEFT JOIN best USING (conv_id, turn)
              LEFT JOIN (SELECT conv_id, turn, count(*) AS n, max(level) AS level FROM quoted GROUP BY ALL) s USING (conv_id, turn)),
        r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM m WHERE parent IS NULL
              UNION ALL SELECT m.conv_id, m.turn, r.root, r.depth + 1 FROM m JOIN r ON m.conv_id = r.conv_id AND m.parent = r.turn)
        SELECT m.conv_id, m.turn, m.role, md5(regexp_replace(m.text, '^\n+|\s+$', '', 'g')) AS own_md5, m.n_quotes::BIGINT AS n_quotes, m.max_level::BIGINT AS max_level,
               m.parent AS parent_turn, r.root AS root_turn, r.depth::BIGINT AS depth, rank() OVER (PARTITION BY m.conv_id, r.root ORDER BY m.turn)::BIGINT AS position
        FROM m JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AND row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
