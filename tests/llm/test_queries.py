"""The registered queries over whole tables: against their SQL, or against a plain version."""

import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codecloom.llm import mixing, packing, queries
from tests.llm.test_operators import DATA, check_mixing, plain_counts, plain_near, plain_substrings

TABLES = ("documents", "labels", "conversations")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n in names if n.startswith("op") and n[2].isdigit()] == list(queries.QUERIES)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    seen, ends = Counter(), {}
    for r in queries.op1_lexical_packing(spark, DATA).orderBy("sequence_id", "offset").collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert max(ends.values()) <= 2048 and max(seen.values()) == 1 and len(seen) == sum(map(len, ids.values()))


def test_op2(spark, texts):
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op2_context_mixing_scores(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))


def test_op3(spark, texts):
    got = rows(queries.op3_difference_cover_dedup(spark, DATA), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(r[:4] for r in plain_substrings(list(texts.items()), 13))


def test_op4(spark, texts):
    got = queries.op4_quality_rules(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        c = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (r.base_failed and r.kept)


def test_op6(spark, texts):
    vocabulary = packing.public_vocabulary()
    got = {r.doc_id: r for r in queries.op6_edit_aware_token_counts(spark, DATA).collect()}
    for i, t in texts.items():
        place, mid = zlib.crc32(str(i).encode()) % (len(t) + 1), len(t) // 2
        new = t[:place] + t[:40] + t[place + 12 :]
        new = new[:mid] + f" edit {i}" + new[mid + 5 :] + "\nEnd."
        assert (got[i].tokens_before, got[i].tokens_after, got[i].n_chars_after) == (len(packing.encode(t, vocabulary)), len(packing.encode(new, vocabulary)), len(new))


def test_op8(spark):
    got = queries.op8_entropy_mixing(spark, DATA).collect()
    rates = mixing.mix_rates(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    check_mixing(rates)
    assert sorted((r.id, r.size, r.source_size, r.target, r.taken) for r in rates) == sorted(map(tuple, got))


def test_op10(spark, texts):
    got = queries.op10_hyperminhash_near_dedup(spark, DATA)
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(plain_near(list(texts.items()), 4, 80))
