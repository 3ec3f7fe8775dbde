"""The queries as registered, on tables with the awkward rows: repeated rows, ids that are null or shared, null texts, further
columns with clashing names, one text of over a million bytes; and on empty tables. Names, types and rows are the contract's."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as cp
from strandloom.llm import registry
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string, start long, item_ids long, component_id long, bin long"
TABLES = {
    "benchmark": "item_id long, text string, doc_id long, n_hit long",
    "labels": "doc_id long, quality int, toxic int, text string",
    "embeddings": "vec_id long, embedding array<float>, score string",
}
TYPES = {
    "op1_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


def texts():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("klmnoprst") for _ in range(r.randrange(2, 8))) for _ in range(3000)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(55)
    secret = " ".join(f"secret={'%06d' % i} {i:024x}" for i in range(300))  # more matches than a stretch of the span walk
    long = prose(110_000) + " " + passage + " " + prose(90_000) + " a.b@c.de"
    return [prose(40), None, "", "two words", prose(12) + " " + passage, passage + " +1 (555) 123-4567", secret, long, prose(300)], passage


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    found, passage = texts()
    extra = ("en", "s", None, "x", 1, 2, 3, 4)
    rows = [(i, t, *extra) for i, t in enumerate(found)]
    rows += [rows[0], rows[0], rows[4], (8, found[0] + " other", *extra), (None, "no id here " + found[8][:400], *extra)]
    folder = str(tmp_path_factory.mktemp("awkward"))
    items = [(1, passage, 9, 9), (None, "two words", 9, 9), (3, None, 9, 9), (1, passage, 9, 9)]
    vectors = [(0, [0.5, 1.0], "x"), (0, [0.5, 1.0], "x"), (50, [-1.0, 0.25], "x"), (7, None, "x"), (8, [1.0, None], "x"), (None, [1.0, 1.0], "x"), (9, [2.0, 2.0], "x")]
    labels = [(i, 0, 0, "x") for i in range(6)] + [(0, 0, 0, "x"), (None, 0, 1, "x")]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    for name, data in (("benchmark", items), ("labels", labels), ("embeddings", vectors)):
        spark.createDataFrame(data, TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder, [r[:2] for r in rows], [x[:2] for x in items]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": DOCS, **TABLES}.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def collected(spark, name, folder, *columns):
    out = registry.QUERIES[name](spark, folder)
    assert {c: t for c, t in out.dtypes if c in TYPES[name]} == TYPES[name]
    return Counter(tuple(r[c] for c in columns) for r in out.collect())


def test_pii_and_secrets(spark, awkward):
    folder, rows, _ = awkward
    assert collected(spark, "op1_pii", folder, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == Counter((i, *brute.pii(t)) for i, t in rows)
    assert collected(spark, "op5_secret_scan", folder, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter((i, *brute.secrets(t)) for i, t in rows)


def test_word_and_byte_repeats(spark, awkward):
    folder, rows, _ = awkward
    want = brute.word_dedup([t for _, t in rows])
    assert collected(spark, "op3_substring_dedup", folder, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    want = brute.byte_dedup([t for _, t in rows])
    assert collected(spark, "op7_suffix_dedup", folder, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_contamination(spark, awkward):
    folder, rows, items = awkward
    want = []
    for (i, t), (n, hit, k, _, bad) in zip(rows, brute.contamination([t for _, t in rows], items), strict=True):
        named = brute.contamination([t], [x for x in items if x[0] is not None])[0][3]
        want.append((i, n, hit, k, named, bad))
    assert collected(spark, "op4_decontamination", folder, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == Counter(want)


def test_token_files(spark, awkward):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    folder, rows, _ = awkward
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = collected(spark, "op8_token_files", folder, "doc_id", "n_tokens", "ids_crc32")
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    assert got == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    ranges = sorted((r["start"], r["n_tokens"]) for r in registry.QUERIES["op8_token_files"](spark, folder).collect())
    assert [s for s, _ in ranges] == [sum(n for _, n in ranges[:k]) for k in range(len(ranges))]


def test_jaccard_join(spark, awkward):
    folder, rows, _ = awkward
    got = collected(spark, "op10_ngram_jaccard_join", folder, "doc_id", "n_shingles")
    assert got == Counter((i, len(brute.shingles(t))) for i, t in rows)


def test_top_k_equals_sql(spark, awkward):
    columns = ("query_id", "rank", "vec_id", "score")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{awkward[0]}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['op9_exact_top_k']})").fetchall()
    assert {q for q, *_ in want} == {0, 50} and collected(spark, "op9_exact_top_k", awkward[0], *columns) == Counter(want)


def test_empty_tables(spark, empty):
    for name in registry.QUERIES:
        assert registry.QUERIES[name](spark, empty).count() == 0, name
    assert cp.run(spark, empty).count() == 0


def test_pipeline_with_awkward_rows(spark, awkward):
    folder, rows, items = awkward
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bad = {t for (_, t), w in zip(rows, brute.contamination([t for _, t in rows], items), strict=True) if w[4]}
    clean = cp.decontamination(spark, docs, folder)
    assert clean.columns == columns and Counter(r["text"] for r in clean.collect()) == Counter(t for _, t in rows if t not in bad)
    apart = cp.near_duplicate_join(spark, docs, folder)
    kept = Counter((r["doc_id"], r["text"]) for r in apart.collect())
    assert apart.columns == columns and set(kept) <= set(rows)
    assert {t for _, t in kept} >= {t for _, t in rows if not brute.shingles(t)} and kept[(0, rows[0][1])] == 1
    packed = cp.run(spark, folder)
    assert not {r["doc_id"] for r in packed.select("doc_id").collect()} & {3, 5, 7}


def test_toxicity_query(spark, awkward):
    out = registry.QUERIES["op2_toxicity"](spark, awkward[0])
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(i for i, _ in awkward[1])
