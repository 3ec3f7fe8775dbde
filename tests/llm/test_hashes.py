"""Hashes of words, windows and bytes on sequences that meet under hashes modulo 2^64, and on very long words."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strandloom.llm import _kernels as k, registry
from tests.llm import brute

P = 2**61 - 1


def thue_morse(n, a="a", b="b"):
    return [b if i.bit_count() % 2 else a for i in range(n)]


@given(st.lists(st.integers(0, P - 1), min_size=1, max_size=20), st.lists(st.integers(0, P - 1), min_size=1, max_size=20))
@settings(deadline=None)
def test_products_in_the_field(a, b):
    n = min(len(a), len(b))
    assert k.times(np.array(a[:n], k.U), np.array(b[:n], k.U)).tolist() == [x * y % P for x, y in zip(a, b, strict=False)]


@pytest.mark.parametrize("n", [64, 128, 512, 1024, 4096, 1 << 15])
def test_thue_morse_stretches(n):
    one, other = (np.array([3 if x == "a" else 900 for x in thue_morse(n, *ab)], k.U) for ab in ("ab", "ba"))
    for which in (0, 1):
        both = k.Rolling(np.concatenate([one, other, one]), which).stretches(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert both[0] == both[2] != both[1]


def test_queries_on_thue_morse(spark, tmp_path):
    tail = " ".join(f"w{i}" for i in range(34))
    rows = []
    for n in (128, 256, 512, 1024, 2048):
        word, unlike = "".join(thue_morse(n)), "".join(thue_morse(n, "b", "a"))
        rows += [f"{word} {tail} {n}", f"{unlike} {tail} {n}", f"{word} one two three {n}", f"{unlike} one two three {n}"]
        rows += [" ".join(thue_morse(n)), " ".join(thue_morse(n, "b", "a")) + " c", word, unlike]
    rows += ["z" * 70_000 + f" {tail}", "z" * 69_999 + f"y {tail}", "z" * 70_000 + f" {tail}"]
    rows = list(enumerate(rows))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name, *columns: Counter(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())
    texts = [t for _, t in rows]
    assert run("op3_substring_dedup", "n_words", "n_removed", "kept_sha256", "doc_id") == Counter((*w, i) for i, w in enumerate(brute.word_dedup(texts)))
    assert run("op10_ngram_jaccard_join", "doc_id", "n_shingles", "component_id") == Counter(brute.components(rows))
    assert run("op7_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256", "doc_id") == Counter((*w, i) for i, w in enumerate(brute.byte_dedup(texts)))
