"""Operators 2 and 6 and the whole pipeline held against their definitions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandloom.llm import packing, toxicity
from tests.llm import brute


# -- best fit --------------------------------------------------------------------------------------------------------
def replay(placed, lengths, sources, clusters, capacity):
    """Follow the placements one by one: each piece goes to a compatible bin of least residual, or to a new bin if none fits."""
    bins = []
    order = sorted(((min(capacity, n - at), i, at // capacity) for i, n in enumerate(lengths) for at in range(0, n, capacity)), key=lambda p: (-p[0], p[1], p[2]))
    assert [(n, i, p) for i, p, _, n, _, _ in placed] == order
    for i, piece, at, n, b, start in placed:
        clash = lambda held, x: x is not None and x in held
        fits = [r for r, s, c in bins if r >= n and not clash(s, sources[i]) and not clash(c, clusters[i])]
        if not fits:
            assert b == len(bins)
            bins.append([capacity, set(), set()])
        room, s, c = bins[b]
        assert at == piece * capacity and start == capacity - room and (not fits or room == min(fits))
        assert not clash(s, sources[i]) and not clash(c, clusters[i])
        bins[b][0] -= n
        s.add(sources[i])
        c.add(clusters[i])


@pytest.mark.parametrize("seed", range(40))
def test_every_piece_goes_to_a_tightest_compatible_bin(seed):
    r = random.Random(seed)
    n = r.randrange(1, 120)
    lengths = [r.randrange(0, r.choice([20, 130])) for _ in range(n)]
    sources = [r.choice(["hot", "hot", "b", "c", None, *"defghij"]) for _ in range(n)]
    clusters = [r.choice([None, 1, 1, *range(2, 40)]) for _ in range(n)]
    replay(packing.pack_shard(lengths, sources, clusters, 50), lengths, sources, clusters, 50)


def test_equal_rows_and_texts_longer_than_a_bin():
    lengths, sources, clusters = [120, 120, 120, 7, 7], ["s", "s", None, None, None], [1, 1, 1, 2, 2]
    replay(packing.pack_shard(lengths, sources, clusters, 50), lengths, sources, clusters, 50)


# -- ordinal regression ----------------------------------------------------------------------------------------------
def loss(w, theta, x, grades, weight, l2, l1):
    """Mean negative log-likelihood of the cumulative-link model, and its penalties, from the formula."""
    score = x @ w
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    up = lambda t: 1 / (1 + np.exp(-np.clip(t - score, -500, 500)))
    chance = np.array([up(edges[g + 1])[i] - up(edges[g])[i] for i, g in enumerate(grades)])
    return -(weight * np.log(np.maximum(chance, 1e-12))).sum() + l2 / 2 * (w @ w) + l1 * np.abs(w).sum()


def test_fit_reaches_the_least_loss_of_a_plain_search():
    r = np.random.default_rng(1)
    grades = np.array([0] * 30 + [1] * 12 + [2] * 12)
    held = lambda g: [k for k in range(6) if r.random() < (0.15 + 0.3 * g if k < 3 else 0.3)]
    rows = [np.array(sorted({100 + k for k in held(g)} | {7}), "<i8") for g in grades]
    l2, l1 = 1e-3, 1e-2
    model = toxicity.fit(rows, grades, l2, l1)
    places = toxicity.telling(rows, grades > 0)
    x = np.array([[p in set(row.tolist()) for p in places] for row in rows], float)
    weight = 1 / (3 * np.bincount(grades)[grades])
    w = np.zeros(len(places))
    w[np.searchsorted(places, model.places)] = model.weights
    found = loss(w, model.thresholds, x, grades, weight, l2, l1)
    # a plain search: coordinate steps that shrink, weights not below zero, thresholds in order
    best, at, step = loss(np.zeros(len(places)), np.array([0.0, 1.0]), x, grades, weight, l2, l1), np.concatenate([np.zeros(len(places)), [0.0, 1.0]]), 0.5
    d = len(places)
    while step > 1e-4:
        moved = False
        for i in range(len(at)):
            for sign in (step, -step):
                trial = at.copy()
                trial[i] += sign
                if (trial[:d] < 0).any() or trial[d] >= trial[d + 1]:
                    continue
                value = loss(trial[:d], trial[d:], x, grades, weight, l2, l1)
                if value < best - 1e-12:
                    best, at, moved = value, trial, True
        step = step if moved else step / 2
    assert found <= best + 1e-3 and len(model.places) > 0


def test_scores_are_the_models_chances(spark):
    model = toxicity.Model(np.array([toxicity._place(b"bad"), toxicity._place(b"^4worse"[:6])], np.int64), np.array([1.5, 0.25]), np.array([1.0, 2.0]))
    texts = ["bad day", "Bad, worse", "worsen bad bad", "", None, "good"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, grade int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, text in enumerate([*texts, texts[0]]):
        score = toxicity.Scorer(model).score(text)
        above = [1 / (1 + np.exp(t - score)) for t in (1.0, 2.0)]
        chances = [1 - above[0], above[0] - above[1], above[1]]
        assert got[i]["expected_severity"] == pytest.approx(sum(above), abs=1e-6) and got[i]["toxic"] == (above[0] >= 0.5)
        assert got[i]["grade"] == int(np.argmax(chances))  # of equal chances the lower grade
    assert got[0] and got[6]["expected_severity"] == got[0]["expected_severity"] and got[5]["expected_severity"] == got[4]["expected_severity"]


# -- the pipeline ----------------------------------------------------------------------------------------------------
def test_run_equals_the_stages_one_by_one(spark, tmp_path):
    r = random.Random(6)
    plain, bad = [f"w{i}" for i in range(400)], ["vilenesse", "scoundrelly", "rottenness", "wretchedly"]
    prose = lambda n: [r.choice(plain) for _ in range(n)]
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        words = prose(r.randrange(30, 70)) + ([r.choice(bad) for _ in range(r.randrange(3, 8))] if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    item = " ".join(prose(14))
    rows += [(200, rows[1][1] + " tail"), (201, rows[1][1]), (202, "x " + item + " y"), (203, "mail me a.b@example.com " + " ".join(prose(20))), (204, None), (205, ""), (206, " ".join(prose(5000)))]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, 0) for i, t in rows]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit_on_labels(docs, spark.read.parquet(f"{d}/labels.parquet")))
    kept = [x for x in rows if scorer.model.probabilities(scorer.score(x[1]))[0] < 0.5]
    gone = {x[0] for x in rows} - {x[0] for x in kept}
    assert len(gone & set(range(0, 160, 4))) > 30 and len(gone - set(range(0, 160, 4))) <= 2
    firsts = {c for _, _, c in brute.components([x[:2] for x in kept])}
    kept = [x for x in kept if x[0] in firsts]
    kept = [x for x, w in zip(kept, brute.contamination([x[1] for x in kept], [(1, item)]), strict=True) if not w[4]]
    assert {201, 202} & {x[0] for x in kept} == set() and {1, 203, 204, 205, 206} <= {x[0] for x in kept}
    words = {i: len((t or "").split()) for i, t, *_ in kept}
    out = cp.run(spark, d).collect()
    assert Counter(x["doc_id"] for x in out if x["piece"] == 0) == Counter(list(words))
    assert all(sum(x["length"] for x in out if x["doc_id"] == i) == n for i, n in words.items() if i != 203)
    source = {x[0]: x[3] for x in kept}
    for shard in {x["shard"] for x in out}:
        own = sorted((x for x in out if x["shard"] == shard and x["bin"] is not None), key=lambda x: (-x["length"], x["doc_id"], x["piece"]))
        ids = sorted({x["doc_id"] for x in own})
        at = {i: k for k, i in enumerate(ids)}
        lengths = [sum(x["length"] for x in own if x["doc_id"] == i) for i in ids]
        placed = [(at[x["doc_id"]], x["piece"], x["piece_start"], x["length"], x["bin"], x["bin_start"]) for x in own]
        replay(placed, lengths, [source[i] for i in ids], list(ids), 2048)
