"""Range joins, islands and nearest against brute force on random intervals, with the boundary rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals as I, islands as M, nearest as N

BOUNDARY = [("1", 0, 10), ("1", 10, 20), ("1", 19, 30), ("1", 12, 15), ("1", 12, 15), ("1", 0, 900), ("2", 5, 6), ("chr2", 5, 6)]


def rows(seed, n=60):
    r = random.Random(seed)
    return BOUNDARY + [(r.choice("123"), s := r.randrange(0, 500), s + r.randrange(1, 60)) for _ in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(c, s, e, i) for i, (c, s, e) in enumerate(data)], "chrom string, start long, end long, id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_matches_brute_force(spark, seed):
    a, b = rows(seed), rows(seed + 10, 40)
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    got = I.overlap_join(frame(spark, a), frame(spark, b), width=16)
    assert sorted((r["id"], r["b_id"], r["overlap"]) for r in got.collect()) == want
    hit = {i for i, _, _ in want}
    assert {r["id"] for r in I.overlap_semi(frame(spark, a), frame(spark, b), 16).collect()} == hit
    assert {r["id"] for r in I.overlap_anti(frame(spark, a), frame(spark, b), 16).collect()} == set(range(len(a))) - hit


def test_left_overlap_keeps_equal_rows_and_zero_fills(spark):
    a = spark.createDataFrame([("1", 0, 10), ("1", 0, 10), ("9", 1, 2)], "chrom string, start long, end long")
    b = spark.createDataFrame([("1", 9, 11)], "chrom string, start long, end long")
    got = sorted((r["chrom"], r["b_start"], r["overlap"]) for r in I.overlap_join(a, b, "left").collect())
    assert got == [("1", 9, 1), ("1", 9, 1), ("9", 0, 0)]


def test_overlap_with_an_empty_side(spark):
    a, none = frame(spark, BOUNDARY), frame(spark, [])
    assert I.overlap_join(a, none).count() == 0
    assert I.overlap_anti(a, none).count() == len(BOUNDARY)
    assert M.merge(none).count() == 0


@pytest.mark.parametrize("gap", [0, -1, 7])
def test_merge_over_block_borders(spark, gap):
    data = rows(5, 80)
    want = []
    for chrom in sorted({r[0] for r in data}):
        reach = None
        for _, s, e in sorted(r for r in data if r[0] == chrom):
            if reach is None or s > reach + gap:
                want.append([chrom, s, e])
                reach = e
            reach = max(reach, e)
            want[-1][2] = max(want[-1][2], e)
    got = M.merge(frame(spark, data), gap, block=50)
    assert sorted((r["chrom"], r["start"], r["end"]) for r in got.collect()) == sorted(map(tuple, want))


def test_adjacency_rules_differ(spark):
    data = [("1", 0, 10, 1.0), ("1", 10, 20, 3.0), ("1", 20, 30, None), ("1", 31, 40, 5.0)]
    df = spark.createDataFrame(data, "chrom string, start long, end long, s double")
    booked = {(r["start"], r["end"], r["s"]) for r in M.merge_bookended_weighted(df, ["s"], block=15).collect()}
    assert booked == {(0, 30, 2.0), (31, 40, 5.0)}
    assert M.merge(df, -1).count() == 4
    assert M.merge(df, 0).count() == 2


def test_cluster_positions_and_loci(spark):
    p = spark.createDataFrame([("4", x, float(i)) for i, x in enumerate([100, 10_100, 20_101, 50_000])], "chrom string, pos long, support double")
    got = {r["region"]: (r["n"], r["span"]) for r in M.cluster_positions(p, 10_000, block=15_000).collect()}
    assert got == {"4_100_10100": (2, 10_000), "4_20101_20101": (1, 0), "4_50000_50000": (1, 0)}
    # a gap is taken to the previous row's end, not to the furthest end so far
    loci = spark.createDataFrame([("1", 0, 100, 1.0, ["A"]), ("1", 10, 20, 2.0, ["B"]), ("1", 90, 95, 4.0, ["A"])], "chrom string, start long, end long, score double, genes array<string>")
    got = sorted((r["D"], r["start"], r["end"], r["genes"]) for r in M.merge_loci(loci, [50, 80], block=30).collect())
    assert got == [(50, 0, 100, ["A", "B"]), (50, 90, 95, ["A"]), (80, 0, 100, ["A", "B"])]


def test_nearest_matches_brute_force(spark):
    a, b = rows(7, 30), [r for r in rows(8, 20) if r[0] != "chr2"]
    want = set()
    for i, (c, s, e) in enumerate(a):
        found = [(0 if s < y[2] and y[1] < e else s - y[2] + 1 if y[2] <= s else y[1] - e + 1, j) for j, y in enumerate(b) if y[0] == c]
        want |= {(i, j, d) for d, j in found if d == min(found)[0]}
    got = N.nearest(frame(spark, a), frame(spark, b), width=16, block=64)
    assert {(r["id"], r["b_id"], r["distance"]) for r in got.collect()} == want
    first = N.nearest(frame(spark, a), frame(spark, b), "first", width=16, block=64)
    least = {i: min((b[j][1], b[j][2], j) for k, j, _ in want if k == i)[2] for i in {w[0] for w in want}}
    assert sorted((r["id"], r["b_id"]) for r in first.collect()) == sorted((i, j) for i, j in least.items())
    near = N.nearest(frame(spark, a), frame(spark, b), "first", 5, block=64)
    assert {(r["id"], r["b_id"], r["distance"]) for r in near.collect()} == {w for w in want if w[2] <= 5 and least[w[0]] == w[1]}
    touching = N.nearest(frame(spark, [("1", 0, 10)]), frame(spark, [("1", 10, 20)])).first()
    assert touching["distance"] == 1


def test_nearest_k(spark):
    pool = spark.createDataFrame([("1", x) for x in (10, 20, 30, 40, 1000)], "chrom string, pos long")
    asks = spark.createDataFrame([(1, "1", 25, 3), (2, "1", 2000, 9)], "anchor int, chrom string, pos long, k int")
    got = {}
    for r in N.nearest_k(asks, pool, block=16).collect():
        got.setdefault(r["anchor"], []).append((r["rank"], r["near_pos"]))
    assert sorted(got[1]) == [(1, 20), (2, 30), (3, 10)]
    assert len(got[2]) == 5


def test_regions_masks_and_spans(spark):
    points = spark.createDataFrame([("1", 5), ("1", 10), ("1", 11), ("2", 5)], "chrom string, pos long")
    regions = spark.createDataFrame([("1", 5, 10, "a"), ("1", 8, 20, "b")], "chrom string, start long, end long, region string")
    assert {(r["chrom"], r["pos"]): r["region"] for r in I.assign_region(points, regions).collect()} == {("1", 5): "a", ("1", 10): "a", ("1", 11): "b", ("2", 5): None}
    masks = spark.createDataFrame([("1", 0, "0223"), ("1", 4, "3301"), ("1", 8, "2")], "chrom string, offset long, mask string")
    assert sorted((r["start"], r["end"]) for r in M.mask_runs(masks).collect()) == [(1, 6), (8, 9)]
    tx = spark.createDataFrame([("1", 0, 100, "A", True), ("1", 90, 300, "A", False), ("1", 200, 260, "B", True)], "chrom string, start long, end long, gene string, canon boolean")
    assert {(r["gene"], r["start"], r["end"]) for r in I.clean_gene_spans(tx).collect()} == {("A", 0, 100), ("B", 200, 260)}


def test_interval_mean_and_snap(spark):
    track = spark.createDataFrame([("1", 0, 10, 1.0), ("1", 10, 20, 3.0)], "chrom string, start long, end long, value double")
    asks = spark.createDataFrame([("1", 5, 20), ("1", 50, 60)], "chrom string, start long, end long")
    assert {r["start"]: round(r["mean"], 6) for r in I.interval_mean(asks, track).collect()} == {5: round((5 + 30) / 15, 6), 50: 0.0}
    grid = spark.createDataFrame([("1", 2000, 7)], "chrom string, start long, value long")
    snapped = I.snap_lookup(spark.createDataFrame([("1", 2500, 1), ("1", 1500, 2), ("1", 2501, 3)], "chrom string, start long, id int"), grid)
    assert {r["id"]: r["value"] for r in snapped.collect()} == {1: 7, 2: 7, 3: None}  # halves go to the even thousand


def test_thinning_keeps_protected(spark):
    df = spark.createDataFrame([("1", p, p in (100, 110)) for p in (0, 10, 25, 100, 105, 110, 131, 20_000)], "chrom string, pos long, protected boolean")
    assert sorted(r["pos"] for r in M.thin_markers(df).select("pos").collect()) == [0, 25, 100, 110, 131]


@pytest.mark.parametrize(("seed", "block", "gap"), [(0, 7, 20), (1, 31, 20), (2, 5, 3), (3, 1000, 9), (4, 60, 1)])
def test_thinning_by_blocks_equals_the_scan(spark, seed, block, gap):
    r = random.Random(seed)
    rows = [(r.choice(["1", "2", "none"]), r.randrange(400), i) for i in range(300)] + [("1", None, 900), (None, 3, 901), ("4", 20_000, 902), ("5", 10_000, 903)]
    rows = [(c, p, i, r.choice([True, False, False, None]) if c in ("1", "2") and r.random() < 0.2 else False) for c, p, i in rows]
    want, tail = [], 30
    for chrom in {c for c, *_ in rows if c}:
        own = sorted((p, i, bool(f)) for c, p, i, f in rows if c == chrom and p is not None)
        held = {p for p, _, f in own if f}
        end, kept = max(held, default=0) + tail, None
        for p, i, _ in own:
            if p in held or (p <= end and (kept is None or p - kept >= gap)):
                want.append(i)
                kept = p
    df = spark.createDataFrame(rows, "chrom string, pos long, id long, protected boolean").repartition(3)
    got = M.thin_markers(df.select("chrom", "pos", "id", "protected"), tail=tail, gap=gap, block=block)
    assert got.columns == ["chrom", "pos", "id", "protected"] and sorted(x["id"] for x in got.collect()) == sorted(want)


def test_callable_between(spark):
    sites = spark.createDataFrame([("1", 6), ("1", 9), ("1", 25), ("1", 40)], "chrom string, pos long")
    mask = spark.createDataFrame([("1", 0, 10), ("1", 20, 30)], "chrom string, start long, end long")
    got = {r["pos"]: r["callable_bp"] for r in M.callable_between(sites, [mask], block=12).collect()}
    assert got == {6: 6, 9: 3, 25: 6}


def test_overlapping_pairs_of_nearest_are_not_shuffled(spark):
    a, b = ([("1", i, i + 200) for i in range(0, 200, 2)] + [("1", 5000 + 10 * i, 5004 + 10 * i) for i in range(k)] for k in (5, 2))
    got = N.nearest(frame(spark, a), frame(spark, b), width=64, block=256)
    assert got.count() == 100 * 100 + 2 + 3 and got.where("distance = 0").count() == 100 * 100 + 2
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    last = max(i for i, x in enumerate(lines) if x.startswith("   +- "))
    pairs = lines[last : next(i for i in range(last, len(lines)) if "Join" in lines[i])]
    assert "Union" in lines[1] and not any("Exchange" in x for x in pairs)
