"""Queries over the driver tables, each with DuckDB SQL for the same rows. The projections to points, intervals, sites and gene
sets are integer and deterministic, so both engines agree exactly; doubles are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandloom.functions import draws as D, scalars as S
from strandloom.operators import bins as B, enrichment as E, genes as G, genotypes as GT, intervals as I, islands as M, nearest as N, remap as R, sites as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The driver points are seconds of one month; a block of the carry is two days of them.
BLOCK = 172_800


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            head, rest = ("WITH RECURSIVE", body[14:]) if body.startswith("WITH RECURSIVE") else ("WITH", body[4:] if body.startswith("WITH") else None)
            ORACLES[f.__name__] = f"{head} pts AS ({PTS}), iv AS ({IV})" + (f" {body}" if rest is None else f", {rest}")
        return f

    return add


PTS = "SELECT event_id, event_type, value, (user_id % 20)::VARCHAR AS chrom, epoch_us(ts) // 1000000 AS pos FROM events"
IV = 'SELECT event_id, event_type, value, chrom, pos AS start, pos + 600 + event_id % 3600 AS "end" FROM pts'


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return _t(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 20).cast("string").alias("chrom"), seconds.alias("pos"))


def intervals(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    out = points(spark, d).select("event_id", "event_type", "value", "chrom", F.col("pos").alias("start"), (F.col("pos") + 600 + F.col("event_id") % 3600).alias("end"))
    return out.where(F.col("event_type") == kind).drop("event_type") if kind else out


def r6(c, name: str | None = None):
    out = F.round(c, 6)
    return out.alias(name) if name else out


# -- windows, merging, overlap, bins: the flagship ---------------------------------------------------------------------
def _windows(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(F.col("pos") / 3600) * 3600
    return points(spark, d).select("chrom", hour.alias("start"), (hour + 3600).alias("end"), "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))


@query("""
WITH w AS (SELECT chrom, pos // 3600 * 3600 AS start, sum(round(value * 100)::BIGINT) AS t FROM pts GROUP BY ALL HAVING t > 10000),
k AS (SELECT *, start > lag(start) OVER (PARTITION BY chrom ORDER BY start) + 3600 OR lag(start) OVER (PARTITION BY chrom ORDER BY start) IS NULL AS fresh FROM w),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY chrom ORDER BY start) AS g FROM k),
m AS (SELECT chrom, min(start) AS s, max(start) + 3600 AS e FROM i GROUP BY chrom, g),
ov AS (SELECT m.chrom, greatest(m.s, iv.start) AS s, least(m.e, iv."end") AS e, iv.value FROM m JOIN iv ON m.chrom = iv.chrom AND m.s < iv."end" AND iv.start < m.e WHERE iv.event_type = 'view'),
q AS (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM iv WHERE event_type = 'view'),
nb AS (SELECT CASE WHEN value < edges[2] THEN 1 WHEN value < edges[3] THEN 2 WHEN value < edges[4] THEN 3 ELSE 4 END AS bin, sum(e - s) AS num_len FROM ov, q GROUP BY ALL),
db AS (SELECT CASE WHEN value < edges[2] THEN 1 WHEN value < edges[3] THEN 2 WHEN value < edges[4] THEN 3 ELSE 4 END AS bin, sum("end" - start) AS den_len, count(*) AS den_n FROM iv, q WHERE event_type = 'view' GROUP BY ALL)
SELECT bin, coalesce(num_len, 0)::BIGINT AS num_len, den_len::BIGINT AS den_len, den_n::BIGINT AS den_n, round(coalesce(num_len, 0) / den_len, 6) AS frac, round(sqrt(coalesce(num_len, 0) / den_len * (1 - coalesce(num_len, 0) / den_len) / den_n), 6) AS se FROM db LEFT JOIN nb USING (bin)
""")
def window_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Sum windows over individuals, keep the high ones, merge, overlap with a second set, fraction by quantile bin."""
    w = _windows(spark, d)
    high = w.groupBy("chrom", "start", "end").agg(F.sum("v").alias("t")).where("t > 10000")
    merged = M.merge(high, 0, block=BLOCK)
    views = intervals(spark, d, "view")
    edges = B.quantile_edges(views, "value", 4)
    inter = I.overlap_join(views, merged.select("chrom", "start", "end"), "intersection", width=3600)
    tag = lambda df: df.crossJoin(F.broadcast(edges)).withColumn("bin", B.assign_bin(F.col("value"), F.col("edges")).cast("int"))
    out = B.bin_fractions(tag(inter), tag(views), F.col("end") - F.col("start"))
    return out.select("bin", "num_len", "den_len", "den_n", r6("frac", "frac"), r6("se", "se"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return window_fractions(spark, d)


@query("SELECT chrom, pos // 3600 * 3600 AS start, pos // 3600 * 3600 + 3600 AS \"end\", round(sum(round(value * 100)::BIGINT) / 100, 6) AS total FROM pts GROUP BY ALL HAVING sum(round(value * 100)::BIGINT) > 5000")
def sum_windows(spark, d):
    hour = F.floor(F.col("pos") / 3600) * 3600
    parts = [points(spark, d).where(F.col("event_type") == t).select("chrom", hour.alias("start"), (hour + 3600).alias("end"), F.col("value").alias("posterior")) for t in ("view", "click", "purchase", "error", "signup")]
    return B.sum_windows(parts, 50, scale=100).withColumn("total", r6("total"))


_ISLANDS = """
WITH r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum((reach IS NULL OR start > reach + {gap})::INT) OVER (PARTITION BY chrom ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY chrom, g
"""


@query(_ISLANDS.format(gap=0))
def merge_touching(spark, d):
    return M.merge(intervals(spark, d), 0, block=BLOCK)


@query(_ISLANDS.format(gap=-1))
def merge_overlapping(spark, d):
    return M.merge(intervals(spark, d), -1, block=BLOCK)


@query("""
WITH w AS (SELECT chrom, pos // 3600 * 3600 AS start, pos // 3600 * 3600 + 3600 AS "end", avg(value) AS score FROM pts GROUP BY ALL),
i AS (SELECT *, sum((lag_end IS NULL OR lag_end <> start)::INT) OVER (PARTITION BY chrom ORDER BY start) AS g FROM (SELECT *, lag("end") OVER (PARTITION BY chrom ORDER BY start) AS lag_end FROM w))
SELECT chrom, min(start) AS start, max("end") AS "end", round(sum(score * ("end" - start)) / sum("end" - start), 6) AS score FROM i GROUP BY chrom, g
""")
def merge_bookended(spark, d):
    hour = F.floor(F.col("pos") / 3600) * 3600
    w = points(spark, d).groupBy("chrom", hour.alias("start")).agg(F.avg("value").alias("score")).withColumn("end", F.col("start") + 3600)
    return M.merge_bookended_weighted(w, ["score"], block=BLOCK).withColumn("score", r6("score"))


@query("""
WITH s AS (SELECT chrom, greatest(1, pos - 1800) AS start, pos + 1800 AS "end" FROM pts WHERE event_type = 'error'),
r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY chrom, g
""")
def padded_windows(spark, d):
    return M.windows_around(points(spark, d).where("event_type = 'error'"), 1800, block=BLOCK)


@query("""
WITH p AS (SELECT chrom, pos, value, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS prev FROM pts WHERE event_type = 'purchase'),
i AS (SELECT *, sum((prev IS NULL OR pos - prev > 10000)::INT) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT chrom, min(pos) AS start, max(pos) AS "end", count(*) AS n, min(value) AS min_value, max(value) AS max_value, max(pos) - min(pos) AS span, chrom || '_' || min(pos) || '_' || max(pos) AS region FROM i GROUP BY chrom, g
""")
def cluster_positions(spark, d):
    return M.cluster_positions(points(spark, d).where("event_type = 'purchase'"), 10_000, "value", block=BLOCK)


@query("""
WITH s AS (SELECT d AS D, chrom, start, "end", value, event_type, lag("end") OVER (PARTITION BY d, chrom ORDER BY start, "end") AS prev FROM iv, (VALUES (0), (1000), (5000)) t(d)),
i AS (SELECT *, sum((prev IS NULL OR start - prev > D)::INT) OVER (PARTITION BY D, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT D, chrom, min(start) AS start, max("end") AS "end", count(*) AS n, round(sum(value * ("end" - start)) / sum("end" - start), 6) AS score, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS genes FROM i GROUP BY D, chrom, g
""")
def merge_loci(spark, d):
    rows = intervals(spark, d).select("chrom", "start", "end", F.col("value").alias("score"), F.array("event_type").alias("genes"))
    return M.merge_loci(rows, [0, 1000, 5000], block=BLOCK).withColumn("score", r6("score")).withColumn("genes", F.array_join("genes", ","))


@query("""
WITH w AS (SELECT DISTINCT chrom, pos // 1800 * 1800 AS start, pos // 1800 * 1800 + 1800 AS "end" FROM pts),
i AS (SELECT *, sum((lag_end IS NULL OR lag_end <> start)::INT) OVER (PARTITION BY chrom ORDER BY start) AS run FROM (SELECT *, lag("end") OVER (PARTITION BY chrom ORDER BY start) AS lag_end FROM w))
SELECT chrom, start, "end", run::BIGINT AS run, min(start) OVER (PARTITION BY chrom, run) AS run_start, max("end") OVER (PARTITION BY chrom, run) AS run_end FROM i
""")
def adjacency_runs(spark, d):
    start = F.floor(F.col("pos") / 1800) * 1800
    w = points(spark, d).select("chrom", start.alias("start"), (start + 1800).alias("end")).distinct()
    return M.adjacency_runs(w, block=BLOCK)


_MERGED = """r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE event_type IN ('view', 'click')),
i AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY chrom ORDER BY start, "end", event_id ROWS UNBOUNDED PRECEDING) AS g FROM r),
m AS (SELECT chrom, min(start) AS s, max("end") AS e FROM i GROUP BY chrom, g)"""


@query(f"""
WITH {_MERGED},
b AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY chrom ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
k AS (SELECT p.chrom, p.pos, before + p.pos - b.s AS c FROM (SELECT DISTINCT chrom, pos FROM pts WHERE event_type = 'error') p JOIN b ON p.chrom = b.chrom AND p.pos - 1 >= b.s AND p.pos <= b.e)
SELECT chrom, pos, (c - coalesce(lag(c) OVER (PARTITION BY chrom ORDER BY pos), 0))::BIGINT AS callable_bp FROM k
""")
def callable_between(spark, d):
    sites = points(spark, d).where("event_type = 'error'").select("chrom", "pos").distinct()
    mask = intervals(spark, d).where("event_type in ('view', 'click')")
    return M.callable_between(sites, [M.merge(mask, 0, block=BLOCK)], block=BLOCK)


# -- range joins ------------------------------------------------------------------------------------------------------
_AB = """a AS (SELECT * FROM iv WHERE event_type = 'view'), b AS (SELECT * FROM iv WHERE event_type = 'purchase'),
o AS (SELECT a.chrom, a.event_id, a.start, a."end", b.event_id AS b_event_id, b.start AS b_start, b."end" AS b_end, least(a."end", b."end") - greatest(a.start, b.start) AS overlap FROM a JOIN b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end")"""


def _ab(spark, d):
    return intervals(spark, d, "view").drop("value"), intervals(spark, d, "purchase").drop("value")


@query(f"WITH {_AB} SELECT * FROM o")
def overlap_pairs(spark, d):
    return I.overlap_join(*_ab(spark, d), width=4096)


@query(f'WITH {_AB} SELECT chrom, greatest(start, b_start) AS start, least("end", b_end) AS "end", event_id FROM o')
def overlap_intersection(spark, d):
    return I.overlap_join(*_ab(spark, d), "intersection", width=4096)


@query(f"""WITH {_AB}, f AS (SELECT * FROM o WHERE overlap >= 0.3 * ("end" - start) AND overlap >= 0.3 * (b_end - b_start))
SELECT a.chrom, a.event_id, a.start, a."end", f.b_event_id, coalesce(f.b_start, 0) AS b_start, coalesce(f.b_end, 0) AS b_end, coalesce(f.overlap, 0) AS overlap FROM a LEFT JOIN f USING (event_id)""")
def overlap_left_reciprocal(spark, d):
    return I.overlap_join(*_ab(spark, d), "left", min_frac=0.3, reciprocal=True, width=4096)


@query(f'WITH {_AB} SELECT chrom, event_id, start, "end" FROM a WHERE event_id IN (SELECT event_id FROM o)')
def overlap_semi(spark, d):
    return I.overlap_semi(*_ab(spark, d), width=4096)


@query(f'WITH {_AB} SELECT chrom, event_id, start, "end" FROM a WHERE event_id NOT IN (SELECT event_id FROM o)')
def overlap_anti(spark, d):
    return I.overlap_anti(*_ab(spark, d), width=4096)


@query(f"WITH {_AB} SELECT (SELECT count(*) FROM a) AS n, (SELECT count(DISTINCT event_id) FROM o) AS n_overlapping")
def overlap_count(spark, d):
    return I.count_overlapping(*_ab(spark, d), width=4096)


@query("""WITH h AS (SELECT p.event_id, arg_min(v.value, (v.start, v."end", v.value)) AS score FROM pts p JOIN iv v ON p.chrom = v.chrom AND p.pos - 1 < v."end" AND v.start < p.pos WHERE p.event_type = 'error' AND v.event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.chrom, p.pos, h.score FROM pts p LEFT JOIN h USING (event_id) WHERE p.event_type = 'error'""")
def annotate_from_intervals(spark, d):
    sites = points(spark, d).where("event_type = 'error'").select("event_id", "chrom", "pos")
    return I.annotate_from_intervals(sites, intervals(spark, d, "view").withColumnRenamed("value", "score"), ["score"], width=4096)


@query("""WITH g AS (SELECT chrom, pos // 1000 * 1000 AS cell, max(value) AS value FROM pts WHERE event_type = 'view' GROUP BY ALL)
SELECT i.event_id, i.chrom, i.start, i."end", g.value FROM iv i LEFT JOIN g ON i.chrom = g.chrom AND g.cell = (round_even(i.start / 1000, 0) * 1000)::BIGINT WHERE i.event_type = 'click'""")
def snap_lookup(spark, d):
    grid = points(spark, d).where("event_type = 'view'").groupBy("chrom", (F.floor(F.col("pos") / 1000) * 1000).alias("start")).agg(F.max("value").alias("value"))
    return I.snap_lookup(intervals(spark, d, "click").drop("value"), grid)


_REGIONS = "g AS (SELECT DISTINCT chrom, pos // 50000 * 50000 AS start, pos // 50000 * 50000 + 20000 AS \"end\", chrom || '_' || (pos // 50000 * 50000) AS region FROM pts)"


def _regions(spark, d):
    start = F.floor(F.col("pos") / 50000) * 50000
    return points(spark, d).select("chrom", start.alias("start"), (start + 20000).alias("end"), F.concat_ws("_", "chrom", start).alias("region")).distinct()


@query(f'WITH {_REGIONS} SELECT p.event_id, p.chrom, p.pos, g.region FROM pts p LEFT JOIN g ON p.chrom = g.chrom AND p.pos BETWEEN g.start AND g."end"')
def assign_region(spark, d):
    return I.assign_region(points(spark, d).select("event_id", "chrom", "pos"), _regions(spark, d), width=20_000)


@query(f"""WITH {_REGIONS} SELECT g.chrom, g.start, g."end", g.region, string_agg(DISTINCT v.event_type, '; ' ORDER BY v.event_type) AS sets, string_agg(DISTINCT 'e' || v.event_id % 7, '; ' ORDER BY 'e' || v.event_id % 7) AS names
FROM g LEFT JOIN iv v ON g.chrom = v.chrom AND v.start <= g."end" AND v."end" >= g.start GROUP BY ALL""")
def tag_overlaps(spark, d):
    sets = intervals(spark, d).select("chrom", "start", "end", F.col("event_type").alias("set"), F.concat(F.lit("e"), F.col("event_id") % 7).alias("name"))
    return I.tag_overlaps(_regions(spark, d), sets, width=20_000)


@query("""WITH t AS (SELECT chrom, start, "end", event_type AS gene, event_id % 3 = 0 AS canon FROM iv), h AS (SELECT DISTINCT a.chrom, a.start, a."end", a.gene FROM t a JOIN t b ON a.chrom = b.chrom AND b.canon AND a.gene <> b.gene AND a.start < b."end" AND b.start < a."end"),
c AS (SELECT t.* FROM t ANTI JOIN h USING (chrom, start, "end", gene))
SELECT chrom, gene, coalesce(min(c.start), min(k.start), min(t.start)) AS start, coalesce(max(c."end"), max(k."end"), max(t."end")) AS "end" FROM t LEFT JOIN (SELECT chrom, gene, min(start) AS start, max("end") AS "end" FROM c GROUP BY ALL) c USING (chrom, gene) LEFT JOIN (SELECT chrom, gene, min(start) AS start, max("end") AS "end" FROM t WHERE canon GROUP BY ALL) k USING (chrom, gene) GROUP BY chrom, gene""")
def clean_gene_spans(spark, d):
    t = intervals(spark, d).select("chrom", "start", "end", F.col("event_type").alias("gene"), (F.col("event_id") % 3 == 0).alias("canon"))
    return I.clean_gene_spans(t, width=4096).select("chrom", "gene", "start", "end")


_NEAR = """a AS (SELECT event_id, chrom, start, "end" FROM iv WHERE event_type = 'error'), b AS (SELECT event_id AS b_event_id, chrom, start AS b_start, "end" AS b_end FROM iv WHERE event_type = 'signup'),
x AS (SELECT a.*, b.* EXCLUDE (chrom), CASE WHEN a.start < b_end AND b_start < a."end" THEN 0 WHEN b_end <= a.start THEN a.start - b_end + 1 ELSE b_start - a."end" + 1 END AS distance FROM a JOIN b ON a.chrom = b.chrom),
k AS (SELECT *, min(distance) OVER (PARTITION BY event_id) AS least FROM x)"""


@query(f"WITH {_NEAR} SELECT * EXCLUDE (least) FROM k WHERE distance = least")
def nearest_all(spark, d):
    return N.nearest(intervals(spark, d, "error").drop("value"), intervals(spark, d, "signup").drop("value"), width=4096, block=BLOCK)


@query(f"WITH {_NEAR} SELECT * EXCLUDE (least) FROM k WHERE distance = least AND distance <= 2000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY b_start, b_end, b_event_id) = 1")
def nearest_first_capped(spark, d):
    return N.nearest(intervals(spark, d, "error").drop("value"), intervals(spark, d, "signup").drop("value"), "first", 2000, 4096, BLOCK)


@query("""WITH x AS (SELECT a.event_id, a.chrom, a.pos, b.pos AS near_pos, abs(a.pos - b.pos) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.pos - b.pos), b.pos) AS rank FROM pts a JOIN (SELECT DISTINCT chrom, pos FROM pts WHERE event_type = 'view') b ON a.chrom = b.chrom WHERE a.event_type = 'purchase')
SELECT event_id, chrom, pos, near_pos, distance, rank::INTEGER AS rank FROM x WHERE rank <= 3""")
def nearest_k(spark, d):
    anchors = points(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("anchor"), "chrom", "pos", F.lit(3).alias("k"))
    pool = points(spark, d).where("event_type = 'view'").select("chrom", "pos").distinct()
    return N.nearest_k(anchors, pool, block=BLOCK).select(F.col("anchor").alias("event_id"), "chrom", "pos", "near_pos", "distance", "rank")


@query("""WITH z AS (SELECT chrom, max("end") AS length FROM iv GROUP BY chrom) SELECT event_id, chrom, greatest(0, start - 5000) AS start, least(length, "end" + 5000) AS "end" FROM iv JOIN z USING (chrom)""")
def slop(spark, d):
    rows = intervals(spark, d).select("event_id", "chrom", "start", "end")
    return I.slop(rows, rows.groupBy("chrom").agg(F.max("end").alias("length")), 5000)


@query("""WITH a AS (SELECT * FROM iv WHERE event_type = 'error'), t AS (SELECT chrom, pos // 600 * 600 AS s, sum(round(value * 100)::BIGINT) AS v FROM pts WHERE event_type <> 'error' GROUP BY ALL),
o AS (SELECT event_id, sum(v * (least("end", s + 600) - greatest(start, s))) / sum(least("end", s + 600) - greatest(start, s)) AS mean FROM a JOIN t ON a.chrom = t.chrom AND a.start < s + 600 AND s < a."end" GROUP BY ALL)
SELECT a.event_id, a.chrom, a.start, a."end", round(coalesce(mean, 0), 6) AS mean FROM a LEFT JOIN o USING (event_id)""")
def interval_mean(spark, d):
    cell = F.floor(F.col("pos") / 600) * 600
    track = points(spark, d).where("event_type <> 'error'").groupBy("chrom", cell.alias("start")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("value")).withColumn("end", F.col("start") + 600)
    return I.interval_mean(intervals(spark, d, "error").drop("value"), track, width=4096).withColumn("mean", r6("mean"))


# -- coordinates ----------------------------------------------------------------------------------------------------
_BLOCKS = "bl AS (SELECT DISTINCT chrom, pos // 7200 * 7200 AS s, pos // 7200 * 7200 + 5000 AS e, 't' || chrom AS tc, pos // 7200 * 8000 AS ts, CASE WHEN (pos // 7200) % 2 = 0 THEN '+' ELSE '-' END AS st FROM pts WHERE event_type IN ('view', 'click'))"


def _blocks(spark, d):
    k = F.floor(F.col("pos") / 7200)
    p = points(spark, d).where("event_type in ('view', 'click')")
    return p.select("chrom", (k * 7200).alias("start"), (k * 7200 + 5000).alias("end"), F.concat(F.lit("t"), "chrom").alias("t_chrom"), (k * 8000).alias("t_start"), (k * 8000 + 5000).alias("t_end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand")).distinct()


@query(f"""WITH {_BLOCKS} SELECT p.event_id, tc AS chrom, CASE WHEN st = '+' THEN ts + p.pos - s ELSE ts + 5000 - (p.pos - 1 - s) END AS pos, CASE WHEN st = '+' THEN 'A' ELSE 'T' END AS ref, CASE WHEN st = '+' THEN 'G' ELSE 'C' END AS alt, p.chrom AS src_chrom, p.pos AS src_pos
FROM pts p JOIN bl ON p.chrom = bl.chrom AND p.pos - 1 >= s AND p.pos - 1 < e WHERE event_type = 'error'""")
def lift_points(spark, d):
    sites = points(spark, d).where("event_type = 'error'").select("event_id", "chrom", "pos", F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    return R.lift_points(sites, _blocks(spark, d), width=7200)[0]


@query(f"""WITH {_BLOCKS}, a AS (SELECT event_id, chrom, start, "end" FROM iv WHERE event_type = 'error'),
h AS (SELECT event_id, tc, st, least("end", e) - greatest(start, s) AS bp, CASE WHEN st = '+' THEN ts + greatest(start, s) - s ELSE ts + 5000 - (least("end", e) - s) END AS x FROM a JOIN bl ON a.chrom = bl.chrom AND start < e AND s < "end"),
p AS (SELECT event_id, tc, st, sum(bp) AS bp, min(x) AS lo, max(x + bp) AS hi FROM h GROUP BY ALL), o AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY event_id) = 1)
SELECT event_id, tc AS chrom, lo AS start, hi AS "end", st AS strand, a.chrom AS src_chrom, a.start AS src_start, a."end" AS src_end FROM a JOIN o USING (event_id) WHERE bp >= 0.5 * (a."end" - a.start)""")
def lift_intervals(spark, d):
    return R.lift_intervals(intervals(spark, d, "error").drop("value"), _blocks(spark, d), 0.5, width=7200)[0]


@query("""WITH m AS (SELECT chrom, pos // 86400 * 86400 AS x, sum(count(*)) OVER (PARTITION BY chrom ORDER BY pos // 86400 * 86400) AS cm FROM pts GROUP BY chrom, pos // 86400 * 86400),
p AS (SELECT event_id, chrom, pos FROM pts WHERE event_type = 'purchase'),
lo AS (SELECT event_id, max(x) AS a, arg_max(cm, x) AS c FROM p JOIN m ON p.chrom = m.chrom AND x <= pos GROUP BY ALL), hi AS (SELECT event_id, min(x) AS a, arg_min(cm, x) AS c FROM p JOIN m ON p.chrom = m.chrom AND x >= pos GROUP BY ALL)
SELECT p.event_id, p.chrom, p.pos, round(CASE WHEN lo.a IS NULL THEN hi.c WHEN hi.a IS NULL OR lo.a = hi.a THEN lo.c ELSE lo.c + (p.pos - lo.a) / (hi.a - lo.a) * (hi.c - lo.c) END, 6) AS cm FROM p LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id)""")
def interpolate_map(spark, d):
    day = F.floor(F.col("pos") / 86400) * 86400
    counts = points(spark, d).groupBy("chrom", day.alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    gmap = counts.select("chrom", "pos", F.sum("n").over(Window.partitionBy("chrom").orderBy("pos")).alias("cm"))
    asks = points(spark, d).where("event_type = 'purchase'").select("event_id", "chrom", "pos")
    return R.interpolate(asks, gmap, block=BLOCK).withColumn("cm", r6("cm"))


# -- bins, ranks, curves ----------------------------------------------------------------------------------------------
@query("SELECT round(unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])), 6) AS edge FROM orders")
def quantile_edges(spark, d):
    return B.quantile_edges(_t(spark, d, "orders"), "o_totalprice", 10).select(F.explode(F.transform("edges", lambda x: F.round(x, 6))).alias("edge"))


@query("""WITH v AS (SELECT l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS b, sum(w) OVER () AS t FROM v)
SELECT q::DOUBLE AS q, min(v) AS edge FROM c, (VALUES (0.25), (0.5), (0.75)) x(q) WHERE b >= q * t GROUP BY q""")
def weighted_edges(spark, d):
    qs = [0.25, 0.5, 0.75]
    out = B.weighted_edges(_t(spark, d, "lineitem"), "l_quantity", F.col("l_linenumber"), qs)
    return out.select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), "edges")).alias("z")).select(F.col("z.q").alias("q"), F.col("z.edges").alias("edge"))


@query("""WITH p AS (SELECT o_orderpriority, o_orderkey, (o_orderkey + 1) / 20000000::DOUBLE AS p FROM orders), r AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS m, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS r FROM p)
SELECT o_orderpriority, o_orderkey, round(least(1.0, min(p * m / r) OVER (PARTITION BY o_orderpriority ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 6) AS p_adjusted FROM r""")
def bh_adjust(spark, d):
    p = _t(spark, d, "orders").select("o_orderpriority", "o_orderkey", ((F.col("o_orderkey") + 1) / 20000000.0).alias("p"))
    return B.bh_adjust(p, "p", ["o_orderpriority"]).select("o_orderpriority", "o_orderkey", r6("p_adjusted", "p_adjusted"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_quantity) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_quantity, r + (n - 1) / 2 AS rank FROM r""")
def average_rank(spark, d):
    return B.avg_rank(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").withColumn("rank", F.col("rank").cast("double"))


@query("""WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, value, round(sum(n) OVER (PARTITION BY event_type ORDER BY value) / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM c""")
def ecdf(spark, d):
    return B.ecdf(_t(spark, d, "events"), "event_type", "value").withColumn("share", r6("share"))


@query("""WITH s AS (SELECT value AS a, value + event_id % 50 AS b FROM events), g AS (SELECT unnest(range(0, 61)) * 10.0 AS age)
SELECT age::DOUBLE AS age, round(sum(CASE WHEN b > a THEN least(1, greatest(0, (b - age) / (b - a))) WHEN age < a THEN 1 ELSE 0 END), 4) AS expected FROM g, s GROUP BY age""")
def survival_curve(spark, d):
    s = _t(spark, d, "events").select(F.array(F.struct(F.col("value").alias("lower"), (F.col("value") + F.col("event_id") % 50).alias("upper"))).alias("samples"))
    return B.survival_curve(s, 10.0, 600.0, 1).select("age", F.round("expected", 4).alias("expected"))


@query("""WITH k AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'A' ELSE l_returnflag END AS category, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'X')) t(rank, category)), t AS (SELECT sum(n) AS total FROM k)
SELECT rank::INTEGER AS rank, o.category, coalesce(n, 0)::BIGINT AS n, round(100 * coalesce(n, 0) / total, 6) AS percent, round(100 * sqrt(coalesce(n, 0) / total * (1 - coalesce(n, 0) / total) / total), 6) AS se FROM o LEFT JOIN k USING (category), t""")
def category_percentages(spark, d):
    out = B.category_percentages(_t(spark, d, "lineitem"), "l_returnflag", ["A", "N", "X"], {"R": "A"})
    return out.select(F.col("rank").cast("int").alias("rank"), "category", "n", r6("percent", "percent"), r6("se", "se"))


@query("""SELECT m::DOUBLE AS min_age, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS low, round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS high FROM lineitem, (VALUES (10), (20), (40)) t(m) WHERE l_quantity >= m GROUP BY m""")
def mean_above(spark, d):
    out = B.mean_above(_t(spark, d, "lineitem"), "l_extendedprice", "l_quantity", [10, 20, 40])
    return out.select("min_age", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "low", "high")])


@query("""SELECT CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 25 THEN 2 ELSE 3 END AS stratum, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 40 GROUP BY ALL""")
def stratify(spark, d):
    return B.stratify(_t(spark, d, "lineitem"), "l_quantity", [1, 10, 25, 40], "l_extendedprice").select(F.col("stratum").cast("int").alias("stratum"), "n", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.75), 4) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr, round(100 * avg((v > 0)::INT), 4) AS percent_positive FROM (SELECT o_orderpriority, o_totalprice - 200000 AS v FROM orders) GROUP BY ALL""")
def describe_tracks(spark, d):
    out = B.describe_tracks(_t(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") - 200000).alias("v")), "o_orderpriority", "v")
    return out.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "q25", "q75", "iqr", "percent_positive")])


@query("""WITH r AS (SELECT value AS x, value * (1 + event_id % 3) AS y FROM events WHERE value > 0), e AS (SELECT log10(min(x)) AS lo, log10(max(x)) AS hi FROM r),
b AS (SELECT floor((log10(x) - lo) / ((hi - lo) / 12))::INTEGER + 1 AS bin, x, y FROM r, e)
SELECT bin, count(*) AS n, round(avg(x), 6) AS x_mean, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.75), 6) AS q75, round(avg(y) / avg(x), 6) AS ratio FROM b WHERE bin BETWEEN 1 AND 12 GROUP BY bin HAVING count(*) >= 10""")
def log_bin_summary(spark, d):
    out = B.log_bin_summary(_t(spark, d, "events").select(F.col("value").alias("x"), (F.col("value") * (1 + F.col("event_id") % 3)).alias("y")), "x", "y", 12)
    return out.select("bin", "n", *[r6(c, c) for c in ("x_mean", "mean", "median", "q25", "q75", "ratio")])


@query("""WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, count(*) AS n_genes, string_agg(o_orderpriority || '(' || n || ')', '; ' ORDER BY n DESC, o_orderpriority) AS genes FROM c GROUP BY ALL""")
def genes_by_bin(spark, d):
    return B.genes_by_bin(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH k AS (SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_regions FROM orders GROUP BY ALL) SELECT *, round(100 * n / sum(n) OVER (), 6) AS percent FROM k""")
def status_breakdown(spark, d):
    return B.status_breakdown(_t(spark, d, "orders"), "o_orderstatus", "o_custkey").withColumn("percent", r6("percent"))


# -- sites ------------------------------------------------------------------------------------------------------------
def _callset(spark, d, flag):
    return _t(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_orderkey"))


@query("""SELECT l_suppkey::VARCHAR AS chrom, l_partkey AS pos, l_orderkey FROM lineitem a WHERE l_returnflag = 'A' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)""")
def intersect_sites(spark, d):
    return J.intersect_sites(_callset(spark, d, "A"), _callset(spark, d, "R"), ("chrom", "pos"))[0]


@query("""SELECT l_suppkey::VARCHAR AS chrom, l_partkey AS pos, l_orderkey FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)""")
def drop_sites(spark, d):
    return J.drop_sites(_callset(spark, d, "A"), _callset(spark, d, "R"))


@query("""WITH k AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT a.l_suppkey::VARCHAR AS chrom, a.l_partkey AS pos, a.l_orderkey, k.first_order FROM lineitem a LEFT JOIN k USING (l_partkey, l_suppkey) WHERE l_returnflag = 'A'""")
def annotate_sites(spark, d):
    ann = _callset(spark, d, "R").groupBy("chrom", "pos").agg(F.min("l_orderkey").alias("first_order"))
    return J.annotate_sites(_callset(spark, d, "A"), ann, ("chrom", "pos"), ["first_order"])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS chain, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, max(q) FILTER (chain = 0) AS v1, max(q) FILTER (chain = 1) AS v2, max(q) FILTER (chain = 2) AS v3, round(avg(q), 6) AS mean FROM s GROUP BY ALL HAVING count(*) = 3""")
def join_replicates(spark, d):
    s = _t(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("chain")).agg(F.sum("l_quantity").alias("q"))
    return J.join_replicates([s.where(F.col("chain") == i).drop("chain") for i in range(3)], ["l_orderkey"], "q").withColumn("mean", r6("mean"))


@query("""SELECT l_orderkey FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber % 3) = 3""")
def complete_groups(spark, d):
    li = _t(spark, d, "lineitem")
    return J.complete_groups([li.where(F.col("l_linenumber") % 3 == i) for i in range(3)], "l_orderkey", li.where("l_orderkey % 7 = 0").select("l_orderkey").distinct())


@query("""WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS chain, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, round(avg(q), 6) AS mean_support, count(*) FILTER (q >= 30) AS n_pass, count(q) AS n_chains, round_even(avg(q), 0)::BIGINT AS rounded, count(*) FILTER (q >= 30) > 0 AS any, count(*) FILTER (q >= 30) * 2 > 3 AS majority, count(*) FILTER (q >= 30) = 3 AS strict, avg(q) >= 30 AS pooled FROM s GROUP BY ALL""")
def pool_support(spark, d):
    s = _t(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("chain")).agg(F.sum("l_quantity").alias("support"))
    return G.pool_support(s, 3, 30, True, ["l_orderkey"]).withColumn("mean_support", r6("mean_support"))


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority, c_mktsegment, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def star_join(spark, d):
    t = lambda n: _t(spark, d, n)
    snps = t("lineitem").select("l_orderkey", "l_linenumber").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    out = J.build_master_table(snps.join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey", "left"), t("customer").select("c_custkey", "c_mktsegment"), geo, ["c_custkey"], ["c_nationkey"])
    return out.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment", "n_name", "r_name")


@query("""SELECT c_nationkey, min(c_name) AS c_name, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS c_mktsegment FROM customer GROUP BY ALL""")
def collapse_genes(spark, d):
    return G.collapse_genes(_t(spark, d, "customer"), "c_nationkey", ["c_name"], ["c_mktsegment"])


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, chrom || '_' || pos AS id, CASE WHEN (json_extract_string(props, '$.k')::BIGINT) % 2 = 0 THEN (1000 + (json_extract_string(props, '$.k')::BIGINT)) / 2 * 29 ELSE (json_extract_string(props, '$.k')::BIGINT) * 29 END AS age FROM pts JOIN (SELECT event_id, props FROM events) USING (event_id)""")
def site_scalars(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    p = points(spark, d).join(_t(spark, d, "events").select("event_id", "props"), "event_id")
    upper = F.when(k % 2 == 0, 1000)
    return p.select("event_id", k.alias("k"), S.site_id(F.col("chrom"), F.col("pos")).alias("id"), S.midpoint_age(k, upper).cast("double").alias("age"))


@query("""SELECT event_id, chrom, pos FROM pts WHERE NOT (chrom = '3' AND pos BETWEEN 1704500000 AND 1705500000) AND least(value / 500, 1 - value / 500) >= 0.05""")
def site_filters(spark, d):
    p = points(spark, d).withColumn("af", F.col("value") / 500)
    return J.maf_filter(J.exclude_region(p, "3", 1704500000, 1705500000), 0.05).select("event_id", "chrom", "pos")


_MARKERS = "mk AS (SELECT event_id, chrom, pos - 1704067200 AS pos, event_type = 'signup' AND chrom <> '3' AS protected FROM pts)"


@query(f"""WITH RECURSIVE {_MARKERS}, la AS (SELECT chrom, coalesce(max(pos) FILTER (protected), 0) + 50000 AS stop FROM mk GROUP BY chrom),
sp AS (SELECT chrom, pos, bool_or(protected) AS held, min(event_id) AS event_id FROM mk JOIN la USING (chrom) WHERE protected OR pos <= stop GROUP BY ALL),
nx AS MATERIALIZED (SELECT a.chrom, a.pos, min(b.pos) AS ahead FROM sp a LEFT JOIN sp b ON a.chrom = b.chrom AND b.pos > a.pos AND (b.held OR b.pos >= a.pos + 900) GROUP BY ALL),
wk(chrom, pos) AS (SELECT chrom, min(pos) FROM sp GROUP BY chrom UNION ALL SELECT wk.chrom, ahead FROM wk JOIN nx ON nx.chrom = wk.chrom AND nx.pos = wk.pos WHERE ahead IS NOT NULL)
SELECT mk.* FROM mk JOIN sp ON mk.chrom = sp.chrom AND mk.pos = sp.pos JOIN wk ON wk.chrom = sp.chrom AND wk.pos = sp.pos WHERE sp.held OR mk.event_id = sp.event_id""")
def thin_markers(spark, d):
    """Markers at least 900 seconds apart up to 50000 past the last protected one; a chromosome has no protected marker."""
    held = (F.col("event_type") == "signup") & (F.col("chrom") != "3")
    rows = points(spark, d).select("event_id", "chrom", (F.col("pos") - 1704067200).alias("pos"), held.alias("protected"))
    return M.thin_markers(rows, tail=50_000, gap=900, block=8 * BLOCK)


# -- genotypes ---------------------------------------------------------------------------------------------------------
def _dosages(spark, d):
    e = _t(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: F.when(v < -0.3, 0).when(v < 0.3, 1).otherwise(2))
    return e.select(F.col("label").alias("region"), F.col("vec_id").alias("pos"), F.posexplode(x).alias("sample", "dosage"))


_DOS = "g AS (SELECT label AS region, vec_id AS pos, i AS sample, CASE WHEN embedding[i] < -0.3 THEN 0 WHEN embedding[i] < 0.3 THEN 1 ELSE 2 END AS dosage FROM embeddings, unnest(range(1, 65)) t(i))"


@query(f"""WITH {_DOS}, r AS (SELECT a.region, a.pos AS pos_a, b.pos AS pos_b, corr(a.dosage, b.dosage) AS r FROM g a JOIN g b ON a.region = b.region AND a.sample = b.sample AND a.pos < b.pos GROUP BY ALL)
SELECT region, round(min(r * r), 5) AS min_r2, round(avg(r * r), 5) AS mean_r2, count(*) AS n FROM r WHERE NOT isnan(r) GROUP BY region""")
def region_ld(spark, d):
    r2 = GT.pairwise_r2(_dosages(spark, d), ("region",))
    return r2.where("r2 is not null").groupBy("region").agg(F.round(F.min("r2"), 5).alias("min_r2"), F.round(F.avg("r2"), 5).alias("mean_r2"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DOS}, r AS (SELECT a.pos AS pos_a, b.pos AS pos_b, corr(a.dosage, b.dosage) AS r, count(*) AS n FROM g a JOIN g b USING (sample) WHERE a.pos % 20 = 3 AND b.pos % 15 = 8 GROUP BY ALL)
SELECT pos_a, pos_b, n, CASE WHEN NOT isnan(r) THEN round(r * r, 5) END AS r2 FROM r""")
def cross_ld(spark, d):
    """Every site of one set with every site of another, over all samples."""
    gt = _dosages(spark, d).withColumn("region", F.lit("all"))
    a, b = gt.where("pos % 20 = 3").select("pos"), gt.where("pos % 15 = 8").select("pos")
    return GT.cross_ld(gt, a, b, ("region",))[0].select("pos_a", "pos_b", "n", F.round("r2", 5).alias("r2"))


@query(f"""WITH {_DOS} SELECT pos, sum(dosage)::INTEGER AS ac, 128 AS an, round(sum(dosage) / 128, 6) AS af FROM g GROUP BY pos""")
def allele_counts(spark, d):
    calls = F.transform("embedding", lambda v: F.struct((v >= -0.3).cast("int").alias("a0"), (v >= 0.3).cast("int").alias("a1")))
    out = GT.fill_tags(_t(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), calls.alias("genotypes")))
    return out.select("pos", "ac", "an", r6("af", "af"))


# -- enrichment ------------------------------------------------------------------------------------------------------
_SETS = "sets AS (SELECT DISTINCT p_brand AS category, l_suppkey::VARCHAR AS gene FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1), fg AS (SELECT DISTINCT l_suppkey::VARCHAR AS gene FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.1)"


def _sets(spark, d):
    li = _t(spark, d, "lineitem").where("l_linenumber = 1").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.lit("brand").alias("library"), F.col("p_brand").alias("category"), F.col("l_suppkey").cast("string").alias("gene")).distinct()


def _foreground(spark, d):
    return _t(spark, d, "lineitem").where("l_quantity >= 49 and l_discount >= 0.1").select(F.col("l_suppkey").cast("string").alias("gene")).distinct()


@query(f"""WITH {_SETS}, u AS (SELECT DISTINCT gene FROM sets), f AS (SELECT gene FROM fg JOIN u USING (gene))
SELECT 'brand' AS library, category, count(f.gene) AS k, count(*) AS set_size, string_agg(f.gene, ';' ORDER BY f.gene) AS members, (SELECT count(*) FROM f) AS drawn, (SELECT count(*) FROM u) AS universe FROM sets LEFT JOIN f ON sets.gene = f.gene GROUP BY category HAVING count(f.gene) >= 2""")
def set_overlap(spark, d):
    sets = _sets(spark, d)
    out = E.set_overlap(_foreground(spark, d), sets, sets.select("gene").distinct(), 2)
    return out


@query(f"""WITH {_SETS}, u AS (SELECT DISTINCT gene FROM sets), f AS (SELECT gene FROM fg JOIN u USING (gene)), c AS (SELECT category, count(f.gene) AS k, count(*) AS s, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM u) AS t FROM sets LEFT JOIN f ON sets.gene = f.gene GROUP BY category HAVING count(f.gene) >= 1),
h AS (SELECT category, k, (k / n) / (s / t) AS fold, least(1, (SELECT sum(exp(lgamma(s + 1) - lgamma(x + 1) - lgamma(s - x + 1) + lgamma(t - s + 1) - lgamma(n - x + 1) - lgamma(t - s - n + x + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1))) FROM (SELECT unnest(range(k, least(s, n) + 1)) AS x) WHERE t - s - n + x >= 0)) AS p FROM c)
SELECT category, k, round(p, 6) AS p, round(fold, 6) AS fold, round(least(1, (SELECT min(y.p * (SELECT count(*) FROM h) / (SELECT count(*) FROM h z WHERE z.p <= y.p)) FROM h y WHERE y.p >= h.p)), 6) AS p_adjusted FROM h""")
def hypergeometric(spark, d):
    sets = _sets(spark, d)
    out = E.set_overlap(_foreground(spark, d), sets, sets.select("gene").distinct(), 1)
    return B.bh_adjust(E.hypergeom_enrichment(out), "p", ["library"]).select("category", "k", r6("p", "p"), r6("fold", "fold"), r6("p_adjusted", "p_adjusted"))


@query(f"""WITH {_SETS}, nul AS (SELECT DISTINCT l_linenumber AS replicate, l_suppkey::VARCHAR AS gene FROM lineitem WHERE l_discount >= 0.1 AND l_quantity < 3),
sz AS (SELECT replicate, count(*) AS size FROM nul GROUP BY ALL), o AS (SELECT category, count(*) AS k FROM fg JOIN sets USING (gene) GROUP BY ALL), n AS (SELECT category, replicate, count(*) AS nk FROM nul JOIN sets USING (gene) GROUP BY ALL),
r AS (SELECT count(*) AS reps FROM sz), nf AS (SELECT count(*) AS n FROM fg)
SELECT category, k, round(coalesce(sum(nk), 0) / max(reps), 6) AS null_count, round(coalesce(sum(nk / size), 0) / max(reps), 6) AS null_frac, round((count(*) FILTER (nk >= k) + 1) / (max(reps) + 1), 6) AS p_count, round((count(*) FILTER (nk / size >= k / n) + 1) / (max(reps) + 1), 6) AS p_frac FROM o LEFT JOIN n USING (category) LEFT JOIN sz USING (replicate), r, nf GROUP BY category, k""")
def matched_enrichment(spark, d):
    nulls = _t(spark, d, "lineitem").where("l_discount >= 0.1 and l_quantity < 3").select(F.col("l_linenumber").alias("replicate"), F.col("l_suppkey").cast("string").alias("gene")).distinct()
    out = E.matched_enrichment(_foreground(spark, d), nulls, _sets(spark, d))
    return out.select("category", "k", *[r6(c, c) for c in ("null_count", "null_frac", "p_count", "p_frac")])


@query("""WITH s AS (SELECT DISTINCT p_brand AS category, p_type || p_size AS gene FROM part), z AS (SELECT category, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.category, b.category AS other, count(*) AS shared FROM s a JOIN s b USING (gene) WHERE a.category <> b.category GROUP BY ALL),
e AS (SELECT p.category, p.other FROM p JOIN z USING (category) JOIN z y ON y.category = p.other WHERE shared / (z.n + y.n - shared) >= 0.25),
c AS (WITH RECURSIVE w(category, other) AS (SELECT category, category FROM z UNION SELECT w.category, e.other FROM w JOIN e ON e.category = w.other) SELECT category, min(other) AS cluster FROM w GROUP BY category)
SELECT category, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM c""")
def cluster_categories(spark, d):
    sets = _t(spark, d, "part").select(F.col("p_brand").alias("category"), F.concat("p_type", F.col("p_size").cast("string")).alias("gene")).distinct()
    return E.cluster_categories(sets, "jaccard", 0.25)


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS r FROM lineitem WHERE l_returnflag IN ('A', 'R')), s AS (SELECT count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, sum(r) FILTER (l_returnflag = 'A') AS r1 FROM r)
SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS p_greater FROM s""")
def mann_whitney(spark, d):
    return E.mann_whitney(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R").select("n1", "n2", "u", r6("p_greater", "p_greater"))


@query("""WITH c AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'A') AS x, count(*) FILTER (l_returnflag = 'R') AS y FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
SELECT round(max(abs(a - b)), 6) AS d, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM (SELECT sum(x) OVER (ORDER BY v) / sum(x) OVER () AS a, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS b, sum(x) OVER () AS n1, sum(y) OVER () AS n2 FROM c)""")
def kolmogorov_smirnov(spark, d):
    return E.ks_2samp(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R").select(r6("d", "d"), "n1", "n2")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    return E.spearman(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r6("rho", "rho"), "n")


@query()
def shuffled_placements(spark, d):
    """Share of the nearest genes of error intervals that are in a set, against 1000 placements that avoid signup intervals.
    Purchase intervals stand for genes; chromosomes run from the first event on."""
    first = intervals(spark, d).agg(F.min("start").alias("zero"))
    based = lambda kind=None: intervals(spark, d, kind).crossJoin(F.broadcast(first)).withColumn("start", F.col("start") - F.col("zero")).withColumn("end", F.col("end") - F.col("zero")).drop("zero")  # noqa: E731  # one row
    sizes = based().groupBy("chrom").agg(F.max("end").alias("length"))
    genes = based("purchase").select("chrom", "start", "end", F.col("event_id").alias("gene"), (F.pmod("event_id", F.lit(5)) == 0).alias("in_set"))
    rows = based("error").select("chrom", "start", "end", "event_id")
    fractions = E.shuffle_intervals(rows, sizes, 1000, 11, based("signup"), genes).withColumn("fraction", F.col("k") / F.col("n"))
    observed = fractions.where("replicate = -1").agg(F.max("fraction").alias("observed"))
    null = fractions.where("replicate >= 0").crossJoin(F.broadcast(observed))  # one row
    return null.groupBy("observed").agg(F.avg("fraction").alias("null_mean"), F.avg((F.col("fraction") >= F.col("observed")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SETS}, seg AS (SELECT DISTINCT l_orderkey AS seg, l_suppkey::VARCHAR AS gene FROM lineitem), num AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS number FROM (SELECT DISTINCT seg FROM seg)),
test AS (SELECT * FROM seg WHERE seg IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.1)), z AS (SELECT (SELECT count(DISTINCT seg) FROM test) AS size, (SELECT count(*) FROM num) AS n),
dr AS (SELECT r.range AS replicate, {D.sql_permuted('i.range', 'n', 3, 'r.range')} AS number FROM z, range(1000) r, range((SELECT size FROM z)) i),
hits AS (SELECT DISTINCT replicate, gene FROM dr JOIN num USING (number) JOIN seg USING (seg)), nul AS (SELECT category, replicate, count(*) AS nk FROM hits JOIN sets USING (gene) GROUP BY ALL),
o AS (SELECT category, count(*) AS k FROM (SELECT DISTINCT gene FROM test) JOIN sets USING (gene) GROUP BY ALL)
SELECT category, k, round(coalesce(sum(nk), 0) / 1000, 6) AS null_mean, round((count(*) FILTER (nk >= k) + 1) / 1001, 6) AS p FROM o LEFT JOIN nul USING (category) GROUP BY category, k""")
def permutation_enrichment(spark, d):
    li = _t(spark, d, "lineitem")
    seg = li.select(F.col("l_orderkey").alias("seg"), F.col("l_suppkey").cast("string").alias("gene")).distinct()
    test = seg.join(li.where("l_quantity >= 49 and l_discount >= 0.1").select(F.col("l_orderkey").alias("seg")).distinct(), "seg", "left_semi")
    return E.permutation_enrichment(test, seg, _sets(spark, d), 1000, 3).select("category", "k", r6("null_mean", "null_mean"), r6("p", "p"))
