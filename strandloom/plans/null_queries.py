"""Queries of the matched nulls, each with DuckDB SQL that repeats the draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandloom.functions import draws as D
from strandloom.operators import enrichment as E, intervals as I, locus_null as L, remap as R
from strandloom.plans.catalog import BLOCK, _t, intervals, points, query, r6


# -- stretches of user days ----------------------------------------------------------------------------------------------
def _days(spark: SparkSession, d: str) -> DataFrame:
    """User days as background: a run is a user's consecutive days, the score the day's value in hundredths."""
    day = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 86400)
    by_day = _t(spark, d, "events").groupBy("user_id", day.alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("score"), F.min("event_id").alias("e"))
    island = F.col("day") - F.row_number().over(Window.partitionBy("user_id").orderBy("day"))  # a user has few days
    return by_day.select(
        (F.col("user_id") * 100_000 + island).alias("run"), (F.col("day") * 86400).alias("start"), ((F.col("day") + 1) * 86400).alias("end"), "score",
        F.concat(F.lit("g"), (F.col("e") % 97).cast("string")).alias("gene"), (F.col("e") * 7919 % 5000).alias("distance"),
    )


_DAYS = """
ud AS (SELECT user_id AS u, epoch_us(ts) // 86400000000 AS day, sum(round(value * 100)::BIGINT)::BIGINT AS score, min(event_id) AS e FROM events GROUP BY ALL),
isl AS (SELECT *, u * 100000 + day - row_number() OVER (PARTITION BY u ORDER BY day) AS run FROM ud),
bg AS (SELECT run, day * 86400 AS start, (day + 1) * 86400 AS stop, score, 'g' || e % 97 AS gene, e * 7919 % 5000 AS distance, row_number() OVER (ORDER BY run, day) - 1 AS number,
sum(score) OVER (PARTITION BY run ORDER BY day) AS w1, count(*) OVER (PARTITION BY run ORDER BY day) AS d1 FROM isl)
"""


@query(f"""WITH {_DAYS}, q AS (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS e FROM bg),
loci AS (SELECT DISTINCT user_id AS locus, 86400 * (1 + user_id % 4) AS span, CASE WHEN user_id // 4 % 4 > 0 THEN e[user_id // 4 % 4] END AS low, CASE WHEN user_id // 4 % 4 < 3 THEN e[user_id // 4 % 4 + 1] END AS high FROM events, q),
dr AS (SELECT locus, span, low, high, r.range AS replicate, a.range AS attempt, {D.sql_draw('(SELECT count(*) FROM bg)', 17, 'r.range', 'locus', 'a.range')} AS number FROM loci, range(20) r, range(80) a),
st AS (SELECT dr.*, b.run, e.number AS last, (e.w1 - b.w1 + b.score) / (e.d1 - b.d1 + 1) AS mean FROM dr JOIN bg b USING (number) JOIN bg e ON e.run = b.run AND e.start < b.start + span AND b.start + span <= e.stop),
nr AS (SELECT replicate, locus, attempt, mean, arg_min(gene, m.distance * 1000000000 + m.number) AS gene, min(m.distance) AS distance FROM st JOIN bg m ON m.run = st.run AND m.number BETWEEN st.number AND st.last WHERE (low IS NULL OR mean > low) AND (high IS NULL OR mean <= high) GROUP BY replicate, locus, attempt, mean HAVING min(m.distance) <= 4000),
f AS (SELECT replicate, locus, min(attempt) AS attempt, arg_min(gene, attempt) AS gene, arg_min(distance, attempt) AS distance, arg_min(mean, attempt) AS mean FROM nr GROUP BY ALL)
SELECT r.range::INT AS replicate, locus, gene, distance::DOUBLE AS distance, round(mean, 6) AS mean_score, attempt::INT AS attempt FROM loci CROSS JOIN range(20) r LEFT JOIN (SELECT replicate AS range, * EXCLUDE replicate FROM f) USING (range, locus)""")
def matched_loci(spark, d):
    """Stretches of user days matched to every user by length and quartile of the score, the closest gene within a cap."""
    bg = _days(spark, d)
    edges = bg.agg(F.percentile("score", [0.25, 0.5, 0.75]).alias("e"))
    q = F.floor(F.col("user_id") / 4) % 4
    low, high = F.when(q > 0, F.try_element_at("e", q.cast("int"))), F.when(q < 3, F.try_element_at("e", (q + 1).cast("int")))
    loci = _t(spark, d, "events").select("user_id").distinct().crossJoin(F.broadcast(edges)).select(F.col("user_id").alias("locus"), (86400 * (1 + F.col("user_id") % 4)).alias("span"), low.alias("low"), high.alias("high"))  # one row
    return L.matched_locus_null(loci, bg, 20, 17, cap=4000, block=BLOCK).withColumn("mean_score", r6("mean_score"))


# -- anchors by score ------------------------------------------------------------------------------------------------
def _null_sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loci, pool, null sites): users with their largest value; some lie beyond all scores and fall back to the 50 closest."""
    pool = points(spark, d).select("chrom", "pos", F.round(F.col("value") * 100).alias("score"))
    far = F.when(F.col("user_id") % 7 == 0, 1e6).otherwise(0.0)
    loci = _t(spark, d, "events").groupBy("user_id").agg(F.max(F.round(F.col("value") * 100)).alias("score")).select(F.col("user_id").alias("locus"), (F.col("score") + far).alias("score"), (1 + F.col("user_id") % 3).alias("k"), (3600 * (1 + F.col("user_id") % 5)).alias("span"))
    anchors = L.settled(L.sample_null_loci(loci, pool, 10, 23, 20.0, 50), "anchors")
    return loci, pool, L.null_locus_sites(anchors, pool)


_SITES = f"""
pool AS (SELECT chrom, pos, round(value * 100) AS score, row_number() OVER (ORDER BY round(value * 100), chrom, pos) - 1 AS rank, row_number() OVER (ORDER BY chrom, pos, round(value * 100)) - 1 AS number FROM pts),
loci AS (SELECT user_id AS locus, max(round(value * 100)) + CASE WHEN user_id % 7 = 0 THEN 1e6 ELSE 0 END AS score, 1 + user_id % 3 AS k, 3600 * (1 + user_id % 5) AS span FROM events GROUP BY user_id),
b AS (SELECT locus, l.score, k, count(*) FILTER (p.score < l.score - 20) AS a, count(*) FILTER (p.score <= l.score + 20) AS b FROM loci l, pool p GROUP BY ALL),
c AS (SELECT locus, k, min(rank) AS a, max(rank) + 1 AS b FROM (SELECT b.locus, b.k, p.rank, row_number() OVER (PARTITION BY locus ORDER BY abs(p.score - b.score), abs(p.rank - b.a + 0.5), p.rank) AS n FROM b, pool p WHERE b.a >= b.b) WHERE n <= 50 GROUP BY ALL UNION ALL SELECT locus, k, a, b FROM b WHERE a < b),
dr AS (SELECT r.range AS replicate, locus, k, a + {D.sql_draw('b - a', 23, 'locus', 'r.range')} AS rank FROM c, range(10) r),
an AS (SELECT replicate, locus, k, chrom, pos AS anchor FROM dr JOIN pool USING (rank)),
sites AS (SELECT * FROM (SELECT replicate, locus, an.chrom, anchor, pos, score, k, row_number() OVER (PARTITION BY replicate, locus ORDER BY abs(pos - anchor), pos, number) AS n FROM an JOIN pool ON pool.chrom = an.chrom) WHERE n <= k)
"""


@query(f"WITH {_SITES} SELECT replicate::INT AS replicate, locus, chrom, anchor, pos, score FROM sites")
def null_locus_sites(spark, d):
    return _null_sites(spark, d)[2]


@query(f"""WITH {_SITES}, w AS (SELECT replicate, locus, max(pos) - min(pos) AS got FROM sites WHERE k > 1 GROUP BY ALL), j AS (SELECT got, span FROM w JOIN loci USING (locus)),
v AS (SELECT v, sum(x) OVER (ORDER BY v) / sum(x) OVER () AS a, sum(y) OVER (ORDER BY v) / sum(y) OVER () AS b FROM (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT score AS v, 1 AS x, 0 AS y FROM loci UNION ALL SELECT score, 0, 1 FROM sites) GROUP BY v))
SELECT (SELECT quantile_cont(score, 0.25) FROM loci) AS foreground_25, (SELECT quantile_cont(score, 0.25) FROM sites) AS null_25, (SELECT round(avg(score), 6) FROM loci) AS foreground_mean, (SELECT round(avg(score), 6) FROM sites) AS null_mean,
(SELECT round(max(abs(a - b)), 6) FROM v) AS d, (SELECT quantile_cont(span::DOUBLE, 0.5) FROM j) AS span, (SELECT quantile_cont(got::DOUBLE, 0.5) FROM j) AS realised, (SELECT round(avg((got > 2 * span)::INT), 6) FROM j) AS share_wide""")
def matching_check(spark, d):
    """How well the null sites match: percentiles, means, Kolmogorov-Smirnov distance, spans."""
    loci, _, sites = _null_sites(spark, d)
    out = L.check_matching(loci, sites)
    return out.select(F.col("foreground")[2].alias("foreground_25"), F.col("null")[2].alias("null_25"), r6("foreground_mean", "foreground_mean"), r6("null_mean", "null_mean"), r6("d", "d"), "span", "realised", r6("share_wide", "share_wide"))


# -- counts by their law ---------------------------------------------------------------------------------------------
_LAW = """
po AS (SELECT event_id, event_type, chrom, start, "end" FROM iv), hit AS (SELECT DISTINCT a.event_id FROM po a JOIN po b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a.event_type <> 'purchase' AND b.event_type = 'purchase'),
z AS (SELECT (SELECT count(*) FROM po WHERE event_type <> 'purchase') AS t, (SELECT count(*) FROM hit) AS k, (SELECT count(*) FROM po WHERE event_type = 'view') AS n, (SELECT count(*) FROM hit JOIN po USING (event_id) WHERE event_type = 'view') AS o),
pm AS (SELECT x, exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(t - k + 1) - lgamma(n - x + 1) - lgamma(t - k - n + x + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)) AS w FROM z, LATERAL (SELECT unnest(range(greatest(0, n - (t - k)), least(k, n) + 1)) AS x)),
cd AS (SELECT x, sum(w) OVER (ORDER BY x) AS upto FROM pm),
"""


@query(f"""WITH {_LAW} dr AS (SELECT range, {D.sql_draw(1 << 40, 7, 'range')} / {1 << 40} AS u FROM range(1000)), nu AS (SELECT range, (SELECT min(x) FROM cd WHERE upto > u) AS nul FROM dr)
SELECT o AS observed, round(avg(nul), 6) AS mean, round(stddev_pop(nul), 6) AS sd, round(o / avg(nul), 6) AS fold, round((count(*) FILTER (nul >= o) + 1) / 1001, 6) AS p FROM nu, z GROUP BY o""")
def overlap_subsample_null(spark, d):
    """Observed overlaps of one set of events against draws from all: the pool is flagged once, replicates are draws."""
    pool, against = intervals(spark, d), intervals(spark, d, "purchase")
    counts = I.count_overlapping(pool.where("event_type <> 'purchase'"), against, 4096).first()
    own = I.count_overlapping(intervals(spark, d, "view"), against, 4096).first()
    out = E.subsample_null(spark, counts["n"], counts["n_overlapping"], own["n"], own["n_overlapping"], 1000, 7)
    return out.select("observed", *[r6(c, c) for c in ("mean", "sd", "fold", "p")])


@query(f"""WITH fg AS (SELECT DISTINCT user_id AS gene FROM events WHERE event_type = 'error'), z AS (SELECT (SELECT count(DISTINCT user_id) FROM events) AS t, (SELECT count(DISTINCT user_id) FROM events WHERE user_id % 3 = 0) AS k, (SELECT count(*) // 2 FROM fg) AS n, (SELECT count(*) FROM fg WHERE gene % 3 = 0) // 2 AS o),
pm AS (SELECT x, exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(t - k + 1) - lgamma(n - x + 1) - lgamma(t - k - n + x + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)) AS w FROM z, LATERAL (SELECT unnest(range(greatest(0, n - (t - k)), least(k, n) + 1)) AS x)),
cd AS (SELECT x, sum(w) OVER (ORDER BY x) AS upto FROM pm), dr AS (SELECT range, {D.sql_draw(1 << 40, 3, 'range')} / {1 << 40} AS u FROM range(5000)), nu AS (SELECT (SELECT min(x) FROM cd WHERE upto > u) AS nul FROM dr)
SELECT o AS observed, round(avg(nul), 6) AS mean, round((count(*) FILTER (nul >= o)) / 5000, 6) AS p FROM nu, z GROUP BY o""")
def random_draw_null(spark, d):
    """Share of random draws of genes that hold as many members of a set as half of the foreground."""
    genes = _t(spark, d, "events").select("user_id", "event_type").distinct()
    member = F.col("user_id") % 3 == 0
    whole = genes.agg(F.countDistinct("user_id").alias("t"), F.countDistinct(F.when(member, F.col("user_id"))).alias("k")).first()
    own = genes.where("event_type = 'error'").agg(F.count(F.lit(1)).alias("n"), F.count_if(member).alias("o")).first()
    out = E.random_draw_null(spark, whole["t"], whole["k"], own["n"] // 2, own["o"] // 2, 5000, 3)
    return out.select("observed", r6("mean", "mean"), r6("p", "p"))


@query()
def bootstrap_ratio(spark, d):
    """Percentiles of resampled ratios of summed lengths; the draws are multinomial and have no SQL."""
    rows = intervals(spark, d).select((F.col("event_id") % 4).cast("int").alias("bin"), (F.col("end") - F.col("start")).cast("double").alias("value"), "event_type")
    return E.bootstrap_ratio(rows.where("event_type = 'view'"), rows, 200, 5).select("bin", r6("low", "low"), r6("high", "high"))


# -- composed maps ---------------------------------------------------------------------------------------------------
_MAPS = """
fw AS (SELECT range AS i, (range % 20)::VARCHAR AS chrom, 1704067200 + range // 20 * 90000 AS s, 1704067200 + range // 20 * 90000 + 60000 AS e, ((range * 7 + range // 20) % 20)::VARCHAR AS tc, range // 20 * 70000 AS ts, CASE WHEN range % 3 = 0 THEN '-' ELSE '+' END AS st FROM range(700)),
bw AS (SELECT tc AS chrom, ts + 5000 AS s, ts + 50000 AS e, chrom AS tc, CASE WHEN st = '-' THEN e - 50000 ELSE s + 5000 END + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS ts, st FROM fw)
"""


@query(f"""WITH {_MAPS}, x AS (SELECT event_id, p.chrom, pos, tc AS c2, CASE WHEN st = '-' THEN ts + 60000 - (pos - 1 - s) ELSE ts + pos - s END AS p2 FROM pts p JOIN fw ON p.chrom = fw.chrom AND pos - 1 < e AND s < pos QUALIFY count(*) OVER (PARTITION BY event_id) = 1),
y AS (SELECT event_id, x.chrom, pos, tc, CASE WHEN st = '-' THEN ts + 45000 - (p2 - 1 - s) ELSE ts + p2 - s END AS p3 FROM x JOIN bw ON c2 = bw.chrom AND p2 - 1 < e AND s < p2 QUALIFY count(*) OVER (PARTITION BY event_id) = 1)
SELECT event_id, chrom, pos FROM y WHERE tc = chrom AND p3 = pos""")
def roundtrip_consistent(spark, d):
    """Sites that come back to their place over two block tables; a fifth of the blocks comes back beside it."""
    i = F.col("id")
    start = 1704067200 + F.floor(i / 20) * 90_000
    strand = F.when(i % 3 == 0, "-").otherwise("+")
    forward = spark.range(700).select("id", (i % 20).cast("string").alias("chrom"), start.alias("start"), (start + 60_000).alias("end"), ((i * 7 + F.floor(i / 20)) % 20).cast("string").alias("t_chrom"), (F.floor(i / 20) * 70_000).alias("t_start"), (F.floor(i / 20) * 70_000 + 60_000).alias("t_end"), strand.alias("strand"))
    home = F.when(F.col("strand") == "-", F.col("end") - 50_000).otherwise(F.col("start") + 5000) + F.when(i % 5 == 0, 1).otherwise(0)
    backward = forward.select(F.col("t_chrom").alias("chrom"), (F.col("t_start") + 5000).alias("start"), (F.col("t_start") + 50_000).alias("end"), F.col("chrom").alias("t_chrom"), home.alias("t_start"), (home + 45_000).alias("t_end"), "strand")
    sites = points(spark, d).select("event_id", "chrom", "pos", F.concat_ws("_", "chrom", F.col("pos").cast("string"), F.col("event_id").cast("string")).alias("id"))
    return R.roundtrip_consistent(sites, forward.drop("id"), backward, width=50_000, block=BLOCK).select("event_id", "chrom", "pos")
