"""Filters, counts, scalars and gene decisions over the driver tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions import draws as D, scalars as S
from strandloom.operators import bins as B, enrichment as E, genes as G, genotypes as GT, intervals as I, islands as M, sites as J
from strandloom.plans.catalog import BLOCK, _t, intervals, points, query, r6
from strandloom.plans.reader_queries import VARIANTS, base, variants
from strandloom.plans.site_queries import EVIDENCE, evidence
from strandloom.sources import text as T
from strandloom.storage import fresh_path

e = F.col
N = "event_id"


def _n(k: int, by: int = 1):
    """event_id divided by ``by``, modulo ``k``."""
    return (F.floor(F.col(N) / by) if by > 1 else F.col(N)) % k


# -- sites and genotypes -------------------------------------------------------------------------------------------------
@query(f"WITH {VARIANTS} SELECT id, ref, alts[1] AS alt FROM vs WHERE len(alts) = 1 AND length(ref) = 1 AND length(alts[1]) = 1")
def biallelic_snps(spark, d):
    return J.biallelic_snps(variants(spark, d)).select("id", "ref", F.get("alts", F.lit(0)).alias("alt"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a site with the calls of a child and two parents."""
    one = lambda name, k: F.struct(F.lit(name).alias("sample"), F.when(_n(10 + k) == 0, None).otherwise(_n(2, k)).cast("int").alias("a0"), _n(2, 2 * k).cast("int").alias("a1"), _n(3 + k).cast("int").alias("dp"), F.array(_n(4 + k).cast("int"), F.lit(0)).alias("pl"))
    return points(spark, d).select(N, "chrom", "pos", F.array(one("child", 1), one("father", 2), one("mother", 3)).alias("genotypes"))


_CALLS = """cl AS (SELECT event_id, chrom, pos, s.sample, CASE WHEN event_id % (10 + k) = 0 THEN NULL ELSE event_id // k % 2 END AS a0, event_id // (2 * k) % 2 AS a1, event_id % (3 + k) AS dp, event_id % (4 + k) AS pl FROM pts, (VALUES ('child', 1), ('father', 2), ('mother', 3)) s(sample, k))"""


@query(f"WITH {_CALLS} SELECT event_id, sample, CASE WHEN dp = 0 OR pl = 0 THEN NULL ELSE a0 END::INT AS a0, CASE WHEN dp = 0 OR pl = 0 THEN NULL ELSE a1 END::INT AS a1 FROM cl")
def mask_uncalled(spark, d):
    return J.mask_uncalled(_calls(spark, d)).select(N, F.explode("genotypes").alias("g")).select(N, "g.sample", "g.a0", "g.a1")


@query(f"""WITH {_CALLS}, w AS (SELECT c.event_id, c.a0 AS c0, c.a1 AS c1, f.a0 AS f0, f.a1 AS f1, m.a0 AS m0, m.a1 AS m1 FROM cl c JOIN cl f USING (event_id) JOIN cl m USING (event_id) WHERE c.sample = 'child' AND f.sample = 'father' AND m.sample = 'mother')
SELECT event_id, CASE WHEN c0 IS NOT NULL AND f0 IS NOT NULL AND m0 IS NOT NULL AND NOT ((c0 IN (f0, f1) AND c1 IN (m0, m1)) OR (c1 IN (f0, f1) AND c0 IN (m0, m1))) THEN 1 ELSE 0 END AS n_errors FROM w""")
def mendel_errors(spark, d):
    return GT.mendel_errors(_calls(spark, d), [("child", "father", "mother")]).select(N, "n_errors")


@query("""WITH g AS (SELECT event_id % 40 AS sample, event_id // 40 AS pos, event_id // 40 % 7 AS k, CASE WHEN event_id % 40 % 9 = 0 AND event_id // 40 % 3 = 0 OR event_id // 40 % 11 = 0 AND event_id % 4 = 0 THEN NULL ELSE event_id % 2 END AS a0 FROM events),
s AS (SELECT sample FROM g GROUP BY sample HAVING avg((a0 IS NULL)::INT) <= 0.2), k AS (SELECT * FROM g SEMI JOIN s USING (sample)), p AS (SELECT pos FROM k GROUP BY pos HAVING avg((a0 IS NULL)::INT) <= 0.2)
SELECT sample, pos, a0::INT AS a0 FROM k SEMI JOIN p USING (pos)""")
def missingness_filter(spark, d):
    missing = ((_n(40) % 9 == 0) & (F.floor(e(N) / 40) % 3 == 0)) | ((F.floor(e(N) / 40) % 11 == 0) & (_n(4) == 0))
    gt = _t(spark, d, "events").select(_n(40).alias("sample"), F.lit("1").alias("chrom"), F.floor(e(N) / 40).alias("pos"), F.when(~missing, _n(2)).cast("int").alias("a0"), F.lit(0).alias("a1"))
    return GT.missingness_filter(gt, 0.2, 0.2).select("sample", "pos", "a0")


@query(f"""WITH {VARIANTS}, a AS (SELECT ref, alts[1] AS alt FROM vs), c AS (SELECT count(*) AS records, count(*) FILTER (length(ref) = 1 AND length(alt) = 1) AS snps, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS transitions FROM a)
SELECT records, snps, transitions, snps - transitions AS transversions, round(transitions / (snps - transitions), 6) AS ts_tv FROM c""")
def callset_stats(spark, d):
    return GT.callset_stats(variants(spark, d).withColumn("alt", F.get("alts", F.lit(0)))).withColumn("ts_tv", r6("ts_tv"))


@query("""WITH m AS (SELECT event_id, event_id % 4000 AS dp, event_id % 97 AS n_geno, (event_id % 80)::DOUBLE AS mq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 23 - 11.0 END AS rs, event_id % 90 AS fs, event_id % 300 AS qual, event_id % 40 / 4 AS qd, event_id % 50 AS eh, event_id % 21 / 20 AS af FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN dp < 950 OR dp > 2850 THEN 'depth' END, CASE WHEN n_geno < 50 THEN 'genotyped' END, CASE WHEN mq < 40 THEN 'mapping_quality' END, CASE WHEN abs(rs) > 6 THEN 'mq_rank_sum' END, CASE WHEN abs(rs / 2) > 6 THEN 'read_pos_rank_sum' END, CASE WHEN abs(rs * 2) > 6 THEN 'base_q_rank_sum' END,
CASE WHEN fs > 60 THEN 'strand' END, CASE WHEN qual < 30 THEN 'qual' END, CASE WHEN qd < 2 THEN 'quality_by_depth' END, CASE WHEN eh > 28.69 THEN 'excess_het' END, CASE WHEN af = 0 OR af = 1 THEN 'monomorphic' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m""")
def hard_filter(spark, d):
    """Every site with the filters that it fails; none for a site that passes."""
    rank = F.when(_n(5) != 0, _n(23) - 11.0)
    metrics = _t(spark, d, "events").select(
        N, _n(4000).alias("dp"), _n(97).alias("n_geno"), _n(80).cast("double").alias("mq"), rank.alias("mq_rank_sum"), (rank / 2).alias("read_pos_rank_sum"), (rank * 2).alias("base_q_rank_sum"),
        _n(90).alias("fs"), _n(300).alias("qual"), (_n(40) / 4).alias("qd"), _n(50).alias("excess_het"), (_n(21) / 20).alias("af"),
    )
    good, bad = J.hard_filter(metrics)
    return bad.select(N, F.array_join("reasons", ",").alias("reasons")).unionByName(good.select(N, F.lit("").alias("reasons")))


@query("""WITH x AS (SELECT chrom, event_id % 300 AS s FROM pts WHERE event_type = 'view' UNION ALL SELECT ((event_id // 7) % 20)::VARCHAR, event_id % 500 FROM pts WHERE event_type = 'view') SELECT DISTINCT chrom, s AS start, s + 10 AS "end" FROM x WHERE chrom IN ('3', '1', '2', '11')""")
def resolved_duplications(spark, d):
    other = F.concat(F.lit("chr"), _n(20, 7).cast("string"))
    ends = {"chrom_1": F.concat(F.lit("chr"), "chrom"), "start_1": _n(300), "end_1": _n(300) + 10, "chrom_2": other, "start_2": _n(500), "end_2": _n(500) + 10}
    rows = points(spark, d).select(F.col("event_type").alias("assemblies"), *[c.alias(n) for n, c in ends.items()])
    return J.resolved_duplications(rows, "view", ["1", "2", "3", "11"])


@query("""WITH a AS (SELECT event_id, 'ACGT'[event_id % 4 + 1] AS ref, 'ACGT'[event_id // 4 % 4 + 1] AS alt, (event_id % 3)::VARCHAR || CASE WHEN event_id % 2 = 0 THEN '0' ELSE '1' END AS g FROM events WHERE event_id % 5 <> 0),
s AS (SELECT event_id, 'ACGT'[event_id // 4 % 4 + 1] AS r, 'ACGT'[event_id % 4 + 1] AS x FROM events WHERE event_id % 3 = 0)
SELECT event_id AS pos, CASE WHEN s.event_id IS NOT NULL AND a.ref = a.alt AND a.ref IN (r, x) THEN r WHEN s.event_id IS NOT NULL AND a.ref = x AND a.alt = r THEN r ELSE a.ref END AS ref,
CASE WHEN s.event_id IS NOT NULL AND a.ref = a.alt AND a.ref IN (r, x) THEN x WHEN s.event_id IS NOT NULL AND a.ref = x AND a.alt = r THEN x ELSE a.alt END AS alt,
CASE WHEN s.event_id IS NOT NULL AND ((a.ref = x AND a.alt = r) OR (a.ref = a.alt AND a.ref = x)) THEN 1 - event_id % 2 ELSE event_id % 2 END::TINYINT AS first FROM a LEFT JOIN s USING (event_id)""")
def fix_haplotype_coding(spark, d):
    ev = _t(spark, d, "events")
    haps = ev.where("event_id % 5 <> 0").select(F.lit("1").alias("chrom"), e(N).alias("pos"), base(e(N)).alias("ref"), base(F.floor(e(N) / 4)).alias("alt"), F.array(_n(2).cast("tinyint")).alias("alleles"))
    sites = ev.where("event_id % 3 = 0").select(F.lit("1").alias("chrom"), e(N).alias("pos"), base(F.floor(e(N) / 4)).alias("ref"), base(e(N)).alias("alt"))
    return GT.fix_haplotype_coding(haps, sites).select("pos", "ref", "alt", F.get("alleles", F.lit(0)).alias("first"))


@query("""WITH d AS (SELECT chrom, pos // 100000 * 100000 AS off, string_agg(event_id % 4, '' ORDER BY event_id) AS m FROM pts GROUP BY ALL), c AS (SELECT chrom, off + i AS p FROM d, unnest(range(length(m))) t(i) WHERE m[i + 1] IN ('2', '3')),
g AS (SELECT chrom, p, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS k FROM c) SELECT chrom, min(p) AS start, max(p) + 1 AS "end" FROM g GROUP BY chrom, k""")
def mask_runs(spark, d):
    """Runs of callable digits in mask texts."""
    rows = points(spark, d).groupBy("chrom", (F.floor(e("pos") / 100_000) * 100_000).alias("offset")).agg(F.array_sort(F.collect_list(F.struct(N))).alias("x"))
    return M.mask_runs(rows.select("chrom", "offset", F.array_join(F.transform("x", lambda r: (r[N] % 4).cast("string")), "").alias("mask")), block=BLOCK)


# -- scalars ---------------------------------------------------------------------------------------------------------
@query("""WITH v AS (SELECT event_id, ['A', 'c', 'N', 'g|x', '.', 'T|A'][event_id % 6 + 1] AS aa, ['0|1', '1/1', './.', '0/0', '2|1', '1'][event_id % 6 + 1] AS gt, ['a|x|p;b|y|q', 'a|x|p;c|x|', '', 'z'][event_id % 4 + 1] AS sub FROM events)
SELECT event_id, [[NULL, 'A'], ['C', NULL], [NULL, NULL]][1][1] AS nothing, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 3 THEN 'G' WHEN 5 THEN 'T' END AS low, CASE event_id % 6 WHEN 0 THEN 'A' WHEN 5 THEN 'T' END AS high,
CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 1 END AS dosage, ['x,y', 'x', '', ''][event_id % 4 + 1] AS middle,
CASE WHEN event_id % 3 = 0 THEN event_id / 2 END::DOUBLE AS number, 'c' || event_id AS chrom, event_id * 3 AS pos, event_id AS start, event_id + 5 AS "end" FROM v""")
def text_scalars(spark, d):
    pick = lambda k, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (e(N) % k).cast("int"))
    aa, gt, sub = pick(6, "A", "c", "N", "g|x", ".", "T|A"), pick(6, "0|1", "1/1", "./.", "0/0", "2|1", "1"), pick(4, "a|x|p;b|y|q", "a|x|p;c|x|", "", "z")
    site = S.parse_site_id(F.concat(F.lit("c"), e(N).cast("string"), F.lit("_"), (e(N) * 3).cast("string")))
    region = S.parse_region(F.concat(F.lit("chr1:"), F.format_number(e(N), 0), F.lit("-"), F.format_number(e(N) + 5, 0)))
    number = F.when(_n(3) == 0, F.concat(F.lit(" "), (e(N) / 2).cast("string"))).when(_n(3) == 1, ".").otherwise("x1")
    return _t(spark, d, "events").select(
        N, F.lit(None).cast("string").alias("nothing"), S.ancestral_allele(aa).alias("low"), S.ancestral_allele(aa, False).alias("high"), S.dosage(gt).alias("dosage"), F.array_join(S.distinct_subfield(sub, 1), ",").alias("middle"),
        S.to_number(number).alias("number"), site["chrom"].alias("chrom"), site["pos"].alias("pos"), region["start"].alias("start"), region["end"].alias("end"),
    )


@query("""WITH v AS (SELECT event_id, 'ACGT'[event_id % 4 + 1] AS b, 'ACGT'[event_id // 4 % 4 + 1] AS r, 'ACGT'[event_id // 16 % 4 + 1] AS a, 'ACGT'[event_id // 64 % 4 + 1] AS alt, CASE WHEN event_id % 7 > 0 THEN 'ACGT'[event_id // 5 % 4 + 1] END AS aa FROM events),
w AS (SELECT *, r IN ('A', 'G') AS f, translate(r, 'ACGT', 'TGCA') AS rc, translate(alt, 'ACGT', 'TGCA') AS xc, translate(aa, 'ACGT', 'TGCA') AS ac, translate(b, 'ACGT', 'TGCA') AS bc FROM v),
x AS (SELECT event_id, CASE WHEN f THEN rc ELSE r END AS r, CASE WHEN f THEN xc ELSE alt END AS t, CASE WHEN f THEN ac ELSE aa END AS z, CASE WHEN f THEN bc ELSE a END AS g FROM w)
SELECT event_id, g = 'G' AND ((coalesce(z = r, true) AND r = 'C' AND t = 'T') OR (NOT coalesce(z = r, true) AND z = t AND r = 'T' AND t = 'C')) AS cpg FROM x""")
def cpg_flags(spark, d):
    b = lambda k: base(F.floor(e(N) / k))
    aa = F.when(_n(7) > 0, b(5))
    return _t(spark, d, "events").select(N, S.cpg_flag(F.concat(b(1), b(4), b(16)), aa, b(4), b(64)).alias("cpg"))


@query("""WITH v AS (SELECT event_id, [['missense_variant', 'missense'], ['intron_variant', 'intron'], ['synonymous_variant', 'synonymous'], ['5_prime_UTR_variant', 'x']][event_id % 4 + 1][1] AS a, event_id FROM events) SELECT event_id, a = 'missense_variant' AS missense, event_id % 5 = 0 AS lof FROM v""")
def worst_effects(spark, d):
    """A missense annotation outranks an intron's; a true flag overrides both."""
    pick = lambda n: F.get(F.array(*[F.lit(x) for x in ("missense_variant", "intron_variant", "synonymous_variant", "5_prime_UTR_variant")]), (n % 4).cast("int"))
    one = S.worst_effect(F.concat_ws(",", F.lit("intron_variant"), pick(e(N))))
    flagged = S.worst_effect(pick(e(N)), _n(5) == 0)
    return _t(spark, d, "events").select(N, (one == S.effect_category(F.lit("missense_variant"))).alias("missense"), (flagged == "LOF").alias("lof"))


@query("""WITH a AS (SELECT event_id % 700 AS pos, min(event_id) AS i FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT event_id % 700 AS pos, min(event_id) AS i FROM events WHERE event_type = 'click' GROUP BY 1),
j AS (SELECT coalesce(a.pos, b.pos) AS pos, a.i AS x, b.i AS y, CASE WHEN a.i IS NULL THEN [] WHEN a.i % 2 = 0 THEN ['C'] ELSE ['G', 'C'] END AS la, CASE WHEN b.i IS NULL THEN [] WHEN b.i % 2 = 0 THEN ['T'] ELSE ['C', 'T'] END AS lb FROM a FULL JOIN b ON a.pos = b.pos),
u AS (SELECT *, list_concat(la, list_filter(lb, lambda t: NOT list_contains(la, t))) AS alts FROM j)
SELECT pos, array_to_string(alts, ',') AS alts, coalesce(x % 2, 0)::INT AS a0, CASE WHEN y IS NULL THEN 0 ELSE list_position(alts, lb[1]) END::INT AS b0 FROM u""")
def merge_cohorts(spark, d):
    """Two cohorts of one sample each: alleles united, the second's calls renumbered, absent calls reference."""
    def cohort(kind, name, odd, even, call):
        rows = _t(spark, d, "events").where(F.col("event_type") == kind).groupBy(_n(700).alias("pos")).agg(F.min(N).alias("i"))
        alts = F.when(e("i") % 2 == 0, F.array(*[F.lit(x) for x in even])).otherwise(F.array(*[F.lit(x) for x in odd]))
        return rows.select(F.lit("1").alias("chrom"), "pos", F.lit("A").alias("ref"), alts.alias("alts"), F.array(F.struct(F.lit(name).alias("sample"), call.cast("int").alias("a0"), F.lit(0).alias("a1"))).alias("genotypes"))

    out = J.merge_cohorts(cohort("view", "s", ("G", "C"), ("C",), e("i") % 2), cohort("click", "t", ("C", "T"), ("T",), F.lit(1)), ["s"], ["t"])
    return out.select("pos", F.array_join("alts", ",").alias("alts"), F.get("genotypes", F.lit(0))["a0"].alias("a0"), F.get("genotypes", F.lit(1))["a0"].alias("b0"))


@query("""SELECT event_id, round(list_sum(list_transform(range(1, 6), lambda i: (event_id % (i + 2)) / 10))::DOUBLE, 6) AS total, round(list_sum(list_transform(range(3, 6), lambda i: (event_id % (i + 2)) / 10))::DOUBLE, 6) AS tail FROM events""")
def inverse_cumulative(spark, d):
    x = F.array(*[(e(N) % (i + 2)) / 10 for i in range(1, 6)])
    return _t(spark, d, "events").select(N, r6(B.inverse_cumulative(x, 0), "total"), r6(B.inverse_cumulative(x, 2), "tail"))


# -- sums over bins, curves ------------------------------------------------------------------------------------------
@query("SELECT c AS cutoff, event_id, value FROM pts, (VALUES (10.0::DOUBLE), (50.0), (200.0)) t(c) WHERE value < c")
def below_cutoffs(spark, d):
    return B.below_cutoffs(points(spark, d).select(N, "value"), "value", [10, 50, 200])


@query('SELECT event_type, sum("end" - start)::BIGINT AS bp FROM iv GROUP BY ALL')
def covered_bp(spark, d):
    iv = intervals(spark, d)
    return iv.groupBy("event_type").agg(I.covered_bp(iv).alias("bp"))


@query("""SELECT b.range AS bin, coalesce(sum(round(value * 100)::BIGINT * (600 + event_id % 3600)), 0)::BIGINT AS numerator, coalesce(sum(600 + event_id % 3600), 0)::BIGINT AS denominator, round((sum(round(value * 100)::BIGINT * (600 + event_id % 3600)) / sum(600 + event_id % 3600))::DOUBLE, 6) AS fraction
FROM range(12) b LEFT JOIN pts ON event_id % 10 = b.range GROUP BY 1""")
def weighted_fraction_by_bin(spark, d):
    rows = points(spark, d).select(_n(10).alias("bin"), F.round(e("value") * 100).cast("long").alias("value"), (600 + _n(3600)).alias("overlap"))
    return B.weighted_fraction_by_bin(rows, spark.range(12).select(F.col("id").alias("bin"))).withColumn("fraction", r6("fraction"))


@query("""WITH s AS (SELECT event_id % 9 AS bin, sum(600 + event_id % 3600) AS l, coalesce(sum(600 + event_id % 3600) FILTER (event_type = 'view'), 0) AS a, coalesce(sum(600 + event_id % 3600) FILTER (value > 50), 0) AS b, coalesce(sum(600 + event_id % 3600) FILTER (event_type = 'view' AND value > 50), 0) AS o FROM pts GROUP BY ALL)
SELECT bin, round((o / l)::DOUBLE, 6) AS observed, round(((a / l) * (b / l))::DOUBLE, 6) AS expected, round(((o / l) / ((a / l) * (b / l)))::DOUBLE, 6) AS enrichment FROM s""")
def obs_vs_exp(spark, d):
    rows = points(spark, d).select("event_type", "value", _n(9).alias("bin"), (600 + _n(3600)).alias("bp"))
    a, b = F.col("event_type") == "view", F.col("value") > 50
    out = B.obs_vs_exp(rows.where(a), rows.where(b), rows.where(a & b), rows)
    return out.select("bin", *[r6(c, c) for c in ("observed", "expected", "enrichment")])


@query("""WITH b AS (SELECT chrom, pos // 7200 * 7200 AS s, pos // 7200 * 7200 + 3600 AS e, pos // 7200 % 4 AS bin FROM pts WHERE event_type = 'signup' GROUP BY ALL), p AS (SELECT event_id, chrom, pos FROM pts WHERE event_type = 'view'),
c AS (SELECT bin, count(DISTINCT event_id) AS n FROM p JOIN b ON p.chrom = b.chrom AND p.pos - 1 < e AND s < p.pos GROUP BY ALL) SELECT b.bin, count(*) * 3600 / 1e6 AS mb, coalesce(max(n), 0) AS n, round(coalesce(max(n), 0) / (count(*) * 3600 / 1e6), 6) AS per_mb FROM b LEFT JOIN c USING (bin) GROUP BY 1""")
def points_per_bin(spark, d):
    p = points(spark, d)
    slot = F.floor(e("pos") / 7200)
    bins = p.where("event_type = 'signup'").select("chrom", (slot * 7200).alias("start"), (slot * 7200 + 3600).alias("end"), (slot % 4).alias("bin")).distinct()
    views = p.where("event_type = 'view'").select("chrom", (e("pos") - 1).alias("start"), F.col("pos").alias("end"), F.col(N).alias("name"))
    return B.points_per_bin(views, bins).withColumn("per_mb", r6("per_mb"))


@query('SELECT b.event_type AS kind, count(DISTINCT (a.chrom, a.start, a."end")) AS n FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" WHERE a.event_type = \'error\' AND b.event_type <> \'error\' GROUP BY ALL')
def classes_hit(spark, d):
    iv = intervals(spark, d)
    return B.classes_hit(iv.where("event_type = 'error'").select("chrom", "start", "end"), iv.where("event_type <> 'error'").select("chrom", "start", "end", F.col("event_type").alias("kind")))


@query("""WITH c AS (SELECT event_type, event_id % 60 AS x, sum(round(value * 100)::BIGINT)::BIGINT AS y FROM pts GROUP BY ALL), f AS (SELECT event_type, arg_min(y, x) AS y0 FROM c GROUP BY ALL), r AS (SELECT event_type, min(x) AS "at", arg_min(y, x) AS got FROM c WHERE x >= 25.5 GROUP BY ALL)
SELECT event_type, x, round(y / y0, 6) AS share, "at", got FROM c JOIN f USING (event_type) JOIN r USING (event_type)""")
def curves(spark, d):
    """Each curve over its first value, with the point read at a cut-off."""
    c = points(spark, d).groupBy("event_type", _n(60).alias("x")).agg(F.sum(F.round(e("value") * 100).cast("long")).alias("y"))
    at = B.read_curve(c, "x", "y", 25.5, ["event_type"]).withColumnsRenamed({"x": "at", "y": "got"})
    return B.normalise_curve(c, "x", "y", ["event_type"]).join(at, "event_type").select("event_type", "x", r6("share", "share"), "at", "got")


@query("SELECT round(avg(CASE WHEN event_id % 3 > 0 THEN event_id % 50 END), 6) AS mean_depth, count(*) FILTER (event_id % 3 > 0) AS n FROM events")
def mean_depth(spark, d):
    return B.mean_depth(_t(spark, d, "events").select(F.when(_n(3) > 0, _n(50)).alias("depth"))).withColumn("mean_depth", r6("mean_depth"))


@query("SELECT chrom, pos, event_id, CASE WHEN chrom = '3' THEN 1001 WHEN chrom = '4' THEN 1003 WHEN chrom = '5' THEN 2000 ELSE chrom::INT END AS rank FROM pts")
def natural_order(spark, d):
    named = F.when(e("chrom") == "3", "chrX").when(e("chrom") == "4", "MT").when(e("chrom") == "5", "other").otherwise(F.concat(F.lit("chr"), "chrom"))
    out = B.natural_order(points(spark, d).select("chrom", "pos", N, named.alias("name")), "name")
    return out.select("chrom", "pos", N, S.chrom_rank(e("name")).alias("rank"))


@query("""SELECT event_id % 3 AS run, chrom, round(avg(event_id % 5), 6) AS mean_n_mut, round(avg(event_id % 4), 6) AS mean_n_fwd, round(avg(event_id % 7), 6) AS mean_n_rev, round(quantile_cont(value, 0.5), 6) AS median_oldest_age, count(*) FILTER (event_id % 2 = 0) AS coalesce_ok_count, count(*) FILTER (event_id % 3 = 0) AS nodes_ok_count,
count(*) FILTER (event_id % 5 = 0) AS nonroot_count, count(*) FILTER (event_id % 6 = 0) AS first_count, count(*) FILTER (event_id % 8 = 0) AS second_count, count(*) AS n_samples, count(*) FILTER (event_id % 6 = 0) + count(*) FILTER (event_id % 8 = 0) AS first_or_second_count FROM pts GROUP BY ALL""")
def support_by_site(spark, d):
    flags = {"coalesce_ok": 2, "nodes_ok": 3, "nonroot": 5, "first": 6, "second": 8}
    rows = points(spark, d).select("chrom", _n(3).alias("run"), _n(5).alias("n_mut"), _n(4).alias("n_fwd"), _n(7).alias("n_rev"), F.col("value").alias("oldest_age"), *[(_n(k) == 0).alias(c) for c, k in flags.items()])
    out = G.support_by_site(rows, ("run", "chrom"))
    return out.withColumns({c: r6(c) for c in ("mean_n_mut", "mean_n_fwd", "mean_n_rev", "median_oldest_age")})


# -- gene decisions ----------------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT event_id, chrom, pos, CASE WHEN event_id % 5 > 0 THEN value END AS lo, CASE WHEN event_id % 7 > 0 THEN value * 2 END AS hi FROM pts), m AS (SELECT *, (coalesce(lo, hi) + coalesce(hi, lo)) / 2 * 29 AS mid FROM a)
SELECT event_id, chrom, pos, round(mid, 6) AS mid_age FROM m WHERE mid >= 3000 AND NOT (chrom = '6' AND pos BETWEEN 1704500000 AND 1705500000)""")
def select_candidates(spark, d):
    rows = points(spark, d).select(N, "chrom", "pos", F.when(_n(5) > 0, e("value")).alias("lower_age"), F.when(_n(7) > 0, e("value") * 2).alias("upper_age"))
    years = S.GENERATION_YEARS / 29
    return G.select_candidates(rows, 3000 * years, ("6", 1_704_500_000, 1_705_500_000)).select(N, "chrom", "pos", r6(e("mid_age") / years, "mid_age"))


_CANDIDATES = """cand AS (SELECT 'r' || event_id % 150 AS region, (event_id % 150 % 9)::VARCHAR AS chrom, event_id % 400 AS pos FROM events WHERE event_type = 'error'),
called AS (SELECT DISTINCT 'r' || event_id % 150 AS region, CASE WHEN event_id % 150 % 4 = 0 THEN 'z' ELSE (event_id % 150 % 9)::VARCHAR END AS chrom, event_id % 400 AS pos FROM events WHERE event_type IN ('view', 'click') AND event_id % 150 % 5 > 0)"""


@query(f"""WITH {_CANDIDATES}, n AS (SELECT region, min(chrom) AS chrom, count(*) AS n_candidates, count(*) FILTER (EXISTS (SELECT 1 FROM called c WHERE c.region = cand.region AND c.chrom = cand.chrom AND c.pos = cand.pos)) AS n_exact, count(*) FILTER (EXISTS (SELECT 1 FROM called c WHERE c.region = cand.region AND c.pos = cand.pos)) AS n_loose FROM cand GROUP BY region)
SELECT *, CASE WHEN n_exact > 0 THEN 'ok' WHEN n_loose > 0 THEN 'cross' ELSE 'lost' END AS status FROM n""")
def candidate_presence(spark, d):
    ev, group = _t(spark, d, "events"), _n(150)
    region = F.concat(F.lit("r"), group.cast("string")).alias("region")
    candidates = ev.where("event_type = 'error'").select(region, (group % 9).cast("string").alias("chrom"), _n(400).alias("pos"))
    sites = ev.where((F.col("event_type").isin("view", "click")) & (group % 5 > 0)).select(region, F.when(group % 4 == 0, "z").otherwise((group % 9).cast("string")).alias("chrom"), _n(400).alias("pos"))
    return G.candidate_presence(sites, candidates, candidates.select("region").limit(0))[0].select("region", "chrom", "n_candidates", "n_exact", "n_loose", "status")


@query("""WITH rg AS (SELECT chrom || ':' || pos // 86400 AS region, chrom, min(pos) AS start, max(pos) AS "end" FROM pts WHERE event_type = 'view' GROUP BY chrom, pos // 86400),
c AS (SELECT event_id, p.chrom, pos, region FROM pts p LEFT JOIN rg ON p.chrom = rg.chrom AND pos BETWEEN start AND "end" WHERE event_type = 'error')
SELECT event_id, chrom, pos, region, CASE WHEN region IS NULL THEN 'no_region' WHEN EXISTS (SELECT 1 FROM pts t WHERE t.event_type = 'error' AND t.event_id % 3 = 0 AND t.chrom = c.chrom AND t.pos = c.pos) THEN 'tested' WHEN region[-1] = '1' THEN 'excluded_region' WHEN region[-1] IN ('2', '3', '4') THEN 'site_absent' ELSE 'region_unfinished' END AS status FROM c""")
def candidate_status(spark, d):
    p = points(spark, d)
    name = F.concat_ws(":", "chrom", F.floor(e("pos") / 86400).cast("string"))
    regions = p.where("event_type = 'view'").groupBy(name.alias("region"), "chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    candidates = p.where("event_type = 'error'").select(N, "chrom", "pos")
    last = F.substring("region", -1, 1)
    out = G.candidate_status(candidates, regions, regions.where(last == "1"), candidates.where(_n(3) == 0), regions.where(last.isin("2", "3", "4")))
    return out.select(N, "chrom", "pos", "region", "status")


@query("""WITH l AS (SELECT event_id, chrom, CASE WHEN event_id % 9 > 0 THEN event_id % 300 END AS pos FROM pts WHERE event_type = 'error'), p AS (SELECT DISTINCT chrom, event_id % 300 AS pos FROM pts WHERE event_type = 'view'), f AS (SELECT DISTINCT chrom, event_id % 300 AS pos FROM pts WHERE event_type = 'click')
SELECT event_id, chrom, pos, CASE WHEN pos IS NULL THEN 'no_candidate' WHEN chrom IN ('2', '5') THEN 'no_file' WHEN (chrom, pos) IN (SELECT (chrom, pos) FROM p) THEN 'passed' WHEN (chrom, pos) IN (SELECT (chrom, pos) FROM f) THEN 'failed' ELSE 'never_called' END AS reason FROM l""")
def loss_reason(spark, d):
    p = points(spark, d)
    cut = lambda kind: p.where(F.col("event_type") == kind).select("chrom", _n(300).alias("pos"))
    lost = p.where("event_type = 'error'").select(N, "chrom", F.when(_n(9) > 0, _n(300)).alias("pos"))
    return G.loss_reason(lost, cut("view"), cut("click"), p.select("chrom").where("chrom not in ('2', '5')")).select(N, "chrom", "pos", "reason")


@query("""WITH g AS (SELECT DISTINCT event_id AS id, 's' || event_id % 40 AS study FROM events), s AS (SELECT 's' || range AS study, CASE WHEN range % 6 > 0 THEN ['Height (MTAG)', 'Body  mass', 'Trait (baseline) x, '][range % 3 + 1] || range % 7 END AS trait FROM range(40))
SELECT DISTINCT id, regexp_replace(regexp_replace(CASE WHEN study[2:]::INT % 3 = 0 THEN 'Height' || study[2:]::INT % 7 WHEN study[2:]::INT % 3 = 1 THEN trait ELSE 'Trait x, ' || study[2:]::INT % 7 END, '\\s{2,}', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g') AS trait FROM g JOIN s USING (study) WHERE trait IS NOT NULL""")
def gwas_hits(spark, d):
    gwas = _t(spark, d, "events").select(e(N).alias("id"), F.concat(F.lit("s"), _n(40).cast("string")).alias("study"))
    k = F.col("id")
    name = F.when(k % 3 == 0, "Height (MTAG)").when(k % 3 == 1, "Body  mass").otherwise("Trait (baseline) x, ")
    studies = spark.range(40).select(F.concat(F.lit("s"), k.cast("string")).alias("study"), F.when(k % 6 > 0, F.concat(name, (k % 7).cast("string"))).alias("trait"))
    return G.gwas_hits(gwas, studies)


_REGIONS = """rg AS (SELECT chrom || ':' || pos // 172800 AS region, chrom, min(pos) AS start, max(pos) AS "end" FROM pts WHERE event_type = 'view' GROUP BY chrom, pos // 172800),
sn AS (SELECT chrom || ':' || pos // 172800 AS region, value, event_type AS kind, 'T' || event_id % 5 AS trait FROM pts WHERE event_type IN ('view', 'click'))"""


@query(f"""WITH {_REGIONS}, su AS (SELECT region, count(*) AS n_snps, avg(value) AS mv, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS kinds FROM sn GROUP BY region),
tc AS (SELECT region, trait, count(*) AS n, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, lower(trait), trait) AS k, count(*) OVER (PARTITION BY region) AS m FROM sn GROUP BY region, trait), tr AS (SELECT region, string_agg(trait, '; ' ORDER BY k) FILTER (k <= 2) || CASE WHEN max(m) > 2 THEN ' (+' || max(m) - 2 || ' more)' ELSE '' END AS traits FROM tc GROUP BY region),
tg AS (SELECT rg.region, string_agg(DISTINCT 'p' || e.event_id % 3, '; ' ORDER BY 'p' || e.event_id % 3) AS sets FROM rg JOIN pts e ON e.event_type = 'purchase' AND e.chrom = rg.chrom AND e.pos BETWEEN rg.start AND rg."end" GROUP BY 1)
SELECT rg.region, sets, n_snps, round(mv, 6) AS mean_value, kinds, traits, 'g' || rg.start % 9 AS assigned_gene, rg."end" - rg.start AS span, CASE WHEN mv <= 20 THEN 1 WHEN mv <= 60 THEN 2 WHEN mv <= 100 THEN 3 WHEN mv <= 1000 THEN 4 END AS decile FROM rg LEFT JOIN su USING (region) LEFT JOIN tr USING (region) LEFT JOIN tg USING (region) WHERE n_snps > 1""")
def region_tables(spark, d):
    """The table of regions of several sites: summary, gene, span, overlaps, traits and the mean's bin."""
    p = points(spark, d)
    name = F.concat_ws(":", "chrom", F.floor(e("pos") / 172_800).cast("string")).alias("region")
    regions = p.where("event_type = 'view'").groupBy(name, "chrom").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    snps = p.where("event_type in ('view', 'click')").select(name, "value", F.col("event_type").alias("kind"), F.concat(F.lit("T"), _n(5).cast("string")).alias("trait"))
    genes = regions.select("region", F.concat(F.lit("g"), (F.col("start") % 9).cast("string")).alias("assigned_gene"), F.lit("nearest").alias("tier"))
    spans = regions.withColumn("span", F.col("end") - F.col("start"))
    published = p.where("event_type = 'purchase'").select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), F.concat(F.lit("p"), _n(3).cast("string")).alias("set"), F.lit("x").alias("name"))
    many = G.region_tables(regions, snps, genes, spans, published, snps.select("region", "trait"), [0, 20, 60, 100, 1000])[1]
    return many.select("region", "sets", "n_snps", r6("mean_value", "mean_value"), "kinds", "traits", "assigned_gene", "span", "decile")


@query("""WITH c AS (SELECT pos, event_id % 3 AS k, max(event_id % 101) AS s FROM pts WHERE chrom = '4' AND pos BETWEEN 1704300000 AND 1706300000 GROUP BY ALL), w AS (SELECT pos, avg(s) AS mean FROM c GROUP BY pos),
a AS (SELECT pos, min(('ACGT'[event_id % 4 + 1], 'ACGT'[event_id // 4 % 4 + 1])) AS x FROM pts WHERE chrom = '4' AND event_id % 5 > 0 GROUP BY pos)
SELECT '4' AS chrom, pos, x[1] AS ref, x[2] AS alt, round(mean, 6) AS mean FROM w LEFT JOIN a USING (pos)""")
def support_track(spark, d):
    p = points(spark, d)
    chain = lambda k: p.where(_n(3) == k).groupBy("chrom", "pos").agg(F.max(_n(101)).alias("support"))
    alleles = p.where(_n(5) > 0).select("chrom", "pos", base(e(N)).alias("ref"), base(F.floor(e(N) / 4)).alias("alt"))
    return G.support_track([chain(0), chain(1), chain(2)], alleles, "4", 1_704_300_000, 1_706_300_000).withColumn("mean", r6("mean"))


@query("""WITH f AS (SELECT DISTINCT 'g' || user_id % 60 AS gene FROM events WHERE event_type = 'error'), n AS (SELECT DISTINCT event_id % 6 AS replicate, 'g' || event_id % 90 AS gene FROM events WHERE event_type = 'view'),
u AS (SELECT count(*) AS universe FROM (SELECT gene FROM f UNION SELECT gene FROM n)) SELECT replicate, string_agg(gene, ',' ORDER BY gene) AS genes, max(universe) AS universe FROM n, u GROUP BY replicate""")
def background_universe(spark, d):
    ev = _t(spark, d, "events")
    fg = ev.where("event_type = 'error'").select(F.concat(F.lit("g"), (F.col("user_id") % 60).cast("string")).alias("gene"))
    nulls = ev.where("event_type = 'view'").select(_n(6).alias("replicate"), F.concat(F.lit("g"), _n(90).cast("string")).alias("gene"))
    genes, by_replicate = G.background_universe(fg, nulls)
    return by_replicate.crossJoin(F.broadcast(genes.agg(F.count(F.lit(1)).alias("universe"))))  # one row


@query("SELECT event_type AS tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def tier_shares(spark, d):
    return G.tier_shares(_t(spark, d, "events"), "event_type").select(F.col("event_type").alias("tier"), "n", r6("share", "share"))


@query("""WITH x AS (SELECT event_id, event_id % 100 / 1000 AS pf, event_id % 90 / 1000 AS pc, event_id % 30 / 10 AS ff, event_id % 17 / 10 AS fc FROM events)
SELECT event_id, CASE WHEN pf < 0.05 AND ff > 1 AND pc < 0.05 AND fc > 1 THEN 'both' WHEN pf < 0.05 AND ff > 1 THEN 'fraction' WHEN pc < 0.05 AND fc > 1 THEN 'count' ELSE 'none' END AS verdict FROM x""")
def verdict(spark, d):
    rows = _t(spark, d, "events").select(N, (_n(100) / 1000).alias("p_frac_adjusted"), (_n(90) / 1000).alias("p_count_adjusted"), (_n(30) / 10).alias("fold_frac"), (_n(17) / 10).alias("fold_count"))
    return E.verdict(rows).select(N, "verdict")


@query("""WITH p AS (SELECT DISTINCT event_type AS category, event_id // 8 % 20 AS resolution, 'g' || event_id % 8 AS gene FROM events WHERE event_id % 8 < 4 OR event_id // 8 % 20 < 9), n AS (SELECT category, gene, count(*) / 20 AS s FROM p GROUP BY ALL)
SELECT category, gene, gene || '(' || round_even(100 * s, 0)::INT || '%)' AS label FROM n WHERE s >= 0.5""")
def driver_genes(spark, d):
    picks = _t(spark, d, "events").where((_n(8) < 4) | (_n(20, 8) < 9)).select(F.col("event_type").alias("category"), _n(20, 8).alias("resolution"), F.concat(F.lit("g"), _n(8).cast("string")).alias("gene"))
    return E.driver_genes(picks, 20)


@query("""WITH a AS (SELECT event_type AS condition, event_id AS category, (event_id % 997 + 1) / 1000 AS p, (event_id % 50)::DOUBLE AS fold FROM events), b AS (SELECT condition, category, p * p AS p, fold * 2 AS fold FROM a WHERE category % 3 > 0),
x AS (SELECT *, count(*) OVER (PARTITION BY condition) AS m, count(*) OVER (PARTITION BY condition ORDER BY p) AS r FROM a), y AS (SELECT *, count(*) OVER (PARTITION BY condition) AS m, count(*) OVER (PARTITION BY condition ORDER BY p) AS r FROM b),
x1 AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY condition ORDER BY p DESC)) AS q FROM x), y1 AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY condition ORDER BY p DESC)) AS q FROM y)
SELECT condition, category, round(x1.p, 6)::DOUBLE AS p_1, x1.fold AS fold_1, round(x1.q, 6)::DOUBLE AS p_adjusted_1, round(y1.p, 6)::DOUBLE AS p_2, y1.fold AS fold_2, round(y1.q, 6)::DOUBLE AS p_adjusted_2 FROM x1 LEFT JOIN y1 USING (condition, category)""")
def summary_table(spark, d):
    a = _t(spark, d, "events").select(F.col("event_type").alias("condition"), F.col(N).alias("category"), ((_n(997) + 1) / 1000).alias("p"), _n(50).cast("double").alias("fold"))
    b = a.where("category % 3 > 0").select("condition", "category", (F.col("p") * F.col("p")).alias("p"), (F.col("fold") * 2).alias("fold"))
    out = E.summary_table(a, b, ["category"], "condition")
    return out.select("condition", "category", *[r6(c, c) if c.startswith("p") else c for c in ("p_1", "fold_1", "p_adjusted_1", "p_2", "fold_2", "p_adjusted_2")])


@query("""WITH sp AS (SELECT 'g' || event_id % 50 AS gene, chrom, start, "end" FROM iv WHERE event_type = 'purchase' AND event_id % 50 < 30), s AS (SELECT chrom, pos, 'g' || event_id % 40 AS gene FROM pts WHERE event_type = 'view')
SELECT DISTINCT s.chrom, pos, s.gene, sp.gene AS in_gene, s.gene <> sp.gene AS differs FROM s JOIN sp ON s.chrom = sp.chrom AND pos - 1 < sp."end" AND sp.start < pos""")
def tag_gene_containment(spark, d):
    gene = lambda k: F.concat(F.lit("g"), _n(k).cast("string")).alias("gene")
    spans = intervals(spark, d, "purchase").select("chrom", "start", "end", gene(50))
    snps = points(spark, d).where("event_type = 'view'").select("chrom", "pos", gene(40))
    return I.tag_gene_containment(snps, spans, spark.range(30).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene")), width=4096)


@query("""WITH n AS (SELECT event_id % 90 AS region, 'g' || user_id % 12 AS gene, count(*) AS n, min(event_id % 500) AS distance FROM events GROUP BY ALL) SELECT region, gene, n, distance FROM n QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, distance, gene) = 1""")
def majority_nearest(spark, d):
    rows = _t(spark, d, "events").select(_n(90).alias("region"), F.concat(F.lit("g"), (F.col("user_id") % 12).cast("string")).alias("gene"), _n(500).alias("distance"))
    return G.majority_nearest(rows)


@query(f"""WITH c AS (SELECT event_type AS stratum, count(*) AS c FROM events GROUP BY 1), q AS (SELECT stratum, round_even(c * 700 / (SELECT count(*) FROM events), 0)::BIGINT AS q, row_number() OVER (ORDER BY c DESC, stratum) AS k FROM c), r AS (SELECT stratum, q + CASE WHEN k = 1 THEN 700 - (SELECT sum(q) FROM q) ELSE 0 END AS q FROM q),
s AS (SELECT 's' || event_id AS sample, event_type AS stratum, {D.sql_text_draw(1 << 59, 11, "'s' || event_id")} AS h FROM events) SELECT sample, stratum FROM s JOIN r USING (stratum) QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY h, sample) <= q""")
def stratified_downsample(spark, d):
    rows = _t(spark, d, "events").select(F.concat(F.lit("s"), e(N).cast("string")).alias("sample"), F.col("event_type").alias("stratum"))
    return GT.stratified_downsample(rows, 700, 11, "stratum").select("sample", "stratum")


_LOCI = "lo AS (SELECT 'L' || user_id AS locus, list_sort(list_distinct(list('g' || event_id % 300))) AS genes FROM events WHERE event_type = 'error' GROUP BY 1), se AS (SELECT DISTINCT 'lib' AS library, p_brand AS category, 'g' || p_partkey % 300 AS gene FROM part), un AS (SELECT DISTINCT 'g' || event_id % 300 AS gene FROM events)"


@query(f"""WITH {_LOCI}, pk AS (SELECT DISTINCT r.range AS resolution, genes[{D.sql_text_draw('len(genes)', 5, 'r.range', 'locus')} + 1] AS gene FROM lo, range(25) r),
ins AS (SELECT category, gene FROM se SEMI JOIN un USING (gene)), sz AS (SELECT category, count(*) AS s FROM ins GROUP BY 1), dn AS (SELECT resolution, count(*) AS n FROM pk SEMI JOIN un USING (gene) GROUP BY 1), kk AS (SELECT resolution, category, count(*) AS k FROM pk JOIN ins USING (gene) GROUP BY ALL), t AS (SELECT count(*) AS t FROM un),
h AS (SELECT resolution, category, (k / n) / (s / t) AS fold, least(1, (SELECT sum(exp(lgamma(s + 1) - lgamma(x + 1) - lgamma(s - x + 1) + lgamma(t - s + 1) - lgamma(n - x + 1) - lgamma(t - s - n + x + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1))) FROM (SELECT unnest(range(k, least(s, n) + 1)) AS x) WHERE t - s - n + x >= 0)) AS p FROM kk JOIN dn USING (resolution) JOIN sz USING (category), t),
m AS (SELECT *, count(*) OVER (PARTITION BY resolution) AS m, count(*) OVER (PARTITION BY resolution ORDER BY p) AS r FROM h), a AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY resolution ORDER BY p DESC)) AS q FROM m)
SELECT category, round(quantile_cont(fold, 0.5), 5) AS median_fold, round(quantile_cont(p, 0.5), 5) AS median_p, count(*) / 25 AS tested, count(*) FILTER (q < 0.9) / 25 AS passing FROM a GROUP BY category""")
def tiebreak_enrichment(spark, d):
    """One candidate gene a locus in each of 25 resolutions, tested in each."""
    gene = lambda k: F.concat(F.lit("g"), (F.col(k) % 300).cast("string"))
    ev = _t(spark, d, "events")
    loci = ev.where("event_type = 'error'").groupBy(F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("locus")).agg(F.array_sort(F.collect_set(gene(N))).alias("genes"))
    sets = _t(spark, d, "part").select(F.lit("lib").alias("library"), F.col("p_brand").alias("category"), gene("p_partkey").alias("gene")).distinct()
    out = E.tiebreak_enrichment(loci, sets, ev.select(gene(N).alias("gene")).distinct(), 25, 5, 0.9)
    return out.select("category", F.round("median_fold", 5).alias("median_fold"), F.round("median_p", 5).alias("median_p"), "tested", "passing")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT p_brand AS category, p_partkey % 300 AS gene FROM part WHERE p_size < 30),
g(step, category, n, covered) AS (SELECT 0, NULL::VARCHAR, 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.step + 1, t.category, t.n, list_concat(g.covered, (SELECT list(gene) FROM s WHERE s.category = t.category)) FROM g, LATERAL (SELECT category, count(*) AS n FROM s WHERE NOT list_contains(g.covered, gene) GROUP BY category ORDER BY n DESC, category LIMIT 1) t)
SELECT category, n FROM g WHERE step > 0""")
def greedy_cover(spark, d):
    sets = _t(spark, d, "part").where("p_size < 30").select(F.col("p_brand").alias("category"), (F.col("p_partkey") % 300).alias("gene"))
    return E.cover_rounds(sets).select("category", "n")


# -- nested evidence, components ---------------------------------------------------------------------------------------
@query(f"""WITH e AS ({EVIDENCE}), q AS (SELECT id, gene, max(pip) AS pip, count(*) AS n_sets FROM e WHERE kind IN ('eqtl', 'sqtl') GROUP BY 1, 2), g AS (SELECT id, symbol AS gene, max(score) AS l2g FROM e WHERE kind = 'gwas' AND symbol IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(q.id, g.id)::VARCHAR AS id, coalesce(q.gene, g.gene) AS gene, pip, n_sets, l2g FROM q FULL JOIN g ON q.id = g.id AND q.gene = g.gene""")
def read_evidence(spark, d):
    """Nested records written as one JSON object a line and read back."""
    path = fresh_path(spark, "evidence")
    evidence(spark, d).withColumn("id", F.col("id").cast("string")).write.json(path, compression="gzip")
    return G.best_evidence(*G.flatten_evidence(T.read_evidence(spark, path))).select("id", "gene", "pip", "n_sets", "l2g")


@query(f"""WITH e AS ({EVIDENCE}), q AS (SELECT id % 50 AS region, gene, count(DISTINCT tissue) AS t, count(DISTINCT kind) AS k, count(*) AS s FROM e WHERE kind IN ('eqtl', 'sqtl') GROUP BY 1, 2),
g AS (SELECT id % 50 AS region, symbol AS gene, max(score) AS l2g FROM e WHERE kind = 'gwas' AND symbol IS NOT NULL AND id % 2 = 0 GROUP BY 1, 2 HAVING max(score) >= 0.5),
q1 AS (SELECT region, gene FROM q QUALIFY row_number() OVER (PARTITION BY region ORDER BY t DESC, k DESC, s DESC, gene) = 1), g1 AS (SELECT region, gene FROM g QUALIFY row_number() OVER (PARTITION BY region ORDER BY l2g DESC, gene) = 1)
SELECT (q1.region % 5)::INT AS replicate, coalesce(g1.gene, q1.gene) AS gene, CASE WHEN g1.gene IS NOT NULL THEN 'l2g' ELSE 'molqtl' END AS tier FROM q1 LEFT JOIN g1 USING (region)""")
def reassign_null(spark, d):
    """The gene rule over null loci of five replicates."""
    qtl, gwas = G.flatten_evidence(evidence(spark, d))
    k = F.col("id") % 50
    variants = spark.range(500).select((k % 5).alias("replicate"), F.floor(k / 5).alias("locus"), "id", F.lit("1").alias("chrom"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 1).alias("end"))
    genes = _t(spark, d, "supplier").select(F.lit("1").alias("chrom"), (F.col("s_suppkey") * 700).alias("start"), (F.col("s_suppkey") * 700 + 90).alias("end"), F.col("s_name").alias("gene"))
    return G.reassign_null(variants, qtl, gwas.where("id % 2 = 0"), genes)


@query("""WITH g AS (SELECT vec_id, CASE WHEN embedding[i] < -0.3 THEN 0 WHEN embedding[i] < 0.3 THEN 1 ELSE 2 END AS x FROM embeddings, unnest(range(1, 65)) t(i)), p AS (SELECT vec_id, avg(x) / 2 AS p FROM g GROUP BY 1)
SELECT 64 AS n, round(sum((x - 2 * p) * (x - 2 * p) / (2 * p * (1 - p))) / count(DISTINCT vec_id), 4) AS total FROM g JOIN p USING (vec_id) WHERE p > 0 AND p < 1""")
def genotype_pca(spark, d):
    """All components of the genotypes: how many, and the sum of their eigenvalues, which is the trace."""
    x = F.transform("embedding", lambda v: F.when(v < -0.3, 0).when(v < 0.3, 1).otherwise(2))
    values, _ = GT.genotype_pca(_t(spark, d, "embeddings").select(x.alias("dosages")), 64)
    return spark.createDataFrame([(len(values), round(float(sum(values)), 4))], "n int, total double")
