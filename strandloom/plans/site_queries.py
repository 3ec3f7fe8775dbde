"""More queries over the driver tables, with DuckDB SQL for the same rows: site filters, lookups, tables and gene evidence.
They add themselves to the catalog's registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions import scalars as S
from strandloom.operators import bins as B, genes as G, sites as J
from strandloom.plans.catalog import _t, intervals, query, r6
from strandloom.sources import text as T

SITES = """SELECT l_orderkey AS pos, l_linenumber AS line, (l_partkey % 27)::VARCHAR AS chrom, l_returnflag AS ref, l_linestatus AS alt,
l_discount * 10 AS af, l_quantity::BIGINT AS ac, l_tax AS tax FROM lineitem"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 27).cast("string").alias("chrom"), F.col("l_returnflag").alias("ref"),
        F.col("l_linestatus").alias("alt"), (F.col("l_discount") * 10).alias("af"), F.col("l_quantity").cast("long").alias("ac"), F.col("l_tax").alias("tax"),
    )


# -- filters --------------------------------------------------------------------------------------------------------
@query(f"WITH s AS ({SITES}) SELECT pos, line, af FROM s WHERE af <> 0 AND af <> 1")
def variable_sites(spark, d):
    return J.variable_only(sites(spark, d)).select("pos", "line", "af")


@query(f"WITH s AS ({SITES}) SELECT 'above' AS kind, pos, line, ac FROM s WHERE ac > 40 UNION ALL SELECT 'at least', pos, line, ac FROM s WHERE ac >= 40")
def min_allele_count(spark, d):
    rows = sites(spark, d)
    kinds = {"above": J.min_ac(rows, 40), "at least": J.min_ac(rows, 40, strict=False)}
    return T.concat_parts([df.select(F.lit(k).alias("kind"), "pos", "line", "ac") for k, df in kinds.items()])


@query(f"WITH s AS ({SITES}) SELECT pos, line, coalesce(n_name, chrom) AS chrom FROM s LEFT JOIN nation ON chrom = n_nationkey::VARCHAR")
def rename_chromosomes(spark, d):
    names = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    return J.rename_chroms(sites(spark, d), names).select("pos", "line", "chrom")


@query(f"WITH s AS ({SITES}) SELECT pos, line, CASE WHEN line = 1 THEN chrom || '_' || pos || '_' || ref || '_' || alt ELSE 'known' END AS id FROM s")
def site_ids(spark, d):
    named = sites(spark, d).withColumn("id", F.when(F.col("line") == 1, ".").otherwise("known"))
    return J.set_ids(named, ["chrom", "pos", "ref", "alt"], only_missing=True).select("pos", "line", "id")


@query("SELECT event_id, chrom FROM (SELECT event_id, CASE WHEN chrom = '7' THEN 'X' ELSE 'chr' || chrom END AS chrom FROM pts) WHERE regexp_matches(chrom, '^(chr)?[0-9]+$')")
def autosomes(spark, d):
    named = intervals(spark, d).withColumn("chrom", F.when(F.col("chrom") == "7", "X").otherwise(F.concat(F.lit("chr"), "chrom")))
    return J.keep_chroms(named).select("event_id", "chrom")


@query('SELECT event_id, start, "end" FROM iv WHERE "end" - start > 1000 AND "end" - start < 2500')
def length_bands(spark, d):
    return J.length_band(intervals(spark, d), 1000, 2500).select("event_id", "start", "end")


@query(f"WITH s AS ({SITES}) SELECT pos, line, ac >= 25 AS at_least, ac > 25 AS above FROM s")
def threshold_passes(spark, d):
    return sites(spark, d).select("pos", "line", J.passes("ac", 25, True).alias("at_least"), J.passes("ac", 25, False).alias("above"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'B%' THEN 'one' WHEN c_mktsegment LIKE 'M%' THEN 'two' ELSE 'rest' END AS species FROM customer")
def classify_samples(spark, d):
    return J.classify_samples(_t(spark, d, "customer"), {"one": ["A", "B"], "two": ["M"]}, "rest", "c_mktsegment").select("c_custkey", "species")


@query("""SELECT "set", sample FROM (SELECT c_mktsegment AS "set", c_name AS sample FROM customer UNION ALL SELECT 'ALL', c_name FROM customer)""")
def sample_sets(spark, d):
    return J.sample_sets(_t(spark, d, "customer").select(F.col("c_mktsegment").alias("super_pop"), F.col("c_name").alias("sample")))


@query("""SELECT c_custkey, CASE WHEN pc1 > 0 THEN 'A' WHEN pc1 < 0 AND pc2 < 0 THEN 'B' WHEN pc1 < 0 AND pc2 > 0 THEN 'C' END AS label
FROM (SELECT c_custkey, c_acctbal - 2000 AS pc1, c_custkey % 7 - 3 AS pc2 FROM customer)""")
def pc_sign_labels(spark, d):
    scores = _t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") - 2000).alias("pc1"), (F.col("c_custkey") % 7 - 3).alias("pc2"))
    return J.label_by_pc_sign(scores).select("c_custkey", "label")


@query(f"""WITH s AS ({SITES}) SELECT kind, n FROM (SELECT 'species ' || ref AS kind, count(*) AS n FROM s WHERE line IN (1, 3) GROUP BY ref)""")
def keep_samples(spark, d):
    long = sites(spark, d).withColumn("sample", F.col("line").cast("string"))
    return J.keep_samples(long, ["1", "3", "unknown"]).groupBy(F.concat(F.lit("species "), "ref").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# -- lookups ---------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def keep_sites(spark, d):
    listed = _t(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.keep_sites(_t(spark, d, "lineitem"), listed, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, upper(n_name) AS c_name, c_mktsegment, n_regionkey AS extra FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 30")
def transfer_annotations(spark, d):
    dst = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") % 30).cast("int").alias("k"))
    src = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("c_name"), F.col("n_regionkey").alias("extra"), F.lit("no").alias("c_mktsegment"))
    return J.transfer_annotations(dst, src, ["c_mktsegment"], ["k"]).select("c_custkey", "c_name", "c_mktsegment", "extra")


@query("SELECT o_orderkey, s_name FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def attach_annotation(spark, d):
    ann = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return J.attach_annotation(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), ann, ["k"]).select("o_orderkey", "s_name")


@query("SELECT o_orderkey, s_acctbal, (SELECT count(*) FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey WHERE s_suppkey IS NULL) AS n_unmatched FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def lookup_subset(spark, d):
    scored = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    rows, missing = J.lookup_subset(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), scored, ["k"], ["s_acctbal"])
    return rows.crossJoin(F.broadcast(missing)).select("o_orderkey", "s_acctbal", "n_unmatched")  # one row of counts


@query("SELECT 'row' AS kind, p_partkey AS k FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'missing', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT p_partkey FROM part))")
def subset_by_ids(spark, d):
    rows, missing = J.subset_by_ids(_t(spark, d, "part").select(F.col("p_partkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")
    return rows.select(F.lit("row").alias("kind"), "k").unionByName(missing.select(F.lit("missing").alias("kind"), "k"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def reorder_by(spark, d):
    order = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("rank"))
    return J.reorder_by(_t(spark, d, "customer").select("c_custkey", "c_name"), order, "c_custkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT s_suppkey AS k FROM supplier)
SELECT 'both' AS kind, k FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'only_a', k FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT 'only_b', k FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark, d):
    found = J.set_operations(_t(spark, d, "orders").select(F.col("o_custkey").alias("k")), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return T.union_tagged(found, r"(\w+)", ["kind"])


@query(f"""WITH s AS ({SITES}), c AS (SELECT 0 AS step, 'all' AS name, count(*) AS n FROM s UNION ALL SELECT 1, 'variable', count(*) FROM s WHERE af <> 0 AND af <> 1
UNION ALL SELECT 2, 'counted', count(*) FROM s WHERE af <> 0 AND af <> 1 AND ac > 10) SELECT step, name, n, lag(n) OVER (ORDER BY step) - n AS removed FROM c""")
def step_counts(spark, d):
    rows = sites(spark, d)
    return B.step_counts({"all": rows, "variable": J.variable_only(rows), "counted": J.min_ac(J.variable_only(rows), 10)})


@query("SELECT 'EUR' AS pop, 'chr1' AS chrom, c_custkey AS k FROM customer UNION ALL SELECT 'AFR', 'chr2', s_suppkey FROM supplier UNION ALL SELECT 'ALL', 'all', o_orderkey FROM orders")
def union_tagged(spark, d):
    own = {"EUR.chr1.tsv": ("customer", "c_custkey"), "AFR.chr2.tsv": ("supplier", "s_suppkey")}
    tagged = T.union_tagged({n: _t(spark, d, t).select(F.col(k).alias("k")) for n, (t, k) in own.items()}, r"(\w+)\.(\w+)\.tsv", ["pop", "chrom"])
    return T.concat_parts([tagged, _t(spark, d, "orders").select(F.lit("ALL").alias("pop"), F.lit("all").alias("chrom"), F.col("o_orderkey").alias("k"))])


# -- scalars ---------------------------------------------------------------------------------------------------------
@query(f"WITH s AS ({SITES}) SELECT pos, line, round(CASE WHEN ref = alt THEN 1 - af ELSE af END, 6) AS daf FROM (SELECT pos, line, af, CASE WHEN line % 2 = 0 THEN alt ELSE ref END AS ref, alt FROM s)")
def derived_frequency(spark, d):
    aa = F.when(F.col("line") % 2 == 0, F.col("alt")).otherwise(F.col("ref"))
    return sites(spark, d).select("pos", "line", r6(S.derived_af(F.col("af"), aa, F.col("alt")), "daf"))


@query("SELECT o_orderkey, round(greatest(1e-300, least(1.0, pow(10.0, -o_totalprice / 100000))), 6) AS p, round(o_totalprice * 29, 4) AS years FROM orders")
def p_values_and_years(spark, d):
    price = F.col("o_totalprice")
    return _t(spark, d, "orders").select("o_orderkey", r6(S.as_pvalue(price / 100000), "p"), F.round(S.to_years(price, 29), 4).alias("years"))


@query("""SELECT p_partkey, p_brand || '|' || 'kind' || '|' || p_type || '|pip=' || printf('%.3f', p_size / 4096.0) AS evidence,
p_brand || '(' || printf('%.2f', p_size * 1.0) || ')' AS score, least(p_size::DOUBLE, p_retailprice / 100) AS low FROM part""")
def evidence_text(spark, d):
    size = F.col("p_size")
    return _t(spark, d, "part").select(
        "p_partkey", S.format_evidence(F.col("p_brand"), F.lit("kind"), F.col("p_type"), size / 4096.0).alias("evidence"),
        S.format_score(F.col("p_brand"), size.cast("double")).alias("score"), B.row_min(size.cast("double"), F.col("p_retailprice") / 100).alias("low"),
    )


@query("SELECT p_partkey, regexp_replace(replace(p_type, ' ', '_') || '_variant', '_variant|_region', '', 'g') AS label FROM part")
def clean_labels(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.clean_labels(F.concat(F.regexp_replace("p_type", " ", "_"), F.lit("_variant"))).alias("label"))


@query("SELECT p_partkey, regexp_replace(p_name, '\\s{2,}', ' ', 'g') || ' level' AS trait FROM part")
def trait_names(spark, d):
    noted = F.concat("p_name", F.lit(" level (UKB data field 12)"), F.lit(" ;"))
    return _t(spark, d, "part").select("p_partkey", S.normalise_trait(noted).alias("trait"))


# -- summaries -------------------------------------------------------------------------------------------------------
@query("SELECT n_nationkey, round(100 * b / sum(b) OVER (), 6) AS percent FROM (SELECT c_nationkey AS n_nationkey, count(*) AS b FROM customer GROUP BY 1)")
def variance_share(spark, d):
    counts = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("eigenvalue"))
    return B.variance_share(counts).select("n_nationkey", r6("percent", "percent"))


@query("""SELECT l_returnflag, round(median(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS "F", round(median(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS "O" FROM lineitem GROUP BY 1""")
def pivot_median(spark, d):
    out = B.pivot_median(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"])
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("F", "O")])


@query(f"""WITH s AS ({SITES}), f AS (SELECT line % 2 = 0 AS c, ac % 3 = 0 AS n FROM s)
SELECT round(count(*) FILTER (n AND NOT c) / nullif(count(*) FILTER (n), 0), 6) AS type1, round(count(*) FILTER (c AND NOT n) / nullif(count(*) FILTER (NOT n), 0), 6) AS type2,
round(100.0 * count(*) FILTER (c) / count(*), 6) AS percent_cpg FROM f""")
def cpg_error_rates(spark, d):
    flags = sites(spark, d).select((F.col("line") % 2 == 0).alias("c"), (F.col("ac") % 3 == 0).alias("n"))
    return B.cpg_error_rates(flags, "c", "n").select(*[r6(c, c) for c in ("type1", "type2", "percent_cpg")])


@query("""SELECT o_custkey AS region, count(*) AS n_snps, round(avg(o_totalprice), 6) AS mean_value, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1""")
def region_summary(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("region"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("kind"))
    return G.region_summary(rows).withColumn("mean_value", F.round("mean_value", 6))


# -- gene evidence ---------------------------------------------------------------------------------------------------
KINDS = ("gwas", "eQTL", "sqtl", "other")
EVIDENCE = """SELECT l_orderkey % 500 AS id, ['gwas', 'eqtl', 'sqtl', 'other'][l_linenumber % 4 + 1] AS kind, CASE WHEN l_suppkey % 3 = 0 THEN 'G' || l_partkey % 50 ELSE 'S' || l_suppkey % 40 END AS gene,
CASE WHEN l_suppkey % 3 <> 0 THEN 'S' || l_suppkey % 40 END AS symbol, l_returnflag AS tissue, l_discount AS pip, l_tax AS score FROM lineitem"""


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Nested records as the evidence reader gives them: a credible set for each line, by variant."""
    c = F.col
    symbol = F.when(c("l_suppkey") % 3 != 0, F.concat(F.lit("S"), c("l_suppkey") % 40))
    target = F.struct(F.lit("id").alias("id"), symbol.alias("approvedSymbol"))
    row = F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), (c("l_linenumber") % 4 + 1).cast("int")).alias("studyType"),
        F.concat(F.lit("G"), c("l_partkey") % 50).alias("qtlGeneId"),
        F.lit("high").alias("confidence"),
        F.struct(F.lit("s").alias("id"), target.alias("target"), F.struct(c("l_returnflag").alias("biosampleName")).alias("biosample")).alias("study"),
        F.struct(F.array(F.struct(c("l_discount").alias("posteriorProbability")), F.struct((c("l_discount") + 1).alias("posteriorProbability"))).alias("rows")).alias("locus"),
        F.struct(F.array(F.struct(c("l_tax").alias("score"), target.alias("target"))).alias("rows")).alias("l2GPredictions"),
    )
    lines = _t(spark, d, "lineitem").select((c("l_orderkey") % 500).alias("id"), row.alias("r"))
    return lines.groupBy("id").agg(F.struct(F.collect_list("r").alias("rows")).alias("credibleSets"))


@query(f"""WITH e AS ({EVIDENCE}), q AS (SELECT id, gene, max(pip) AS pip, count(DISTINCT tissue) AS n_tissues, count(DISTINCT kind) AS n_kinds, count(*) AS n_sets FROM e WHERE kind IN ('eqtl', 'sqtl') GROUP BY 1, 2),
g AS (SELECT id, symbol AS gene, max(score) AS l2g FROM e WHERE kind = 'gwas' AND symbol IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(q.id, g.id) AS id, coalesce(q.gene, g.gene) AS gene, pip, n_tissues, n_kinds, n_sets, l2g FROM q FULL JOIN g ON q.id = g.id AND q.gene = g.gene""")
def gene_evidence(spark, d):
    return G.best_evidence(*G.flatten_evidence(evidence(spark, d))).select("id", "gene", "pip", "n_tissues", "n_kinds", "n_sets", "l2g")


@query(f"""WITH e AS ({EVIDENCE}), q AS (SELECT id % 50 AS region, gene, count(DISTINCT tissue) AS t, count(DISTINCT kind) AS k, count(*) AS s FROM e WHERE kind IN ('eqtl', 'sqtl') GROUP BY 1, 2),
g AS (SELECT id % 50 AS region, symbol AS gene, max(score) AS l2g FROM e WHERE kind = 'gwas' AND symbol IS NOT NULL AND id % 2 = 0 GROUP BY 1, 2 HAVING max(score) >= 0.08),
q1 AS (SELECT region, gene FROM q QUALIFY row_number() OVER (PARTITION BY region ORDER BY t DESC, k DESC, s DESC, gene) = 1),
g1 AS (SELECT region, gene FROM g QUALIFY row_number() OVER (PARTITION BY region ORDER BY l2g DESC, gene) = 1)
SELECT q1.region, coalesce(g1.gene, q1.gene) AS assigned_gene, CASE WHEN g1.gene IS NOT NULL THEN 'l2g' ELSE 'molqtl' END AS tier FROM q1 LEFT JOIN g1 USING (region)""")
def assigned_genes(spark, d):
    qtl, gwas = G.flatten_evidence(evidence(spark, d))
    variants = spark.range(500).select((F.col("id") % 50).alias("region"), "id", F.lit("1").alias("chrom"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 1).alias("end"))
    genes = _t(spark, d, "supplier").select(F.lit("1").alias("chrom"), (F.col("s_suppkey") * 700).alias("start"), (F.col("s_suppkey") * 700 + 90).alias("end"), F.col("s_name").alias("gene"))
    regions, _ = G.assign_genes(variants, qtl, gwas.where("id % 2 = 0"), genes, 0.08)
    return regions.select("region", "assigned_gene", "tier")
