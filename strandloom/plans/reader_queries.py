"""Text formats written from the event table and read back, and the readers' rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.plans.catalog import _t, points, query
from strandloom.sources import text as T
from strandloom.storage import fresh_path

#: Events as variants: bases and alternatives by the event's number.
VARIANTS = """vs AS (SELECT event_id, event_type, value, chrom, pos, 'v' || event_id AS id, 'ACGT'[event_id % 4 + 1] || CASE WHEN event_id % 9 = 0 THEN 'T' ELSE '' END AS ref,
CASE WHEN event_id % 11 = 0 THEN ['G', 'C'] WHEN event_id % 13 = 0 THEN ['TT'] ELSE ['ACGT'[event_id // 4 % 4 + 1]] END AS alts FROM pts)"""


def base(n: Column) -> Column:
    return F.substring(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))


def variants(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    alts = F.when(e % 11 == 0, F.array(F.lit("G"), F.lit("C"))).when(e % 13 == 0, F.array(F.lit("TT"))).otherwise(F.array(base(F.floor(e / 4))))
    return points(spark, d).select("event_id", "event_type", "value", "chrom", "pos", F.concat(F.lit("v"), e.cast("string")).alias("id"), F.concat(base(e), F.when(e % 9 == 0, "T").otherwise("")).alias("ref"), alts.alias("alts"))


def _text(df: DataFrame, line: Column, label: str) -> str:
    path = fresh_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


@query(f"""WITH {VARIANTS} SELECT chrom, pos, id, ref, array_to_string(alts, ',') AS alts, value AS qual, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 / 100 END AS af, event_id % 5 = 0 AS db,
s.sample, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id + s.k) % 2 END::INT AS a0, ((event_id + s.k) // 2 % 2)::INT AS a1, s.k = 1 AS phased, (event_id % 40)::INT AS dp FROM vs, (VALUES ('s0', 0), ('s1', 1)) s(sample, k)""")
def read_vcf(spark, d):
    """Variant text with typed INFO fields and two samples' calls."""
    e = F.col("event_id")
    call = lambda k: F.concat(F.when(e % 6 == 0, ".").otherwise(((e + k) % 2).cast("string")), F.lit("/|"[k]), (F.floor((e + k) / 2) % 2).cast("string"), F.lit(":"), (e % 40).cast("string"))
    info = F.concat_ws(";", F.when(e % 3 != 0, F.concat(F.lit("AF="), (e % 100 / 100).cast("string"))), F.when(e % 5 == 0, "DB"))
    fields = ["chrom", F.col("pos").cast("string"), "id", "ref", F.array_join("alts", ","), F.col("value").cast("string"), F.lit("PASS"), F.when(info == "", ".").otherwise(info), F.lit("GT:DP"), call(0), call(1)]
    rows = variants(spark, d)
    path = _text(rows, F.concat_ws("\t", *fields), "vcf")
    _head = spark.range(1).select(F.lit("##fileformat=VCFv4.2").alias("value"))
    _head.write.mode("append").text(path)
    got = T.read_vcf(spark, path, {"AF": "double", "DB": "boolean"}, ["s0", "s1"])
    calls = T.site_table(got, ["chrom", "pos", "id", "ref", "alts", "qual", "AF", "DB"], genotypes=True)
    return calls.select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.col("AF").alias("af"), F.col("DB").alias("db"), "sample", "a0", "a1", "phased", "dp")


@query(f"WITH {VARIANTS} SELECT id, chrom, pos - 1 AS pos0, pos + length(ref) - 1 AS \"end\" FROM vs")
def site_table(spark, d):
    return T.site_table(variants(spark, d), ["id", "chrom", "pos0", "end"])


@query('SELECT chrom, start, "end", event_type AS name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS score FROM iv')
def read_bed(spark, d):
    p = points(spark, d)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 600 + F.col("event_id") % 3600).cast("string"), "event_type", F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.col("value").cast("string")))
    path = _text(p, line, "bed")
    spark.range(1).select(F.lit("# intervals").alias("value")).write.mode("append").text(path)
    return T.read_bed(spark, path, ["chrom", "start", "end", "name", ("score", "double")])


@query("SELECT 'r' || event_id % 8 AS region, chrom, pos, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS support FROM pts")
def read_region_metrics(spark, d):
    """One folder a region, each with a header row of its own."""
    p = points(spark, d).select(F.concat(F.lit("r"), (F.col("event_id") % 8).cast("string")).alias("region"), F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.when(F.col("event_id") % 4 == 0, "NA").otherwise(F.col("value").cast("string"))).alias("value"))
    heads = p.select("region").distinct().withColumn("value", F.lit("chrom\tpos\tsupport"))
    path = fresh_path(spark, "metrics")
    p.unionByName(heads).write.partitionBy("region").text(path)
    return T.read_region_metrics(spark, f"{path}/*", "chrom string, pos long, support double", r"region=([^/]+)/")


@query('SELECT chrom, start, "end", event_id, value FROM iv WHERE event_id % 5 <> 0 UNION ALL SELECT chrom, start, "end", event_id, NULL FROM iv WHERE event_id % 5 = 0')
def write_table(spark, d):
    e = F.col("event_id")
    rows = points(spark, d).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 600 + e % 3600).alias("end"), "event_id", F.when(e % 5 != 0, F.col("value")).alias("value"))
    path = fresh_path(spark, "table")
    T.write_table(rows, path)
    return T.read_table(spark, path, "chrom string, start long, end long, event_id long, value double")


@query("SELECT event_id, chrom, pos, 'r' || event_id % 8 AS region FROM pts")
def write_by_region(spark, d):
    path = fresh_path(spark, "regions")
    T.write_by_region(points(spark, d).select("event_id", "chrom", "pos", F.concat(F.lit("r"), (F.col("event_id") % 8).cast("string")).alias("region")), path)
    return spark.read.parquet(path)


@query(f"WITH {VARIANTS} SELECT chrom, id, pos, ref[1] AS ref, alts[1] AS alt, (event_id % 2) || ',' || (event_id // 2 % 2) || ',' || (event_id // 3 % 2) AS alleles FROM vs")
def read_haps(spark, d):
    e = F.col("event_id")
    bit = lambda n: (F.floor(e / n) % 2).cast("string")
    line = F.concat_ws(" ", "chrom", "id", F.col("pos").cast("string"), F.substring("ref", 1, 1), F.get("alts", F.lit(0)), bit(1), bit(2), bit(3))
    return T.read_haps(spark, _text(variants(spark, d), line, "haps")).withColumn("alleles", F.array_join(F.transform("alleles", lambda x: x.cast("string")), ","))


@query("SELECT 'f' || c_nationkey AS fid, c_name AS sample, c_acctbal::DOUBLE AS pc1, (c_acctbal * 2 + c_custkey)::DOUBLE AS pc2, 'f' || c_nationkey AS family, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS father, NULL::VARCHAR AS mother, (1 + c_custkey % 2)::VARCHAR AS sex, '-9' AS phenotype, c_mktsegment AS pop, 'all' AS super_pop FROM customer")
def read_samples(spark, d):
    """Components, pedigree and panel of customers as samples, joined by the sample's name (which holds no blank)."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    fid = F.concat(F.lit("f"), F.col("c_nationkey").cast("string"))
    vec = T.read_eigenvec(spark, _text(c, F.concat_ws(" ", fid, "c_name", F.col("c_acctbal").cast("double").cast("string"), (F.col("c_acctbal").cast("double") * 2 + k).cast("string")), "eigenvec"), 2)
    fam = T.read_fam(spark, _text(c, F.concat_ws("  ", fid, "c_name", F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).otherwise("0"), F.lit("0"), (1 + k % 2).cast("string"), F.lit("-9")), "fam"))
    path = fresh_path(spark, "panel")
    c.select(F.col("c_name").alias("sample"), F.col("c_mktsegment").alias("pop"), F.lit("all").alias("super_pop"), F.lit("x").alias("gender")).write.csv(path, sep="\t", header=True)
    return vec.join(fam, "sample").join(T.read_panel(spark, path).drop("gender"), "sample")


@query("SELECT DISTINCT p_brand AS category, upper('g' || p_partkey % 500) AS gene FROM part")
def read_gmt(spark, d):
    sets = _t(spark, d, "part").groupBy("p_brand").agg(F.collect_list(F.concat(F.lit(" g"), (F.col("p_partkey") % 500).cast("string"), F.lit(",1.0"))).alias("g"))
    return T.read_gmt(spark, _text(sets, F.concat_ws("\t", "p_brand", F.lit(""), F.array_join("g", "\t")), "gmt")).select("category", "gene")


@query("SELECT 'chr' || chrom AS chrom, pos AS start, pos + 500 AS \"end\", 'g' || event_id % 60 AS gene, event_id % 4 = 0 AS canon FROM pts WHERE event_type IN ('view', 'click') AND event_id % 3 <> 0")
def read_transcripts(spark, d):
    p = points(spark, d).where("event_type in ('view', 'click', 'error')")
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "exon").otherwise("transcript")
    attributes = F.concat(F.lit('gene_type "'), F.when(e % 3 == 0, "lncRNA").otherwise("protein_coding"), F.lit('"; gene_name "g'), (e % 60).cast("string"), F.lit('";'), F.when(e % 4 == 0, ' tag "Ensembl_canonical";').otherwise(""))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom")), F.lit("src"), kind, (F.col("pos") + 1).cast("string"), (F.col("pos") + 500).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)
    return T.read_gtf_transcripts(spark, _text(p, line, "gtf"))


@query("""SELECT event_id AS chain_id, 10.0::DOUBLE AS score, chrom, pos + b.s AS start, pos + b.s + b.n AS "end", 't' || chrom AS t_chrom, CASE WHEN event_id % 2 = 0 THEN b.t ELSE 5000 - b.t - b.n END::BIGINT AS t_start, CASE WHEN event_id % 2 = 0 THEN b.t + b.n ELSE 5000 - b.t END::BIGINT AS t_end, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand
FROM pts, (VALUES (0, 100, 30), (150, 130, 70)) b(s, t, n) WHERE event_type = 'error'""")
def read_chain(spark, d):
    p = points(spark, d).where("event_type = 'error'")
    strand = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    at = lambda n: (F.col("pos") + n).cast("string")
    head = F.concat_ws(" ", F.lit("chain 10"), "chrom", F.lit("9999999999 +"), at(0), at(220), F.concat(F.lit("t"), F.col("chrom")), F.lit("5000"), strand, F.lit("100 200"), F.col("event_id").cast("string"))
    path = fresh_path(spark, "chain")
    p.select(F.concat(head, F.lit("\n30 120 0\n70")).alias("value")).write.option("lineSep", "\n\n").text(path)
    return T.read_chain(spark, path)


@query("""WITH c AS (SELECT chrom, count(*) AS n FROM pts WHERE event_type = 'view' GROUP BY chrom) SELECT chrom, (row_number() OVER w - 1) * 1000 AS start, (row_number() OVER w) * 1000 AS "end", round(value * 100)::BIGINT / 1e6 AS value FROM pts JOIN c USING (chrom) WHERE event_type = 'view' WINDOW w AS (PARTITION BY chrom ORDER BY pos, event_id)""")
def read_window_scores(spark, d):
    """A column of scaled integers whose place gives the window; the file is one ordered part."""
    p = points(spark, d).where("event_type = 'view'")
    counts = {r["chrom"]: r["n"] for r in p.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).orderBy("chrom").collect()}  # one row a chromosome
    path = _text(p.orderBy("chrom", "pos", "event_id").coalesce(1), F.round(F.col("value") * 100).cast("long").cast("string"), "scores")
    return T.read_window_scores(spark, path, counts)
