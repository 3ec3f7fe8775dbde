"""Readers and writers of the text formats. Schemas are explicit; nothing is inferred. Gzip text reads as one task a file, so
repartition and store it as Parquet once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandloom.functions.scalars import chrom_rank


def _null(c: Column, *marks: str) -> Column:
    return F.when(c.isin(*marks), None).otherwise(c)


def read_vcf(spark: SparkSession, path: str, info_schema: Mapping[str, str], samples: Sequence[str] | None = None) -> DataFrame:
    """Sites with typed INFO fields (name: type; ``boolean`` for flags), and with ``samples`` (all of the file, in its order) a
    ``genotypes`` array of (sample, a0, a1, phased, dp, pl). Header lines are skipped, ``.`` is null."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    parts = F.split("value", "\t")
    f = [F.get(parts, F.lit(i)) for i in range(9)]  # not [i]: filters that Spark infers may meet a header line first
    info = F.str_to_map(_null(f[7], "."), F.lit(";"), F.lit("="))
    fields = [(F.coalesce(F.map_contains_key(info, k), F.lit(False)) if t == "boolean" else _null(info[k], ".").try_cast(t)).alias(k) for k, t in info_schema.items()]
    out = [f[0].alias("chrom"), f[1].cast("long").alias("pos"), _null(f[2], ".").alias("id"), f[3].alias("ref"), F.when(f[4] == ".", F.array().cast("array<string>")).otherwise(F.split(f[4], ",")).alias("alts"), f[5].try_cast("double").alias("qual"), _null(f[6], ".").alias("filter"), *fields]
    if samples:
        names = F.split(f[8], ":")

        def call(text: Column, name: Column) -> Column:
            own = F.split(text, ":")
            value = lambda key: F.try_element_at(own, F.array_position(names, key).cast("int"))
            held = lambda key: F.when(F.array_position(names, key) > 0, value(key))
            gt = held("GT")
            alleles = F.split(gt, r"[|/]")
            return F.struct(
                name.alias("sample"), F.get(alleles, F.lit(0)).try_cast("int").alias("a0"), F.get(alleles, F.lit(1)).try_cast("int").alias("a1"), F.contains(gt, F.lit("|")).alias("phased"),
                held("DP").try_cast("int").alias("dp"), F.transform(F.split(held("PL"), ","), lambda x: x.try_cast("int")).alias("pl"),
            )

        listed = F.array(*[F.lit(s) for s in samples])
        out.append(F.zip_with(F.slice(parts, 10, len(samples)), listed, call).alias("genotypes"))
    return lines.select(*out)


def site_table(df: DataFrame, fields: Sequence[str], genotypes: bool = False) -> DataFrame:
    """Named columns, with ``pos0`` and ``end`` made on demand; with ``genotypes`` one row for each sample's call."""
    wide = df.withColumn("pos0", F.col("pos") - 1).withColumn("end", F.col("pos") + F.length("ref") - 1)
    if not genotypes:
        return wide.select(*fields)
    return wide.select(*fields, F.explode("genotypes").alias("_g")).select(*fields, "_g.*")


_BED_TYPES = {"chrom": "string", "start": "long", "end": "long"}


def read_bed(spark: SparkSession, path: str | Sequence[str], cols: Sequence[str | tuple[str, str]] = ("chrom", "start", "end")) -> DataFrame:
    """Headerless tab-separated intervals; further columns as (name, type), strings by default; comments skipped, NA null."""
    pairs = [(c, _BED_TYPES.get(c, "string")) if isinstance(c, str) else c for c in cols]
    return spark.read.csv(path if isinstance(path, str) else list(path), sep="\t", schema=", ".join(f"`{n}` {t}" for n, t in pairs), comment="#", nullValue="NA")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = "\t", header: bool = True, null: str = "NA") -> DataFrame:
    return spark.read.csv(path if isinstance(path, str) else list(path), sep=sep, schema=schema, header=header, nullValue=null)


def read_window_scores(spark: SparkSession, path: str, counts: Mapping[str, int], width: int = 1000, scale: float = 1e6) -> DataFrame:
    """A column of scaled integers whose place gives the window: chromosomes in the order of ``counts``, each from 0.

    ``path``: text with ``#`` header lines. Places come from the rows' numbers inside their partition and the partitions'
    sizes; a total that differs from the counts raises."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.col("value").cast("long").alias("v"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = {r["p"]: (r["n"], r["low"]) for r in lines.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low")).collect()}  # one row a partition
    total, base = 0, []
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p][0]
    if total != sum(counts.values()):
        raise ValueError(f"{total} windows, but the header's counts add up to {sum(counts.values())}")
    offsets, at = [], 0
    for chrom, n in counts.items():
        offsets.append((chrom, at, at + n))
        at += n
    # rows of a text partition are numbered densely by their order; filtered header lines leave gaps, hence the row number
    order = F.row_number().over(Window.partitionBy("p").orderBy("m")) - 1
    placed = lines.withColumn("r", order).join(F.broadcast(spark.createDataFrame(base, "p int, b long")), "p").withColumn("i", F.col("r") + F.col("b"))
    spans = F.broadcast(spark.createDataFrame(offsets, "chrom string, lo long, hi long"))
    out = placed.join(spans, (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
    start = (F.col("i") - F.col("lo")) * width
    return out.select("chrom", start.alias("start"), (start + width).alias("end"), (F.col("v") / scale).alias("value"))


def read_gmt(spark: SparkSession, folder: str, strip_weight: bool = True) -> DataFrame:
    """(library, category, gene) of all gene-set files of a folder, genes in upper case; weights after a comma go if asked."""
    f = F.split("value", "\t")
    token = F.trim(F.col("token"))
    gene = F.upper(F.split_part(token, F.lit(","), F.lit(1)) if strip_weight else token)
    # a line is split once, before its tokens become rows: a column of the same step as explode is worked out anew for every token
    lines = spark.read.text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.gmt|\.txt)?$", 1).alias("library"), F.substring_index("value", "\t", 1).alias("category"), F.slice(f, 3, F.greatest(F.size(f) - 2, F.lit(0))).alias("tokens"))
    rows = lines.select("library", "category", F.explode("tokens").alias("token"))
    return rows.select("library", "category", gene.alias("gene")).where("gene <> ''").distinct()


def read_gtf_transcripts(spark: SparkSession, path: str, gene_type: str = "protein_coding") -> DataFrame:
    """Transcripts of one gene type as 0-based intervals with gene name and canonical flag."""
    f = F.split("value", "\t")
    attribute = lambda k: F.regexp_extract(f[8], k + r' "([^"]*)"', 1)
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).where(f[2] == "transcript")
    return rows.where(attribute("gene_type") == gene_type).select(f[0].alias("chrom"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), attribute("gene_name").alias("gene"), F.contains(f[8], F.lit("Ensembl_canonical")).alias("canon"))


EVIDENCE_DDL = (
    "id string, rsIds array<string>, mostSevereConsequence struct<label:string>, credibleSets struct<count:int, rows:array<struct<"
    "studyType:string, qtlGeneId:string, confidence:string, study:struct<id:string,"
    "target:struct<id:string,approvedSymbol:string>,biosample:struct<biosampleName:string>>,"
    "locus:struct<rows:array<struct<posteriorProbability:double>>>, l2GPredictions:struct<rows:array<struct<"
    "score:double,target:struct<id:string,approvedSymbol:string>>>>>>>"
)


def read_evidence(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """Nested evidence records, one JSON object a line; with ``keyed`` each file is one object of id: record."""
    if not keyed:
        return spark.read.schema(EVIDENCE_DDL).json(path)
    text = spark.read.text(path, wholetext=True)
    record = "struct<" + EVIDENCE_DDL.replace("id string, ", "", 1).replace(" array<", ":array<").replace(" struct<", ":struct<") + ">"
    entries = text.select(F.explode(F.from_json("value", f"map<string,{record}>")).alias("id", "r"))
    return entries.select("id", "r.*")


def read_region_metrics(spark: SparkSession, paths: str | Sequence[str], schema: str, pattern: str = r"([^/]+?)\.[^/]*$") -> DataFrame:
    """Many per-region metric files with the region from the path; repeated header rows and empty files give no rows."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(F.regexp_extract(F.input_file_name(), pattern, 1).alias("region"), "value")
    body = raw.where(~F.startswith("value", F.lit("chrom")) & (F.trim("value") != ""))
    return body.select("region", F.from_csv("value", schema, {"sep": "\t", "nullValue": "NA"}).alias("r")).select("region", "r.*")


def concat_parts(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), dfs)


def union_tagged(named: Mapping[str, DataFrame], pattern: str, tags: Sequence[str]) -> DataFrame:
    """Union of tables with columns taken from their names by the groups of ``pattern``."""
    import re

    parts = []
    for name, df in named.items():
        found = re.fullmatch(pattern, name)
        if found is None:
            raise ValueError(f"{name!r} does not fit {pattern!r}")
        parts.append(df.select(*[F.lit(v).alias(t) for t, v in zip(tags, found.groups(), strict=True)], *df.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_table(df: DataFrame, path: str, order: str = "natural", sep: str = "\t", header: bool = True) -> None:
    """Sorted delimited text; ``natural`` chromosome order or ``string``. The sort is a range partition, not one task."""
    pos = "start" if "start" in df.columns else "pos"
    keys = [chrom_rank(F.col("chrom")), F.col("chrom"), F.col(pos)] if order == "natural" else [F.col("chrom"), F.col(pos)]
    df.orderBy(*keys).write.csv(path, sep=sep, header=header, nullValue="NA", mode="overwrite")


def write_by_region(df: DataFrame, path: str, region: str = "region") -> None:
    df.repartition(region).sortWithinPartitions(region, "pos").write.partitionBy(region).parquet(path, mode="overwrite")


def read_haps(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated haplotypes: chrom id pos ref alt and one 0/1 column for each haplotype, as an array."""
    f = F.split("value", " ")
    return spark.read.text(path).select(f[0].alias("chrom"), f[1].alias("id"), f[2].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), F.transform(F.slice(f, 6, F.size(f) - 5), lambda x: x.cast("tinyint")).alias("alleles"))


def read_eigenvec(spark: SparkSession, path: str, k: int = 20) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(f[0].alias("fid"), f[1].alias("sample"), *[F.get(f, F.lit(i + 1)).try_cast("double").alias(f"pc{i}") for i in range(1, k + 1)])


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    names = ("family", "sample", "father", "mother", "sex", "phenotype")
    return spark.read.text(path).select(*[_null(f[i], "0").alias(n) if n in ("father", "mother") else f[i].alias(n) for i, n in enumerate(names)])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="sample string, pop string, super_pop string, gender string")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Alignment blocks: chain_id, score, chrom, start, end, t_chrom, t_start, t_end, strand (target on its forward strand).

    Chains are blank-line separated; each is one record of the reader and is laid out in its own row."""
    text = spark.read.option("lineSep", "\n\n").text(path)

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for record in pdf["value"]:
                head, s, t = None, 0, 0
                for line in record.splitlines():
                    p = line.split()
                    if not p or line.startswith("#"):
                        continue
                    if p[0] == "chain":
                        head, s, t = p, int(p[5]), int(p[10])
                        continue
                    n = int(p[0])
                    a, b = (t, t + n) if head[9] == "+" else (int(head[8]) - t - n, int(head[8]) - t)
                    rows.append((int(head[12]), float(head[1]), head[2], s, s + n, head[7], a, b, head[9]))
                    if len(p) > 2:
                        s, t = s + n + int(p[1]), t + n + int(p[2])
            yield pd.DataFrame(rows, columns=["chain_id", "score", "chrom", "start", "end", "t_chrom", "t_start", "t_end", "strand"])

    return text.mapInPandas(lay, "chain_id long, score double, chrom string, start long, end long, t_chrom string, t_start long, t_end long, strand string")
