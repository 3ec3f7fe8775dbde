"""Genotype tables: counts over arrays of calls without exploding, and the linear algebra that needs more."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.storage import settled
from strandloom.functions.draws import text_draw
from strandloom.operators.carry import numbered, running


# -- per-site counts over an array of (sample, a0, a1) ---------------------------------------------------------------
def fill_tags(df: DataFrame, genotypes: str = "genotypes") -> DataFrame:
    """Add ac, an, af and n_missing from a site's calls (alleles as numbers, null for missing)."""
    alleles = F.flatten(F.transform(genotypes, lambda g: F.array(g["a0"], g["a1"])))
    known = F.filter(alleles, lambda a: a.isNotNull())
    out = df.withColumn("an", F.size(known)).withColumn("ac", F.size(F.filter(known, lambda a: a > 0)))
    return out.withColumn("af", F.try_divide("ac", "an")).withColumn("n_missing", F.size(F.filter(genotypes, lambda g: g["a0"].isNull() | g["a1"].isNull())))


def mendel_errors(df: DataFrame, trios: Sequence[tuple[str, str, str]], genotypes: str = "genotypes") -> DataFrame:
    """Add ``n_errors``: trios (child, father, mother) whose child's call no pair of parental alleles gives; incomplete
    trios do not count. Works inside the site's array."""
    by_name = F.map_from_entries(F.transform(genotypes, lambda g: F.struct(g["sample"], F.struct(g["a0"].alias("a0"), g["a1"].alias("a1")))))
    total = F.lit(0)
    for child, father, mother in trios:
        c, f, m = (F.col("_calls")[x] for x in (child, father, mother))
        has = lambda p, a: (p["a0"] == a) | (p["a1"] == a)
        fits = (has(f, c["a0"]) & has(m, c["a1"])) | (has(f, c["a1"]) & has(m, c["a0"]))
        known = c["a0"].isNotNull() & c["a1"].isNotNull() & f["a0"].isNotNull() & f["a1"].isNotNull() & m["a0"].isNotNull() & m["a1"].isNotNull()
        total = total + F.when(known & ~fits, 1).otherwise(0)
    return df.withColumn("_calls", by_name).withColumn("n_errors", total).drop("_calls")


def drop_mendel_errors(df: DataFrame, trios: Sequence[tuple[str, str, str]], genotypes: str = "genotypes") -> DataFrame:
    return mendel_errors(df, trios, genotypes).where("n_errors = 0").drop("n_errors")


def missingness_filter(gt: DataFrame, geno: float = 0.1, mind: float = 0.1) -> DataFrame:
    """Long calls (chrom, pos, sample, a0, a1): samples with more than ``mind`` missing go first, then sites with more than
    ``geno`` missing among the samples left."""
    missing = (F.col("a0").isNull() | F.col("a1").isNull()).cast("int")
    samples = gt.groupBy("sample").agg(F.avg(missing).alias("m")).where(F.col("m") <= mind).select("sample")
    kept = gt.join(F.broadcast(samples), "sample", "left_semi")  # one row a sample
    sites = kept.groupBy("chrom", "pos").agg(F.avg(missing).alias("m")).where(F.col("m") <= geno).select("chrom", "pos")
    return kept.join(sites, ["chrom", "pos"], "left_semi")


def callset_stats(df: DataFrame) -> DataFrame:
    """Records, SNPs, transitions, transversions and their ratio (columns ref, alt)."""
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    ts = snp & F.concat("ref", "alt").isin("AG", "GA", "CT", "TC")
    out = df.agg(F.count(F.lit(1)).alias("records"), F.count_if(snp).alias("snps"), F.count_if(ts).alias("transitions"), F.count_if(snp & ~ts).alias("transversions"))
    return out.withColumn("ts_tv", F.try_divide("transitions", "transversions"))


def af_spectrum(df: DataFrame, bins: int = 100, af: str = "af") -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col(af) * bins), F.lit(bins - 1)).cast("int").alias("af_bin")).agg(F.count(F.lit(1)).alias("n"))


def genotype_dosage(gt: DataFrame) -> DataFrame:
    """Long calls with ``dosage``: the number of ALT copies, null if an allele is missing."""
    return gt.withColumn("dosage", (F.col("a0") > 0).cast("int") + (F.col("a1") > 0).cast("int"))


# -- linkage ---------------------------------------------------------------------------------------------------------
#: Sites of a block, and cells (sites times samples) of one at most.
SITES, CELLS = 256, 1 << 22


def bit_blocks(gt: DataFrame, by: Sequence[str], samples: DataFrame, total: int, width: int) -> DataFrame:
    """Dosages (by, pos, sample, dosage: 0, 1, 2 or null) as blocks of ``width`` sites in order of position: by, block, positions and
    three planes of bits, a row a site and a bit a sample: known, one copy or more, two copies. ``samples``: sample and its number.
    Of repeated calls the larger dosage counts."""
    sites = gt.select(*by, "pos").distinct()
    at = settled(numbered(sites, [*by, "pos"], "_g", "sites"), "sites")
    first = at.groupBy(*by).agg(F.min("_g").alias("_base"))
    placed = at.join(first, list(by)).select(*by, "pos", F.floor((F.col("_g") - F.col("_base")) / width).alias("block"))
    rows = gt.select(*by, "pos", "sample", "dosage").join(placed, [*by, "pos"]).join(samples, "sample")
    schema = ", ".join(f"{c} {gt.schema[c].dataType.simpleString()}" for c in by)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        positions, row = np.unique(pdf["pos"].to_numpy(np.int64), return_inverse=True)
        x = np.full((len(positions), total), -1, np.int8)
        np.maximum.at(x, (row, pdf["number"].to_numpy(np.int64)), pdf["dosage"].fillna(-1).to_numpy(np.int8))
        planes = np.packbits(np.stack([x >= k for k in range(3)]), axis=2)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "block": [pdf["block"].iloc[0]], "positions": [positions.tolist()], "planes": [planes.tobytes()]})

    return settled(rows.groupBy(*by, "block").applyInPandas(pack, f"{schema}, block long, positions array<long>, planes binary"), "planes")


def _block_r2(a: pd.DataFrame, b: pd.DataFrame, total: int, triangle: bool) -> tuple[np.ndarray, ...]:
    """pos_a, pos_b, n and r2 of every pair of sites of two blocks, from the bits that both share."""
    unpack = lambda row: np.unpackbits(np.frombuffer(row["planes"], np.uint8).reshape(3, len(row["positions"]), -1), axis=2, count=total).astype(np.float32)
    a, b = a.iloc[0], b.iloc[0]
    (pa, oa, ta), (pb, ob, tb) = unpack(a), unpack(b)
    shared = lambda x, y: (x @ y.T).astype(float)  # noqa: E731  whole numbers below 2^24
    n, xa, xb = shared(pa, pb), oa + ta, ob + tb
    sx, sy, sxy = shared(xa, pb), shared(pa, xb), shared(xa, xb)
    sxx, syy = sx + 2 * shared(ta, pb), sy + 2 * shared(pa, tb)
    cov, var = sxy * n - sx * sy, (sxx * n - sx * sx) * (syy * n - sy * sy)
    r2 = np.divide(cov * cov, var, out=np.full(cov.shape, np.nan), where=var > 0)
    left, right = np.meshgrid(np.asarray(a["positions"]), np.asarray(b["positions"]), indexing="ij")
    keep = left < right if triangle else np.ones(left.shape, bool)
    return left[keep], right[keep], n[keep].astype(np.int64), r2[keep]


def _pairs_of_blocks(a: DataFrame, b: DataFrame, by: Sequence[str], total: int, triangle: bool) -> DataFrame:
    """r2 of the pairs of sites of ``a`` and ``b`` (blocks). A pair of blocks is a group of its own, so a region is as many tasks as it
    has pairs; a block is copied once a partner."""
    many = b.groupBy(*by).agg((F.max("block") + 1).alias("_m")).join(a.groupBy(*by).agg((F.max("block") + 1).alias("_k")), list(by))
    begin = F.col("block") if triangle else F.lit(0).cast("long")
    left = a.join(many, list(by)).withColumn("_j", F.explode(F.sequence(begin, F.col("_m") - 1))).withColumnRenamed("block", "_i").drop("_m", "_k")
    stop = F.col("block") if triangle else F.col("_k") - 1
    right = b.join(many, list(by)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), stop))).withColumnRenamed("block", "_j").drop("_m", "_k")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, as both may be one table
    schema = ", ".join(f"{c} {a.schema[c].dataType.simpleString()}" for c in by)

    def measure(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in (*by, "pos_a", "pos_b", "n", "r2")})
        pos_a, pos_b, n, r2 = _block_r2(x, y, total, triangle)
        return pd.DataFrame({**{c: np.full(len(n), x[c].iloc[0], object) for c in by}, "pos_a": pos_a, "pos_b": pos_b, "n": n, "r2": r2})

    keys = [*by, "_i", "_j"]
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(measure, f"{schema}, pos_a long, pos_b long, n long, r2 double")
    return out.withColumn("r2", F.when(~F.isnan("r2"), F.col("r2")))


def _samples(gt: DataFrame, sites: int) -> tuple[DataFrame, int, int]:
    """(samples with numbers, how many, sites of a block)."""
    named = settled(numbered(gt.select("sample").where("sample is not null").distinct(), ["sample"], label="samples"), "samples")
    total = named.count()
    return named, total, max(1, min(sites, CELLS // max(1, total)))


def pairwise_r2(gt: DataFrame, by: Sequence[str] = ("region", "set"), sites: int = SITES) -> DataFrame:
    """Squared correlation of dosages for every pair of sites in a region and sample set (long: by, pos, sample, dosage): by, pos_a <
    pos_b, n (samples known at both) and r2 (null where a site does not vary among them).

    Genotypes become planes of bits; pairs are made of blocks of about ``sites`` sites, and no row stands for a pair's sample."""
    named, total, width = _samples(gt, sites)
    blocks = bit_blocks(gt, by, named, total, width)
    return _pairs_of_blocks(blocks, blocks, by, total, True)


def region_ld(r2: DataFrame, sites: DataFrame, by: Sequence[str] = ("region", "set"), high: float = 0.8) -> DataFrame:
    """Least and mean r2 of each region and set, whether all reach ``high``, and the number of sites present."""
    stats = r2.groupBy(*by).agg(F.min("r2").alias("min_r2"), F.avg("r2").alias("mean_r2"), F.coalesce(F.bool_and(F.col("r2") >= high), F.lit(False)).alias("all_high"))
    return sites.groupBy(*by).agg(F.countDistinct("pos").alias("n_present")).join(stats, list(by), "left")


def cross_ld(gt: DataFrame, set_a: DataFrame, set_b: DataFrame, by: Sequence[str] = ("set",)) -> tuple[DataFrame, DataFrame]:
    """(r2 of every site of ``set_a`` with every site of ``set_b``, per set the maximum and median)."""
    named, total, width = _samples(gt, SITES)
    a, b = (bit_blocks(gt.join(x.select("pos").distinct(), "pos", "left_semi"), by, named, total, width) for x in (set_a, set_b))
    r2 = _pairs_of_blocks(a, b, by, total, False)
    return r2, r2.groupBy(*by).agg(F.max("r2").alias("max_r2"), F.percentile("r2", 0.5).alias("median_r2"))


def ld_prune(gt: DataFrame, window: int = 50, step: int = 10, r2: float = 0.1, block: int = 5000, use: str = "in") -> DataFrame:
    """Sites (chrom, pos, dosages array) kept by a sliding window of ``window`` sites moved by ``step``: of a pair above
    ``r2`` the one of lower minor-allele frequency goes (of equals the later). ``use='out'`` gives the removed sites.

    Chromosomes are cut into blocks of ``block`` sites that scan the windows starting in them and hold the next block's first
    ``window`` sites too. What a block removes there is handed on and the scan repeated until no hand-over changes, so the
    result is that of one scan over the chromosome. Positions of a chromosome are unique."""
    block = max(-(-block // step) * step, -(-window // step) * step)
    numbered = running(gt, ["chrom"], "pos", ["pos"], {"_i": ("count", F.lit(1))}).select("chrom", "pos", "dosages", (F.col("_i") - 1).cast("long").alias("_i"))
    own = numbered.withColumn("_block", F.floor(F.col("_i") / block).cast("long"))
    shared = own.where((F.col("_i") - F.col("_block") * block < window) & (F.col("_block") > 0)).withColumn("_block", F.col("_block") - 1)
    sites = settled(own.unionByName(shared), "prune")

    def prune(pdf: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"chrom": [], "pos": [], "_i": [], "_block": [], "kept": []})
        pdf = pdf.sort_values("_i")
        x = np.array(pdf["dosages"].tolist(), float)
        mean = np.nanmean(x, axis=1, keepdims=True)
        x = np.where(np.isnan(x), mean, x)
        freq = np.minimum(mean[:, 0] / 2, 1 - mean[:, 0] / 2)
        x = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        keep = (norm > 0) & ~pdf["_i"].isin(gone["_i"]).to_numpy()
        for at in range(0, min(len(x), block), step):
            live = np.flatnonzero(keep[at : at + window]) + at
            while len(live) > 1:
                z = x[live] / norm[live, None]
                r = np.triu((z @ z.T) ** 2, 1)
                hit = np.argwhere(r > r2)
                if not len(hit):
                    break
                i, j = live[hit[0][0]], live[hit[0][1]]
                keep[i if freq[i] < freq[j] else j] = False
                live = live[keep[live]]
        return pdf[["chrom", "pos", "_i", "_block"]].assign(kept=keep)

    handed = gt.sparkSession.createDataFrame([], "chrom string, _i long, _block long")
    while True:
        scanned = settled(sites.groupBy("chrom", "_block").cogroup(handed.groupBy("chrom", "_block")).applyInPandas(prune, "chrom string, pos long, _i long, _block long, kept boolean"), "prune")
        past = F.col("_i") >= (F.col("_block") + 1) * block
        fresh = scanned.where(past & ~F.col("kept")).select("chrom", "_i", (F.col("_block") + 1).alias("_block"))
        # later rounds may also hand over less than earlier ones
        if not fresh.exceptAll(handed).take(1) and not handed.exceptAll(fresh).take(1):
            return scanned.where(~past & (F.col("kept") if use == "in" else ~F.col("kept"))).select("chrom", "pos")
        handed = fresh


def genotype_pca(gt: DataFrame, k: int = 20) -> tuple[list[float], np.ndarray]:
    """(eigenvalues, samples x k vectors) of the standardised genotypes (``dosages`` arrays of one fixed length).

    Partitions add up sample-by-sample products; only these small matrices reach the driver."""

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for pdf in frames:
            x = np.array(pdf["dosages"].tolist(), float)
            if not len(x):
                continue
            p = np.nanmean(x, axis=1, keepdims=True) / 2
            scale = np.sqrt(2 * p * (1 - p))
            z = np.where(np.isnan(x) | (scale == 0), 0, (x - 2 * p) / np.where(scale == 0, 1, scale))
            total, n = z.T @ z if total is None else total + z.T @ z, n + int((scale > 0).sum())
        if total is not None:
            rows, cols = np.indices(total.shape)
            yield pd.DataFrame({"i": rows.ravel(), "j": cols.ravel(), "v": total.ravel(), "n": n})

    sums = gt.select("dosages").mapInPandas(gram, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    size = int(sums["i"].max()) + 1
    g = np.zeros((size, size))
    g[sums["i"], sums["j"]] = sums["v"] / sums["n"].max()
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)[:k]
    return values[order].tolist(), vectors[:, order]


def orient_components(vectors: np.ndarray, known: Sequence[int]) -> np.ndarray:
    """Signs turned so that the mean of the ``known`` samples is positive on every component."""
    sign = np.sign(vectors[list(known)].mean(axis=0))
    return vectors * np.where(sign == 0, 1, sign)


# -- haplotypes and samples ----------------------------------------------------------------------------------------
def fix_haplotype_coding(haps: DataFrame, sites: DataFrame) -> DataFrame:
    """Haplotypes (chrom, pos, ref, alt, alleles array of 0/1) recoded to a site list's REF and ALT: swapped rows are flipped,
    rows that lost an allele (ref = alt) get the list's, flipped if theirs is its ALT; other rows stay."""
    want = sites.select("chrom", "pos", F.col("ref").alias("_ref"), F.col("alt").alias("_alt"))
    joined = haps.join(want, ["chrom", "pos"], "left")
    flip = ((F.col("ref") == F.col("_alt")) & (F.col("alt") == F.col("_ref"))) | ((F.col("ref") == F.col("alt")) & (F.col("ref") == F.col("_alt")))
    flip = F.coalesce(flip, F.lit(False))
    known = F.coalesce(flip | ((F.col("ref") == F.col("alt")) & (F.col("ref") == F.col("_ref"))), F.lit(False))
    out = joined.withColumn("alleles", F.when(flip, F.transform("alleles", lambda x: (1 - x).cast("tinyint"))).otherwise(F.col("alleles").cast("array<tinyint>")))
    return out.withColumn("ref", F.when(known, F.col("_ref")).otherwise(F.col("ref"))).withColumn("alt", F.when(known, F.col("_alt")).otherwise(F.col("alt"))).drop("_ref", "_alt")


def stratified_downsample(samples: DataFrame, n: int, seed: int, stratum: str = "dosage") -> DataFrame:
    """``n`` samples with the strata's shares kept: quotas round half to even, the largest stratum takes up the difference, and
    the choice inside a stratum follows a hash of seed and name."""
    counts = samples.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    all_ = counts.crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("_all"))))
    quota = all_.withColumn("_q", F.bround(F.col("_c") * n / F.col("_all")).cast("int"))
    first = F.row_number().over(Window.orderBy(F.desc("_c"), stratum))  # one row a stratum
    repaired = quota.withColumn("_first", first).crossJoin(F.broadcast(quota.agg((F.lit(n) - F.sum("_q")).alias("_off"))))
    repaired = repaired.select(stratum, F.when(F.col("_first") == 1, F.col("_q") + F.col("_off")).otherwise(F.col("_q")).alias("_q"))
    w = Window.partitionBy(stratum).orderBy(text_draw(1 << 59, seed, F.col("sample")), "sample")
    return samples.withColumn("_n", F.row_number().over(w)).join(F.broadcast(repaired), stratum).where("_n <= _q").drop("_n", "_q")
