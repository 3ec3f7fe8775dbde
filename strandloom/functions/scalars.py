"""Column functions: parsing, conversion, classification. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Years in a generation, and mutations a base and generation at relative rate one. Fixed values.
GENERATION_YEARS = 29
BASE_RATE = 1.015e-7

#: Effect terms and the category each stands for; the first contained term of the ladder decides. Fixed values.
EFFECTS = (
    ("stop_gained", "LOF"),
    ("start_lost", "LOF"),
    ("stop_lost", "LOF"),
    ("missense_variant", "missense"),
    ("stop_retained_variant", "synonymous"),
    ("synonymous_variant", "synonymous"),
    ("initiator_codon_variant", "missense"),
    ("splice", "splice_region"),
    ("upstream_gene_variant", "upstream_gene"),
    ("downstream_gene_variant", "downstream_gene"),
    ("5_prime_UTR", "5_prime_UTR"),
    ("3_prime_UTR", "3_prime_UTR"),
    ("non_coding_transcript_exon_variant", "non_coding_transcript_exon"),
    ("intron_variant", "intron"),
    ("intergenic_region", "intergenic"),
    ("intragenic", "intragenic"),
)

#: Categories from the least to the greatest consequence; one that is not listed ranks below all. Fixed values.
SEVERITY = (
    "intergenic", "intron", "intragenic", "non_coding_transcript_exon",
    "synonymous", "3_prime_UTR", "5_prime_UTR", "downstream_gene", "upstream_gene", "splice_region", "missense", "LOF",
)

#: Bracketed notes that name the study and not the trait. A fixed value.
TRAIT_NOTES = (
    r"UKB data field[^)]*|PheCode[^)]*|MTAG|PGS-adjusted|baseline|2df test|rank-based inverse normal transformation"
    r"|[A-Za-z0-9]{2,8},[^)]*(?:inv-norm|inverse normal)[^)]*|[^)]*inv-norm(?:al)? transformed|[A-Z][A-Za-z0-9]{1,6}"
)


def to_number(c: Column, missing: Sequence[str] = (".", "NA", "")) -> Column:
    """Double from text; the missing marks and anything unreadable become null."""
    text = F.trim(c.cast("string"))
    return F.when(text.isin(*missing), None).otherwise(text).try_cast("double")


def midpoint_age(lower: Column, upper: Column, years: float = GENERATION_YEARS, require_both: bool = False) -> Column:
    """Mean of the bounds in years. With one bound missing: null if ``require_both``, else the bound that is there."""
    middle = (lower + upper) / 2 if require_both else (F.coalesce(lower, upper) + F.coalesce(upper, lower)) / 2
    return middle * years


def to_years(generations: Column, years: float = GENERATION_YEARS) -> Column:
    return generations * years


def scale_rate(relative: Column, base: float = BASE_RATE) -> Column:
    return relative * base


def site_id(*parts: Column) -> Column:
    """Parts joined by ``_``; null if a part is null."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws("_", *[p.cast("string") for p in parts]))


def parse_site_id(c: Column) -> Column:
    """struct<chrom,pos,ref,alt> of ``chrom_pos[_ref_alt]``; unreadable positions are null."""
    p = F.split(c, "_")
    return F.struct(F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).try_cast("long").alias("pos"), F.get(p, F.lit(2)).alias("ref"), F.get(p, F.lit(3)).alias("alt"))


def parse_region(c: Column) -> Column:
    """struct<chrom,start,end> of ``chrom_start_end``, ``chrN:start-end`` or ``chrN:1,234-5,678``."""
    plain = F.regexp_replace(c, ",", "")
    part = lambda i: F.regexp_extract(plain, r"^(?:chr)?([^:_]+)[:_](\d+)[-_](\d+)$", i)
    return F.when(plain.rlike(r"^(?:chr)?([^:_]+)[:_](\d+)[-_](\d+)$"), F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end")))


def ancestral_allele(c: Column, keep_low_confidence: bool = True) -> Column:
    """First base before ``|`` in upper case; null unless A, C, G or T. Lower case marks low confidence."""
    first = F.substring(F.split_part(c, F.lit("|"), F.lit(1)), 1, 1)
    known = F.upper(first)
    allowed = known.isin("A", "C", "G", "T") if keep_low_confidence else first.isin("A", "C", "G", "T")
    return F.when(allowed, known)


def complement(c: Column) -> Column:
    return F.translate(c, "ACGTacgt", "TGCAtgca")


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def cpg_flag(context: Column, aa: Column, ref: Column, alt: Column) -> Column:
    """Whether a transition mutates a CpG: with the pyrimidine strand up, C>T in CG when the ancestral base is REF, T>C in TG
    when it is ALT; an unknown ancestral base is taken as REF. ``context``: the reference base and its neighbours."""
    purine = ref.isin("A", "G")
    r, a, x = (F.when(purine, complement(v)).otherwise(v) for v in (ref, alt, aa))
    around = F.when(purine, reverse_complement(context)).otherwise(context)
    follows_g = F.substring(around, 3, 1) == "G"
    from_ref = F.coalesce(x == r, F.lit(True))
    return F.coalesce(follows_g & ((from_ref & (r == "C") & (a == "T")) | (~from_ref & (x == a) & (r == "T") & (a == "C"))), F.lit(False))


def effect_category(c: Column, ladder: Sequence[tuple[str, str]] = EFFECTS, other: str = "other") -> Column:
    """Category of the first term of the ladder that the text contains."""
    out = F.lit(other)
    for term, category in reversed(ladder):
        out = F.when(F.contains(c, F.lit(term)), F.lit(category)).otherwise(out)
    return F.when(c.isNotNull(), out)


def worst_effect(annotations: Column, lof: Column | None = None, ladder: Sequence[tuple[str, str]] = EFFECTS, severity: Sequence[str] = SEVERITY) -> Column:
    """The category of greatest consequence among comma-separated annotations (of equals the first); ``lof`` true overrides."""
    ranks = F.create_map(*[F.lit(x) for i, c in enumerate(severity) for x in (c, i)])
    named = F.transform(F.split(annotations, ","), lambda a: effect_category(a, ladder))
    ranked = F.transform(named, lambda c, i: F.struct(F.coalesce(F.try_element_at(ranks, c), F.lit(-1)).alias("rank"), (-i).alias("first"), c.alias("category")))
    found = F.when(annotations.isNotNull(), F.array_max(ranked)["category"])
    return found if lof is None else F.when(lof, F.lit("LOF")).otherwise(found)


def derived_af(af: Column, aa: Column, alt: Column) -> Column:
    """Frequency of the derived allele: one minus AF where ALT is ancestral."""
    return F.when(aa == alt, 1 - af).otherwise(af)


def distinct_subfield(c: Column, index: int, outer: str = ";", inner: str = r"\|") -> Column:
    """Distinct non-empty values of one inner field, in order of first appearance."""
    values = F.transform(F.split(c, outer), lambda x: F.get(F.split(x, inner), F.lit(index)))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def normalise_trait(c: Column, notes: str = TRAIT_NOTES) -> Column:
    """A trait's name without notes about its study, white space squeezed and closing marks trimmed."""
    plain = F.regexp_replace(c, r"(?i)\s*\((?:" + notes + r")\)", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\s{2,}", " "), r"^[ ,;]+|[ ,;]+$", "")


def format_top(values: Column, k: int = 2, sep: str = "; ") -> Column:
    """The first ``k`` values, and how many more there are."""
    more = F.size(values) - k
    return F.concat(F.array_join(F.slice(values, 1, k), sep), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(F.lit("")))


def format_evidence(gene: Column, kind: Column, tissue: Column, pip: Column) -> Column:
    return F.format_string("%s|%s|%s|pip=%.3f", gene, kind, tissue, pip)


def format_score(gene: Column, score: Column) -> Column:
    return F.format_string("%s(%.2f)", gene, score)


def clean_labels(c: Column) -> Column:
    return F.regexp_replace(c, "_variant|_region", "")


def as_pvalue(neg_log10: Column, floor: float = 1e-300) -> Column:
    """10^-x, between ``floor`` and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(floor), F.pow(F.lit(10.0), -neg_log10)))


def dosage(c: Column) -> Column:
    """Number of ALT copies of a diploid call text; null if any allele is missing."""
    alleles = F.split(c, r"[|/]")
    known = F.size(alleles) > 0
    return F.when(known & ~F.exists(alleles, lambda a: a == "."), F.aggregate(alleles, F.lit(0), lambda n, a: n + F.when(a == "0", 0).otherwise(1)))


def chrom_rank(c: Column) -> Column:
    """Sort key for the natural chromosome order: numbers by value, then X, Y, M and the rest by name."""
    plain = F.regexp_replace(c, "^chr", "")
    number = plain.try_cast("int")
    return F.coalesce(number, F.when(plain == "X", 1001).when(plain == "Y", 1002).when(plain.isin("M", "MT"), 1003).otherwise(2000))
