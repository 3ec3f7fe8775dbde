"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. An
empty table goes through every stage and gives an empty result; further columns are kept by all stages but the last,
whatever their names; null texts stay, and have no place in a sequence. The stages take whole tables: the clusters that the
last one keeps apart are equal texts, as the second leaves one text of each near-duplicate class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm._shared import settled, table
from strandloom.llm.decontam import drop_contaminated
from strandloom.llm.jaccard import near_duplicates
from strandloom.llm.packing import pack_documents
from strandloom.llm.pii import redact_pii
from strandloom.llm.toxicity import drop_toxic, fit_on_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model rejects go."""
    return drop_toxic(docs, fit_on_labels(docs, table(spark, sf_dir, "labels")))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the text of least (doc_id, hash) stays, once; rows without words or without an id stay.
    Unlike texts that share a doc_id are not duplicates. Of repeated rows (same id and text) any one stays."""
    found = settled(near_duplicates(docs).where("class_id is not null and doc_id is not null"), "classes")
    first = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_key")).alias("kept")).select("kept.doc_id", "kept.text_key")
    gone = found.join(first, ["doc_id", "text_key"], "left_anti").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["gone_id"]) & (key == gone["gone_key"]), "left_anti").select(*docs.columns)
    if found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        named = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = kept.where(named).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~named))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes a mark; n_chars follows the new text."""
    out = redact_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents into sequences: doc_id, piece, its place, and its bin."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicate_join),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted model and a greedy packing are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
