"""The pipeline's stages on a small corpus: what each must drop or change, and what must stay."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import brute


def test_stages_take_effect(spark, tmp_path):
    clean = [(i, " ".join(f"w{(i * 7 + j * j) % 997}x{j}" for j in range(40)), "en", f"s{i % 4}", 0) for i in range(60)]
    near = (100, clean[3][1] + " tail", "en", "s1", 0)
    leak = (101, "before " + " ".join(f"item{j}" for j in range(14)) + " after", "en", "s2", 0)
    mail = (102, "write to somebody@mail.example.com today " + " ".join(f"z{j}" for j in range(30)), "en", "s3", 0)
    docs = spark.createDataFrame([*clean, near, leak, mail, (103, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{j}" for j in range(14)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    read = spark.read.parquet(f"{d}/documents.parquet")
    kept = cp.toxicity(spark, read, d)
    assert kept.count() == 64  # labels of one class reject nothing
    firsts = {c for _, _, c in brute.components([(r["doc_id"], r["text"]) for r in read.collect()])}
    apart = cp.near_duplicate_join(spark, read, d)
    assert apart.columns == read.columns and {r["doc_id"] for r in apart.collect()} == firsts and 100 not in firsts
    assert {r["doc_id"] for r in read.collect()} - {r["doc_id"] for r in cp.decontamination(spark, read, d).collect()} == {101}
    masked = cp.personal_data(spark, read, d)
    text = masked.where("doc_id = 102").first()
    assert "[EMAIL]" in text["text"] and text["n_chars"] == len(text["text"]) and masked.columns == read.columns
    packed = cp.run(spark, d)
    assert packed.select("doc_id").distinct().count() == 62
    shared = packed.where("bin is not null").join(read.select("doc_id", "source"), "doc_id").groupBy("shard", "bin", "source").count()
    assert shared.where(F.col("count") > 1).count() == 0
