"""A training-text pipeline: each stage is one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontam, langid, secrets, simhash
from quillgraph.plans.staging import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the learned languages; others go.

    Null and empty texts, texts without a letter, and texts that fit no language (see
    ``langid.keep_identified``) are others.  An empty table stays empty.
    """
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that of the least doc_id, then least fingerprint.

    Rows that share a doc_id, or have none, are told apart by their fingerprint, so that none of
    them goes but for a class in which another row stays; of several texts with one fingerprint under such
    an id, the one with the least XXH64 stays.  Null and empty texts are one class.
    """
    found = cut(simhash.near_duplicates(docs), "simhash-rows")
    heads = found.groupBy("root").agg(F.min_by(F.struct("doc_id", "fp"), F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("h")).select("h.doc_id", "h.fp")
    unclear = found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id")
    if unclear.isEmpty():
        return docs.join(heads.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    unclear = cut(unclear, "simhash-rows")
    clear = docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["doc_id"]), "left_anti").join(heads.select("doc_id"), "doc_id", "left_semi")
    rows, fp = simhash.with_fingerprints(docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["doc_id"]), "left_semi"))
    rows = rows.withColumn("__hash", decontam.text_hash())
    kept = heads.join(rows.groupBy(F.col("doc_id").alias("d"), F.col(fp).alias("f")).agg(F.min("__hash").alias("least")), heads["doc_id"].eqNullSafe(F.col("d")) & (heads["fp"] == F.col("f"))).select("d", "f", "least")
    picked = rows.join(kept, rows["doc_id"].eqNullSafe(kept["d"]) & (rows[fp] == kept["f"]) & (rows["__hash"] == kept["least"]), "left_semi").dropDuplicates(["doc_id", fp])
    return clear.select(*docs.columns).unionByName(picked.select(*docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark, however small a part of them; each is judged by its own text.

    Null, empty and word-free texts stay, and all rows do if the test set or the table is empty.

    A verdict meets its rows by doc_id and the hash of the text: rows that agree in both have one verdict.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontam.decontaminate(docs, items).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad_id")) & (decontam.text_hash() == F.col("bad_hash")), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted in their text; null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests of ids and decoded text.

    Null and empty texts have no tokens; an empty table gives an empty result.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: Code lengths, XXH64 and BPE have no counterpart in the oracle's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
