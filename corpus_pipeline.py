"""From documents to packed token sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterfoil.llm import digest_index, near_dedup, packing, quality_rules, secret_scan
from counterfoil.llm.queries import new_index, vocabulary
from counterfoil.llm.shared import documents, stored

#: SQL can't express the line labelling, the sketches, the secret tests or the tokens; tests use brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the labelled ones among them train the line labelling."""
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.passing(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside; rows equal in doc_id and text are one document."""
    found = digest_index.deduplicate(docs, new_index(spark), "documents").filter("NOT kept")
    copies = stored(found.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")).distinct())
    same = (digest_index.digest(docs["text"]) == copies["_digest"]) & docs["doc_id"].eqNullSafe(copies["_id"])
    # Dealt out at any size, and looked up there, so that the texts are not sorted.
    return docs.join(copies.hint("shuffle_hash"), same, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links.

    Rows that share a doc_id with another text, and rows without one, go by a number of doc_id and text, so
    that each text is judged by itself; rows equal in both stay or go together.
    """
    content = F.xxhash64("text")
    texts = docs.groupBy("doc_id").agg(F.min(content).alias("low"), F.max(content).alias("high"))
    several = stored(texts.filter("doc_id IS NULL OR low != high").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several")))
    number = F.when(several["_several"], F.xxhash64(F.lit("row"), docs["doc_id"], docs["text"])).otherwise(docs["doc_id"])
    row = F.struct(*[docs[n] for n in docs.columns]).alias("_row")
    numbered = docs.join(several, docs["doc_id"].eqNullSafe(several["_id"]), "left").select(row, number.alias("_number"))
    groups = near_dedup.near_duplicates(numbered.select(F.col("_number").alias("doc_id"), "_row.text"))
    dropped = stored(groups.filter("NOT kept").select(F.col("doc_id").alias("_number")).distinct())
    return numbered.join(dropped, "_number", "left_anti").select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark."""
    return secret_scan.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; the result is that of the packing.

    A null text is an empty one, which the quality rules reject; texts may have any length. Of repeated rows with
    equal doc_id and text all or none are left. Further columns are carried along, whatever their names, and an
    empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
