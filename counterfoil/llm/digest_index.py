"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by digest. A batch of
new documents is reduced to one row per digest, sort-merge anti-joined with the index (whose
buckets need no shuffle) and what is new is appended. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

INDEX_COLUMNS = "digest binary, keep_id long, n_chars long, group_size long, batch_id string"


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest and number of code points of each row of doc_id, text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", digest(text).alias("digest"), F.length(text).cast("long").alias("n_chars"))


def best_per_digest(marked: DataFrame) -> DataFrame:
    """Of each digest: the row with the most code points, then the smallest doc_id, and the number of rows.

    A null doc_id loses against any other at equal length.
    """
    order = F.struct("n_chars", (-F.col("doc_id")).alias("back"))
    return (
        marked.groupBy("digest")
        .agg(F.max(order).alias("best"), F.count("*").alias("group_size"))
        .select("digest", (-F.col("best.back")).alias("keep_id"), "best.n_chars", "group_size")
    )


class DigestIndex:
    """A bucketed table of digests seen so far.

    `table` names it in the session's catalog; `buckets` should be the number of shuffle
    partitions of the largest batch, as it is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int):
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], INDEX_COLUMNS))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def committed(self, batch_id: str) -> bool:
        return not self.rows().filter(F.col("batch_id") == batch_id).isEmpty()

    def add(self, classes: DataFrame, batch_id: str) -> DataFrame:
        """Append the digests that no earlier batch has and return this batch's rows of the index.

        `classes` has one row per digest. A batch that is already committed is not appended
        again, so a job that failed after the commit can be repeated.
        """
        if not self.committed(batch_id):
            held = self.rows().select("digest").hint("merge")
            fresh = classes.join(held, "digest", "left_anti")
            names = [name.split()[0] for name in INDEX_COLUMNS.split(", ")]
            self._append(fresh.withColumn("batch_id", F.lit(batch_id)).select(names))
        return self.rows().filter(F.col("batch_id") == batch_id)

    def held(self, classes: DataFrame) -> DataFrame:
        """digest, keep_id, group_size of the digests of `classes`; only these are shuffled, not the index."""
        asked = classes.select("digest").hint("merge")
        return self.rows().join(asked, "digest", "left_semi").select("digest", "keep_id", "group_size")


def deduplicate(docs: DataFrame, index: DigestIndex, batch_id: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document of the batch.

    Ties of length go to the smaller doc_id. A text that an earlier batch holds keeps that
    batch's document; group_size counts the batch in which the text came first. Rows with equal
    doc_id and text are both kept rows. Null texts are empty ones, and texts may have any length. What is read of
    the index goes with the batch: its rows meet the index in the index's buckets, and what they find is then
    joined with the documents, where a text with very many copies can be split.
    """
    marked = stored(fingerprints(docs))
    classes = stored(best_per_digest(marked))
    index.add(classes, batch_id)
    known = stored(index.held(classes))
    return marked.join(known, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
