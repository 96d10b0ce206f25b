"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of events is folded into one signed row per group and written under its batch id.
Totals are sums over the committed batches, so the order of batches does not matter. Writing a
batch again replaces its own rows only, which makes a repeated commit harmless.
"""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode, encoding

GROUP = ("source", "lang", "tokenizer_version")
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, batch_id string"


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, source, lang, n_tokens for each row of doc_id, source, lang, text; a null text has no tokens."""

    def run(batches):
        model = encoding(path, pattern)
        for batch in batches:
            counts = [len(encode(model, text.as_py())) for text in batch.column("text")]
            kept = [batch.column(name) for name in ("doc_id", "source", "lang")]
            yield pa.record_batch([*kept, pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    texts = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def inserts(counted: DataFrame, version: str) -> DataFrame:
    return _events(counted, version, "insert", F.lit(None).cast("long"), F.col("n_tokens"))


def deletes(counted: DataFrame, version: str) -> DataFrame:
    """`counted` holds the counts with which the documents went in."""
    return _events(counted, version, "delete", F.col("n_tokens"), F.lit(None).cast("long"))


def revisions(counted: DataFrame, version: str) -> DataFrame:
    """`counted` has old_tokens and n_tokens; a null on either side counts as 0."""
    return _events(counted, version, "revise", F.col("old_tokens"), F.col("n_tokens"))


def _events(counted: DataFrame, version: str, kind: str, old: Column, new: Column) -> DataFrame:
    return counted.select(
        "source",
        "lang",
        F.lit(version).alias("tokenizer_version"),
        F.lit(kind).alias("kind"),
        old.alias("old_tokens"),
        new.alias("new_tokens"),
    )


def signed(events: DataFrame) -> DataFrame:
    """One signed row per group; an unknown kind of event stops the job."""
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1)
    sign = sign.when(F.col("kind") == "revise", 0)
    sign = sign.otherwise(F.raise_error(F.concat(F.lit("unknown event "), F.coalesce("kind", F.lit("null")))).cast("int"))
    change = F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return events.groupBy(*GROUP).agg(
        F.sum(sign.cast("long")).alias("n_docs"), F.sum(change).alias("n_tokens")
    )


class TokenRollup:
    """Committed deltas below `folder`, which all machines must reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def commit(self, batch_id: str, events: DataFrame) -> None:
        """Write the batch's signed rows in place of any that an earlier try of the batch left.

        A batch without events leaves no rows. The rows of a try that fails are not seen, as they lie in
        Spark's temporary folder until all of them are written; the batch is then to be tried again.
        """
        if not batch_id:
            raise ValueError("a batch needs an id")
        signed(events).write.mode("overwrite").parquet(f"{self.folder}/batch_id={quote(batch_id, safe='')}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups without documents or tokens are left out."""
        deltas = self.spark.read.schema(DELTAS).parquet(self.folder)
        sums = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
