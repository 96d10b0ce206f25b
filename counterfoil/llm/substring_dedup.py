"""Removal of long word sequences that also stand in a document with a smaller doc_id.

The reference index holds non-overlapping blocks of half a window at fixed places of each document,
so every window that repeats holds a whole block of the document it repeats. Every rolling window of
a block's length is probed against the index, and hits are extended to exact repeats: all windows
around hits and around the blocks hit are grouped by content, which gives each window the smallest
document that holds it, and windows that follow each other make up the maximal repeats.

Two steps save work and change no result. Of equal documents only the smallest is searched, as the
others go entirely. And a window's smallest inner fingerprint must stand in two documents, or else
the window repeats nowhere; blocks and probes are made only where it does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import LANES, Chunk, Words, chunks, leftmost_minima, runs, signed, word_hashes, words
from .shared import stored

EMPTY = hashlib.sha256(b"").hexdigest()
ANCHOR = 16  # words in the fingerprint of the first step; at most half a window


def repeated_words(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document.

    Windows are judged on the input. Of rows with equal doc_id each is judged alone. A row with a null
    doc_id loses nothing and takes nothing from others.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = stored(_whole(texts))
    same = ["seq_a", "seq_b", "n_words"]
    long = marked.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    firsts = stored(long.groupBy(*same).agg(F.min("doc_id").alias("first_doc")))

    anchors = _anchors(texts.filter("doc_id IS NOT NULL"), size)
    twice = anchors.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    twice = stored(twice.filter("_low != _high").select("anchor"))
    regions = anchors.join(twice, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("regions"))
    searched = firsts.select(F.col("first_doc").alias("doc_id"))
    regions = stored(regions.join(searched, "doc_id", "left_semi"))
    work = stored(regions.join(texts, "doc_id"))

    blocks = _blocks(work, size // 2)
    index = stored(blocks.groupBy("block").agg(F.min("doc_id").alias("low")))
    probes = _rolling(work, size // 2)
    hits = stored(probes.join(index, "block").filter("low < doc_id").select("doc_id", "at", "block"))
    targets = blocks.join(hits.select("block").distinct(), "block").select("doc_id", "at")
    spots = hits.select("doc_id", "at").union(targets).groupBy("doc_id").agg(F.collect_set("at").alias("spots"))
    around = stored(work.select("doc_id", "text").join(spots, "doc_id"))

    windows = _windows(around, size)
    least = stored(windows.groupBy("win_a", "win_b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low != high").drop("high"))
    covered = windows.join(least, ["win_a", "win_b"]).filter("low < doc_id")
    covered = covered.groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    partly = stored(_cut(around.select("doc_id", "text").join(covered, "doc_id"), size))

    keep = F.col("doc_id").isNull() | (F.col("n_words") < size) | F.col("first_doc").isNull()
    whole = ~keep & (F.col("first_doc") < F.col("doc_id"))
    return (
        marked.join(firsts, same, "left")
        .join(partly, "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(whole, F.col("n_words")).when(keep, F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(EMPTY)).when(keep, F.col("all_sha256")).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        )
    )


def _whole(texts: DataFrame) -> DataFrame:
    """Number of words, a 128-bit fingerprint of the word sequence and its digest."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = words(chunk)
                bounds = found.per_row(chunk.rows)
                prints = []
                for lane in (0, 1):
                    prefix = LANES[lane].prefix(word_hashes(chunk, found, lane))
                    prints.append(signed(LANES[lane].between(prefix, bounds[:-1], bounds[1:])))
                digests = [hashlib.sha256(b" ".join(chunk.text(i).split())).hexdigest() for i in range(chunk.rows)]
                ids = batch.column("doc_id").slice(chunk.first, chunk.rows)
                counts = pa.array(np.diff(bounds), pa.int64())
                yield pa.record_batch([ids, counts, *prints, pa.array(digests)], ["doc_id", "n_words", "seq_a", "seq_b", "all_sha256"])

    return texts.mapInArrow(run, "doc_id long, n_words long, seq_a long, seq_b long, all_sha256 string")


def _anchors(texts: DataFrame, size: int) -> DataFrame:
    """anchor, doc_id, first, last: windows first to last of the document have this smallest fingerprint."""
    width = min(ANCHOR, size // 2)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = words(chunk)
                prints = LANES[0].rolling(word_hashes(chunk, found), width)
                minima = leftmost_minima(prints, size - width + 1)
                if not len(minima):
                    continue
                inside = np.flatnonzero(found.row[: len(minima)] == found.row[size - 1 :])
                starts, ends = runs(minima[inside])
                first, last = inside[starts], inside[ends - 1]
                row = found.row[first]
                origin = found.per_row(chunk.rows)[row]
                ids = batch.column("doc_id").slice(chunk.first, chunk.rows).take(pa.array(row))
                spans = [pa.array((x - origin).astype(np.int32)) for x in (first, last)]
                yield pa.record_batch([signed(prints[minima[first]]), ids, *spans], ["anchor", "doc_id", "first", "last"])

    return texts.mapInArrow(run, "anchor long, doc_id long, first int, last int")


def _each(work: DataFrame, column: str, emit, schema: str) -> DataFrame:
    """`emit(chunk, words, bounds, values of the column per row)` gives the row and the columns of each output row."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = words(chunk)
                values = batch.column(column).slice(chunk.first, chunk.rows)
                row, columns = emit(chunk, found, found.per_row(chunk.rows), values)
                ids = batch.column("doc_id").slice(chunk.first, chunk.rows).take(pa.array(row))
                yield pa.record_batch([ids, *columns], [part.split()[0] for part in schema.split(", ")])

    return work.select("doc_id", "text", column).mapInArrow(run, schema)


def _marked(found: Words, bounds: np.ndarray, regions: pa.Array) -> np.ndarray:
    """Which windows (by first word) lie in a region."""
    flat = regions.flatten()
    row = np.repeat(np.arange(len(regions)), np.diff(regions.offsets.to_numpy()))
    steps = np.zeros(len(found.starts) + 1, np.int64)
    np.add.at(steps, bounds[row] + flat.field("first").to_numpy(), 1)
    np.add.at(steps, bounds[row] + flat.field("last").to_numpy() + 1, -1)
    return np.cumsum(steps)[:-1] > 0


def _widened(marks: np.ndarray, reach: int) -> np.ndarray:
    """Positions at most `reach` after a mark."""
    steps = np.zeros(len(marks) + reach + 2, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + reach + 1, -1)
    return np.cumsum(steps)[: len(marks)] > 0


def _spots(size: int, every_place: bool):
    """Blocks of `size` words inside the windows of the regions: all of them, or those at fixed places."""

    def emit(chunk: Chunk, found: Words, bounds: np.ndarray, regions: pa.Array):
        prints = LANES[1].rolling(word_hashes(chunk, found, 1), size)
        n = len(prints)
        row = found.row[:n]
        # A window of 2 * size words holds the blocks that start at most `size` words after it.
        wanted = _widened(_marked(found, bounds, regions), size)[:n] & (row == found.row[size - 1 :][:n])
        place = np.arange(n) - bounds[row]
        if not every_place:
            wanted &= place % size == 0
        at = np.flatnonzero(wanted)
        return row[at], [signed(prints[at]), pa.array(place[at].astype(np.int32))]

    return emit


def _blocks(work: DataFrame, size: int) -> DataFrame:
    return _each(work, "regions", _spots(size, False), "doc_id long, block long, at int")


def _rolling(work: DataFrame, size: int) -> DataFrame:
    return _each(work, "regions", _spots(size, True), "doc_id long, block long, at int")


def _windows(around: DataFrame, size: int) -> DataFrame:
    """A 128-bit fingerprint of each window that holds a block hit; `at` is its first word."""

    def emit(chunk: Chunk, found: Words, bounds: np.ndarray, spots: pa.Array):
        lanes = [LANES[k].rolling(word_hashes(chunk, found, k), size) for k in (0, 1)]
        n = len(lanes[0])
        row = found.row[:n]
        marks = np.zeros(len(found.starts), bool)
        owner = np.repeat(np.arange(len(spots)), np.diff(spots.offsets.to_numpy()))
        marks[bounds[owner] + spots.flatten().to_numpy()] = True
        reach = size - size // 2
        ahead = _widened(marks[::-1], reach)[::-1][:n]
        at = np.flatnonzero(ahead & (row == found.row[size - 1 :][:n]))
        return row[at], [signed(lane[at]) for lane in lanes] + [pa.array((at - bounds[row[at]]).astype(np.int32))]

    return _each(around, "spots", emit, "doc_id long, win_a long, win_b long, at int")


def _cut(covered: DataFrame, size: int) -> DataFrame:
    """What is left of each text without the words of the windows that begin at `starts`."""

    def run(batches):
        for batch in batches:
            out = []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                parts = np.array(text.as_py().encode().split(), dtype=object)
                marks = np.zeros(len(parts), bool)
                marks[starts.values.to_numpy()] = True
                gone = _widened(marks, size - 1)
                out.append((int(gone.sum()), hashlib.sha256(b" ".join(parts[~gone])).hexdigest()))
            removed, kept = zip(*out) if out else ((), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "kept_sha256"])

    return covered.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_removed long, kept_sha256 string")
