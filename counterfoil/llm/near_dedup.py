"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

A sketch of t coordinates is filled in rounds: round i hashes every shingle to one random
coordinate and a value that begins with i, and each coordinate keeps its least value. Round t + j
sends all shingles to coordinate j, so every coordinate is filled for certain, and large sets are
done after a few rounds. Bands of coordinates give buckets.

Links are those of the buckets, confirmed on the full sets. In each bucket all members are first
held against one pivot, and members of buckets with several components against a few more pivots in
some rounds. What is still in such buckets then goes through an exact prefix join on shingles ordered by
rarity, which finds every link that is left, so a bucket of n members costs some n comparisons and no link
between bucket mates in different components is lost. Equal sets are one node throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesview import LANES, U64, Chunk, chunks, mix, word_hashes, words
from .components import components
from .shared import stored

FULL = U64(2**64 - 1)
ROUNDS = 2  # of further pivots at most; what they leave open goes through the prefix join


@dataclass(frozen=True)
class Banding:
    """bands of rows coordinates each. 112 bands of 8 miss a pair of similarity 0.75 once in 130,000 times.

    Long bands keep pairs out that share a passage only: at similarity 0.2 one in 3,500 meets in a bucket.
    """

    bands: int = 112
    rows: int = 8

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def shingle_sets(chunk: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, and the bounds of the rows.

    A row with fewer words than `width` has its whole sequence as its only shingle.
    """
    found = words(chunk)
    hashes = word_hashes(chunk, found, lower=True)
    per_row = found.per_row(chunk.rows)
    counts = np.diff(per_row)
    lane = LANES[1]
    grams = lane.rolling(hashes, width)
    whole = found.row[: len(grams)] == found.row[width - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    values = np.concatenate([grams[whole], lane.between(lane.prefix(hashes), per_row[short], per_row[short + 1])])
    owner = np.concatenate([found.row[: len(grams)][whole], short])
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(chunk.rows + 1))
    for start, end in zip(bounds[:-1], bounds[1:]):
        values[start:end].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(chunk.rows + 1))


def sketches(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of `size` coordinates for each set that is not empty, in order."""
    counts = np.diff(bounds)
    counts = counts[counts > 0]
    table = np.full((len(counts), size), FULL)
    open_rows, owner = np.arange(len(counts)), np.repeat(np.arange(len(counts)), counts)
    for turn in range(2 * size):
        if not len(open_rows):
            break
        spread = mix(values + U64((turn * 0x9E3779B97F4A7C15) % 2**64))
        place = ((spread >> U64(40)) * U64(size)) >> U64(24) if turn < size else np.full(len(spread), turn - size, U64)
        value = (U64(turn) << U64(40)) | (spread & U64(2**40 - 1))
        np.minimum.at(table.reshape(-1), owner * size + place.astype(np.int64), value)
        if turn % 4 == 3:  # more rounds than needed change nothing
            still = (table[open_rows] == FULL).any(axis=1)
            open_rows = open_rows[still]
            keep = np.isin(owner, open_rows)
            values, owner = values[keep], owner[keep]
    return table


def band_keys(table: np.ndarray, banding: Banding) -> np.ndarray:
    parts = table.reshape(len(table), banding.bands, banding.rows)
    keys = np.zeros(parts.shape[:2], U64)
    for i in range(banding.rows):
        keys = mix(keys + parts[:, :, i])
    return mix(keys + np.arange(banding.bands, dtype=U64))


def signatures(docs: DataFrame, banding: Banding, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (together a hash of the set) and bands of each document."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, bounds = shingle_sets(chunk, width)
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(values + U64(salt)))]) for salt in (1, 2)]
                sides = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
                counts = np.diff(bounds)
                keys = band_keys(sketches(values, bounds, banding.coordinates), banding).view(np.int64)
                at = np.concatenate([[0], np.cumsum((counts > 0) * banding.bands)]).astype(np.int32)
                columns = [
                    batch.column("doc_id").slice(chunk.first, chunk.rows),
                    pa.array(counts, pa.int64()),
                    *map(pa.array, sides),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1))),
                ]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    return _texts(docs).mapInArrow(run, schema)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """The pairs (a, b) of documents whose full sets reach the similarity; texts meet by shuffled joins."""

    def run(batches):
        for batch in batches:
            first = _sets(batch.column("text_a"), width)
            second = _sets(batch.column("text_b"), width)
            linked = [similar(x, y, percent) for x, y in zip(first, second)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    texts = docs.select("doc_id", "text")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _sets(column: pa.Array, width: int):
    for chunk in chunks(column):
        values, bounds = shingle_sets(chunk, width)
        for start, end in zip(bounds[:-1], bounds[1:]):
            yield values[start:end]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((x, y), key=len)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 75, banding: Banding = Banding(), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document.

    Texts without words are linked with nothing. A row with a null doc_id is linked with nothing and
    has a null component_id. Rows that repeat a doc_id are one document.
    """
    marked = stored(signatures(docs, banding, width))
    linked = marked.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    classes = stored(linked.groupBy(*same).agg(F.min("doc_id").alias("node")))
    nodes = linked.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    members = nodes.select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("_last"))
    pivots = stored(pivots.filter("pivot != _last").select("bucket", "pivot"))
    shared = stored(members.join(pivots, "bucket"))

    met = shared.select(F.col("node").alias("doc_id")).distinct()
    known = stored(_texts(docs).join(met, "doc_id", "left_semi"))
    tried = stored(shared.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(confirmed(tried, known, percent, width))
    labels = components(links)
    for turn in range(ROUNDS):
        more = stored(_further_pivots(_mixed(shared, labels), turn).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        fresh = stored(confirmed(more, known, percent, width))
        tried = tried.union(more)
        if fresh.isEmpty():
            break
        links = links.union(fresh)
        labels = components(links)
    rest = stored(_open_pairs(_mixed(shared, labels), known, percent, width).join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        labels = components(links.union(confirmed(rest, known, percent, width)))

    grouped = classes.join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return (
        marked.drop("bands")
        .join(grouped, same, "left")
        .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets whose members are in different components: each member with its component and the largest."""
    named = shared.join(labels, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "component"))["component"].alias("major"), F.count("*").alias("parts")
    )
    return stored(named.join(stored(mixed.filter("parts > 1").select("bucket", "major")), "bucket"))


def _further_pivots(mixed: DataFrame, turn: int) -> DataFrame:
    """For each member outside the largest component of some bucket, two members of such components.

    In each bucket one member of the largest component is picked by a hash that depends on bucket and
    turn, and a node takes two of the picks of its buckets.
    """
    picks = mixed.filter("component = major").withColumn("pick", F.struct(F.xxhash64("node", "bucket", F.lit(turn)), "node"))
    picks = stored(picks.groupBy("bucket").agg(F.min("pick")["node"].alias("pick")))
    met = mixed.filter("component != major").select("bucket", "node").join(picks, "bucket")
    order = F.struct(F.xxhash64("pick", "node", F.lit(turn)), "pick")
    ends = met.groupBy("node").agg(F.array(F.min(order)["pick"], F.max(order)["pick"]).alias("picks"))
    pairs = ends.select("node", F.explode(F.array_distinct("picks")).alias("pick"))
    return pairs.select(F.least("node", "pick").alias("a"), F.greatest("node", "pick").alias("b")).distinct()


def shingle_rows(docs: DataFrame, width: int = 5) -> DataFrame:
    """node, shingle for each distinct shingle of each document."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                values, bounds = shingle_sets(chunk, width)
                owner = np.repeat(np.arange(chunk.rows), np.diff(bounds))
                nodes = batch.column("doc_id").slice(chunk.first, chunk.rows).take(pa.array(owner))
                yield pa.record_batch([nodes, pa.array(values.view(np.int64))], ["node", "shingle"])

    return _texts(docs).mapInArrow(run, "node long, shingle long")


def _open_pairs(mixed: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs of members in different components that may be similar; all that are similar are among them.

    An exact prefix join. All shingles have one order: first those of one component alone, then the others
    from rare to frequent. If two sets are similar, their first common shingle is among the first of both,
    n - ceil(2p / (100 + p) n) + 1 of the smaller set of n and n - ceil(p / 100 n) + 1 of the larger one, and
    no more may follow it than the overlap leaves. Sets that share only the common part of a group have that part
    last, so they don't meet, however large the group is.
    """
    nodes = stored(mixed.select("node", "n_shingles", "component").distinct())
    grams = stored(shingle_rows(docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), width))
    owned = grams.join(nodes.select("node", "component"), "node")
    held = owned.groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    met = grams.join(held.filter("low != high").select("shingle", "n"), "shingle")
    lists = met.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("n", "shingle")))["shingle"].alias("shared"))
    size = F.col("n_shingles")
    lists = lists.join(nodes, "node").withColumn("alone", size - F.size("shared"))

    def prefix(least: Column, mark: str) -> DataFrame:
        """The first size - least + 1 shingles, of which those that meet no other component are left out."""
        length = F.greatest(size - least + 1 - F.col("alone"), F.lit(0)).cast("int")
        spread = lists.select("node", "n_shingles", "component", "alone", F.posexplode(F.slice("shared", F.lit(1), length)))
        return spread.select(
            F.col("col").alias("shingle"), F.col("node").alias(f"{mark}node"), size.alias(f"{mark}size"),
            F.col("component").alias(f"{mark}part"), (size - F.col("alone") - F.col("pos")).alias(f"{mark}left"),
        )

    small = prefix(_ceil(2 * percent * size, 100 + percent), "s_")
    large = prefix(_ceil(percent * size, 100), "l_")
    overlap = _ceil(percent * (F.col("s_size") + F.col("l_size")), 100 + percent)
    once = (F.col("s_size") < F.col("l_size")) | ((F.col("s_size") == F.col("l_size")) & (F.col("s_node") < F.col("l_node")))
    fits = (100 * F.col("s_size") >= percent * F.col("l_size")) & (F.least("s_left", "l_left") >= overlap)
    pairs = small.join(large, (small["shingle"] == large["shingle"]) & (F.col("s_part") != F.col("l_part")) & once & fits)
    return pairs.select(F.least("s_node", "l_node").alias("a"), F.greatest("s_node", "l_node").alias("b")).distinct()


def _ceil(value: Column, by: int) -> Column:
    return F.floor((value + (by - 1)) / by)
