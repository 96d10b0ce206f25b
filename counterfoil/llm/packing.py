"""Best-fit packing of token pieces into sequences of a fixed length, planned on a length histogram.

The histogram has at most one entry per length, so the plan is small whatever the corpus. It says
for each length which ranks go to which sequences; a piece's rank within its length, taken from
counts per (length, bucket), then names its place. No length is ranked in one task.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import encode, encoding
from .shared import stored

# Outside these characters the Unicode tables of the two libraries might differ.
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7E\xA1-\xAC\xAE-ſ]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Vocabulary:
    """One byte-level BPE vocabulary as files of two libraries.

    The tokenizers file defines the ids. The rank file is the same vocabulary for tiktoken, which is
    several times faster and is used for texts of common characters only.
    """

    tokenizer: str
    ranks: str
    pattern: str


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # such strings in a text are ordinary text
    return model


def token_ids(text: str, vocabulary: Vocabulary) -> np.ndarray:
    if UNUSUAL.search(text):
        return np.array(_tokenizer(vocabulary.tokenizer).encode(text, add_special_tokens=False).ids, np.uint32)
    return encode(encoding(vocabulary.ranks, vocabulary.pattern), text).astype(np.uint32)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of `size`, the first may be shorter."""
    first = n % size or size
    return [(0, min(n, first))] + [(start, size) for start in range(first, n, size)]


def pieces(docs: DataFrame, vocabulary: Vocabulary, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids and end_id: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def run(batches):
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(token_ids(text.as_py(), vocabulary), np.uint32(end_id))
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.astype("<u4").tobytes()), part)
                    for column, value in zip(out.values(), row):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = list(out)[: 6 if with_ids else 5]
            yield pa.record_batch([pa.array(out[n], k) for n, k in zip(names, kinds)], names)

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """Where the ranks of each length go.

    slots[length] lists runs in rank order: (first rank, copies in a sequence, first sequence,
    offset of the first copy). Sequences of one shape have consecutive numbers.
    """

    sequences: int
    slots: dict[int, list[tuple[int, int, int, int]]]


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Best fit, longest first, over counts: groups of equally filled sequences are filled together.

    A group is (free space, number of sequences, contents); each length either fills whole groups or
    splits one, so there are a few groups per length.
    """
    free: list[int] = []  # sorted spaces that some group has
    groups: dict[int, list[tuple[int, tuple]]] = {}

    def put(space: int, count: int, shape: tuple) -> None:
        if count:
            if space not in groups:
                groups[space] = []
                bisect.insort(free, space)
            groups[space].append((count, shape))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(free, length)
            space, (count, shape) = size, (left, ())
            if at < len(free):
                space = free[at]
                count, shape = groups[space].pop()
                if not groups[space]:
                    del groups[space], free[at]
            each = space // length
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            put(space - each * length, full, (*shape, (length, each)))
            put(space - rest * length, int(rest > 0), (*shape, (length, rest)))
            if shape:
                put(space, count - full - (rest > 0), shape)
            left -= full * each + rest
    made: Counter = Counter()
    total, slots = 0, {}
    for space in free:
        for count, shape in groups[space]:
            offset = 0
            for length, each in shape:
                slots.setdefault(length, []).append((made[length], each, total, offset))
                made[length] += each * count
                offset += length * each
            total += count
    return Plan(total, slots)


def ranked(found: DataFrame, buckets: int) -> DataFrame:
    """rank from 0 of each row within its length, without a task that holds a whole length."""
    dealt = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("_within", F.row_number().over(inside) - 1)
    joined = numbered.join(counts, ["length", "_bucket"])
    return joined.withColumn("rank", F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def pack(found: DataFrame, size: int, buckets: int = 512) -> DataFrame:
    """found with sequence_id and offset; every piece gets a place and offsets leave no gap.

    `found` is read three times and should be a written table. `buckets` splits a length that many
    pieces share; it changes which equal piece goes where, not the number of sequences.
    """
    histogram = {row["length"]: row["n"] for row in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(histogram, size)
    slots = {length: np.array(runs, np.int64) for length, runs in made.slots.items()}

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own, runs = np.flatnonzero(lengths == length), slots[length]
                run = runs[np.searchsorted(runs[:, 0], ranks[own], "right") - 1]
                inside = ranks[own] - run[:, 0]
                sequence[own] = run[:, 2] + inside // run[:, 1]
                offset[own] = run[:, 3] + inside % run[:, 1] * length
            kept = batch.drop_columns(["rank"])
            yield pa.record_batch([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"{name} {kind}" for name, kind in found.dtypes) + ", sequence_id long, offset long"
    return ranked(found, buckets).select(*found.columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(stored(pieces(docs, vocabulary, size, end_id)), size)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids of each sequence, from placed pieces with ids; a sequence is of bounded length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
