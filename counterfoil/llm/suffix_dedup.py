"""Removal of bytes covered by long strings that also start anywhere else in the corpus.

Strings are judged by a Burrows-Wheeler transform and common prefixes (see bwt.py), built column by
column over collections of short segments, so the number of rounds is bounded by the segment length
and not by the longest document. Segments come about like this:

* The leftmost smallest fingerprint (anchor) inside a window depends on the window's content only. A
  run of windows with one anchor is a segment, and equal windows have equal anchors, so a collection
  that holds all segments of an anchor sees every repeat of their windows.
* Anchors that stand at one place only are left out, as their windows can't repeat.
* Equal segments are one segment with a count. Where an anchor has one segment only, or a segment
  stands at several places, the count tells that its windows repeat.
* In a collection a short number stands for the bytes of an anchor, since each window of a segment holds
  its whole anchor. That leaves fewer columns and shorter ones, and equal windows stay equal.
* An anchor with very many different segments (a passage common to many documents) is not put into
  one collection. Its segments are cut into parts of a few windows each, by the place of the anchor in
  the window. The bytes that all windows of a part share take the anchor's place, and the parts are
  judged like segments. Where even these have very many kinds, single windows are counted by content.

Equal texts are one text throughout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bwt import Collection
from .bytesview import LANES, Chunk, chunks, leftmost_minima, mix, runs, signed
from .shared import stored

EMPTY = hashlib.sha256(b"").hexdigest()
MANY = 256  # different segments of an anchor beyond which they are cut further
PART = 13  # windows in a part
COLLECTION = 1 << 20  # bytes of segments in a collection, give or take an anchor's
CACHED = 1 << 18  # bytes of text whose fingerprints are made at a time, give or take a text
RUNS = "array<struct<first: int, last: int>>"


def repeated_bytes(docs: DataFrame, size: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, texts taken as UTF-8 bytes.

    A null text is empty. Rows with equal or null doc_id are judged by their texts like all others.
    """
    if not 4 <= size < 256:
        raise ValueError("strings of 4 to 255 bytes can be searched")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64(text)).alias("rid"), text.alias("text"))
    marked = stored(_whole(texts))
    same = ["text_a", "text_b", "n_bytes"]
    long = marked.filter(F.col("n_bytes") >= size)
    classes = stored(long.groupBy(*same).agg(F.count("*").alias("copies"), F.min("rid").alias("rid")))

    anchors = _anchors(texts, size)
    places = anchors.groupBy("anchor").agg(
        *[f("text_a").alias(f"{f.__name__}_text") for f in (F.min, F.max)],
        *[f("first").alias(f"{f.__name__}_first") for f in (F.min, F.max)],
    )
    twice = stored(places.filter("min_text != max_text OR min_first != max_first").select("anchor"))
    regions = anchors.join(twice, "anchor").groupBy("text_a")
    regions = stored(regions.agg(F.collect_set(F.struct("first", "last", "anchor", "place")).alias("regions")))
    searched = classes.select("rid", "text_a").join(regions, "text_a")
    work = stored(searched.join(texts.select("rid", "text"), "rid").select("text_a", "text", "regions"))

    segments = _segments(work, size).groupBy("anchor", "seg_a", "seg_b")
    distinct = stored(segments.agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("place", "segment")]))
    decided = stored(_repeats(distinct, size, _width(size), _by_parts))

    covered = _segments(work, size, with_bytes=False).join(decided, ["seg_a", "seg_b"])
    covered = covered.select("text_a", _moved().alias("runs"))
    covered = covered.groupBy("text_a").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    partly = stored(_cut(work.select("text_a", "text").join(covered, "text_a"), size).distinct())

    copied = F.col("copies") > 1
    known = classes.select(*same, "copies").join(partly, ["text_a", "text_b"], "left")
    known = known.select(
        *same,
        F.when(copied, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copied, F.lit(EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    return marked.join(known, same, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
    )


def _moved() -> Column:
    """The runs, counted from `first`."""
    first = F.col("first")
    return F.transform("runs", lambda r: F.struct((first + r["first"]).alias("first"), (first + r["last"]).alias("last")))


def _repeats(distinct: DataFrame, size: int, width: int, further) -> DataFrame:
    """seg_a, seg_b, runs of windows that repeat, for different segments with their numbers of places.

    All windows of a segment hold the `width` bytes at its `place`. `further` judges those of anchors with very many kinds.
    """
    groups = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    groups = stored(groups.filter("kinds > 1 AND least = 1").select("anchor", "kinds"))
    open_ones = stored(distinct.join(groups, "anchor"))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.length("segment") - size).alias("last")))
    decided = distinct.filter("n > 1").select("seg_a", "seg_b", whole.cast(RUNS).alias("runs"))
    decided = decided.union(_by_transform(open_ones.filter(F.col("kinds") <= MANY), size, width))
    return decided.union(further(open_ones.filter(F.col("kinds") > MANY), size))


def _width(size: int) -> int:
    """Bytes of an anchor."""
    return max(2, size * 12 // 25)


def _prints(chunk: Chunk, lane: int) -> np.ndarray:
    return LANES[lane].prefix(LANES[lane].table[chunk.data])


def _names(chunk: Chunk) -> list[np.ndarray]:
    """The 128-bit fingerprint of each text."""
    return [LANES[k].between(_prints(chunk, k), chunk.bounds[:-1], chunk.bounds[1:]) for k in (0, 1)]


def _whole(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), CACHED):
                ids = [batch.column(name).slice(chunk.first, chunk.rows) for name in ("doc_id", "rid")]
                digests = pa.array([hashlib.sha256(chunk.text(i)).hexdigest() for i in range(chunk.rows)])
                columns = [*ids, pa.array(np.diff(chunk.bounds)), *map(signed, _names(chunk)), digests]
                yield pa.record_batch(columns, ["doc_id", "rid", "n_bytes", "text_a", "text_b", "all_sha256"])

    return texts.mapInArrow(run, "doc_id long, rid long, n_bytes long, text_a long, text_b long, all_sha256 string")


def _anchors(texts: DataFrame, size: int) -> DataFrame:
    """anchor, text_a, first, last, place: windows that begin at first to last have the anchor at first + place."""
    width = _width(size)

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), CACHED):
                n = len(chunk.data)
                if n < size:
                    continue
                prefix = _prints(chunk, 0)
                prints = LANES[0].windows(prefix, width)
                minima = leftmost_minima(prints, size - width + 1)
                row = np.repeat(np.arange(chunk.rows), np.diff(chunk.bounds))
                inside = np.flatnonzero(row[: len(minima)] == row[size - 1 :])
                starts, ends = runs(minima[inside])
                first, last = inside[starts], inside[ends - 1]
                own = row[first]
                name = LANES[0].between(prefix, chunk.bounds[:-1], chunk.bounds[1:])[own]
                spans = (first - chunk.bounds[own], last - chunk.bounds[own], minima[first] - first)
                spans = [pa.array(x.astype(np.int32)) for x in spans]
                columns = [signed(prints[minima[first]]), signed(name), *spans]
                yield pa.record_batch(columns, ["anchor", "text_a", "first", "last", "place"])

    return texts.select("text").mapInArrow(run, "anchor long, text_a long, first int, last int, place int")


def _segments(work: DataFrame, size: int, with_bytes: bool = True) -> DataFrame:
    """seg_a, seg_b (a fingerprint), text_a and first of each region, and its anchor, place and bytes if wanted."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text"), CACHED):
                regions = batch.column("regions").slice(chunk.first, chunk.rows)
                names = batch.column("text_a").slice(chunk.first, chunk.rows).to_numpy()
                # A doc_id that stands for several texts has met the regions of all of them.
                right = np.flatnonzero(_names(chunk)[0].view(np.int64) == names)
                counts = np.diff(regions.offsets.to_numpy())
                row = np.repeat(np.arange(chunk.rows), counts)
                flat, own = regions.flatten(), np.isin(row, right)
                row = row[own]
                first, last, anchor, spot = (flat.field(k).to_numpy()[own] for k in ("first", "last", "anchor", "place"))
                start, end = chunk.bounds[row] + first, chunk.bounds[row] + last + size
                prints = [signed(LANES[k].between(_prints(chunk, k), start, end)) for k in (0, 1)]
                columns = [*prints, pa.array(names[row]), pa.array(first)]
                if with_bytes:
                    data = chunk.data.tobytes()
                    cut = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
                    columns += [pa.array(anchor), pa.array(spot), pa.array(cut, pa.binary())]
                yield pa.record_batch(columns, names_out)

    schema = "seg_a long, seg_b long, text_a long, first int" + ", anchor long, place int, segment binary" * with_bytes
    names_out = [part.split()[0] for part in schema.split(", ")]
    return work.mapInArrow(run, schema)


def _shortened(segments: list[bytes], places: list[int], width: int) -> tuple[list[bytes], int]:
    """Segments with a mark and a number for the `width` bytes at their places, and by how much each is shorter.

    The mark stands in no segment, so two strings that hold it and are equal hold it at the same place, with
    the same number behind it, which stands for the same bytes.
    """
    cores = [segment[at : at + width] for segment, at in zip(segments, places)]
    number = {core: k for k, core in enumerate(dict.fromkeys(cores))}
    digits = 1
    while 128**digits < len(number):
        digits += 1
    used = np.bincount(np.frombuffer(b"".join(segments), np.uint8), minlength=256) > 0
    used[:128] = True
    if width <= digits + 1 or used.sum() > 254:
        return segments, 0
    mark = int(np.flatnonzero(~used)[0])
    codes = {core: bytes([mark, *(k >> 7 * d & 127 for d in range(digits))]) for core, k in number.items()}
    short = [s[:at] + codes[core] + s[at + width :] for s, at, core in zip(segments, places, cores)]
    return short, width - digits - 1


def _by_transform(segments: DataFrame, size: int, width: int) -> DataFrame:
    """seg_a, seg_b, runs of windows that repeat, for segments that stand at one place."""
    total = segments.agg(F.sum(F.length("segment"))).first()[0] or 0
    dealt = segments.repartition(max(1, total // COLLECTION), "anchor").sortWithinPartitions("anchor")

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        short, less = _shortened([row[4] for row in rows], [row[5] for row in rows], width)
        marks = Collection(short, size - less).repeats()
        out = []
        for (_, seg_a, seg_b, n, _, _), mark in zip(rows, marks):
            if n == 1 and mark.any():
                found = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                out.append((seg_a, seg_b, [{"first": a, "last": b - 1} for a, b in found.tolist()]))
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["seg_a", "seg_b", "runs"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held >= COLLECTION and row[0] != rows[-1][0]:
                    yield judged(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield judged(rows)

    return dealt.select("anchor", "seg_a", "seg_b", "n", "segment", "place").mapInArrow(run, f"seg_a long, seg_b long, runs {RUNS}")


def _by_parts(segments: DataFrame, size: int) -> DataFrame:
    """seg_a, seg_b, runs for anchors with very many segments, cut by the place of the anchor in the window."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("segment")):
                given = batch.slice(chunk.first, chunk.rows)
                windows = np.diff(chunk.bounds) - size + 1
                place = given.column("place").to_numpy().astype(np.int64)
                # The anchor stands at `place` in window 0 and one byte earlier in each window after it.
                highest, lowest = place // PART, (place - windows + 1) // PART
                row = np.repeat(np.arange(chunk.rows), highest - lowest + 1)
                part = highest[row] - (np.arange(len(row)) - np.searchsorted(row, row))
                first = np.maximum(0, place[row] - part * PART - PART + 1)
                last = np.minimum(windows[row] - 1, place[row] - part * PART)
                origin = chunk.bounds[row]
                start, end = origin + first, origin + last + size
                core = origin + place[row] - part * PART
                prints = [LANES[k].between(_prints(chunk, k), start, end) for k in (0, 1)]
                shared = LANES[0].between(_prints(chunk, 0), core, core - PART + 1 + size)
                shared = mix(shared + part.astype(np.uint64))
                data = chunk.data.tobytes()
                cut = pa.array([data[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())
                kept = given.select(["seg_a", "seg_b", "n"]).take(pa.array(row))
                numbers = [pa.array(x.astype(np.int32)) for x in (first, core - start)]
                columns = [*kept.columns, *map(signed, [shared, *prints]), *numbers, cut]
                yield pa.record_batch(columns, names)

    schema = "seg_a long, seg_b long, n long, anchor long, part_a long, part_b long, first int, place int, segment binary"
    names = [part.split()[0] for part in schema.split(", ")]
    parts = stored(segments.select("seg_a", "seg_b", "n", "place", "segment").mapInArrow(run, schema))
    distinct = parts.groupBy("anchor", F.col("part_a").alias("seg_a"), F.col("part_b").alias("seg_b"))
    distinct = stored(distinct.agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("place", "segment")]))
    decided = stored(_repeats(distinct, size, size - PART + 1, _by_windows))
    decided = decided.select(F.col("seg_a").alias("part_a"), F.col("seg_b").alias("part_b"), "runs")
    found = parts.drop("place", "segment").join(decided, ["part_a", "part_b"]).select("seg_a", "seg_b", _moved().alias("runs"))
    return found.groupBy("seg_a", "seg_b").agg(F.flatten(F.collect_list("runs")).cast(RUNS).alias("runs"))


def _by_windows(segments: DataFrame, size: int) -> DataFrame:
    """The same by counting every window by its content."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("segment")):
                row = np.repeat(np.arange(chunk.rows), np.diff(chunk.bounds))
                start = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
                own = row[start]
                part = batch.slice(chunk.first, chunk.rows).select(["seg_a", "seg_b", "n"]).take(pa.array(own))
                prints = [signed(LANES[k].between(_prints(chunk, k), start, start + size)) for k in (0, 1)]
                at = pa.array((start - chunk.bounds[own]).astype(np.int32))
                yield pa.record_batch([*part.columns, *prints, at], ["seg_a", "seg_b", "n", "win_a", "win_b", "at"])

    schema = "seg_a long, seg_b long, n long, win_a long, win_b long, at int"
    windows = segments.select("seg_a", "seg_b", "n", "segment").mapInArrow(run, schema)
    key = ["win_a", "win_b"]
    twice = stored(windows.groupBy(*key).agg(F.sum("n").alias("_n")).filter("_n > 1").select(*key))
    hit = windows.filter("n = 1").join(twice, key).groupBy("seg_a", "seg_b")
    single = F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last")))
    return hit.agg(single.cast(RUNS).alias("runs"))


def _cut(covered: DataFrame, size: int) -> DataFrame:
    """n_removed, n_spans, kept_sha256 of each text without the bytes of the windows in `runs`."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                lists = batch.column("runs").slice(chunk.first, chunk.rows)
                row = np.repeat(np.arange(chunk.rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                names = _names(chunk)
                given = batch.column("text_a").slice(chunk.first, chunk.rows).to_numpy()
                right = (names[0].view(np.int64) == given)[row]
                steps = np.zeros(len(chunk.data) + 1, np.int64)
                for field, sign, more in (("first", 1, 0), ("last", -1, size)):
                    np.add.at(steps, (chunk.bounds[row] + flat.field(field).to_numpy() + more)[right], sign)
                gone = np.cumsum(steps)[:-1] > 0
                removed, spans, kept = [], [], []
                for start, end in zip(chunk.bounds[:-1], chunk.bounds[1:]):
                    own = gone[start:end]
                    removed.append(int(own.sum()))
                    spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                    kept.append(hashlib.sha256(chunk.data[start:end][~own].tobytes()).hexdigest())
                keep = pa.array(names[0].view(np.int64) == given)
                columns = [*map(signed, names), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)]
                yield pa.record_batch(columns, ["text_a", "text_b", "n_removed", "n_spans", "kept_sha256"]).filter(keep)

    schema = "text_a long, text_b long, n_removed long, n_spans long, kept_sha256 string"
    return covered.select("text_a", "text", "runs").mapInArrow(run, schema)
