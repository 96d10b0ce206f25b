"""Main text of web pages, by markup and by what a host repeats on other pages.

Where a page has an article or main element, its text without furniture (menus, forms, notices and so
on) is the main text; elsewhere it is the text that markup leaves open. From both, the blocks go that
long strings of the host cover: the blocks of a page that follow each other with one kind are one
stream of tokens, and strings of `depth` tokens, over block borders, are counted over the different
pages of the host. A block whose tokens are not all covered stays whole.

All streams of all pages are searched. The smallest fingerprint of `GRAM` tokens in a string (its anchor)
depends on the string only, so strings whose anchor stands on one page can't repeat and are left out before
any string is made. Of the others, those on two pages by one fingerprint are written down, and their
pages are counted. Pages of a host with equal blocks throughout are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesview import LANES, U64, Chunk, Words, chunks, leftmost_minima, mix, runs, signed, word_hashes, words
from .html_text import FURNITURE, MAIN, OPEN, blocks
from .shared import bucketed, stored

KINDS = (MAIN, OPEN, FURNITURE)  # stored by their places
BLOCK = pa.struct([("kind", pa.int32()), ("block", pa.string()), ("size", pa.int32())])
BLOCKS = "array<struct<kind: int, block: string, size: int>>"
GRAM = 3  # tokens of an anchor
BUCKETS = 32  # files of pages for each task that reads them
MARKS = 1 << 29  # bits of a filter at most
CUT = 24  # bits of a fingerprint that a filter does without, to shuffle less
SHIFTS = (0, 11)  # where the two places in a filter begin in the bits that are left
SLICE = 1 << 20  # bytes of text that are hashed at a time, give or take a page

# Different pages on which a string must stand to be no text of an open page, or of a main
# element, where markup speaks for it; and the share of a main text that can be boilerplate. A page of
# which repeats cover more is another version of an article.
PAGES_OPEN, PAGES_MAIN, MOST = 2, 3, 2 / 3


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, site and page (fingerprints), blocks with their words, and more of each row.

    wanted is the kind of the blocks that can be main text and shown a fingerprint of these; same is one of host
    and all blocks, and number tells rows apart.
    """

    def run(batches):
        for batch in batches:
            found = [
                [{"kind": KINDS.index(kind), "block": text, "size": len(text.encode().split())} for kind, text in blocks(page.as_py())]
                for page in batch.column("html")
            ]
            given = ["page_id", "url", "site", "page"]
            yield pa.record_batch([*(batch.column(n) for n in given), pa.array(found, pa.list_(BLOCK))], [*given, "blocks"])

    source = pages.select(
        "page_id", "url", F.xxhash64(host(F.col("url"))).alias("site"), F.xxhash64("page_id", "url").alias("page"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    read = source.mapInArrow(run, f"page_id long, url string, site long, page long, blocks {BLOCKS}")
    read = read.withColumn("wanted", F.when(F.exists("blocks", lambda b: b["kind"] == 0), 0).otherwise(1))
    read = read.withColumn("shown", F.xxhash64(F.filter("blocks", lambda b: b["kind"] == F.col("wanted"))))
    return read.withColumns({"same": F.xxhash64("site", "blocks"), "number": F.monotonically_increasing_id()})


@dataclass
class Tokens:
    """The tokens of some pages of a batch, page after page."""

    first: int  # place of the first page in the batch
    chunk: Chunk
    found: Words
    page: np.ndarray  # place in the batch, of each token
    at: np.ndarray  # number in the page, of each token
    kind: np.ndarray
    strings: np.ndarray  # tokens at which a string begins that ends in the same stream

    def fingerprints(self, lane: int, start: np.ndarray, size: int, site: np.ndarray) -> np.ndarray:
        """Of the `size` tokens from each start on, and the host."""
        prefix = LANES[lane].prefix(word_hashes(self.chunk, self.found, lane))
        return mix(LANES[lane].between(prefix, start, start + size) + site[self.page[start]])

    def anchors(self, depth: int, site: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor of each stretch of strings that share it, and where the first and last of them begin."""
        gram = min(GRAM, depth)
        prefix = LANES[0].prefix(word_hashes(self.chunk, self.found, 0))
        start = np.arange(max(0, len(self.page) - gram + 1))
        grams = LANES[0].between(prefix, start, start + gram)
        minima = leftmost_minima(grams, depth - gram + 1)[self.strings]
        begins, ends = runs(minima)
        first, last = self.strings[begins], self.strings[ends - 1]
        return mix(grams[minima[begins]] + site[self.page[first]]), first, last


def _tokens(batch: pa.RecordBatch, depth: int) -> Iterator[Tokens]:
    lists = batch.column("blocks")
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    kinds = flat.field("kind").to_numpy()
    weight = np.concatenate([[0], np.cumsum(pc.binary_length(flat.field("block")).to_numpy().astype(np.int64))])[bounds]
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(weight, weight[first] + SLICE, "right")) - 1)
        a, b = bounds[first], bounds[last]
        if a < b:
            chunk = next(chunks(flat.field("block").slice(a, b - a), 1 << 62, 1 << 62))
            found = words(chunk)
            owner = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
            kind = kinds[a:b]
            stream = np.cumsum(np.concatenate([[0], (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])]))[found.row]
            page = owner[found.row]
            at = np.arange(len(page)) - np.searchsorted(page, page)
            strings = np.flatnonzero(stream[: max(0, len(page) - depth + 1)] == stream[depth - 1 :])
            yield Tokens(first, chunk, found, page, at, kind[found.row], strings)
        first = last


def _site(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("site").to_numpy().view(U64)


def _anchor_counts(read: DataFrame, depth: int) -> DataFrame:
    """anchor (its upper bits), n (pages) and asked (1 if it stands in text that can be main text) for parts of the pages."""

    def run(batches):
        for batch in batches:
            site, wanted = _site(batch), batch.column("wanted").to_numpy()
            for some in _tokens(batch, depth):
                anchor, first, _ = some.anchors(depth, site)
                anchor = anchor >> U64(CUT)
                page = some.page[first]
                asked = some.kind[first] == wanted[page]
                order = np.lexsort((page, anchor))
                anchor, page, asked = anchor[order], page[order], asked[order]
                starts, _ = runs(anchor)
                if not len(starts):
                    continue
                new = np.ones(len(anchor), np.int64)
                new[1:] = (anchor[1:] != anchor[:-1]) | (page[1:] != page[:-1])
                counts = [np.add.reduceat(new, starts), np.maximum.reduceat(asked.astype(np.int64), starts)]
                yield pa.record_batch([signed(anchor[starts]), *map(pa.array, counts)], ["anchor", "n", "asked"])

    return read.select("site", "wanted", "blocks").mapInArrow(run, "anchor long, n long, asked long")


def _marks(found: DataFrame) -> Broadcast:
    """A Bloom filter of the upper bits of fingerprints in the only column of `found`, of at most MARKS bits.

    Beyond MARKS / 16 fingerprints more strings pass that can't repeat, which costs time and disk and changes no result.
    """
    (name,) = found.columns
    size = min(MARKS, max(1 << 16, 1 << (16 * found.count()).bit_length()))
    place = F.explode(F.array(*[F.shiftright(name, k).bitwiseAND(size - 1) for k in SHIFTS])).alias("place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    words = found.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    marks = np.zeros(size >> 6, np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.sparkSession.sparkContext.broadcast(marks.view(U64))


def _marked(marks: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether each fingerprint may be among those that were marked."""
    found = np.ones(len(prints), bool)
    for k in SHIFTS:
        place = (prints >> U64(CUT + k)) & U64(64 * len(marks) - 1)
        found &= (marks[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1
    return found


def _strings(read: DataFrame, depth: int, anchors: Broadcast, heads: Broadcast | None = None) -> DataFrame:
    """head_a and head_b (a fingerprint), number, shown and at of each string whose anchor, and head_a, are marked.

    asked is its kind if it stands in text that can be main text, or else -1.
    """

    def run(batches):
        for batch in batches:
            site, wanted = _site(batch), batch.column("wanted").to_numpy()
            for some in _tokens(batch, depth):
                anchor, first, last = some.anchors(depth, site)
                known = _marked(anchors.value, anchor)
                first, count = first[known], (last - first)[known] + 1
                start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                head = some.fingerprints(0, start, depth, site)
                if heads:
                    known = _marked(heads.value, head)
                    start, head = start[known], head[known]
                if not len(start):
                    continue
                page = some.page[start]
                given = [batch.column(n).take(pa.array(page)) for n in ("number", "shown")]
                asked = pa.array(np.where(some.kind[start] == wanted[page], wanted[page], -1).astype(np.int32))
                columns = [signed(head), signed(some.fingerprints(1, start, depth, site)), *given, pa.array(some.at[start].astype(np.int32)), asked]
                yield pa.record_batch(columns, ["head_a", "head_b", "number", "shown", "at", "asked"])

    schema = "head_a long, head_b long, number long, shown long, at int, asked int"
    return read.select("site", "wanted", "number", "shown", "blocks").mapInArrow(run, schema)


def _gone(judged: DataFrame, depth: int) -> DataFrame:
    """number, covered (words) and gone: places of the blocks that repeats cover.

    A block of fewer than `depth` words goes only where at least half of what surrounds it is repeated with it.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.select(["number", "kinds", "sizes", "spans"]).to_pylist():
                kinds, bounds = np.array(page["kinds"]), np.cumsum([0, *page["sizes"]])
                often = np.zeros(bounds[-1], np.int64)
                for span in page["spans"]:
                    part = often[span["at"] : span["at"] + depth]
                    np.maximum(part, span["often"], out=part)
                gone = []
                for first, last in zip(*runs(kinds)):
                    own = often[bounds[first] : bounds[last]]
                    starts, ends = runs(own > 0)
                    most = np.repeat([own[a:b].max() for a, b in zip(starts, ends)], ends - starts)
                    for k in range(first, last):
                        a, b = bounds[k : k + 2] - bounds[first]
                        if a < b and own[a:b].all() and (b - a >= depth or 2 * own[a:b].min() >= most[a]):
                            gone.append(k)
                rows.append({"number": page["number"], "covered": int((often > 0).sum()), "gone": gone})
            schema = pa.schema([("number", pa.int64()), ("covered", pa.int64()), ("gone", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return judged.mapInArrow(run, "number long, covered long, gone array<int>")


def main_text(pages: DataFrame, depth: int = 10) -> DataFrame:
    """page_id, url, text, n_chars of each page; pages without main text have an empty one.

    A null or empty html has no text. Rows with equal page_id and url count as one page of the host,
    as do pages with the same text, but each keep their text. Pages without a host are searched together.
    """
    # Each page's text is written once and stays where it is; what is found out about a page comes to it.
    read = bucketed(parsed(pages), "number", BUCKETS)
    groups = stored(
        read.groupBy("same").agg(
            F.min("number").alias("number"), F.count("*").alias("copies"),
            F.min("page").alias("low"), F.max("page").alias("high"),
        )
    )
    copied = groups.filter("copies > 1").select("same", F.col("number").alias("first"))
    copies = stored(read.select("same", "number").join(copied, "same").filter("number != first").select("number", "first"))
    searched = read.join(copies.select("number").hint("shuffle_hash"), "number", "left_anti")

    anchors = _anchor_counts(searched, depth).groupBy("anchor").agg(F.sum("n").alias("_n"), F.max("asked").alias("_asked"))
    anchors = _marks(stored(anchors.filter("_n > 1 AND _asked = 1").select("anchor")))
    twice = _strings(searched, depth, anchors).groupBy(F.shiftrightunsigned("head_a", CUT).alias("head"))
    twice = twice.agg(F.min("shown").alias("_low"), F.max("shown").alias("_high"), F.max("asked").alias("_asked"))
    twice = _marks(stored(twice.filter("_low != _high AND _asked >= 0").select("head")))
    hits = stored(_strings(searched, depth, anchors, twice))

    heads, named = ["head_a", "head_b"], hits.join(groups.drop("same"), "number")
    often = named.groupBy(*heads).agg(F.sum("copies").alias("often"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    often = stored(often.filter("_low != _high").select(*heads, "often"))
    n_pages = hits.select(*heads, "shown").distinct().groupBy(*heads).agg(F.count("*").alias("n_pages"))
    repeats = stored(often.join(n_pages.filter(F.col("n_pages") >= PAGES_OPEN), heads))

    spans = hits.filter("asked >= 0").join(repeats, heads)
    spans = spans.filter((F.col("asked") == 1) | (F.col("n_pages") >= PAGES_MAIN)).groupBy("number")
    spans = stored(spans.agg(F.collect_list(F.struct("at", "often")).alias("spans")))
    layout = read.select("number", F.col("blocks.kind").alias("kinds"), F.col("blocks.size").alias("sizes"))
    gone = stored(_gone(layout.join(spans.hint("shuffle_hash"), "number"), depth))
    gone = stored(gone.unionByName(copies.join(gone.withColumnRenamed("number", "first"), "first").drop("first")))

    whole = F.array_join(F.filter("blocks", lambda b: b["kind"] == F.col("wanted"))["block"], " ")
    rest = F.array_join(F.filter("blocks", lambda b, i: (b["kind"] == F.col("wanted")) & ~F.array_contains("gone", i))["block"], " ")
    version = (F.col("wanted") == 0) & (F.col("covered") > MOST * F.size(F.split(whole, " ")))
    text = F.when(F.col("gone").isNull() | version, whole).otherwise(rest)
    out = read.select("page_id", "url", "number", "wanted", "blocks").join(gone.hint("shuffle_hash"), "number", "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
