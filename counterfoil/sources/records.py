"""Records of delimited text whose quoted fields may hold line ends, cut by many tasks.

A line end is the end of a record unless it stands inside a quoted field. Whether it does depends on all
the text before it, but only through one bit, so every line is a function of that bit: where does it end
if it begins outside a field, and where if it begins inside one. One pass brings the function of each
block of a file (one row per block, as many as the tasks that read them); these are put together in order,
which tells for each block whether it begins inside a field. A second pass then cuts the records of all blocks
at once. Only records that a block border cuts are put together by grouping their parts.

The records are those of an unsplit reading, but for malformed ones: where text follows a closing quote the last
cell may keep one more quote at its end, and a field left open at the end of a file is without the last line end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


@dataclass(frozen=True)
class Quoting:
    """What makes a field: a delimiter and a quote that is doubled inside a quoted field."""

    delimiter: str
    quote: str

    def _parts(self) -> tuple[str, str, str]:
        q, sep = re.escape(self.quote), re.escape(self.delimiter)
        body = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
        rest = f"(?:(?!{sep})[\\s\\S])*+"  # a field goes on to the next delimiter, whatever follows its quotes
        fields = f"(?:(?:{q}{body}{q}|(?!{q})){rest}{sep})*+"
        return body, rest, f"{fields}{q}{body}\\z"

    def ends_inside(self, line: Column) -> tuple[Column, Column]:
        """Does the line end inside a quoted field if it begins outside one, and if it begins inside one?"""
        q, sep = re.escape(self.quote), re.escape(self.delimiter)
        body, rest, opens = self._parts()
        quoted = line.contains(self.quote)
        outside = quoted & line.rlike(f"\\A{BOM}?{opens}")
        inside = ~quoted | line.rlike(f"\\A{body}(?:\\z|{q}{rest}{sep}{opens})")
        return outside, inside


def _lines(spark: SparkSession, path: str, quoting: Quoting, decoded: Callable[[Column], Column]) -> DataFrame:
    """file, block, line, from_out, from_in of each line, in the order of the file within a block."""
    df = spark.read.option("lineSep", "\n").text(path)
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    df = df.select(*place, decoded(F.col("value")).alias("line"))
    from_out, from_in = quoting.ends_inside(F.col("line"))
    return df.select("*", from_out.alias("from_out"), from_in.alias("from_in"))


def states(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """Is each line's end inside a field, when the first line begins inside one (`start`) or not?"""
    n = len(from_out)
    fixed, turns = from_out == from_in, np.cumsum(from_out & ~from_in)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    known = last >= 0
    base = np.where(known, from_out[last], start)
    return base ^ (((turns - np.where(known, turns[last], 0)) & 1) == 1)


def _segments(batch: pa.RecordBatch):
    """Slices of a batch that belong to one block, with its name."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    if not len(file):
        return
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        yield (int(file[a]), int(block[a])), batch.slice(a, b - a)


def _flags(piece: pa.RecordBatch, name: str) -> np.ndarray:
    return piece.column(name).to_numpy(zero_copy_only=False).astype(bool)


BLOCKS = "file long, block long, end_out boolean, end_in boolean, record_out long, record_in long, lead long, bare boolean, returns boolean"


def _summaries(batches):
    """One row for each block: its two ends, the line at which the last record begins (-1: none), its first line with text."""
    name, held = None, None

    def row():
        return {"file": name[0], "block": name[1], **held, "n": None}

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        names = [part.split()[0] for part in BLOCKS.split(", ")]
        return pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    for batch in batches:
        done = []
        for key, piece in _segments(batch):
            if key != name:
                if name:
                    done.append(row())
                name = key
                held = {"end_out": False, "end_in": True, "record_out": -1, "record_in": -1, "lead": -1, "bare": False, "n": 0}
                held["returns"] = piece.column("returns")[0].as_py()
            out, inn = _flags(piece, "from_out"), _flags(piece, "from_in")
            for end, record in (("end_out", "record_out"), ("end_in", "record_in")):
                after = states(out, inn, held[end])
                outside = np.flatnonzero(~np.concatenate([[held[end]], after[:-1]]))
                if len(outside):
                    held[record] = held["n"] + int(outside[-1])
                held[end] = bool(after[-1])
            held["bare"] |= bool(_flags(piece, "bare").any())
            text = np.flatnonzero(_flags(piece, "text"))
            if held["lead"] < 0 and len(text):
                held["lead"] = held["n"] + int(text[0])
            held["n"] += len(piece)
        yield table(done)
    if name:
        yield table([row()])


def _plain(line: Column) -> Column:
    """The line without a mark of its byte order and a carriage return at its end."""
    return F.regexp_replace(line, f"\\A{BOM}|\r\\z", "")


def _resolved(blocks: list) -> list[tuple] | None:
    """file, block, start, carry_block, carry_n, goes_on, header, returns of each block; None where a lone carriage return may end records."""
    if any(b["bare"] for b in blocks):
        return None
    out, file = [], None
    ordered = sorted(blocks, key=lambda b: (b["file"], b["block"]))
    for i, b in enumerate(ordered):
        if b["file"] != file:
            file, inside, carry, header, returns = b["file"], False, (None, None), None, b["returns"]
        lead = None
        if header is None and b["lead"] >= 0:
            header = lead = b["lead"]
            header_key = (b["block"], lead)
        end = b["end_in"] if inside else b["end_out"]
        follows = i + 1 < len(ordered) and ordered[i + 1]["file"] == file
        out.append((file, b["block"], inside, *carry, bool(end and follows), lead, returns))
        record = b["record_in"] if inside else b["record_out"]
        if record >= 0:
            key = (b["block"], record)
            carry = (None, None) if header is not None and key == header_key else key
        inside = end
    return out


RECORDS = "file long, record_block long, record_n long, block long, record string"


def _cut(parts: bool):
    """The whole records of each block, or the parts of records that a border of blocks cuts."""

    def run(batches):
        name, n, inside, open_lines, open_key, info = None, 0, False, [], None, None
        out = []

        def close(at_end: bool):
            """The open record ends here, or the block does."""
            nonlocal open_lines
            if not open_lines:
                return
            head = open_key is None
            cut = head or (at_end and info["goes_on"])
            if cut == parts:
                key = (info["carry_block"], info["carry_n"]) if head else (name[1], open_key)
                if head or open_key != info["header"]:
                    text = "\n".join(open_lines)
                    out.append((name[0], *key, name[1], text.replace("\r\n", "\n").removesuffix("\r") if info["returns"] else text))
            open_lines = []

        def table():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            names = [part.split()[0] for part in RECORDS.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for key, piece in _segments(batch):
                if key != name:
                    if name:
                        close(at_end=True)
                    name, n, open_key = key, 0, None
                    info = {c: piece.column(c)[0].as_py() for c in ("start", "carry_block", "carry_n", "goes_on", "header", "returns")}
                    inside = info["start"]
                after = states(_flags(piece, "from_out"), _flags(piece, "from_in"), inside)
                before = np.concatenate([[inside], after[:-1]])
                for i, (line, within) in enumerate(zip(piece.column("line").to_pylist(), before)):
                    if not within:
                        close(at_end=False)
                        open_key = n + i
                    open_lines.append(line)
                inside, n = bool(after[-1]), n + len(piece)
            yield table()
        if name:
            close(at_end=True)
            yield table()

    return run


def quoted_records(
    spark: SparkSession, path: str, quoting: Quoting, decoded: Callable[[Column], Column]
) -> DataFrame | None:
    """`record`: the text of each record behind the header of its file; empty ones are left out.

    `decoded` makes text of the raw bytes of a line. None where carriage returns stand alone, which may be line ends of their own.
    """
    lines = _lines(spark, path, quoting, decoded)
    bare = F.regexp_replace("line", "\r\\z", "").contains("\r")
    line = F.col("line")
    told = [bare.alias("bare"), (_plain(line) != "").alias("text"), line.endswith("\r").alias("returns")]
    asked = lines.select("file", "block", "from_out", "from_in", *told)
    found = _resolved(asked.mapInArrow(_summaries, BLOCKS).collect())  # a row per block, as many as tasks read
    if found is None:
        return None
    kinds = "file long, block long, start boolean, carry_block long, carry_n long, goes_on boolean, header long, returns boolean"
    placed = lines.join(F.broadcast(spark.createDataFrame(found, kinds)), ["file", "block"])
    records = placed.mapInArrow(_cut(parts=False), RECORDS).select("record")
    if any(block[5] for block in found):
        pieces = placed.filter("start OR goes_on").mapInArrow(_cut(parts=True), RECORDS).filter("record_n IS NOT NULL")
        ordered = F.array_sort(F.collect_list(F.struct("block", "record")))
        whole = pieces.groupBy("file", "record_block", "record_n").agg(ordered.alias("pieces"))
        joined = F.array_join(F.transform("pieces", lambda p: p["record"]), "\n")
        records = records.union(whole.select(joined.alias("record")))
    text = F.regexp_replace("record", "\r\\z", "")
    return records.select(text.alias("record")).filter("record != ''")
