"""Quality rules: counts over words and lines, and a line labelling that finds boilerplate.

The lines of a text are labelled content or boilerplate by Viterbi decoding of a linear-chain
conditional random field. A document stays if it passes the base rule and at least half of its words
stand in content lines. The field is trained on a bounded sample of labelled documents, whose lines all
take the document's quality as their label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesview import LANES, Chunk, chunks, mix, runs, word_hashes, words
from .crf import CONTENT, ChainModel, train

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(65, 91)))
DIGIT = np.isin(np.arange(256), list(range(48, 58)))
BANG = np.isin(np.arange(256), list(b"!?"))
COMMA = np.isin(np.arange(256), list(b",;:"))
STOP = np.isin(np.arange(256), list(b".!?"))
BEGINS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
WINDOW = 8


@dataclass
class Lines:
    """What is known of each line with a word, in order, and of each text."""

    bounds: np.ndarray
    n_words: np.ndarray
    features: np.ndarray
    per_text: dict[str, np.ndarray]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more in their row."""
    joint = mix(keys ^ mix(rows.astype(np.uint64)))
    order = np.argsort(joint)
    starts, ends = runs(joint[order])
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(ends - starts > 1, ends - starts)
    return out


def measure(chunk: Chunk) -> Lines:
    data, found = chunk.data, words(chunk)
    hashes = word_hashes(chunk, found)
    rows = found.per_row(chunk.rows)
    n_words = np.diff(rows)

    grams = LANES[0].rolling(hashes, WINDOW)
    own = found.row[: len(grams)]
    whole = np.flatnonzero(own == found.row[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    twice = whole[_repeated(grams[whole], own[whole])]
    steps = np.zeros(len(hashes) + WINDOW + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + WINDOW, -1)
    in_repeat = np.cumsum(steps)[: len(hashes)] > 0

    # A line goes to the next one or to the end of its text, without the line feed.
    starts = np.union1d(np.flatnonzero(data == 10) + 1, chunk.bounds)
    starts, ends = starts[:-1], starts[1:]
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    first, last = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
    solid = last > first
    starts, ends, first, last = starts[solid], ends[solid], first[solid], last[solid]
    row = found.row[first] if len(first) else first
    size = last - first
    prefix = LANES[0].prefix(LANES[0].table[data])
    line_keys = LANES[0].between(prefix, starts, ends)
    joint = mix(line_keys ^ mix(row.astype(np.uint64)))
    order = np.argsort(joint, kind="stable")
    again = np.zeros(len(starts), bool)
    again[order[1:]] = joint[order[1:]] == joint[order[:-1]]

    chars = np.maximum(_sums(BEGINS[data], starts, ends), 1)
    share = lambda table, of=chars: _sums(table[data], starts, ends) / of
    tail = found.ends[last - 1] - 1 if len(last) else last
    lengths = _sums(BEGINS[data], found.starts, found.ends)
    short = _sums(lengths <= 3, first, last) / size
    features = np.stack([
        np.log1p(size), share(SYMBOLS), share(UPPER), share(DIGIT), share(BANG, size), share(COMMA, size),
        _sums(lengths, first, last) / size / 8, short, STOP[data[tail]].astype(float),
        again.astype(float), _sums(in_repeat, first, last) / size, share(STOP, size),
    ], axis=1) if len(size) else np.zeros((0, 12))
    bounds = np.searchsorted(row, np.arange(chunk.rows + 1))
    per_text = {
        "n_words": n_words,
        "word_chars": _sums(lengths, rows[:-1], rows[1:]),
        "n_symbols": _sums(SYMBOLS[data], chunk.bounds[:-1], chunk.bounds[1:]),
        "n_dup_lines": _sums(again, bounds[:-1], bounds[1:]),
        "n_repeat_words": _sums(in_repeat, rows[:-1], rows[1:]),
    }
    return Lines(bounds, size, features, per_text)


def base_failed(counts: dict[str, np.ndarray], min_words: int = 20, most_repeated: int = 30) -> np.ndarray:
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > most_repeated * counts["n_words"])


def content_words(lines: Lines, model: ChainModel | None) -> np.ndarray:
    """Words in content lines of each text; without a model every line is content."""
    labels = model.decode(lines.features, lines.bounds) if model else np.full(len(lines.n_words), CONTENT)
    return _sums(lines.n_words * (labels == CONTENT), lines.bounds[:-1], lines.bounds[1:])


def judged(chunk: Chunk, model: ChainModel | None) -> dict[str, np.ndarray]:
    lines = measure(chunk)
    out = dict(lines.per_text)
    out["base_failed"] = base_failed(out)
    out["content_words"] = content_words(lines, model)
    out["kept"] = ~out["base_failed"] & (2 * out["content_words"] >= out["n_words"])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 600, longest: int = 20000) -> ChainModel | None:
    """Train on at most `sample` labelled documents of at most `longest` characters, chosen by a hash of their id."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    rows = rows.filter((F.length("text") <= longest) & (F.length("text") > 0)).orderBy("doc_id", "text").limit(sample).collect()
    if not rows:
        return None
    chunk = next(chunks(pa.array([row["text"] for row in rows], pa.string()), 1 << 40, sample))
    lines = measure(chunk)
    parts = [lines.features[a:b] for a, b in zip(lines.bounds[:-1], lines.bounds[1:])]
    return train(parts, [int(row["quality"] > 0) for row in rows])


def quality(docs: DataFrame, model: ChainModel | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words.

    A null text has no words and fails the base rule. Rows are judged alone, whatever their doc_id.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [*counts, "base_failed", "kept", "content_words"]

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                found = judged(chunk, model)
                columns = [pa.array(found[n]) for n in names]
                yield pa.record_batch([batch.column("doc_id").slice(chunk.first, chunk.rows), *columns], ["doc_id", *names])

    schema = ", ".join(["doc_id long", *(f"{n} long" for n in counts), "base_failed boolean, kept boolean, content_words long"])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def passing(docs: DataFrame, model: ChainModel | None) -> DataFrame:
    """The rows of docs, with all columns, whose text passes."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("")
            kept = [judged(chunk, model)["kept"] for chunk in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)
