"""Byte-level BPE with a local rank file: texts to token ids and back.

tiktoken does the merging. Long texts are cut at safe places first: before a space that
follows a character other than white space and precedes a letter. Every match of the pattern
that holds such a space starts there, so the pieces give the ids of the whole text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAFE = regex.compile(r"(?<=\S)(?= \p{L})")
PIECE = 1 << 16


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut only at safe places."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(model: tiktoken.Encoding, text: str, size: int = PIECE) -> np.ndarray:
    parts = [model.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(model: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    """The raw bytes of the ids, whether or not they are whole characters."""
    return model.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> for each row of doc_id, text."""

    def run(batches):
        model = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(model, text) for text in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data binary for each row of doc_id, ids; null ids give no bytes."""

    def run(batches):
        model = encoding(path, pattern)
        for batch in batches:
            data = [model.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, storing neither."""

    def run(batches):
        model = encoding(path, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column("text"):
                ids = encode(model, text.as_py())
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(model, ids)).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=bounds[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))
