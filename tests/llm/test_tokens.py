"""Encoding, counts and packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from counterfoil.llm import byte_bpe, packing, token_rollup
from counterfoil.llm.queries import vocabulary
from counterfoil.llm.shared import shared_folder

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_round_trip_digests(docs, texts):
    model = byte_bpe.encoding(PATH, PATTERN)
    want = []
    for i, t in texts:
        ids = model.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    got = byte_bpe.round_trip_digests(docs, PATH, PATTERN).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encoded_documents_decode_to_the_text(docs, texts):
    tokens = byte_bpe.encode_documents(docs, PATH, PATTERN)
    got = byte_bpe.decode_documents(tokens, PATH, PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.data)) for r in got) == sorted((i or -1, (t or "").encode()) for i, t in texts)


@pytest.mark.parametrize("text", ["a b  c\n\n d's  9 8x" * 30, " " * 900, "é ü 日本 " * 200, "x" * 3000, "", " a", "a \n b"])
def test_pieces_give_the_ids_of_the_whole(text):
    model = byte_bpe.encoding(PATH, PATTERN)
    for size in (1, 7, 50):
        assert "".join(byte_bpe.safe_pieces(text, size)) == text
        assert byte_bpe.encode(model, text, size).tolist() == model.encode_ordinary(text)


def test_bytes_that_are_no_characters_decode():
    model = byte_bpe.encoding(PATH, PATTERN)
    ids = byte_bpe.encode(model, "日")
    assert byte_bpe.decode(model, ids[:1]) == "日".encode()[: len(byte_bpe.decode(model, ids[:1]))]


def test_rollup(spark):
    frame = lambda *r: spark.createDataFrame(r, "doc_id long, source string, lang string, n_tokens long")
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark))
    rollup.commit("a", token_rollup.inserts(frame((1, "s", "en", 5), (2, "s", None, 7), (3, "t", "en", 1)), "v1"))
    rollup.commit("b", token_rollup.deletes(frame((3, "t", "en", 1)), "v1"))
    revised = frame((1, "s", "en", 9)).selectExpr("*", "5L AS old_tokens")
    for _ in range(3):
        rollup.commit("c", token_rollup.revisions(revised, "v1"))
    rollup.commit("d", token_rollup.inserts(frame(), "v1"))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == [("s", "en", "v1", 1, 9), ("s", None, "v1", 1, 7)]
    rollup.commit("a", token_rollup.inserts(frame((1, "s", "en", 5)), "v1"))
    assert ("s", None, "v1", 1, 7) not in map(tuple, rollup.totals().collect())
    for batch in ("a", "c"):  # tried again, now without events
        rollup.commit(batch, token_rollup.inserts(frame(), "v1"))
    rollup.commit("b/1 %=x", token_rollup.inserts(frame((4, "u", "en", 2)), "v1"))
    got = sorted(map(tuple, rollup.totals().collect()), key=str)
    assert got == [("t", "en", "v1", -1, -1), ("u", "en", "v1", 1, 2)]
    with pytest.raises(ValueError):
        rollup.commit("", token_rollup.inserts(frame(), "v1"))


def test_unknown_events_stop_the_job(spark):
    bad = token_rollup.inserts(spark.createDataFrame([(1, "s", "e", 1)], "doc_id long, source string, lang string, n_tokens long"), "v")
    with pytest.raises(Exception, match="unknown event"):
        token_rollup.signed(bad.selectExpr("source", "lang", "tokenizer_version", "'x' AS kind", "old_tokens", "new_tokens")).collect()


def test_counts(docs, texts):
    model = byte_bpe.encoding(PATH, PATTERN)
    got = token_rollup.count_tokens(docs, PATH, PATTERN).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(model.encode_ordinary(t or ""))) for i, t in texts)


def check_packing(found, size):
    taken = defaultdict(list)
    for r in found:
        taken[r.sequence_id].append((r.offset, r.length))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return taken


def test_packing(docs, texts):
    vocab = vocabulary()
    got = packing.pack_documents(docs, vocab, 64).collect()
    check_packing(got, 64)
    model = Tokenizer.from_file(vocab.tokenizer)
    want = []
    for i, t in texts:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_both_vocabularies_agree():
    vocab, draw = vocabulary(), random.Random(3)
    model = packing._tokenizer(vocab.tokenizer)
    for _ in range(300):
        text = "".join(draw.choice("ab Z9é'\n\t.,#ßſ  日🙂") for _ in range(40))
        assert packing.token_ids(text, vocab).tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    histogram = Counter(draw.randint(1, 50) for _ in range(draw.randint(0, 400)))
    made = packing.plan(histogram, 50)
    used = Counter()
    for length, runs in made.slots.items():
        ends = [*[r[0] for r in runs[1:]], histogram[length]]
        for (start, each, first, offset), end in zip(runs, ends):
            assert (end - start) % each == 0
            for k in range(end - start):
                used[first + k // each] += length
    assert sum(used.values()) == sum(k * n for k, n in histogram.items())
    assert all(n <= 50 for n in used.values()) and len(used) == made.sequences
    least = -(-sum(used.values()) // 50)
    assert made.sequences <= 11 * least / 9 + 1


def test_sequences_hold_the_ids(docs):
    found = packing.pieces(docs, vocabulary(), 64, 2, with_ids=True).filter("length < 64")
    placed = packing.pack(found.cache(), 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    for r in placed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_empty_tables(empty):
    assert packing.pack_documents(empty, vocabulary()).count() == 0
    assert byte_bpe.round_trip_digests(empty, PATH, PATTERN).count() == 0
    assert token_rollup.count_tokens(empty, PATH, PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
