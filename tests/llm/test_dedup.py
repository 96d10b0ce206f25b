"""Exact, near and substring deduplication against plain definitions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from counterfoil.llm import digest_index, near_dedup, substring_dedup, suffix_dedup
from counterfoil.llm.bwt import Collection
from counterfoil.llm.bytesview import LANES, chunks
from counterfoil.llm.components import components
from counterfoil.llm.queries import new_index


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def exact_groups(texts):
    groups = {}
    for i, t in texts:
        groups.setdefault("".join(brute.words(t)), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in texts:
        group = groups["".join(brute.words(t))]
        keep = min(group)[3]
        out.append((i, keep, len(group), i == keep, brute.sha("".join(brute.words(t)))))
    return sorted(out, key=str)


def test_exact_dedup(spark, docs, texts):
    assert rows(digest_index.deduplicate(docs, new_index(spark), "b")) == exact_groups(texts)


def test_index_keeps_earlier_batches_and_commits_once(spark):
    index = new_index(spark)
    frame = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    first = frame((5, "a b"), (6, "ab  "), (7, "c"))
    for _ in range(2):
        assert rows(digest_index.deduplicate(first, index, "one").select("doc_id", "keep_id")) == [(5, 6), (6, 6), (7, 7)]
    second = digest_index.deduplicate(frame((1, "a  b     "), (2, "d")), index, "two")
    assert rows(second.select("doc_id", "keep_id", "kept")) == [(1, 6, False), (2, 2, True)]
    assert index.rows().count() == 3
    plan = index.rows().join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_index_is_not_shuffled_for_a_batch(spark, docs, texts):
    index = new_index(spark)
    frame = docs.filter("doc_id % 2 = 0")
    known = {r.text_sha256: r.keep_id for r in digest_index.deduplicate(frame, index, "half").collect()}
    got = digest_index.deduplicate(docs, index, "all").collect()
    best = {row[4]: row[1] for row in exact_groups(texts)}
    assert {r.text_sha256: r.keep_id for r in got} == best | known
    classes = digest_index.best_per_digest(digest_index.fingerprints(docs))
    plan = index.held(classes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(digest") == 1  # that of the batch
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_near_dedup(docs, texts):
    want = brute.near_groups({i: (i, t) for i, t in texts if i is not None}.values())
    got = rows(near_dedup.near_duplicates(docs))
    assert len(got) == len(texts)
    for i, size, component, kept in got:
        if i is None:
            assert (component, kept) == (None, True)
        else:
            assert (size, component) == want[i] and kept == (component == i)


def test_near_dedup_of_chains_in_one_bucket(spark):
    """Members of a large group that are far from its first pivot."""
    draw = random.Random(2)
    base = [str(draw.random()) for _ in range(200)]
    chain = []
    for i in range(60):
        for k in range(4):
            base[(i * 4 + k) % 200] = str(draw.random())
        chain.append((i * 7 % 60, " ".join(base)))
    got = {r[0]: r[1:3] for r in rows(near_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")))}
    assert got == brute.near_groups(chain)


def test_prefix_join_finds_all_similar_pairs_and_few_others(spark):
    """Copies with changes of any size, some rows twice; and a group that shares three quarters of its words only."""
    draw = random.Random(3)
    base = [str(draw.random()) for _ in range(90)]
    made = []
    for i in range(70):
        words = list(base[: draw.randint(50, 90)])
        for _ in range(draw.choice([0, 1, 2, 4, 8])):
            words[draw.randrange(len(words))] = str(draw.random())
        made.append((i, " ".join(words)))
    group = [(100 + i, " ".join(base[:75] + [str(draw.random()) for _ in range(25)])) for i in range(60)]

    def pairs(rows):
        sets = {i: brute.shingles(t) for i, t in rows}
        parts = [("x", i, len(v), i // 2) for i, v in sets.items()]  # neighbours are in one component
        mixed = spark.createDataFrame(parts, "bucket string, node long, n_shingles long, component long")
        frame = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
        found = {tuple(r) for r in near_dedup._open_pairs(mixed, frame, 75, 5).collect()}
        like = lambda x, y: 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
        return found, {(x, y) for x in sets for y in sets if x < y and x // 2 != y // 2 and like(x, y)}

    found, want = pairs(made)
    assert want <= found and len(want) > 100
    assert pairs(group) == (set(), set())


def test_sketch_fills_every_coordinate_and_estimates():
    import numpy as np

    draw = np.random.default_rng(1)
    both = draw.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [both[:600], both[300:], both[:1], both[:3]]
    table = near_dedup.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 400)
    assert (table != near_dedup.FULL).all()
    assert abs((table[0] == table[1]).mean() - 1 / 3) < 0.08
    assert abs((table[2] == table[3]).mean() - 1 / 3) < 0.15


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    draw = random.Random(4)
    n = 60
    edges = {
        "path": [(k, k + 1) for k in range(n)],
        "star": [(n, k) for k in range(n)],
        "random": [(draw.randrange(n), draw.randrange(n)) for _ in range(45)],
    }[shape]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in parent:
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = components(spark.createDataFrame(edges * 2, "a long, b long"))
    assert rows(got) == sorted(parent.items(), key=str)


def test_substring_dedup(docs, texts):
    known = [(i, t) for i, t in texts if i is not None]
    want = brute.repeated_words(dict(known).items())
    got = rows(substring_dedup.repeated_words(docs))
    assert len(got) == len(texts)
    for i, *rest in got:
        assert i is None or tuple(rest) == want[i]


def test_substring_windows_stand_in_any_smaller_document(spark):
    """A window may repeat another document than the one whose block is hit first."""
    draw = random.Random(5)
    words = [str(k) for k in range(400)]
    made = []
    for i in range(80):
        parts = [words[a : a + draw.randint(3, 40)] for a in (draw.randrange(380) for _ in range(draw.randint(1, 6)))]
        made.append((i, " ".join(sum(parts, []))))
    got = {r[0]: r[1:] for r in rows(substring_dedup.repeated_words(spark.createDataFrame(made, "doc_id long, text string"), 10))}
    assert got == brute.repeated_words(made, 10)


def test_suffix_dedup(docs, texts):
    assert rows(suffix_dedup.repeated_bytes(docs)) == sorted(brute.repeated_bytes(texts), key=str)


@pytest.mark.parametrize("many", [2, 256])
def test_suffix_dedup_of_a_passage_with_many_surroundings(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    draw = random.Random(6)
    some = lambda n: "".join(draw.choice("abcd ") for _ in range(draw.randint(0, n)))
    passage = "".join(draw.choice("abcdefgh") for _ in range(60))
    made = [(i, some(40) + passage + some(40)) for i in range(150)] + [(9, "ab" * 50), (8, "y" * 70)]
    got = suffix_dedup.repeated_bytes(spark.createDataFrame(made, "doc_id long, text string"), 40)
    assert rows(got) == sorted(brute.repeated_bytes(made, 40), key=str)


def test_transform_and_common_prefixes(tmp_path):
    draw = random.Random(1)
    for trial in range(60):
        cap = draw.choice([1, 2, 3, 5])
        made = [bytes(draw.choice(b"abc"[: draw.randint(1, 3)]) for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 8))]
        folder = tmp_path / str(trial)
        folder.mkdir()
        held = Collection(made, cap)
        bwt, prefixes = held.build(str(folder))
        order = sorted((t[k:], i, t[k - 1] if k else -1) for i, t in enumerate(held.texts) for k in range(len(t) + 1))
        used = sorted({b for t in made for b in t})
        assert [used[s - 1] if s else -1 for s in bwt.tolist()] == [before for _, _, before in order]
        want = [0]
        for (x, *_), (y, *_) in zip(order, order[1:]):
            want.append(next((k for k in range(min(len(x), len(y), cap)) if x[k] != y[k]), min(len(x), len(y), cap)))
        assert prefixes[:-1].tolist() == want
        seen = [t[k : k + cap] for t in made for k in range(len(t) - cap + 1)]
        assert [m.tolist() for m in held.repeats()] == [[seen.count(t[k : k + cap]) > 1 for k in range(len(t) - cap + 1)] for t in made]


def test_empty_tables(spark, empty):
    assert rows(digest_index.deduplicate(empty, new_index(spark), "b")) == []
    for operator in (near_dedup.near_duplicates, substring_dedup.repeated_words, suffix_dedup.repeated_bytes):
        assert rows(operator(empty)) == []


def thue_morse(one, other, n):
    """Two sequences that swap two values in Thue-Morse order."""
    order = [bin(i).count("1") % 2 for i in range(n)]
    return [[(one, other)[k] for k in order], [(other, one)[k] for k in order]]


def test_texts_of_one_polynomial_are_different_texts(spark):
    """Pairs without a common string of 200 bytes, or window of 50 words, that no base of a polynomial tells apart."""
    draw = random.Random(9)
    gap = lambda n: "".join(draw.choice("cdefghijk") for _ in range(n))
    gaps = [gap(7) for _ in range(1024)]
    first, second = ("".join(map("".join, zip(side, gaps))) for side in thue_morse("a", "b", 1024))
    texts = [(1, first), (2, second)]
    got = rows(suffix_dedup.repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == sorted(brute.repeated_bytes(texts), key=str) and got[0][2] < 8192
    words = [(i + 1, " ".join(w for pair in zip(side, map(str, range(1024))) for w in pair)) for i, side in enumerate(thue_morse("one", "two", 1024))]
    want = brute.repeated_words(words)
    assert {r[0]: tuple(r)[1:] for r in substring_dedup.repeated_words(spark.createDataFrame(words, "doc_id long, text string")).collect()} == want
    assert want[2][1] == 0


def test_lines_of_one_polynomial_are_different_lines(spark):
    lines = "\n".join("".join(side) for side in thue_morse("a", "b", 2048))
    assert brute.quality_counts(lines)[3] == 0
    chunk = next(chunks(pa.array([lines + "\n" + lines])))
    family = LANES[0]
    prefix = family.prefix(family.table[chunk.data])
    bounds = np.array([0, 2049, 4098, 6147])
    names = family.between(prefix, bounds, bounds + 2048)
    assert names[0] != names[1] and names[0] == names[2] and names[1] == names[3]


def test_numbers_stand_for_the_anchors_in_a_collection(monkeypatch):
    """Marks are those of the whole segments, and the columns fewer, also of texts that are no UTF-8."""
    draw = random.Random(8)
    some = lambda n, of: bytes(draw.choice(of) for _ in range(n))
    for of in (b"ab", b"a\x00\xff", bytes(range(256)), bytes(range(200))):
        segments, places = [], []
        for core in [some(20, of) for _ in range(150)]:
            left, right = some(12, of), some(12, of)
            for _ in range(3):
                a, b = draw.randint(8, 12), draw.randint(8, 12)
                segments.append(some(2, of) + left[-a:] + core + right[:b])
                places.append(a + 2)
        short, less = suffix_dedup._shortened(segments, places, 20)
        if len(of) == 256:
            assert (short, less) == (segments, 0)
            continue
        assert less == 17 and [len(s) for s in short] == [len(s) - less for s in segments]
        want = [m.tolist() for m in Collection(segments, 36).repeats()]
        got = [m.tolist() for m in Collection(short, 36 - less).repeats()]
        # Strings that hold their anchor, as those of a segment in a corpus do.
        holds = [[k <= at and at + 20 <= k + 36 for k in range(len(s) - 35)] for s, at in zip(segments, places)]
        assert [[x and h for x, h in zip(*z)] for z in zip(got, holds)] == [[x and h for x, h in zip(*z)] for z in zip(want, holds)]
    assert suffix_dedup._shortened([b"abc", b"bcd"], [1, 0], 2) == ([b"abc", b"bcd"], 0)
