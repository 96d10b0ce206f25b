"""The registered queries over whole tables, and the pipeline, against plain definitions."""

import brute
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from counterfoil.llm import packing, quality_rules
from counterfoil.llm.queries import ORACLES, QUERIES, vocabulary
from counterfoil.llm.shared import documents, stored
from workload.check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in documents(spark, FOLDER).select("doc_id", "text").collect()]


def test_all_are_registered():
    assert sorted(n for n in contract.queries() if n.startswith("op")) == sorted(QUERIES)
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), FOLDER, ORACLES[name]) == ""


def test_repeats(spark, texts):
    got = QUERIES["op1_suffix_dedup"](spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(brute.repeated_bytes(texts))
    got = QUERIES["op9_substring_dedup"](spark, FOLDER).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute.repeated_words(texts)
    got = QUERIES["op10_near_dedup"](spark, FOLDER).collect()
    assert {r[0]: tuple(r)[1:3] for r in got} == brute.near_groups(texts)


def test_scans(spark, texts):
    got = QUERIES["op3_secret_scan"](spark, FOLDER).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted((i, *brute.base_row(t)) for i, t in texts)
    got = QUERIES["op4_quality_rules"](spark, FOLDER).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((i, *brute.quality_counts(t)) for i, t in texts)


def test_token_totals(spark, texts):
    model = packing.encoding(vocabulary().ranks, vocabulary().pattern)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    want = {}
    for r in documents(spark, FOLDER).collect():
        quality, toxic = labels.get(r.doc_id, (1, 0))
        if not toxic:
            docs, tokens = want.get((r.source, r.lang), (0, 0))
            count = len(model.encode_ordinary(r.text)) + (quality == 0)
            want[r.source, r.lang] = (docs + 1, tokens + count)
    got = QUERIES["op6_token_counts"](spark, FOLDER).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == want


def test_pipeline(spark, texts):
    docs = documents(spark, FOLDER)
    model = quality_rules.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in quality_rules.quality(docs, model).collect() if r.kept}
    left = [(i, t) for i, t in texts if i in good]
    best = {}
    for i, t in left:
        best.setdefault("".join(brute.words(t)), []).append((-len(t), i))
    once = {min(group)[1] for group in best.values()}
    left = [(i, t) for i, t in left if i in once]
    groups = brute.near_groups(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    stages = dict(corpus_pipeline.STAGES)
    frame = docs
    for name in list(stages)[:4]:
        frame = stored(stages[name](spark, frame, FOLDER))
        assert frame.columns == docs.columns
    masked = {r.doc_id: r.text for r in frame.collect()}
    assert sorted(masked) == sorted(i for i, _ in left)
    for i, t in left:
        spans = brute.base_secrets(t)
        assert (masked[i] == t) == (not spans) and not brute.base_secrets(masked[i])
    model = packing._tokenizer(vocabulary().tokenizer)
    tokens = sum(len(model.encode(t, add_special_tokens=False).ids) + 1 for t in masked.values())
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert sum(r.length for r in packed) == tokens
    assert {r.doc_id for r in packed} == set(masked)


def test_namesakes_are_judged_by_their_texts(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    near = [word("a", 60), word("a", 61), word("a", 62)]
    rows = [(3, near[0]), (5, near[1]), (5, word("u", 50)), (None, near[2]), (None, word("v", 50)), (None, word("v", 50)), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _number", "'y' AS _id")
    left = [tuple(r)[:2] for r in corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()]
    assert sum(t in near for _, t in left) == 1
    assert sorted((r for r in left if r[1] not in near), key=str) == sorted((r for r in rows if r[1] not in near), key=str)


def test_pipeline_on_empty_documents(spark):
    frame = documents(spark, FOLDER).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, FOLDER))
        assert frame.count() == 0


def test_few_copies_are_dropped_by_the_plan_that_many_take(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (None, "c ")], "doc_id long, text string")
    left = corpus_pipeline.drop_copies(spark, docs, FOLDER)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.text, r.doc_id) for r in left.collect()) == [("a  b", 2), ("c ", None)]
