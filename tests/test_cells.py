"""Counts and details against brute force over all row pairs of small tables."""

import random
from collections import defaultdict
from decimal import Decimal, InvalidOperation

import pytest
from pyspark.sql import functions as F

from counterfoil import Metric, reconcile, weighted_count
from counterfoil.operators import cells as cell_ops

NAMES = [("p", "q", "exact"), ("s", "t", "set"), ("n", "m", "tolerance")]


def job(join_type, mappings=NAMES, **more):
    return {
        "schema_version": "1.0",
        "compare": {
            "key_column": {"source_a": "k", "source_b": "ref"},
            "join_type": join_type,
            "column_mappings": [
                {"source_a": a, "source_b": b, "method": m, "tolerance": "0.5"} for a, b, m in mappings
            ],
        },
        **more,
    }


def random_rows(rnd, n):
    keys = [None, "hot", "hot", "hot", "a", "b", "c", "d", "e", "f", "g"]
    return [
        (
            rnd.choice(keys),
            rnd.choice(["x", "y", None]),
            rnd.choice(["a,b", "[b, a]", '["a"]', "a,a", "", None]),
            rnd.choice(["1", "1.4", "1.5", "1.6", "2.0", " 2.1 ", "-3", "word", "other", None]),
        )
        for _ in range(n)
    ]


def number(cell):
    try:
        return Decimal(cell.strip())
    except InvalidOperation:
        return None


def judge(method, a, b):
    if a is None or b is None:
        return "exact_match" if a is b else "missing_in_a" if a is None else "missing_in_b"
    if method == "set":
        sets = [{x.strip() for x in c.strip('[]').replace('"', "").split(",") if x.strip()} for c in (a, b)]
        return "exact_match" if sets[0] == sets[1] else "set_diff"
    if method == "tolerance":
        x, y = number(a), number(b)
        if x is not None and y is not None:
            return "exact_match" if abs(x - y) <= Decimal("0.5") else "value_diff"
    return "exact_match" if a == b else "value_diff"


def brute(rows_a, rows_b, join_type):
    """All details of the row pairs, one by one."""
    by_a, by_b = defaultdict(list), defaultdict(list)
    for rows, found in ((rows_a, by_a), (rows_b, by_b)):
        for key, *cells in rows:
            if key is not None:
                found[key].append(cells)
    out = []
    for key in set(by_a) | set(by_b):
        left, right = by_a[key], by_b[key]
        if not left and join_type in ("right", "outer"):
            left = [[None] * 3]
        if not right and join_type in ("left", "outer"):
            right = [[None] * 3]
        for x in left:
            for y in right:
                out += [(key, i, judge(m, x[i], y[i])) for i, (_, _, m) in enumerate(NAMES)]
    return out


@pytest.mark.parametrize("join_type", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_counts_and_details_equal_brute_force(table, join_type, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(cell_ops, "BROADCAST_BYTES", 0)
    rnd = random.Random(join_type)
    rows_a, rows_b = random_rows(rnd, 60), random_rows(rnd, 50)
    recon = reconcile(table("k p s n", rows_a), table("ref q t m", rows_b), job(join_type))
    wanted = brute(rows_a, rows_b, join_type)

    details = recon.details().select("key", "mapping_idx", "diff_type", "status").collect()
    assert sorted((d.key, d.mapping_idx, d.diff_type) for d in details) == sorted(wanted)
    assert all((d.status == "match") == (d.diff_type == "exact_match") for d in details)

    bad, total = defaultdict(int), defaultdict(int)
    for key, i, verdict in wanted:
        total[i] += 1
        bad[i] += verdict != "exact_match"
    columns = {r.column: (r.matched, r.mismatched, r.total_compared) for r in recon.per_column().collect()}
    assert columns == {
        f"{a} vs {b}": (total[i] - bad[i], bad[i], total[i]) for i, (a, b, _) in enumerate(NAMES)
    }

    per_key = defaultdict(int)
    for key, _, verdict in wanted:
        per_key[key] += verdict != "exact_match"
    risky = {r.key: r.mismatches for r in recon.high_risk().collect()}
    assert risky == {k: n for k, n in per_key.items() if n >= 3}

    m = recon.metrics().first()
    assert m.full_match_count == sum(n == 0 for n in per_key.values())
    assert m.total_mismatches == sum(bad.values())
    assert m.mismatch_count == m.matched_keys - m.full_match_count
    summary = {r.metric: r.value for r in recon.summary().collect()}
    assert summary["Keys Compared"] == str(len(per_key))
    assert summary["Cell-Level Matches"] == str(sum(total.values()) - sum(bad.values()))

    keys_a = {r[0] for r in rows_a} - {None}
    keys_b = {r[0] for r in rows_b} - {None}
    assert (m.matched_keys, m.only_in_a, m.only_in_b) == (
        len(keys_a & keys_b), len(keys_a - keys_b), len(keys_b - keys_a))
    collapsed = recon.details(collapse=True)
    assert collapsed.groupBy().sum("pairs").first()[0] == len(wanted)
    assert recon.mismatches().count() == sum(bad.values())
    recon.close()


@pytest.mark.parametrize("join_type", ["inner", "outer"])
def test_rows_of_a_hot_key_do_not_meet_in_one_task(spark, table, join_type, monkeypatch):
    """With too many repeated keys for a broadcast the rows are dealt out by key, but for those of hot keys."""
    monkeypatch.setattr(cell_ops, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(cell_ops, "HOT_ROWS", 120, raising=False)
    monkeypatch.setattr(cell_ops, "TASK_ROWS", 50, raising=False)
    shares, counted = [], cell_ops._counted_rows

    def seen(a, b, *more):
        for rows in (a, b):
            task = F.spark_partition_id().alias("task")
            sizes = [r["count"] for r in rows.filter("key = 'hot'").groupBy(task).count().collect()]
            shares.append(max(sizes) / sum(sizes) if sizes else 0)
        return counted(a, b, *more)

    monkeypatch.setattr(cell_ops, "_counted_rows", seen)
    rnd = random.Random(join_type)
    rows_a, rows_b = random_rows(rnd, 300), random_rows(rnd, 300)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        with reconcile(table("k p s n", rows_a), table("ref q t m", rows_b), job(join_type)) as recon:
            columns = {r.column: (r.matched, r.total_compared) for r in recon.per_column().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    wanted = brute(rows_a, rows_b, join_type)
    assert columns == {
        f"{a} vs {b}": (sum(k == "exact_match" for _, j, k in wanted if j == i), len(wanted) // 3)
        for i, (a, b, _) in enumerate(NAMES)
    }
    assert 0 < max(shares) < 0.5


def test_swapping_the_sides_mirrors_the_details(table):
    rnd = random.Random(7)
    rows_a, rows_b = random_rows(rnd, 40), random_rows(rnd, 40)
    there = reconcile(table("k p s n", rows_a), table("ref q t m", rows_b), job("outer"))
    back = reconcile(table("k p s n", rows_b), table("ref q t m", rows_a), job("outer"))
    turned = {"missing_in_a": "missing_in_b", "missing_in_b": "missing_in_a"}
    x = [(d.key, d.value_a, d.value_b, d.diff_type, d.only_in_a) for d in there.details().collect()]
    y = [(d.key, d.value_b, d.value_a, turned.get(d.diff_type, d.diff_type), d.only_in_b)
         for d in back.details().collect()]
    assert sorted(map(repr, x)) == sorted(map(repr, y))


def test_counts_beyond_64_bits_need_the_wider_type(spark):
    rows = spark.range(4).selectExpr("'hot' AS k", "'x' AS p")
    other = spark.range(3).selectExpr("'hot' AS ref", "'x' AS q")
    recon = reconcile(rows, other, job("inner", [("p", "q", "exact")]), count_type="decimal(38,0)")
    row = recon.per_column().first()
    assert (int(row.matched), int(row.total_compared)) == (12, 12)
    assert "decimal" in recon.per_column().schema["matched"].dataType.simpleString()


def test_frequent_key_needs_no_pairs(spark):
    """60,000 x 60,000 pairs of one key are counted in the time that the rows take."""
    n = 60_000
    a = spark.range(n).selectExpr("'hot' AS k", "CAST(id % 7 AS STRING) AS p", "CAST(id / 100 AS STRING) AS n")
    b = spark.range(n).selectExpr("'hot' AS ref", "CAST(id % 7 AS STRING) AS q", "CAST(id / 100 AS STRING) AS m")
    recon = reconcile(a, b, job("inner", [("p", "q", "exact"), ("n", "m", "tolerance")]))
    found = {r.column: (r.matched, r.total_compared) for r in recon.per_column().collect()}
    sevenths = [len(range(r, n, 7)) for r in range(7)]
    near = sum(min(n - 1, i + 50) - max(0, i - 50) + 1 for i in range(n))
    assert found == {"p vs q": (sum(x * x for x in sevenths), n * n), "n vs m": (near, n * n)}


@pytest.mark.parametrize("join_type", ["inner", "left", "right", "outer"])
def test_judgements_are_the_details_counted(spark, table, join_type):
    draw = random.Random(8)
    rows = lambda n: [(draw.choice(["k1", "k2", "k3", "k4", None]), draw.choice(["x", "y", None]), draw.choice(["1,2", "2,1", "3", None, "1.0"])) for _ in range(n)]
    a, b = rows(40) + [("only a", "x", None), ("only a", None, None)], rows(30) + [("only b", None, "3")]
    mappings = [
        {"source_a": "v", "source_b": "v", "method": "exact"},
        {"source_a": "w", "source_b": "w", "method": "set"},
        {"source_a": "w", "source_b": "w", "method": "tolerance", "tolerance": "2"},
    ]
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "join_type": join_type, "column_mappings": mappings}}
    with reconcile(table("k v w", a), table("k v w", b), job) as recon:
        names = ["key", "mapping_idx", "column", "status", "diff_type"]
        want = {tuple(r[n] for n in names): r["count"] for r in recon.details().groupBy(*names).count().collect()}
        got = recon.judgements()
        assert {tuple(r[n] for n in names): r.pairs for r in got.collect()} == want


def test_metrics_over_judgements_make_no_pairs_of_rows(spark, table):
    sides = [table("k v w", [("hot", str(i % 5), str(i % 3)) for i in range(900)]) for _ in range(2)]
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "column_mappings": [{"source_a": c, "source_b": c} for c in "vw"]}}
    own = (Metric("bad", "judgements", weighted_count(F.col("status") == "mismatch")),)
    with reconcile(*sides, job, metrics=own) as recon:
        found = recon.metrics(["bad"])
        assert found.first().bad == 900 * 900 * (4 / 5 + 2 / 3)
        tree = found._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in tree.splitlines() if "Join" in line and "LeftSemi" not in line]
        assert len(joins) == 1 and "Inner, (key#" in joins[0]  # two tables with one row a key
