"""The physical plans: few shuffles, no pairwise joins, splittable hot keys."""

import re

import pytest

from workload import sides
from workload.queries import QUERIES, orders

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for sides that are too large to send around."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_joins_everything_with_everything(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text or name == "nrm_user_fn"


def test_the_comparison_shuffles_each_side_once(spark, no_broadcast):
    text = plan(orders(spark, FOLDER).details())
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("SortMergeJoin") == 1


def test_the_first_count_is_one_shuffle_with_sums_before_it(spark, monkeypatch):
    from counterfoil.operators import cells

    seen = []
    single = cells._single_rows
    monkeypatch.setattr(cells, "_single_rows", lambda *a: seen.append(single(*a)) or seen[-1])
    orders(spark, FOLDER).key_cells  # noqa: B018
    text = plan(seen[0]).split("Initial Plan")[-1]
    assert text.count("Exchange") == 1
    before_shuffle = text.split("Exchange")[1]
    assert "partial_sum" in before_shuffle


def test_unmapped_columns_are_not_read(spark):
    side_a = sides.ORDERS_A.frame(spark, FOLDER)
    job = {"schema_version": "1.0", "compare": {"key_column": {"source_a": "k", "source_b": "order_ref"},
           "column_mappings": [{"source_a": "status", "source_b": "state"}]},
           "normalization_rules": {"global_cleaning": {"trim_whitespace": True}}}
    from counterfoil import reconcile

    text = plan(reconcile(side_a, sides.ORDERS_B.frame(spark, FOLDER), job).details())
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert set(re.findall(r"(\w+):", schema)) == {"o_orderkey", "o_orderstatus"}


def test_outer_comparison_reuses_the_shuffled_sides(spark, no_broadcast):
    df = orders(spark, FOLDER, join_type="outer").details()
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 2


def test_a_hot_key_is_split_between_tasks(spark, no_broadcast):
    """The inner join and the anti join of a left comparison both split a frequent key."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.files.maxPartitionBytes": "20KB",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        from counterfoil import reconcile

        def side(modulus, name, extra):
            return spark.range(0, 20000, 1, 8).selectExpr(
                f"CASE WHEN id % 3 = 0 THEN '{name}' ELSE CAST(id AS STRING) END AS k", f"uuid() AS v{extra}")

        job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "join_type": "left",
               "column_mappings": [{"source_a": "v", "source_b": "vb"}]}}
        b = spark.range(0, 20000, 1, 8).selectExpr("CAST(id AS STRING) AS k", "'x' AS vb")
        df = reconcile(side(3, "hot", ""), b, job).mismatches()
        assert df.count() == 20000
        df.collect()
        final = plan(df).split("Initial Plan")[0]
        assert "skew=true" in final
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_side_marked_for_broadcast_is_sent_to_the_tasks(spark, no_broadcast):
    from pyspark.sql import functions as F

    from counterfoil import reconcile
    from workload.jobs import orders_job

    b = F.broadcast(sides.ORDERS_B.frame(spark, FOLDER))
    text = plan(reconcile(sides.ORDERS_A.frame(spark, FOLDER), b, orders_job()).details())
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_bucketed_sides_are_not_shuffled(spark, no_broadcast, tmp_path):
    from counterfoil import reconcile
    from workload.jobs import orders_job

    tables = {}
    for name, side, key in (("bucketed_a", sides.ORDERS_A, "k"), ("bucketed_b", sides.ORDERS_B, "order_ref")):
        writer = side.frame(spark, FOLDER).write.mode("overwrite").bucketBy(4, key).sortBy(key)
        writer.option("path", str(tmp_path / name)).saveAsTable(name)
        tables[name] = spark.table(name)
    try:
        df = reconcile(tables["bucketed_a"], tables["bucketed_b"], orders_job()).details()
        assert "Exchange" not in plan(df) and df.count() > 0
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE {name}")
