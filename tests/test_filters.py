"""Every filter operator on the cells that tell the semantics apart."""

import pytest

from counterfoil import ReconSpec, SpecError, reconcile
from counterfoil.operators.filters import apply_filters, check_patterns, filter_audit
from counterfoil.spec import FilterRule

CELLS = ["x", "X", "", None, "0", "0.0", " 12 ", "1e3", "nan", "TRUE", "true", "  ", " ", "a,b", "xabx", "inf"]


def kept(table, operator, value=None, action="keep"):
    df = table("c", [(c,) for c in CELLS])
    return [r.c for r in apply_filters(df, [FilterRule("c", operator, value, action)]).collect()]


@pytest.mark.parametrize(
    "operator, value, cells",
    [
        ("equals", "x", ["x"]),
        ("equals", "", ["", None]),
        ("equals", 0, ["0", "0.0"]),
        ("equals", "0", ["0"]),
        ("equals", float("nan"), []),
        ("equals", True, ["TRUE", "true"]),
        ("not_equals", "x", [c for c in CELLS if c != "x"]),
        ("not_equals", 0, [c for c in CELLS if c not in ("0", "0.0")]),
        ("in", ["x", 0], ["x", "0"]),
        ("in", [""], ["", None]),
        ("in", [True], ["true"]),
        ("not_in", ["x", ""], [c for c in CELLS if c not in ("x", "", None)]),
        ("not_in", ["x"], [c for c in CELLS if c != "x"]),
        ("greater_than", 5, [" 12 ", "1e3", "inf"]),
        ("greater_than", "5", [" 12 ", "1e3", "inf"]),
        ("less_than", 5, ["0", "0.0"]),
        ("contains", "ab", ["xabx"]),
        ("contains", "", CELLS),
        ("matches_regex", "ab", []),
        ("matches_regex", "x.*x", ["xabx"]),
        ("matches_regex", ".*", CELLS),
        ("is_null", None, ["", None, "  ", " "]),
        ("is_not_null", None, [c for c in CELLS if c not in ("", None, "  ", " ")]),
    ],
)
def test_operators(table, operator, value, cells):
    assert kept(table, operator, value) == cells
    assert kept(table, operator, value, "skip") == [c for c in CELLS if c not in cells]


def test_rules_chain_and_ignore_absent_columns(table):
    df = table("a b", [("1", "x"), ("2", "y"), ("3", "x")])
    rules = [FilterRule("b", "equals", "x", "keep"), FilterRule("z", "equals", "1", "keep"),
             FilterRule("a", "greater_than", 1, "skip")]
    assert [r.a for r in apply_filters(df, rules).collect()] == ["1"]
    log = filter_audit(df, rules, "source_a").orderBy("rule_index").collect()
    assert [(r.rows_before, r.rows_after, r.rows_affected, r.status) for r in log] == [
        (3, 2, 1, "applied"), (2, 2, 0, "warning"), (2, 1, 1, "applied")]
    assert log[1].message == (
        "source_a lacks the column 'z' of this rule, which lets every row pass; it has ['a', 'b']")
    assert [r.value for r in log] == ["x", "1", "1"]


def test_audit_without_rules(table):
    row = filter_audit(table("a", [("1",), ("2",)]), [], "source_b").first()
    assert (row.action, row.status, row.rows_before, row.rows_after) == ("no_rules", "passthrough", 2, 2)
    assert row.message == "nothing to filter in source_b: all 2 rows pass"


def test_audit_of_an_empty_source(table):
    row = filter_audit(table("a", []), [FilterRule("a", "equals", "1")], "source_a").first()
    assert (row.rows_before, row.rows_after) == (0, 0)


def test_pattern_that_only_the_engine_refuses(spark):
    with pytest.raises(SpecError):
        check_patterns(spark, ["(?dU)a(?<1x>b)"])


def test_text_rules_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "1")], "c string, d string").write.parquet(path)
    df = spark.read.parquet(path)
    rules = [FilterRule("c", "in", ["a", "b"], "keep"), FilterRule("c", "not_equals", "z", "keep"),
             FilterRule("c", "contains", "a", "keep")]
    plan = apply_filters(df, rules).select("d")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert "In(c, [a,b])" in pushed and "EqualNullSafe(c,z)" in pushed and "StringContains(c,a)" in pushed


def test_job_with_an_unusable_rule_fails_before_reading(table):
    df = table("k v", [("1", "a")])
    job = {"schema_version": "1.0",
           "compare": {"key_column": {"source_a": "k", "source_b": "k"},
                       "column_mappings": [{"source_a": "v", "source_b": "v"}]},
           "pre_filters": {"source_a": [{"column": "v", "operator": "matches_regex", "value": "("}]}}
    with pytest.raises(SpecError):
        reconcile(df, df, job)
    assert ReconSpec.from_dict({**job, "pre_filters": {}}).key_a == "k"
