"""Cleaning, aliases, column rules, callers' functions and their counts."""

import pytest
from pyspark.sql import functions as F

from counterfoil import ReconSpec, SpecError, elementwise
from counterfoil.operators import normalize as nrm


def spec(**rules):
    return ReconSpec.from_dict({
        "schema_version": "1.0",
        "compare": {"key_column": {"source_a": "k", "source_b": "k"},
                    "column_mappings": [{"source_a": "k", "source_b": "k"}]},
        "normalization_rules": rules,
    })


def cells(df, job, column="v", **options):
    return [r[column] for r in nrm.normalize(df, job, **options).orderBy("k").collect()]


def log(df, job):
    return [(r.action, r.column, r.status, r.cells_transformed)
            for r in nrm.normalization_audit(df, job, "source_a").orderBy("step").collect()]


@pytest.fixture
def messy(table):
    values = [" Ab ", None, "nan", "None", "", " x", "ok"]
    return table("k v", [(str(i), v) for i, v in enumerate(values)])


def test_any_cleaning_fills_nulls(messy):
    assert cells(messy, spec(global_cleaning={"trim_whitespace": False})) == [
        " Ab ", "", "", "None", "", " x", "ok"]
    assert cells(messy, spec(global_cleaning={"preserve_nan_text": True}))[2] == "nan"
    assert cells(messy, spec())[1] is None


def test_cleaning_and_its_counts(messy):
    job = spec(global_cleaning={"trim_whitespace": True, "remove_nulls": True, "case_normalize": "lower"})
    assert cells(messy, job) == ["ab", "", "", "none", "", "x", "ok"]
    # one null filled, two cells trimmed, two cells changed by case
    assert log(messy, job) == [("global_cleaning", None, "applied", 5)]
    quiet = spec(global_cleaning={"case_normalize": "none"})
    assert log(messy, quiet) == []


@pytest.mark.parametrize("mode, wanted", [("upper", " AB "), ("title", " Ab "), ("lower", " ab ")])
def test_cases(messy, mode, wanted):
    assert cells(messy, spec(global_cleaning={"case_normalize": mode}))[0] == wanted


def test_null_tokens_and_inner_space(table):
    df = table("k v", [("1", "N/A"), ("2", "a   b"), ("3", None), ("4", "NULL ")])
    job = spec(global_cleaning={"trim_whitespace": True, "collapse_whitespace": True,
                                "null_tokens": True, "null_value": "-"})
    assert cells(df, job) == ["-", "a b", "-", "-"]


GROUP = {"normalized_name": "g", "aliases": ["A001", " A002 ", "a001"], "display_format": "{normalized}({original})"}


def test_alias_shows_the_alias_as_written(table):
    df = table("k v", [("1", "A001 "), ("2", " a002"), ("3", "zz"), ("4", None)])
    assert cells(df, spec(alias_groups=[GROUP])) == ["g(a001)", "g(A002)", "zz", None]
    assert log(df, spec(alias_groups=[GROUP])) == [("alias_groups", None, "applied", 2)]


def test_alias_groups_run_in_turn(table):
    groups = [{"normalized_name": "b", "aliases": ["a"]}, {"normalized_name": "c", "aliases": ["b"]},
              {"normalized_name": "a", "aliases": ["x"]}]
    df = table("k v", [("1", "a"), ("2", "b"), ("3", "x"), ("4", "c")])
    assert cells(df, spec(alias_groups=groups)) == ["c", "c", "a", "c"]
    assert log(df, spec(alias_groups=groups)) == [("alias_groups", None, "applied", 4)]


def test_alias_columns_by_logical_name(table):
    job = spec(alias_groups=[{**GROUP, "columns": ["model"]}], column_mappings={"model": ["m1", "m2"]})
    df = table("k m1 v", [("1", "A001", "A001")])
    row = nrm.normalize(df, job).first()
    assert (row.m1, row.v) == ("g(a001)", "A001")


def test_long_alias_lists_are_joined_and_agree(table, monkeypatch):
    df = table("k v", [("1", "A001 "), ("2", " a002"), ("3", "zz"), ("4", None), ("A001", "A002")])
    job = spec(alias_groups=[GROUP])
    short, counted = nrm.normalize(df, job, canonical=["v"]).orderBy("v").collect(), log(df, job)
    monkeypatch.setattr(nrm, "LITERAL_ALIASES", 0)
    assert nrm.normalize(df, job, canonical=["v"]).orderBy("v").collect() == short
    assert log(df, job) == counted


def test_canonical_shadow(table):
    df = table("k v", [("1", "A001"), ("2", "zz")])
    out = nrm.normalize(df, spec(alias_groups=[GROUP]), canonical=["v"]).orderBy("k").collect()
    assert [r[nrm.shadow_name("v")] for r in out] == ["g", "zz"]
    plain = nrm.normalize(df, spec(), canonical=["v"]).orderBy("k").collect()
    assert [r[nrm.shadow_name("v")] for r in plain] == ["A001", "zz"]


def test_column_rules(table):
    df = table("k v w", [("1", "a,b", "ABCDE"), ("2", None, None), ("3", "[]", "AB")])
    job = spec(column_specific=[{"column": "v", "array_parse": True},
                                {"column": "w", "fixed_length_parse": True, "lengths": [2, 3]},
                                {"column": "gone", "array_parse": True}])
    assert cells(df, job) == [["a", "b"], [], []]
    assert cells(df, job, "w") == ["AB|CDE", "", "AB"]
    assert log(df, job) == [("array_parse", "v", "applied", 2), ("fixed_length_parse", "w", "applied", 2),
                            ("column_specific", "gone", "warning", None)]


def test_callers_functions(table):
    # Local classes travel to the workers by value, as a shell's or notebook's do.
    class Doubler:
        def normalize(self, series):
            return series + series

    class Broken:
        def __init__(self):
            raise RuntimeError("no")

    df = table("k v", [("1", "a"), ("2", "b")])
    job = spec(custom_normalizers=[
        {"class": Doubler, "columns": ["v"]},
        {"function": lambda c: F.concat(c, F.lit("!")), "columns": ["v"], "name": "bang"},
        {"function": elementwise(lambda x: x.upper()), "columns": ["v"]},
        {"class": Broken},
        {"class": "some.dotted.Path"},
    ])
    assert cells(df, job) == ["AA!", "BB!"]
    entries = nrm.normalization_audit(df, job, "source_a").orderBy("step").collect()
    assert [(e.status, e.cells_transformed) for e in entries] == [
        ("applied", 2), ("applied", 2), ("applied", 2), ("error", None), ("error", None)]
    assert "some.dotted.Path" in entries[-1].message


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("1", "a", "b")], "k string, v string, w string").write.parquet(path)
    job = spec(global_cleaning={"trim_whitespace": True}, alias_groups=[GROUP])
    plan = nrm.normalize(spark.read.parquet(path), job, ["k", "v"])._jdf.queryExecution().executedPlan()
    assert "ReadSchema: struct<k:string,v:string>" in plan.toString()


@pytest.mark.parametrize("rules", [
    {"global_cleaning": {"case_normalize": "camel"}},
    {"alias_groups": [{"normalized_name": "g", "aliases": []}]},
    {"alias_groups": [{"aliases": ["a"]}]},
    {"alias_groups": [GROUP, GROUP]},
    {"alias_groups": [{**GROUP, "display_format": "{other}"}]},
    {"column_specific": [{"array_parse": True}]},
    {"column_specific": [{"column": "v", "fixed_length_parse": True}]},
    {"column_specific": [{"column": "k", "array_parse": True}]},
    {"custom_normalizers": [{"columns": ["v"]}]},
])
def test_wrong_rules(rules):
    with pytest.raises(SpecError):
        spec(**rules)


def test_a_normaliser_with_fit_sees_its_whole_column_at_any_partitioning(spark, table):
    class FillMostFrequent:
        def fit(self, cells):
            return cells.filter("cell IS NOT NULL").groupBy("cell").count().orderBy(F.desc("count"), "cell").limit(1)

        def apply(self, cell, row):
            return F.coalesce(cell, row["cell"])

    rules = {"custom_normalizers": [{"class": FillMostFrequent, "columns": ["v", "w"]}]}
    spec = ReconSpec.from_dict({
        "schema_version": "1.0",
        "compare": {"key_columns": ["k"], "column_mappings": [{"source_a": "v", "source_b": "v"}]},
        "normalization_rules": rules,
    })
    rows = [(str(i), None if i % 3 == 0 else "ab"[i % 5 == 0], None) for i in range(60)]
    want = sorted((k, v or "a", w) for k, v, w in rows)
    for n in (1, 20):
        assert sorted(map(tuple, nrm.normalize(table("k v w", rows).repartition(n), spec).collect())) == want
