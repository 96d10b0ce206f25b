"""A small catalogue compared from end to end: files, logs, metrics, report."""

import pytest
from pyspark.sql import functions as F

from counterfoil import Metric, Report, SourceError, SpecError, reconcile, run_job

SHOP = """id,title,code,price,left,state,labels
S1,Desk Lamp,L10,19.50,4,Live,"light,home"
S2,Wall Clock,L20,32.00,0,Live,"home,time"
S3,Tea Pot,T01,15.25,0,Retired,"kitchen"
S4,Mug,T02,6.75,80,Live,"kitchen,gift"
S5,Tray,T03,9.10,0,Dropped,
S6,Rug,R01,120.00,2,Live,"home, floor"
"""
FEED = """ref,name,model,cost,stock,status,tags
S1,Desk Lamp,l10,19.50,4,live,"home,light"
S2,Wall Clock,L20,31.00,3,live,"time,home"
S3,Tea Pot,t01,15.25,0,archived,kitchen
S4,Mug,T02,6.75,80,live,kitchen
S6,Rug,R01,120.00,2,live,"floor,home"
S7,Vase,V01,44.00,1,live,glass
"""
PAIRS = [("title", "name"), ("code", "model"), ("price", "cost"), ("left", "stock"), ("state", "status")]
RULES = {
    "global_cleaning": {"trim_whitespace": True, "remove_nulls": True, "case_normalize": "lower"},
    "alias_groups": [
        {"normalized_name": "lights", "aliases": ["L10", "L20"], "display_format": "{normalized}({original})"},
        {"normalized_name": "tea", "aliases": ["T01", "T02", "T03"]},
    ],
}


@pytest.fixture
def job(tmp_path):
    (tmp_path / "shop.csv").write_text(SHOP)
    (tmp_path / "feed.csv").write_text("﻿" + FEED)
    return {
        "schema_version": "1.0",
        "sources": {"source_a": {"file": str(tmp_path / "shop.csv")},
                    "source_b": {"file": str(tmp_path / "feed.csv")}},
        "compare": {"key_column": {"source_a": "id", "source_b": "ref"},
                    "column_mappings": [{"source_a": a, "source_b": b} for a, b in PAIRS]},
        "normalization_rules": RULES,
    }


def lines(folder, section):
    (file,) = [p for p in (folder / section).iterdir() if p.suffix == ".csv"]
    return file.read_text().splitlines()


def test_report_of_the_filtered_job(spark, job, tmp_path):
    job["pre_filters"] = {
        "source_a": [{"column": "left", "operator": "not_equals", "value": "0", "action": "skip"},
                     {"column": "state", "operator": "in", "value": ["Dropped"], "action": "skip"}],
        "source_b": [{"column": "tags", "operator": "contains", "value": "glass"}],
    }
    folder = tmp_path / "report"
    recon = run_job(spark, job)
    Report(recon).write(str(folder))
    assert lines(folder, "summary") == [
        "Metric,Value", "Total Rows (Source A),6", "Total Rows (Source B),6", "Keys Compared,2",
        "Fully Matched Keys,0", "Keys with Mismatches,2", "Only in Source A,0", "Only in Source B,3",
        "Cell-Level Matches,7", "Cell-Level Mismatches,3", "Match Rate (%),0.0"]
    assert lines(folder, "mismatch_details") == [
        "Key,Column,Value A,Value B,Diff Type", "s2,price vs cost,32.00,31.00,value_diff",
        "s2,left vs stock,0,3,value_diff", "s3,state vs status,retired,archived,value_diff"]
    assert lines(folder, "unmatched_records") == ["Source,Key", "Source B,s1", "Source B,s4", "Source B,s6"]
    assert lines(folder, "per_column_breakdown") == [
        "Column,Matched,Mismatched,Total,Match Rate %", "code vs model,2,0,2,100.0", "left vs stock,1,1,2,50.0",
        "price vs cost,1,1,2,50.0", "state vs status,1,1,2,50.0", "title vs name,2,0,2,100.0"]
    log = lines(folder, "filter_log")
    assert log[1:] == ["filter,source_a,0,left,not_equals,skip,0,6,3,3,applied,",
                       "filter,source_a,1,state,in,skip,['Dropped'],3,2,1,applied,",
                       "filter,source_b,0,tags,contains,skip,glass,6,5,1,applied,"]
    counts = {(r.source, r.action): r.cells_transformed for r in recon.normalization_log().collect()}
    assert counts == {("source_a", "global_cleaning"): 8, ("source_a", "alias_groups"): 2,
                      ("source_b", "global_cleaning"): 13, ("source_b", "alias_groups"): 4}


def test_unfiltered_metrics_and_sets(spark, job):
    job["compare"]["column_mappings"].append({"source_a": "labels", "source_b": "tags", "method": "set"})
    job["report"] = {"sections": [
        {"name": "summary", "stats": ["match_rate_percent", {"name": "risk", "expression": "total_mismatches / 0"}]},
        {"name": "unmatched_records", "enabled": False, "stats": ["no_such_metric"]},
        {"name": "derived", "stats": [{"name": "half", "expression": "full_match_count * 2 >= matched_keys"},
                                      "high_risk_mismatches"]},
    ]}
    recon = run_job(spark, job)
    row = recon.metrics().first().asDict()
    assert row == {"match_rate_percent": 40.0, "risk": 0.0, "half": False}
    assert list(recon.metric_tables()) == ["high_risk_mismatches"]
    sets = recon.mismatches().filter("diff_type = 'set_diff'").collect()
    assert [(d.key, d.only_in_a, d.only_in_b, d.common, d.normalized_a) for d in sets] == [
        ("s4", ["gift"], [], ["kitchen"], '["gift","kitchen"]')]
    assert recon.spec.enabled_sections() == ("summary", "derived")
    by_column = {r.column: r.mismatches for r in recon.mismatches_by_column().collect()}
    assert by_column == {"price vs cost": 1, "left vs stock": 1, "state vs status": 1, "labels vs tags": 1}


@pytest.mark.parametrize("join_type", ["inner", "left", "right", "outer"])
def test_empty_side_leaves_nothing_to_compare(table, join_type):
    job = {"schema_version": "1.0", "compare": {
        "key_column": {"source_a": "k", "source_b": "k"}, "join_type": join_type,
        "column_mappings": [{"source_a": "v", "source_b": "v"}]}}
    recon = reconcile(table("k v", [("1", "a"), ("2", None)]), table("k v", []), job)
    assert recon.details().isEmpty()
    assert [tuple(r) for r in recon.unmatched().orderBy("key").collect()] == [("Source A", "1"), ("Source A", "2")]
    summary = {r.metric: r.value for r in recon.summary().collect()}
    assert summary["Match Rate (%)"] == "100.0" and summary["Only in Source A"] == "2"
    assert recon.metrics(["match_rate_percent"]).first()[0] == 0.0
    assert recon.per_column().isEmpty()


def test_null_keys(table):
    job = {"schema_version": "1.0", "compare": {
        "key_columns": ["k"], "join_type": "outer", "column_mappings": [{"source_a": "v", "source_b": "v"}]}}
    a, b = table("k v", [(None, "a"), ("1", "x")]), table("k v", [(None, "a"), ("1", "x")])
    assert [d.key for d in reconcile(a, b, job).details().collect()] == ["1"]
    job["normalization_rules"] = {"global_cleaning": {"remove_nulls": True}}
    assert sorted(d.key for d in reconcile(a, b, job).details().collect()) == ["", "1"]


def test_list_cells_compared_exactly_keep_their_order(table):
    job = {"schema_version": "1.0", "compare": {
        "key_columns": ["k"], "column_mappings": [{"source_a": "v", "source_b": "v"}]},
        "normalization_rules": {"column_specific": [{"column": "v", "array_parse": True}]}}
    a = table("k v", [("1", "a,b"), ("2", "a,b"), ("3", None)])
    b = table("k v", [("1", "b,a"), ("2", '["a","b"]'), ("3", "")])
    rows = reconcile(a, b, job).details().orderBy("key").collect()
    assert [d.diff_type for d in rows] == ["value_diff", "exact_match", "exact_match"]
    assert (rows[0].value_a, rows[0].normalized_a) == ('["a","b"]', "['a', 'b']")


def test_mappings_without_their_column_are_logged(table):
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "column_mappings": [
        {"source_a": "gone", "source_b": "v"}, {"source_a": "v", "source_b": "v"}]}}
    df = table("k v", [("1", "a")])
    recon = reconcile(df, df, job)
    assert [(e.column, e.source, e.error_type) for e in recon.error_log().collect()] == [
        ("gone", "a", "column_missing")]
    assert [(d.mapping_idx, d.column) for d in recon.details().collect()] == [(1, "v vs v")]
    assert recon.per_column().count() == 1
    with pytest.raises(SpecError):
        recon.spec.check(df.columns, df.columns)
    with pytest.raises(SpecError):
        reconcile(df.drop("k"), df, job)
    nothing = {**job, "compare": {**job["compare"], "column_mappings": [{"source_a": "gone", "source_b": "v"}]}}
    empty = reconcile(df, df, nothing)
    assert empty.details().isEmpty() and empty.per_column().isEmpty()
    assert empty.metrics(["full_match_count", "matched_keys"]).first() == (0, 1)


def test_labels_that_occur_twice_are_one_row(table):
    pair = {"source_a": "v", "source_b": "w"}
    job = {"schema_version": "1.0", "compare": {"key_column": {"source_a": "k", "source_b": "k"},
           "column_mappings": [pair, {**pair, "method": "set"}]}}
    recon = reconcile(table("k v", [("1", "a,b")]), table("k w", [("1", "b,a")]), job)
    assert [tuple(r) for r in recon.per_column().collect()] == [("v vs w", 1, 1, 2, 50.0)]


def test_duplicate_warnings(table):
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"],
           "column_mappings": [{"source_a": "v", "source_b": "v"}]},
           "normalization_rules": {"global_cleaning": {"case_normalize": "lower"}}}
    a = table("k v", [(None, "1"), (None, "2"), ("x", "1"), ("X", "2")] + [(f"d{i:02d}", "1") for i in range(25)] * 2)
    recon = reconcile(a, table("k v", [("x", "1")]), job)
    log = {(r.stage, r.source): r.message for r in recon.filter_log().filter("status = 'warning'").collect()}
    first = [f"d{i:02d}" for i in range(25)]
    assert log == {
        ("import", "source_a"): f"side A as read: 26 keys stand on several rows, among them {first[:5]}",
        ("compare", "source_a"): "source_a, key k: 27 keys stand on several rows and pair up with every partner, "
        f"among them {['', *first[:19]]} ...",
    }


def test_callers_metrics_and_conflicts(table):
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"],
           "column_mappings": [{"source_a": "v", "source_b": "v"}]}}
    a, b = table("k v", [("1", "a"), ("2", "b")]), table("k v", [("1", "a"), ("2", "c")])
    longest = Metric("longest", "details", F.max(F.length("value_a")))
    recon = reconcile(a, b, job, metrics=[longest])

    class Share:
        depends_on = ("total_mismatches", "longest")

        @staticmethod
        def compute(m):
            return m["total_mismatches"] / m["longest"]

    assert recon.metrics(["longest", {"name": "share", "plugin": Share}]).first() == (1, 1.0)
    for bad in (["nope"], ["longest", "longest"], [{"name": "x", "expression": "y + 1"}],
                [{"name": "x", "expression": "x + 1"}], [{"name": "x", "plugin": object()}],
                [{"name": "x", "expression": "high_risk_mismatches + 1"}],
                [{"name": "x", "expression": "y"}, {"name": "y", "expression": "x"}]):
        with pytest.raises(SpecError):
            recon.metrics(bad)
    both = recon.metrics([{"name": "x", "expression": "y + 1"}, {"name": "y", "expression": "matched_keys * 2"}])
    assert both.first() == (5, 4)
    with pytest.raises(SpecError):
        Metric("m", "nowhere", F.count("*"))
    with pytest.raises(SpecError):
        reconcile(a, b, job, metrics=[Metric("matched_keys", "keys", F.count("*"))]).metrics(["only_in_a"])


def test_only_the_needed_frames_are_read(table, monkeypatch):
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"],
           "column_mappings": [{"source_a": "v", "source_b": "v"}]}}
    a = table("k v", [("1", "a")])
    recon = reconcile(a, a, job)
    asked = []
    frame = recon._frame
    monkeypatch.setattr(recon, "_frame", lambda name: asked.append(name) or frame(name))
    assert recon.metrics(["total_rows_a"]).first() == (1,)
    assert asked == ["source_a"]


def test_row_with_too_many_fields_stops_a_strict_job(spark, job, tmp_path):
    (tmp_path / "shop.csv").write_text(SHOP + "S9,a,b,c,d,e,f,g\n")
    with pytest.raises(Exception, match="more fields"):
        run_job(spark, job).source_a.count()
    assert run_job(spark, job, strict_rows=False).source_a.count() == 6


@pytest.mark.parametrize("change", [
    {"schema_version": "2.0"}, {"schema_version": None}, {"sources": {"source_a": {"file": "x"}}},
    {"compare": None}, {"compare": {"key_column": {"source_a": "id"}}},
    {"compare": {"key_columns": ["id"], "column_mappings": []}},
    {"compare": {"key_columns": ["id"], "join_type": "cross", "column_mappings": [{"source_a": "a", "source_b": "b"}]}},
    {"compare": {"key_columns": ["id"], "column_mappings": [{"source_a": "a", "source_b": "b", "method": "fuzzy"}]}},
    {"compare": {"key_columns": ["id"], "column_mappings": [{"source_a": "a"}]}},
    {"pre_filters": {"source_a": [{"column": "x", "operator": "like", "value": "y"}]}},
    {"pre_filters": {"source_a": [{"column": "x", "operator": "in", "value": []}]}},
    {"pre_filters": {"source_a": [{"column": "x", "operator": "greater_than", "value": "many"}]}},
    {"pre_filters": {"source_a": [{"column": "x", "operator": "equals"}]}},
    {"pre_filters": {"source_a": [{"column": "x", "operator": "is_null", "action": "drop"}]}},
    {"filter": {"pre_filters": {"source_a": [{"column": "x", "operator": "is_null"}]}}},
    {"report": {"output": {"formats": [{"type": "pdf"}]}}}, {"report": {"sections": [{"enabled": True}]}},
])
def test_wrong_jobs(job, change):
    from counterfoil import ReconSpec

    with pytest.raises(SpecError):
        ReconSpec.from_dict({**job, **change})


def test_nested_rules_win_over_top_level_ones(job):
    from counterfoil import ReconSpec

    job["pre_filters"] = {"source_a": [{"column": "x", "operator": "is_null"}]}
    job["filter"] = {"pre_filters": {"source_b": [{"column": "y", "operator": "is_null", "action": "keep"}]}}
    job["normalize"] = {"normalization_rules": {"global_cleaning": {"case_normalize": "upper"}}}
    spec = ReconSpec.from_dict(job)
    assert spec.filters_a == () and spec.filters_b[0].action == "keep"
    assert spec.cleaning.case_normalize == "upper" and spec.alias_groups == ()


def test_typed_sinks_and_previews(spark, job, tmp_path):
    job["compare"]["column_mappings"].append({"source_a": "labels", "source_b": "tags", "method": "set"})
    recon = run_job(spark, job)
    report = Report(recon)
    for form in ("parquet", "json"):
        report.write(str(tmp_path / form), form, ["mismatch_details", "unmatched_records"], ordered=False)
        back = spark.read.format(form).load(str(tmp_path / form / "mismatch_details"))
        assert back.filter("diff_type = 'set_diff'").first().only_in_a == ["gift"]
    assert [r.key for r in report.preview("unmatched_records").collect()] == ["s5", "s7"]
    assert report.preview("mismatch_details", 2).count() == 2
    assert report.size("mismatch_details").first().rows == 4
    bands = {r.column: r.band for r in report.banded_breakdown().collect()}
    assert bands["title vs name"] == "high" and bands["state vs status"] == "medium"
    with pytest.raises(SpecError):
        report.section("pie_chart")


def test_empty_sections_keep_their_header(spark, job, tmp_path):
    job["pre_filters"] = {"source_a": [{"column": "id", "operator": "is_not_null", "action": "skip"}]}
    Report(run_job(spark, job)).write(str(tmp_path / "r"), sections=["mismatch_details"])
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "mismatch_details")).isEmpty()


def test_outputs_of_the_job(table, tmp_path):
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "column_mappings": [{"source_a": "v", "source_b": "v"}]}}
    job["report"] = {"output": {"formats": [{"type": "csv", "file_name": "out"}]}, "sections": [{"name": "summary", "enabled": True}]}
    sides = table("k v", [("1", "2")]), table("k v", [("1", "2")])
    assert Report(reconcile(*sides, job)).write_job(str(tmp_path)) == [f"{tmp_path}/out/summary"]
    job["report"]["output"]["formats"].append({"type": "html"})
    with pytest.raises(SpecError, match="html"):
        Report(reconcile(*sides, job)).write_job(str(tmp_path))
    with pytest.warns(UserWarning, match="html"):
        assert Report(reconcile(*sides, job)).write_job(str(tmp_path), skip_unbuilt=True) == [f"{tmp_path}/out/summary"]
    assert Report(reconcile(*sides, job)).preview("summary", 0).count() == 0
