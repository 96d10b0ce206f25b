"""The registered queries: each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfoil import Metric, Recon, ReconSpec, Report, as_string_table, damaged_cells, decode_audit, elementwise
from counterfoil import profile, read_delimited, reconcile, weighted_count
from counterfoil.operators.filters import apply_filters, filter_audit
from counterfoil.operators.keys import duplicate_keys

from counterfoil.operators.normalize import normalization_audit, normalize
from counterfoil.plans.storage import new_path
from counterfoil.spec import FilterRule

from . import sides
from .jobs import CLEAN_LOWER, PRIORITY_ALIASES, job, orders_job, rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def scratch(spark: SparkSession) -> str:
    """A new folder that all tasks can reach."""
    return new_path(spark)


def orders(spark: SparkSession, folder: str, **options) -> Recon:
    return reconcile(
        sides.ORDERS_A.frame(spark, folder), sides.ORDERS_B.frame(spark, folder), orders_job(**options)
    )


def repeated_orders(spark: SparkSession, folder: str, **options) -> Recon:
    return reconcile(
        sides.ORDERS_A_REPEATED.frame(spark, folder),
        sides.ORDERS_B_REPEATED.frame(spark, folder),
        orders_job(**options),
    )


# -- filters ------------------------------------------------------------------

FILTERS = {
    "flt_equals_text": (sides.ORDERS_A, [("status", "equals", "F", "skip")]),
    "flt_equals_bool": (sides.MESSY, [("flag", "equals", True, "keep")]),
    "flt_equals_number": (sides.MESSY, [("amount", "equals", 0, "keep")]),
    "flt_not_equals": (sides.ORDERS_B, [("prio", "not_equals", "1-URGENT", "keep")]),
    "flt_in": (sides.ORDERS_B, [("prio", "in", ["1-URGENT", "5-LOW", ""], "keep")]),
    "flt_not_in": (sides.ORDERS_B, [("prio", "not_in", ["1-URGENT", "5-LOW"], "keep")]),
    "flt_greater_than": (sides.MESSY, [("amount", "greater_than", 250000, "keep")]),
    "flt_less_than": (sides.MESSY, [("amount", "less_than", "50000.5", "skip")]),
    "flt_contains": (sides.ORDERS_A, [("priority", "contains", "-H", "keep")]),
    "flt_matches_regex": (sides.CUSTOMERS, [("name", "matches_regex", r"Customer#0+\d*5", "keep")]),
    "flt_is_null": (sides.MESSY, [("priority", "is_null", None, "keep")]),
    "flt_is_not_null": (sides.MESSY, [("priority", "is_not_null", None, "keep")]),
    "flt_keep_chain": (
        sides.ORDERS_A,
        [
            ("status", "in", ["F", "O"], "keep"),
            ("price", "greater_than", 100000, "keep"),
            ("priority", "contains", "LOW", "skip"),
        ],
    ),
}


def _filter_query(name: str) -> Query:
    side, rules = FILTERS[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return apply_filters(side.frame(spark, folder), [FilterRule(*r) for r in rules])

    return run


for _name in FILTERS:
    QUERIES[_name] = _filter_query(_name)


@query
def flt_contains_documents(spark, folder):
    """A substring rule over whole texts; only the columns that are needed are read."""
    docs = as_string_table(spark.read.parquet(f"{folder}/documents.parquet"))
    return apply_filters(docs, [FilterRule("text", "contains", "the", "keep")]).select(
        "doc_id", "lang", "source"
    )


@query
def flt_audit(spark, folder):
    rules = [
        FilterRule("status", "in", ["F", "O"], "keep"),
        FilterRule("no_such_column", "equals", "x", "skip"),
        FilterRule("price", "less_than", 100000, "skip"),
        FilterRule("priority", "equals", "5-LOW", "skip"),
    ]
    audit = filter_audit(sides.ORDERS_A.frame(spark, folder), rules, "source_a").unionByName(
        filter_audit(sides.ORDERS_B.frame(spark, folder), [], "source_b")
    )
    return audit.drop("message")


@query
def filter_log(spark, folder):
    """The whole log: rule counts and the warnings on repeated keys."""
    filters = {"source_a": [rule("status", "equals", "P", "skip")]}
    return repeated_orders(spark, folder, filters=filters).filter_log()


# -- normalisation --------------------------------------------------------------


def _normalized(spark, folder, side: sides.Side, rules: dict) -> DataFrame:
    spec = ReconSpec.from_dict(job(("k", "k"), [("k", "k")], rules=rules))
    return normalize(side.frame(spark, folder), spec)


@query
def nrm_clean_lower(spark, folder):
    return _normalized(spark, folder, sides.MESSY, {"global_cleaning": CLEAN_LOWER})


@query
def nrm_clean_upper(spark, folder):
    rules = {"global_cleaning": {"trim_whitespace": True, "case_normalize": "upper"}}
    return _normalized(spark, folder, sides.MESSY, rules)


@query
def nrm_clean_title(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    df = as_string_table(part.select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" o'neil x-1b")).alias("p_name"), "p_type"))
    rules = {"global_cleaning": {"case_normalize": "title"}}
    return normalize(df, ReconSpec.from_dict(job(("k", "k"), [("k", "k")], rules=rules)))


@query
def nrm_nulls(spark, folder):
    return _normalized(spark, folder, sides.MESSY, {"global_cleaning": {"remove_nulls": True}})


@query
def nrm_alias(spark, folder):
    return _normalized(spark, folder, sides.MESSY, {"alias_groups": list(PRIORITY_ALIASES)})


@query
def nrm_alias_scoped_chain(spark, folder):
    """A later group takes up what an earlier one wrote; one group is limited to a column."""
    groups = [
        {"normalized_name": "fast", "aliases": ["1-URGENT", "2-HIGH"], "columns": ["urgency"]},
        {"normalized_name": "final", "aliases": ["F", "Fast"], "display_format": "<{normalized}>"},
    ]
    rules = {"alias_groups": groups, "column_mappings": {"urgency": ["priority", "prio"]}}
    return _normalized(spark, folder, sides.ORDERS_A, rules)


@query
def nrm_alias_many(spark, folder):
    """More aliases than a literal map should hold: the lookup becomes a join."""
    aliases = [f"Customer#{n:09d}" for n in range(0, 100_000, 100)]
    group = {"normalized_name": "round", "aliases": aliases, "display_format": "{normalized}:{original}"}
    return _normalized(spark, folder, sides.CUSTOMERS, {"alias_groups": [group]})


@query
def nrm_array_parse(spark, folder):
    rules = {"column_specific": [{"column": "tags", "array_parse": True}]}
    df = _normalized(spark, folder, sides.LISTS_A, rules)
    return df.select("k", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n"))


@query
def nrm_fixed_width(spark, folder):
    rules = {"column_specific": [{"column": "name", "fixed_length_parse": True, "lengths": [8, 1, 9]}]}
    return _normalized(spark, folder, sides.CUSTOMERS, rules)


def dashes(c: Column) -> Column:
    return F.regexp_replace(c, "#", "-")


@query
def nrm_user_fn(spark, folder):
    class ShortSegment:
        """A caller's class on pandas Series; being local it needs no module on the workers."""

        def normalize(self, cells):
            return cells.str.slice(0, 4)

    rules = {
        "custom_normalizers": [
            {"function": dashes, "columns": ["name"]},
            {"class": ShortSegment, "columns": ["segment"]},
        ]
    }
    return _normalized(spark, folder, sides.CUSTOMERS, rules)


class FillMostFrequent:
    """A caller's class that looks at its whole column: empty cells get the most frequent value."""

    def fit(self, cells):
        counted = cells.filter("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return counted.orderBy(F.desc("n"), "cell").limit(1)

    def apply(self, cell, row):
        return F.coalesce(cell, row["cell"])


@query
def nrm_elementwise(spark, folder):
    """A caller's function on single values."""
    rules = {"custom_normalizers": [{"function": elementwise(lambda cell: cell and cell[::-1]), "columns": ["name"]}]}
    return _normalized(spark, folder, sides.CUSTOMERS, rules)


@query
def nrm_fitted(spark, folder):
    rules = {"custom_normalizers": [{"class": FillMostFrequent, "columns": ["prio"]}]}
    spec = ReconSpec.from_dict(job(("order_ref", "order_ref"), [("prio", "prio")], rules=rules))
    return normalize(sides.ORDERS_B.frame(spark, folder), spec)


@query
def nrm_audit(spark, folder):
    rules = {
        "global_cleaning": CLEAN_LOWER,
        "alias_groups": list(PRIORITY_ALIASES),
        "column_specific": [
            {"column": "flag", "fixed_length_parse": True, "lengths": [1, 3]},
            {"column": "absent", "array_parse": True},
            {"column": "status", "array_parse": True},
        ],
    }
    spec = ReconSpec.from_dict(job(("k", "k"), [("k", "k")], rules=rules))
    log = normalization_audit(sides.MESSY.frame(spark, folder), spec, "source_a")
    return log.select("step", "source", "action", "column", "status", "cells_transformed")


@query
def nrm_null_tokens(spark, folder):
    rules = {
        "global_cleaning": {
            "trim_whitespace": True,
            "collapse_whitespace": True,
            "null_tokens": True,
            "null_value": "<none>",
        }
    }
    return _normalized(spark, folder, sides.MESSY, rules)


# -- keys -----------------------------------------------------------------------


@query
def key_status(spark, folder):
    return repeated_orders(spark, folder).key_status()


@query
def unmatched(spark, folder):
    return orders(spark, folder).unmatched()


@query
def dup_keys_raw(spark, folder):
    return duplicate_keys(sides.EVENTS.frame(spark, folder), ["user_ref", "kind"], nulls=True)


@query
def dup_keys_clean(spark, folder):
    rules = {"global_cleaning": {"case_normalize": "lower"}}
    return repeated_orders(spark, folder, rules=rules).duplicate_keys("b")


# -- details ----------------------------------------------------------------------

DETAIL = ("key", "mapping_idx", "column", "value_a", "value_b", "status", "diff_type")


@query
def details_inner(spark, folder):
    return orders(spark, folder).details().select(*DETAIL, "normalized_a", "normalized_b")


@query
def details_left(spark, folder):
    return orders(spark, folder, join_type="left").details().select(*DETAIL)


@query
def details_right(spark, folder):
    return orders(spark, folder, join_type="right").details().select(*DETAIL)


@query
def details_full(spark, folder):
    return orders(spark, folder, join_type="outer").details().select(*DETAIL)


@query
def details_dup_keys(spark, folder):
    return repeated_orders(spark, folder).details().select(*DETAIL)


@query
def details_collapsed(spark, folder):
    """Identical rows are counted before the join, each judgement comes once."""
    return repeated_orders(spark, folder).details(collapse=True).select(*DETAIL, "pairs")


def lists(spark: SparkSession, folder: str) -> Recon:
    mapping = {"source_a": "tags", "source_b": "keywords", "method": "set"}
    return reconcile(
        sides.LISTS_A.frame(spark, folder),
        sides.LISTS_B.frame(spark, folder),
        job(("k", "ref"), [mapping]),
    )


@query
def details_set(spark, folder):
    joined = [F.array_join(c, "|").alias(c) for c in ("only_in_a", "only_in_b", "common")]
    return lists(spark, folder).details().select(*DETAIL, *joined)


@query
def mismatches(spark, folder):
    return orders(spark, folder, rules={"global_cleaning": CLEAN_LOWER}).mismatches().select(*DETAIL)


@query
def mismatches_preview(spark, folder):
    preview = Report(orders(spark, folder)).preview("mismatch_details", 200)
    return preview.select(*DETAIL)


@query
def unmatched_preview(spark, folder):
    return Report(orders(spark, folder)).preview("unmatched_records", 100)


# -- metrics ------------------------------------------------------------------------


@query
def metrics_core(spark, folder):
    filters = {"source_a": [rule("status", "equals", "P", "skip")]}
    return orders(spark, folder, filters=filters).metrics()


@query
def metrics_left_join(spark, folder):
    return repeated_orders(spark, folder, join_type="left").metrics()


@query
def summary(spark, folder):
    return orders(spark, folder).summary()


@query
def summary_full_join(spark, folder):
    return repeated_orders(spark, folder, join_type="outer").summary()


@query
def per_column(spark, folder):
    rules = {"global_cleaning": CLEAN_LOWER}
    return orders(spark, folder, rules=rules).per_column()


@query
def per_column_hot_key(spark, folder):
    """A key with a third of all rows on both sides, counted without making the pairs."""
    columns = (("flag", "flag_b"), ("line", "line_b"), ("quantity", "quantity_b"))
    recon = reconcile(
        sides.HOT_A.frame(spark, folder), sides.HOT_B.frame(spark, folder), job(("k", "ref"), columns)
    )
    return recon.per_column()


@query
def mismatch_by_column(spark, folder):
    return orders(spark, folder).mismatches_by_column()


@query
def high_risk(spark, folder):
    return orders(spark, folder).high_risk()


@query
def rate_bands(spark, folder):
    return Report(orders(spark, folder)).banded_breakdown()


EXPRESSIONS = (
    {"name": "efficiency", "expression": "full_match_count * 100 / total_rows_a"},
    {"name": "alert", "expression": "match_rate_percent < 80"},
    {"name": "by_zero", "expression": "1 + total_rows_a / (only_in_b - only_in_b)"},
    {"name": "whole", "expression": "total_mismatches // 7"},
    {"name": "rest", "expression": "-total_mismatches % 7"},
    {"name": "grade", "expression": "1 if match_rate_percent >= 90 else 2 if efficiency > 50 else 3"},
)


@query
def metrics_derived(spark, folder):
    return orders(spark, folder).metrics(["matched_keys", *EXPRESSIONS])


@query
def metrics_user(spark, folder):
    """Callers' aggregates over the details, the keys and a source, and a formula."""
    own = (
        Metric("missing_cells", "details", F.count_if(F.col("diff_type").startswith("missing"))),
        Metric("longest_key", "keys", F.max(F.length("key"))),
        Metric("statuses", "source_a", F.count_distinct("status")),
        Metric(
            "missing_share",
            formula=lambda m: F.bround(100 * m["missing_cells"] / m["total_mismatches"], 2),
            depends_on=("missing_cells", "total_mismatches"),
        ),
    )
    recon = Recon(
        sides.ORDERS_A.frame(spark, folder),
        sides.ORDERS_B.frame(spark, folder),
        ReconSpec.from_dict(orders_job()),
        metrics=own,
    )
    return recon.metrics(["missing_share", "longest_key", "statuses", "missing_cells"])


@query
def metrics_user_hot(spark, folder):
    """Callers' aggregates over judged cells under a key with a third of all rows, without its pairs."""
    kind = F.col("diff_type")
    own = (
        Metric("missing_cells", "judgements", weighted_count(kind.startswith("missing"))),
        Metric("other_cells", "judgements", weighted_count(kind == "value_diff")),
        Metric("kinds", "judgements", F.count_distinct("column", "diff_type")),
        Metric(
            "missing_share",
            formula=lambda m: F.bround(100 * m["missing_cells"] / m["total_mismatches"], 2),
            depends_on=("missing_cells", "total_mismatches"),
        ),
    )
    recon = Recon(
        sides.HOT_A.frame(spark, folder),
        sides.HOT_B.frame(spark, folder),
        ReconSpec.from_dict(job(("k", "ref"), (("flag", "flag_b"), ("quantity", "quantity_b")))),
        metrics=own,
    )
    return recon.metrics([metric.name for metric in own])


class MismatchesPerKey:
    """A caller's metric object over built-in metrics."""

    depends_on = ("total_mismatches", "matched_keys")

    def compute(self, m):
        return F.bround(m["total_mismatches"] / m["matched_keys"], 3)


@query
def metrics_object(spark, folder):
    return orders(spark, folder).metrics([{"name": "mismatches_per_key", "plugin": MismatchesPerKey()}, "matched_keys"])


@query
def missing_mapping(spark, folder):
    """A mapping whose column one side lacks is left out of the comparison and told in the error log."""
    columns = [("status", "state"), ("price", "no_such_column"), ("odate", "order_date")]
    recon = reconcile(
        sides.ORDERS_A.frame(spark, folder), sides.ORDERS_B.frame(spark, folder), job(("k", "order_ref"), columns)
    )
    errors = recon.error_log().select("column", F.concat_ws(" ", "error_type", "source").alias("told"))
    return recon.per_column().select("column", "matched", "mismatched").unionByName(errors, allowMissingColumns=True)


@query
def filter_log_written(spark, folder):
    """The log as it stands in its file."""
    path = scratch(spark) + "/log"
    filters = {"source_a": [rule("status", "equals", "P", "skip")]}
    Report(orders(spark, folder, filters=filters)).write(path, sections=("filter_log",))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/filter_log")
    counts = [F.col(c).cast("long").alias(c) for c in ("rows_before", "rows_after", "rows_affected")]
    return back.filter("stage = 'filter'").select("source", "operator", "action", *counts)


# -- keys, numbers and lists at the edges ---------------------------------------------


@query
def cmp_tolerance_wide(spark, folder):
    """Counts of near pairs among many distinct numbers, too long for one decimal, under two keys."""
    mapping = {"source_a": "v", "source_b": "w", "method": "tolerance", "tolerance": "50.00000000003"}
    recon = reconcile(
        sides.WIDE_A.frame(spark, folder), sides.WIDE_B.frame(spark, folder), job(("k", "ref"), [mapping])
    )
    return recon.key_cells.select("key", "n_a", "n_b", "pairs", F.col("m0").alias("near"))


@query
def details_null_keys(spark, folder):
    """Rows without a key are compared with nothing, and are no partner that lacks."""
    recon = reconcile(
        sides.NULL_KEYS_A.frame(spark, folder),
        sides.NULL_KEYS_B.frame(spark, folder),
        job(("k", "ref"), [("status", "state")], join_type="outer"),
    )
    return recon.details().select("key", "value_a", "value_b", "diff_type")


@query
def details_empty_side(spark, folder):
    """With no row left on one side nothing is compared, whatever the join."""
    none = {"source_b": [rule("amount", "less_than", -1)]}
    return orders(spark, folder, join_type="outer", filters=none).details().select(*DETAIL)


@query
def unmatched_ordered(spark, folder):
    """Positions of the report's unmatched keys in its order, counted for each source."""
    placed = Report(orders(spark, folder)).positions("unmatched_records").select("source", "key", "position")
    first = placed.groupBy("source").agg(F.min("position").alias("first"))  # two rows
    return placed.join(F.broadcast(first), "source").select("source", "key", (F.col("position") - F.col("first") + 1).alias("position"))


@query
def details_page(spark, folder):
    """Rows 101 to 150 of the report's mismatches in its order."""
    return Report(orders(spark, folder)).page("mismatch_details", 101, 50).select("position", "key", "mapping_idx")


@query
def nrm_array_nested(spark, folder):
    rules = {"column_specific": [{"column": "tags", "array_parse": True}]}
    parsed = _normalized(spark, folder, sides.NESTED, rules)
    return parsed.select("k", F.size("tags").alias("n"), F.array_join("tags", " / ").alias("items"))


@query
def flt_regex_groups(spark, folder):
    """A named group with an underscore that is repeated, and a class with doubled ampersands."""
    rules = [
        FilterRule("name", "matches_regex", r"Customer#0+(?P<last_digit>\d)(?P=last_digit)\d*", "keep"),
        FilterRule("segment", "matches_regex", "[A-Z&&B]+", "keep"),
    ]
    return apply_filters(sides.CUSTOMERS.frame(spark, folder), rules)


# -- sources and sinks ------------------------------------------------------------------


@query
def csv_options(spark, folder):
    """Semicolons, single quotes and a Windows character set."""
    path = scratch(spark) + "/windows"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    name = F.concat(F.lit("€ 'n';"), F.col("lang"))
    lines = docs.select(F.col("doc_id").cast("string").alias("id"), name.alias("naïve"))
    stand_in = lines.withColumn("naïve", F.replace("naïve", F.lit("€"), F.lit("\x80")))  # the byte of the set
    stand_in.write.option("header", True).option("sep", ";").option("quote", "'").option("escape", "'").option(
        "encoding", "ISO-8859-1"
    ).csv(path)
    return read_delimited(spark, path, delimiter=";", quotechar="'", encoding="cp1252").table


@query
def typed_source(spark, folder):
    return as_string_table(spark.read.parquet(f"{folder}/lineitem.parquet"), {"l_discount": 3})


@query
def source_profile(spark, folder):
    return profile(*(spark.read.parquet(f"{folder}/{table}.parquet") for table in ("orders", "events")))


@query
def csv_roundtrip(spark, folder):
    """Documents with quotes, commas and line ends, written as CSV and read back."""
    path = scratch(spark) + "/documents"
    docs = as_string_table(spark.read.parquet(f"{folder}/documents.parquet"))
    docs.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = read_delimited(spark, path, use_columns=["doc_id", "text", "lang", "n_chars"]).table
    return back.select("doc_id", "lang", "n_chars", F.length("text").alias("length"), F.md5("text").alias("digest"))


def _uneven_file(spark: SparkSession, folder: str) -> str:
    """Orders as lines of which some have a field too many and some one too few."""
    path = scratch(spark) + "/uneven"
    line = (
        F.when(F.col("k").cast("int") % 50 == 0, F.concat_ws(",", "k", "status", "price", "odate"))
        .when(F.col("k").cast("int") % 40 == 1, F.concat_ws(",", "k", "status"))
        .otherwise(F.concat_ws(",", "k", "status", "price"))
    )
    lines = sides.ORDERS_A.frame(spark, folder).select(line.alias("k,status,price"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path)
    return path


@query
def csv_bom(spark, folder):
    """Files that begin with a byte order mark, two of them so that both headers carry one."""
    path = scratch(spark) + "/marked"
    line = F.concat_ws(",", "k", "name", "segment")
    lines = sides.CUSTOMERS.frame(spark, folder).select(line.alias("\ufeffk,name,segment"))
    lines.repartition(2, "\ufeffk,name,segment").write.option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path)
    return read_delimited(spark, path).table


@query
def csv_rejects(spark, folder):
    return read_delimited(spark, _uneven_file(spark, folder)).rejects


@query
def csv_short_rows(spark, folder):
    return read_delimited(spark, _uneven_file(spark, folder)).table


@query
def decode_audits(spark, folder):
    """Documents of which some end in a character that was lost in decoding."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lost = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\ufffd"))).otherwise(F.col("text"))
    return decode_audit(as_string_table(docs.withColumn("text", lost)))


@query
def damaged_bytes(spark, folder):
    """Documents in a file, some with a cut character and some with a U+FFFD of their own, which is no damage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "\ufffd").otherwise("."))
    as_bytes = F.decode(F.encode(own, "UTF-8"), "ISO-8859-1")  # a character for each byte
    cut = F.when(F.col("doc_id") % 7 == 0, F.lit("\xe3\x81")).otherwise(F.lit(""))
    path = scratch(spark) + "/damaged"
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer = docs.select("doc_id", F.concat(as_bytes, cut).alias("text"), "source").write.options(**kept)
    writer.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return damaged_cells(spark, path)


@query
def title_forms(spark, folder):
    """Words of the documents behind letters whose title form is not their upper form."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = F.element_at(F.array(F.lit("\u01c6"), F.lit("\xdf"), F.lit("\ufb01"), F.lit("x")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs.select(F.col("doc_id").cast("string").alias("k"), F.concat(first, F.lit("AB"), "lang").alias("word"))
    rules = {"global_cleaning": {"case_normalize": "title"}}
    return normalize(rows, ReconSpec.from_dict(job(("k", "k"), [("k", "k")], rules=rules)))


@query
def report_contents(spark, folder):
    """The two large sections as they stand in the files."""
    path = scratch(spark) + "/contents"
    sections = ("mismatch_details", "unmatched_records")
    Report(orders(spark, folder)).write(path, sections=sections)
    details, alone = (spark.read.option("header", True).csv(f"{path}/{name}") for name in sections)
    details = details.select(
        F.lit(sections[0]).alias("section"), F.col("Key").alias("key"), F.col("Column").alias("c1"),
        F.col("Value A").alias("c2"), F.col("Value B").alias("c3"), F.col("Diff Type").alias("c4"),
    )
    alone = alone.select(F.lit(sections[1]).alias("section"), F.col("Key").alias("key"), F.col("Source").alias("c1"))
    return details.unionByName(alone, allowMissingColumns=True)


@query
def report_sections(spark, folder):
    """The report written as datasets and the rows of each section read back."""
    path = scratch(spark) + "/report"
    report = Report(orders(spark, folder))
    written = report.write(path, sections=("summary", "mismatch_details", "unmatched_records", "per_column_breakdown"))
    parts = [
        spark.read.option("header", True).csv(p).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(p.rsplit("/", 1)[1]).alias("section"), "rows"
        )
        for p in written
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# -- further comparison methods ------------------------------------------------


def customers(spark: SparkSession, folder: str, mapping: dict, rules: dict | None = None) -> Recon:
    return reconcile(
        sides.CUSTOMERS.frame(spark, folder),
        sides.CUSTOMERS_B.frame(spark, folder),
        job(("k", "ref"), [{"source_a": "name", "source_b": "name_b", **mapping}], rules=rules),
    )


@query
def cmp_regex(spark, folder):
    mapping = {"method": "regex", "pattern": r"[#-]0*(\d+)"}
    return customers(spark, folder, mapping).details().select(*DETAIL)


@query
def cmp_segments(spark, folder):
    mapping = {"method": "segments", "lengths": [8, 1, 9]}
    parts = [F.array_join(c, "|").alias(c) for c in ("only_in_a", "only_in_b", "common")]
    return customers(spark, folder, mapping).details().select(*DETAIL, *parts)


@query
def cmp_canonical(spark, folder):
    rules = {"alias_groups": list(PRIORITY_ALIASES)}
    shifted = sides.Side(
        "orders",
        (
            "CAST(o_orderkey AS STRING) AS ref",
            "CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '3-MEDIUM' THEN '5-LOW'"
            " ELSE o_orderpriority END AS urgency",
        ),
    )
    mapping = {"source_a": "priority", "source_b": "urgency", "compare_on": "canonical"}
    recon = reconcile(
        sides.ORDERS_A.frame(spark, folder),
        shifted.frame(spark, folder),
        job(("k", "ref"), [mapping], rules=rules),
    )
    return recon.details().select(*DETAIL)


TOLERANT = {"source_a": "price", "source_b": "amount", "method": "tolerance", "tolerance": "0.5"}


@query
def cmp_tolerance(spark, folder):
    recon = reconcile(
        sides.ORDERS_A.frame(spark, folder),
        sides.ORDERS_B.frame(spark, folder),
        job(("k", "order_ref"), [TOLERANT]),
    )
    return recon.details().select(*DETAIL)


@query
def cmp_tolerance_hot_key(spark, folder):
    """Near numbers under one very frequent key and under many keys with a few rows."""
    mapping = {"source_a": "quantity", "source_b": "quantity_b", "method": "tolerance", "tolerance": "1.5"}
    recon = reconcile(
        sides.HOT_A.frame(spark, folder), sides.HOT_B.frame(spark, folder), job(("k", "ref"), [mapping])
    )
    return recon.per_column()
