"""Pairs of sources made from the test tables.

Each side is a list of select expressions that Spark SQL and ANSI SQL read
alike, so a query and its check SQL start from the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Side:
    table: str
    select: tuple[str, ...]
    where: str | None = None
    extra: "Side | None" = None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{self.table}.parquet")
        if self.where:
            df = df.filter(self.where)
        df = df.selectExpr(*self.select)
        return df.unionAll(self.extra.frame(spark, folder)) if self.extra else df

    @property
    def sql(self) -> str:
        text = f"SELECT {', '.join(self.select)} FROM {self.table}"
        if self.where:
            text += f" WHERE {self.where}"
        return f"{text} UNION ALL {self.extra.sql}" if self.extra else text

    def plus(self, where: str) -> "Side":
        """The side with the rows that satisfy ``where`` a second time."""
        return Side(self.table, self.select, self.where, Side(self.table, self.select, where))


MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS STRING)"

ORDERS_A = Side(
    "orders",
    (
        "CAST(o_orderkey AS STRING) AS k",
        "o_orderstatus AS status",
        "o_orderpriority AS priority",
        MONEY.format("o_totalprice") + " AS price",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS odate",
    ),
)
# Drops a tenth of the keys, renames some, and plants case, value and null differences.
ORDERS_B = Side(
    "orders",
    (
        "CASE WHEN o_orderkey % 97 = 0 THEN concat('X', CAST(o_orderkey AS STRING))"
        " ELSE CAST(o_orderkey AS STRING) END AS order_ref",
        "CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS state",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio",
        MONEY.format("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END")
        + " AS amount",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date",
    ),
    "o_orderkey % 10 <> 3",
)
ORDERS_A_REPEATED = ORDERS_A.plus("o_orderkey % 500 = 0")
ORDERS_B_REPEATED = ORDERS_B.plus("o_orderkey % 1000 = 0")

# Cells with white space, empty and odd texts.
MESSY = Side(
    "orders",
    (
        "CAST(o_orderkey AS STRING) AS k",
        "CASE WHEN o_orderkey % 13 = 0 THEN '   ' WHEN o_orderkey % 11 = 0 THEN NULL"
        " WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('  ', o_orderpriority, ' ') END AS priority",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'nan' WHEN o_orderkey % 19 = 0 THEN 'N/A'"
        " ELSE o_orderstatus END AS status",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'TRUE' WHEN o_orderkey % 3 = 1 THEN 'true'"
        " ELSE 'no' END AS flag",
        "CASE WHEN o_orderkey % 7 = 0 THEN '0.0' WHEN o_orderkey % 7 = 1 THEN '1e3'"
        " WHEN o_orderkey % 7 = 2 THEN 'nan' WHEN o_orderkey % 7 = 3 THEN '1,000'"
        " ELSE " + MONEY.format("o_totalprice") + " END AS amount",
    ),
)

# List cells in three spellings on side A, one on side B.
LISTS_A = Side(
    "lineitem",
    (
        "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',"
        " CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_quantity AS STRING)) AS k",
        "CASE WHEN l_linenumber % 3 = 0 THEN concat('[\"', l_returnflag, '\",\"', l_linestatus, '\"]')"
        " WHEN l_linenumber % 3 = 1 THEN concat('[', l_returnflag, ' , ', l_linestatus, ']')"
        " ELSE concat(l_returnflag, ',,', l_linestatus) END AS tags",
    ),
)
LISTS_B = Side(
    "lineitem",
    (
        LISTS_A.select[0].replace(" AS k", " AS ref"),
        "CASE WHEN l_partkey % 10 = 0 THEN concat(l_linestatus, ',Z')"
        " ELSE concat(l_linestatus, ', ', l_returnflag) END AS keywords",
    ),
)

CUSTOMERS = Side(
    "customer",
    (
        "CAST(c_custkey AS STRING) AS k",
        "CASE WHEN c_custkey % 10 = 0 THEN substr(c_name, 1, 12) ELSE c_name END AS name",
        "c_mktsegment AS segment",
    ),
)
CUSTOMERS_B = Side(
    "customer",
    (
        "CAST(c_custkey AS STRING) AS ref",
        "CASE WHEN c_custkey % 4 = 0 THEN replace(c_name, 'Customer#', 'Client-')"
        " WHEN c_custkey % 4 = 1 THEN concat(substr(c_name, 1, 17), 'X') ELSE c_name END AS name_b",
        "c_mktsegment AS segment_b",
    ),
)

# One key with a third of all rows on both sides.
HOT_A = Side(
    "lineitem",
    (
        "CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey AS STRING) END AS k",
        "l_returnflag AS flag",
        "l_linestatus AS line",
        MONEY.format("l_quantity") + " AS quantity",
    ),
)
HOT_B = Side(
    "lineitem",
    (
        "CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey AS STRING) END AS ref",
        "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_returnflag END AS flag_b",
        "l_linestatus AS line_b",
        MONEY.format("l_quantity") + " AS quantity_b",
    ),
)

# Many numbers of eleven decimals under two keys, some of more than twenty digits.
WIDE_A = Side(
    "lineitem",
    (
        "CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE 'warm' END AS k",
        "concat(CASE WHEN l_partkey % 9 = 0 THEN '900000000000000000000' ELSE '' END,"
        " CAST(l_partkey % 197 AS STRING), '.000000000', CAST(l_suppkey % 7 + 10 AS STRING)) AS v",
    ),
)
WIDE_B = Side(
    "orders",
    (
        "CASE WHEN o_orderkey % 4 = 0 THEN 'hot' ELSE 'warm' END AS ref",
        "concat(CASE WHEN o_custkey % 11 = 0 THEN '900000000000000000000' ELSE '' END,"
        " CAST(o_orderkey % 193 AS STRING), '.000000000', CAST(o_custkey % 7 + 10 AS STRING)) AS w",
    ),
)
# Keys that are null on either side.
NULL_KEYS_A = Side("orders", ("CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey AS STRING) END AS k", "o_orderstatus AS status"))
NULL_KEYS_B = Side(
    "orders",
    ("CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS STRING) END AS ref", "lower(o_orderstatus) AS state"),
)
# JSON lists that hold a list or an object.
NESTED = Side(
    "events",
    (
        "CAST(event_id AS STRING) AS k",
        "concat('[[\"', event_type, '\",\"z\"],{\"u\":', CAST(user_id AS STRING), '},\" ', event_type, '\"]') AS tags",
    ),
)

EVENTS = Side(
    "events",
    ("CAST(user_id AS STRING) AS user_ref", "event_type AS kind"),
)
