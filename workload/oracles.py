"""For each query the SQL that gives the same rows over the same tables."""

from __future__ import annotations

from . import sides

DETAIL = "key, mapping_idx, \"column\", value_a, value_b, status, diff_type"
ORDER_PAIRS = (("status", "state"), ("priority", "prio"), ("price", "amount"), ("odate", "order_date"))

ORACLES: dict[str, str] = {}


def _filtered(side: sides.Side, condition: str) -> str:
    return f"SELECT * FROM ({side.sql}) WHERE {condition}"


# The number patterns that a filter accepts in a cell.
NUMBER = (
    "CASE WHEN regexp_full_match({c}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')"
    " THEN TRY_CAST({c} AS DOUBLE) END"
)


def number(c: str) -> str:
    return NUMBER.format(c=c)


ORACLES |= {
    "flt_equals_text": _filtered(sides.ORDERS_A, "status <> 'F'"),
    "flt_equals_bool": _filtered(sides.MESSY, "lower(flag) = 'true'"),
    "flt_equals_number": _filtered(sides.MESSY, f"{number('amount')} = 0"),
    "flt_not_equals": _filtered(sides.ORDERS_B, "coalesce(prio, '') <> '1-URGENT'"),
    "flt_in": _filtered(sides.ORDERS_B, "coalesce(prio, '') IN ('1-URGENT', '5-LOW', '')"),
    "flt_not_in": _filtered(sides.ORDERS_B, "coalesce(prio, '') NOT IN ('1-URGENT', '5-LOW')"),
    "flt_greater_than": _filtered(sides.MESSY, f"{number('amount')} > 250000"),
    "flt_less_than": _filtered(sides.MESSY, f"NOT coalesce({number('amount')} < 50000.5, false)"),
    "flt_contains": _filtered(sides.ORDERS_A, "contains(priority, '-H')"),
    "flt_matches_regex": _filtered(sides.CUSTOMERS, "regexp_full_match(name, 'Customer#0+\\d*5')"),
    "flt_is_null": _filtered(sides.MESSY, "trim(coalesce(priority, '')) = ''"),
    "flt_is_not_null": _filtered(sides.MESSY, "trim(coalesce(priority, '')) <> ''"),
    "flt_keep_chain": _filtered(
        sides.ORDERS_A,
        "status IN ('F', 'O') AND CAST(price AS DOUBLE) > 100000 AND NOT contains(priority, 'LOW')",
    ),
    "flt_contains_documents": (
        "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source FROM documents"
        " WHERE contains(text, 'the')"
    ),
    "flt_audit": f"""
        WITH a AS ({sides.ORDERS_A.sql}), b AS ({sides.ORDERS_B.sql}),
        n AS (SELECT count(*) AS n0,
                     count(*) FILTER (status IN ('F', 'O')) AS n1,
                     count(*) FILTER (status IN ('F', 'O') AND CAST(price AS DOUBLE) >= 100000) AS n2,
                     count(*) FILTER (status IN ('F', 'O') AND CAST(price AS DOUBLE) >= 100000
                                      AND priority <> '5-LOW') AS n3 FROM a)
        SELECT 'filter' AS stage, 'source_a' AS source, 0 AS rule_index, 'status' AS "column",
               'in' AS operator, 'keep' AS action, '[''F'', ''O'']' AS value,
               n0 AS rows_before, n1 AS rows_after, n0 - n1 AS rows_affected, 'applied' AS status FROM n
        UNION ALL SELECT 'filter', 'source_a', 1, 'no_such_column', 'equals', 'skip', 'x', n1, n1, 0, 'warning' FROM n
        UNION ALL SELECT 'filter', 'source_a', 2, 'price', 'less_than', 'skip', '100000', n1, n2, n1 - n2, 'applied' FROM n
        UNION ALL SELECT 'filter', 'source_a', 3, 'priority', 'equals', 'skip', '5-LOW', n2, n3, n2 - n3, 'applied' FROM n
        UNION ALL SELECT 'filter', 'source_b', NULL, NULL, NULL, 'no_rules', NULL, count(*), count(*), 0, 'passthrough' FROM b
    """,
}


def _duplicate_row(stage: str, side: str, source: str, action: str, n: int, head: str, tail: str) -> str:
    sample = (
        f"'[' || (SELECT string_agg('''' || k || '''', ', ' ORDER BY k) FROM"
        f" (SELECT k FROM dup_{side} ORDER BY k LIMIT {n})) || ']'"
    )
    return (
        f"SELECT '{stage}' AS stage, '{source}' AS source, CAST(NULL AS INTEGER) AS rule_index,"
        f" CAST(NULL AS VARCHAR) AS \"column\", CAST(NULL AS VARCHAR) AS operator, '{action}' AS action,"
        f" CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS rows_before,"
        f" CAST(NULL AS BIGINT) AS rows_after, CAST(NULL AS BIGINT) AS rows_affected,"
        f" 'warning' AS status, {head} || {sample} || {tail} AS message FROM n_{side} WHERE n > 0"
    )


def _filter_log() -> str:
    a, b = sides.ORDERS_A_REPEATED.sql, sides.ORDERS_B_REPEATED.sql

    def row(side: str, stage: str) -> str:
        if stage == "import":
            head = f"'side {side.upper()} as read: ' || n || ' keys stand on several rows, among them '"
            return _duplicate_row(stage, side, f"source_{side}", "duplicate_keys_warning", 5, head, "''")
        key = "k" if side == "a" else "order_ref"
        head = f"'source_{side}, key {key}: ' || n || ' keys stand on several rows and pair up with every partner, among them '"
        tail = "CASE WHEN n > 20 THEN ' ...' ELSE '' END"
        shown = "fa" if side == "a" else "b"
        return _duplicate_row(stage, shown, f"source_{side}", "duplicate_key_warning", 20, head, tail)

    return f"""
        WITH a AS ({a}), b AS ({b}), fa AS (SELECT * FROM a WHERE status <> 'P'),
        dup_a AS (SELECT k FROM a GROUP BY k HAVING count(*) > 1),
        dup_fa AS (SELECT k FROM fa GROUP BY k HAVING count(*) > 1),
        dup_b AS (SELECT order_ref AS k FROM b GROUP BY order_ref HAVING count(*) > 1),
        n_a AS (SELECT count(*) AS n FROM dup_a), n_fa AS (SELECT count(*) AS n FROM dup_fa),
        n_b AS (SELECT count(*) AS n FROM dup_b),
        c AS (SELECT count(*) AS n0, count(*) FILTER (status <> 'P') AS n1 FROM a)
        {row('a', 'import')} UNION ALL {row('b', 'import')}
        UNION ALL SELECT 'filter', 'source_a', 0, 'status', 'equals', 'skip', 'P', n0, n1, n0 - n1, 'applied', NULL FROM c
        UNION ALL SELECT 'filter', 'source_b', NULL, NULL, NULL, 'no_rules', NULL, count(*), count(*), 0, 'passthrough',
            'nothing to filter in source_b: all ' || count(*) || ' rows pass' FROM b
        UNION ALL {row('a', 'compare')} UNION ALL {row('b', 'compare')}
    """


ORACLES["filter_log"] = _filter_log()

# -- normalisation ------------------------------------------------------------


def _each(side: sides.Side, change: dict[str, str] | str) -> str:
    names = [expression.rsplit(" AS ", 1)[1] for expression in side.select]
    if isinstance(change, str):
        change = {name: change.format(c=name) for name in names}
    kept = ", ".join(f"{change.get(name, name)} AS {name}" for name in names)
    return f"SELECT {kept} FROM ({side.sql})"


FILLED = "CASE WHEN {c} IS NULL OR {c} = 'nan' THEN '' ELSE {c} END"
TITLED = (
    "array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split({c}, ' ')], ' ')"
)
ALIASED = (
    "CASE lower(trim({c})) WHEN '1-urgent' THEN 'top(1-URGENT)' WHEN '2-high' THEN 'top(2-HIGH)'"
    " WHEN '4-not specified' THEN 'rest' WHEN '5-low' THEN 'rest' ELSE {c} END"
)

ORACLES |= {
    "nrm_clean_lower": _each(sides.MESSY, f"lower(trim({FILLED}))"),
    "nrm_clean_upper": _each(sides.MESSY, f"upper(trim({FILLED}))"),
    "nrm_clean_title": (
        f"SELECT CAST(p_partkey AS VARCHAR) AS k, {TITLED.format(c='p_name')} || ' O''Neil X-1B' AS p_name,"
        f" {TITLED.format(c='p_type')} AS p_type FROM part"
    ),
    "nrm_nulls": _each(sides.MESSY, FILLED),
    "nrm_alias": _each(sides.MESSY, ALIASED),
    "nrm_alias_scoped_chain": _each(
        sides.ORDERS_A,
        {
            "status": "CASE lower(trim(status)) WHEN 'f' THEN '<final>' ELSE status END",
            "priority": "CASE WHEN lower(trim(priority)) IN ('1-urgent', '2-high') THEN '<final>'"
            " ELSE priority END",
        },
    ),
    "nrm_alias_many": _each(
        sides.CUSTOMERS,
        {"name": "CASE WHEN regexp_full_match(name, 'Customer#0000\\d{3}00') THEN 'round:' || name ELSE name END"},
    ),
    "nrm_array_parse": f"""
        SELECT k, array_to_string(items, '|') AS tags, CAST(len(items) AS INTEGER) AS n FROM (
          SELECT k, [trim(x) for x in string_split(replace(replace(replace(tags, '[', ''), ']', ''), '"', ''), ',')
                     if trim(x) <> ''] AS items FROM ({sides.LISTS_A.sql}))
    """,
    "nrm_fixed_width": _each(
        sides.CUSTOMERS,
        {
            "name": "CASE WHEN length(name) = 18 THEN substr(name, 1, 8) || '|' || substr(name, 9, 1)"
            " || '|' || substr(name, 10, 9) ELSE name END"
        },
    ),
    "nrm_user_fn": _each(
        sides.CUSTOMERS, {"name": "replace(name, '#', '-')", "segment": "substr(segment, 1, 4)"}
    ),
    "nrm_null_tokens": _each(
        sides.MESSY,
        "CASE WHEN regexp_replace(trim(" + FILLED + "), '\\s+', ' ', 'g') IN ('', 'N/A', 'NULL', 'null')"
        " THEN '<none>' ELSE regexp_replace(trim(" + FILLED + "), '\\s+', ' ', 'g') END",
    ),
}


def _audit() -> str:
    names = [e.rsplit(" AS ", 1)[1] for e in sides.MESSY.select]

    def total(test: str) -> str:
        return " + ".join(f"count(*) FILTER ({test.format(c=n)})" for n in names)

    trimmed = f"trim({FILLED})"
    lowered = f"lower({trimmed})"
    cleaning = " + ".join(
        total(test)
        for test in (
            "{c} IS NULL",
            f"({FILLED}) <> {trimmed}",
            f"{trimmed} <> {lowered}",
        )
    )
    aliases = total(lowered + " IN ('1-urgent', '2-high', '4-not specified', '5-low')")
    flag = lowered.format(c="flag")
    status = lowered.format(c="status")
    head = "'source_a' AS source"
    return f"""
        WITH s AS ({sides.MESSY.sql}), n AS (SELECT {cleaning} AS cleaned, {aliases} AS aliased,
            count(*) FILTER (length({flag}) = 4) AS cut, count(*) FILTER ({status} <> '[]') AS listed FROM s)
        SELECT 0 AS step, {head}, 'global_cleaning' AS action, CAST(NULL AS VARCHAR) AS "column",
               'applied' AS status, CAST(cleaned AS BIGINT) AS cells_transformed FROM n
        UNION ALL SELECT 1, {head}, 'alias_groups', NULL, 'applied', aliased FROM n
        UNION ALL SELECT 2, {head}, 'fixed_length_parse', 'flag', 'applied', cut FROM n
        UNION ALL SELECT 3, {head}, 'column_specific', 'absent', 'warning', NULL FROM n
        UNION ALL SELECT 4, {head}, 'array_parse', 'status', 'applied', listed FROM n
    """


ORACLES["nrm_audit"] = _audit()

# -- keys ------------------------------------------------------------------------


def _with(a: sides.Side, b: sides.Side, key_a: str, key_b: str, clean: str = "{c}") -> str:
    """Both sides with all cells cleaned, as CTEs ``a`` and ``b`` with the key first."""

    def cte(side: sides.Side, key: str) -> str:
        names = [e.rsplit(" AS ", 1)[1] for e in side.select]
        cells = ", ".join(
            f"{clean.format(c=n)} AS {'key' if n == key else n}" for n in names
        )
        return f"SELECT {cells} FROM ({side.sql})"

    return f"WITH a AS ({cte(a, key_a)}), b AS ({cte(b, key_b)})"


ORDERS = _with(sides.ORDERS_A, sides.ORDERS_B, "k", "order_ref")
REPEATED = _with(sides.ORDERS_A_REPEATED, sides.ORDERS_B_REPEATED, "k", "order_ref")
CLEANED = _with(sides.ORDERS_A, sides.ORDERS_B, "k", "order_ref", f"lower(trim({FILLED}))")
STATUS = """, ks AS (SELECT coalesce(x.key, y.key) AS key, x.key IS NOT NULL AS in_a, y.key IS NOT NULL AS in_b
    FROM (SELECT DISTINCT key FROM a WHERE key IS NOT NULL) x
    FULL JOIN (SELECT DISTINCT key FROM b WHERE key IS NOT NULL) y ON x.key = y.key)"""
UNMATCHED = (
    f"{ORDERS} {STATUS} SELECT CASE WHEN in_a THEN 'Source A' ELSE 'Source B' END AS source, key"
    " FROM ks WHERE NOT (in_a AND in_b)"
)

ORACLES |= {
    "key_status": f"{REPEATED} {STATUS} SELECT key, in_a, in_b FROM ks",
    "unmatched": UNMATCHED,
    "unmatched_preview": f"{UNMATCHED} ORDER BY source, key LIMIT 100",
    "dup_keys_raw": f"SELECT user_ref, kind, count(*) AS rows FROM ({sides.EVENTS.sql})"
    " GROUP BY user_ref, kind HAVING count(*) > 1",
    "dup_keys_clean": f"SELECT lower(order_ref) AS order_ref, count(*) AS rows"
    f" FROM ({sides.ORDERS_B_REPEATED.sql}) GROUP BY 1 HAVING count(*) > 1",
}

# -- details -----------------------------------------------------------------------


def _details(ctes: str, pairs=ORDER_PAIRS, how: str = "INNER", equal: str = "{a} = {b}", extra="") -> str:
    """CTE ``d`` with one row per joined row and pair."""
    one = []
    for i, (x, y) in enumerate(pairs):
        xa, yb = f"a.{x}", f"b.{y}"
        same = equal.format(a=xa, b=yb)
        one.append(
            f"SELECT coalesce(a.key, b.key) AS key, {i} AS mapping_idx, '{x} vs {y}' AS \"column\","
            f" {xa} AS value_a, {yb} AS value_b,"
            f" CASE WHEN {xa} IS NULL AND {yb} IS NULL THEN 'exact_match'"
            f" WHEN {xa} IS NULL THEN 'missing_in_a' WHEN {yb} IS NULL THEN 'missing_in_b'"
            f" WHEN {same} THEN 'exact_match' ELSE 'value_diff' END AS diff_type{extra}"
            f" FROM a {how} JOIN b ON a.key = b.key"
        )
    judged = " UNION ALL ".join(one)
    return (
        f"{ctes}, d0 AS ({judged}), d AS (SELECT *, CASE WHEN diff_type = 'exact_match' THEN 'match'"
        " ELSE 'mismatch' END AS status FROM d0)"
    )


D = _details(ORDERS)
D_REPEATED = _details(REPEATED)
ORACLES |= {
    "details_inner": f"{D} SELECT {DETAIL}, value_a AS normalized_a, value_b AS normalized_b FROM d",
    "details_left": f"{_details(ORDERS, how='LEFT')} SELECT {DETAIL} FROM d",
    "details_right": f"{_details(ORDERS, how='RIGHT')} SELECT {DETAIL} FROM d",
    "details_full": f"{_details(ORDERS, how='FULL')} SELECT {DETAIL} FROM d",
    "details_dup_keys": f"{D_REPEATED} SELECT {DETAIL} FROM d",
    "details_collapsed": f"{D_REPEATED} SELECT {DETAIL}, count(*) AS pairs FROM d GROUP BY ALL",
    "mismatches": f"{_details(CLEANED)} SELECT {DETAIL} FROM d WHERE status = 'mismatch'",
    "mismatches_preview": f"{D} SELECT {DETAIL} FROM d WHERE status = 'mismatch'"
    " ORDER BY key, mapping_idx LIMIT 200",
}

LISTS = f"""
    WITH a AS (SELECT k AS key, tags AS va, list_sort(list_distinct([trim(x) for x in string_split(
        replace(replace(replace(tags, '[', ''), ']', ''), '"', ''), ',') if trim(x) <> ''])) AS sa
        FROM ({sides.LISTS_A.sql})),
    b AS (SELECT ref AS key, keywords AS vb, list_sort(list_distinct([trim(x) for x in
        string_split(keywords, ',') if trim(x) <> ''])) AS sb FROM ({sides.LISTS_B.sql}))
"""
ORACLES["details_set"] = f"""
    {LISTS} SELECT a.key, 0 AS mapping_idx, 'tags vs keywords' AS "column", va AS value_a, vb AS value_b,
        CASE WHEN sa = sb THEN 'match' ELSE 'mismatch' END AS status,
        CASE WHEN sa = sb THEN 'exact_match' ELSE 'set_diff' END AS diff_type,
        coalesce(array_to_string([x for x in sa if NOT list_contains(sb, x)], '|'), '') AS only_in_a,
        coalesce(array_to_string([x for x in sb if NOT list_contains(sa, x)], '|'), '') AS only_in_b,
        coalesce(array_to_string([x for x in sa if list_contains(sb, x)], '|'), '') AS common
    FROM a JOIN b ON a.key = b.key
"""

# -- metrics ------------------------------------------------------------------------


def rate(part: str, whole: str, empty: str = "0.0") -> str:
    return (
        f"CASE WHEN {whole} = 0 THEN {empty} ELSE round_even(CAST({part} AS DOUBLE) / {whole} * 100, 2) END"
    )


BY_KEY = """, k0 AS (SELECT key, count(*) FILTER (status = 'mismatch') AS bad, count(*) AS n FROM d GROUP BY key),
    m0 AS (SELECT (SELECT count(*) FROM ks WHERE in_a AND in_b) AS matched,
                  (SELECT count(*) FROM ks WHERE in_a AND NOT in_b) AS only_a,
                  (SELECT count(*) FROM ks WHERE in_b AND NOT in_a) AS only_b,
                  (SELECT count(*) FROM k0) AS compared,
                  (SELECT count(*) FROM k0 WHERE bad = 0) AS full_keys,
                  (SELECT count(*) FROM d WHERE status = 'mismatch') AS bad_cells,
                  (SELECT count(*) FROM d WHERE status = 'match') AS good_cells)"""


def _metrics(ctes: str, how: str, raw_a: sides.Side, raw_b: sides.Side, kept_a: str = "true") -> str:
    return f"""
        {_details(ctes, how=how)} {STATUS} {BY_KEY}
        SELECT (SELECT count(*) FROM ({raw_a.sql})) AS total_rows_a,
               (SELECT count(*) FROM ({raw_b.sql})) AS total_rows_b,
               (SELECT count(*) FILTER ({kept_a}) FROM ({raw_a.sql})) AS rows_filtered_a,
               (SELECT count(*) FROM ({raw_b.sql})) AS rows_filtered_b,
               matched AS matched_keys, only_a AS only_in_a, only_b AS only_in_b,
               full_keys AS full_match_count, bad_cells AS total_mismatches,
               matched AS total_compared_keys, matched - full_keys AS mismatch_count,
               {rate('full_keys', 'matched')} AS match_rate_percent FROM m0
    """


def _summary(ctes: str, how: str, raw_a: sides.Side, raw_b: sides.Side) -> str:
    rows = (
        ("Total Rows (Source A)", f"(SELECT count(*) FROM ({raw_a.sql}))"),
        ("Total Rows (Source B)", f"(SELECT count(*) FROM ({raw_b.sql}))"),
        ("Keys Compared", "compared"),
        ("Fully Matched Keys", "full_keys"),
        ("Keys with Mismatches", "compared - full_keys"),
        ("Only in Source A", "only_a"),
        ("Only in Source B", "only_b"),
        ("Cell-Level Matches", "good_cells"),
        ("Cell-Level Mismatches", "bad_cells"),
        ("Match Rate (%)", rate("full_keys", "compared", "100.0")),
    )
    parts = (
        f"SELECT {i} AS position, '{name}' AS metric, CAST({value} AS VARCHAR) AS value FROM m0"
        for i, (name, value) in enumerate(rows, start=1)
    )
    return f"{_details(ctes, how=how)} {STATUS} {BY_KEY} {' UNION ALL '.join(parts)}"


FILTERED = _with(
    sides.Side(sides.ORDERS_A.table, sides.ORDERS_A.select, "o_orderstatus <> 'P'"),
    sides.ORDERS_B,
    "k",
    "order_ref",
)
BREAKDOWN = (
    "SELECT \"column\", count(*) FILTER (status = 'match') AS matched,"
    " count(*) FILTER (status = 'mismatch') AS mismatched, count(*) AS total_compared, "
    + rate("count(*) FILTER (status = 'match')", "count(*)")
    + " AS match_rate_percent FROM d GROUP BY \"column\""
)
HIGH_RISK = (
    f"{D} SELECT key, count(*) FILTER (status = 'mismatch') AS mismatches FROM d GROUP BY key"
    " HAVING count(*) FILTER (status = 'mismatch') >= 3"
)

ORACLES |= {
    "metrics_core": _metrics(FILTERED, "INNER", sides.ORDERS_A, sides.ORDERS_B, "status <> 'P'"),
    "metrics_left_join": _metrics(REPEATED, "LEFT", sides.ORDERS_A_REPEATED, sides.ORDERS_B_REPEATED),
    "summary": _summary(ORDERS, "INNER", sides.ORDERS_A, sides.ORDERS_B),
    "summary_full_join": _summary(REPEATED, "FULL", sides.ORDERS_A_REPEATED, sides.ORDERS_B_REPEATED),
    "per_column": f"{_details(CLEANED)} {BREAKDOWN}",
    "mismatch_by_column": f"{D} SELECT \"column\", count(*) AS mismatches FROM d"
    " WHERE status = 'mismatch' GROUP BY \"column\"",
    "high_risk": HIGH_RISK,
    "rate_bands": f"{D}, r AS ({BREAKDOWN}) SELECT *, CASE WHEN match_rate_percent >= 90 THEN 'high'"
    " WHEN match_rate_percent >= 70 THEN 'medium' ELSE 'low' END AS band FROM r",
    "metrics_derived": f"""
        {D} {STATUS} {BY_KEY}, r AS (SELECT *, {rate('full_keys', 'matched')} AS rate,
            CAST(full_keys * 100 AS DOUBLE) / (SELECT count(*) FROM a) AS efficiency FROM m0)
        SELECT matched AS matched_keys, efficiency, rate < 80 AS alert, 0.0::DOUBLE AS by_zero,
               CAST(bad_cells // 7 AS BIGINT) AS whole, CAST((7 - bad_cells % 7) % 7 AS BIGINT) AS rest,
               CAST(CASE WHEN rate >= 90 THEN 1 WHEN efficiency > 50 THEN 2 ELSE 3 END AS BIGINT) AS grade FROM r
    """,
    "metrics_user": f"""
        {D} {STATUS}, m AS (SELECT count(*) FILTER (diff_type LIKE 'missing%') AS missing,
            count(*) FILTER (status = 'mismatch') AS bad FROM d)
        SELECT round_even(100 * missing / CAST(bad AS DOUBLE), 2) AS missing_share,
               (SELECT CAST(max(length(key)) AS INTEGER) FROM ks) AS longest_key,
               (SELECT count(DISTINCT status) FROM a) AS statuses, missing AS missing_cells FROM m
    """,
}


def _hot(pairs, near: str | None = None) -> str:
    """Agreeing pairs per column from counts of values, since the pairs are too many."""
    parts = []
    for x, y in pairs:
        agree = near or "x.v IS NOT DISTINCT FROM y.v"
        parts.append(
            f"SELECT '{x} vs {y}' AS \"column\", (SELECT sum(x.n * y.n) FROM"
            f" (SELECT k, {x} AS v, count(*) AS n FROM a GROUP BY ALL) x JOIN"
            f" (SELECT ref, {y} AS v, count(*) AS n FROM b GROUP BY ALL) y"
            f" ON x.k = y.ref AND {agree}) AS matched"
        )
    return f"""
        WITH a AS ({sides.HOT_A.sql}), b AS ({sides.HOT_B.sql}),
        t AS (SELECT sum(x.n * y.n) AS n FROM (SELECT k, count(*) AS n FROM a GROUP BY k) x
              JOIN (SELECT ref, count(*) AS n FROM b GROUP BY ref) y ON x.k = y.ref),
        p AS ({' UNION ALL '.join(parts)})
        SELECT "column", CAST(matched AS BIGINT) AS matched, CAST(n - matched AS BIGINT) AS mismatched,
               CAST(n AS BIGINT) AS total_compared, {rate('matched', 'n')} AS match_rate_percent FROM p, t
    """


ORACLES |= {
    "per_column_hot_key": _hot((("flag", "flag_b"), ("line", "line_b"), ("quantity", "quantity_b"))),
    "cmp_tolerance_hot_key": _hot(
        (("quantity", "quantity_b"),),
        "abs(CAST(x.v AS DECIMAL(18,2)) - CAST(y.v AS DECIMAL(18,2))) <= 1.5",
    ),
}

# -- sources and sinks -----------------------------------------------------------------

ORACLES |= {
    "csv_roundtrip": """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars,
               CAST(length(nullif(text, '')) AS INTEGER) AS length, md5(nullif(text, '')) AS digest FROM documents
    """,
    "csv_rejects": f"SELECT concat_ws(',', k, status, price, odate) AS record FROM ({sides.ORDERS_A.sql})"
    " WHERE CAST(k AS INTEGER) % 50 = 0",
    "csv_short_rows": f"SELECT k, status, CASE WHEN CAST(k AS INTEGER) % 40 = 1 THEN NULL ELSE price END AS price"
    f" FROM ({sides.ORDERS_A.sql}) WHERE CAST(k AS INTEGER) % 50 <> 0",
    "decode_audits": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (contains(CAST({c} AS VARCHAR), chr(65533))"
        f" OR ('{c}' = 'text' AND doc_id % 7 = 0)) AS damaged_cells FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
    "damaged_bytes": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ('{c}' = 'text' AND doc_id % 7 = 0) AS damaged_cells FROM documents"
        for c in ("doc_id", "text", "source")
    ),
    "title_forms": """
        SELECT CAST(doc_id AS VARCHAR) AS k,
               ['\u01c5', 'Ss', 'Fi', 'X'][doc_id % 4 + 1] || 'ab' || lower(lang) AS word FROM documents
    """,
    "report_sections": f"""
        {D} {STATUS} SELECT 'summary' AS section, CAST(10 AS BIGINT) AS rows
        UNION ALL SELECT 'mismatch_details', count(*) FROM d WHERE status = 'mismatch'
        UNION ALL SELECT 'unmatched_records', count(*) FROM ks WHERE NOT (in_a AND in_b)
        UNION ALL SELECT 'per_column_breakdown', count(DISTINCT "column") FROM d
    """,
}
ORACLES["report_contents"] = f"""
    {D} {STATUS} SELECT 'mismatch_details' AS section, key, "column" AS c1, value_a AS c2, value_b AS c3, diff_type AS c4
        FROM d WHERE status = 'mismatch'
    UNION ALL SELECT 'unmatched_records', key, CASE WHEN in_a THEN 'Source A' ELSE 'Source B' END, NULL, NULL, NULL
        FROM ks WHERE NOT (in_a AND in_b)
"""

# -- further comparison methods -------------------------------------------------

NAMES = _with(sides.CUSTOMERS, sides.CUSTOMERS_B, "k", "ref")
NAME_PAIR = (("name", "name_b"),)
DIGITS = "regexp_extract({c}, '[#-]0*(\\d+)', 1)"
PIECES = "[substr({c}, 1, 8), substr({c}, 9, 1), substr({c}, 10, 9)]"


def _piece_columns() -> str:
    a, b = PIECES.format(c="value_a"), PIECES.format(c="value_b")
    keep = "array_to_string([{side}[i] for i in [1, 2, 3] if {test}], '|')"
    columns = (
        ("only_in_a", a, f"({a})[i] <> ({b})[i]"),
        ("only_in_b", b, f"({a})[i] <> ({b})[i]"),
        ("common", a, f"({a})[i] = ({b})[i]"),
    )
    return ", ".join(
        f"coalesce({keep.format(side=f'({side})', test=test)}, '') AS {name}" for name, side, test in columns
    )


CANONICAL_B = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH'"
    " WHEN '3-MEDIUM' THEN '5-LOW' ELSE o_orderpriority END AS urgency FROM orders"
)
CANON = (
    "CASE lower({c}) WHEN '1-urgent' THEN 'top' WHEN '2-high' THEN 'top'"
    " WHEN '4-not specified' THEN 'rest' WHEN '5-low' THEN 'rest' ELSE {c} END"
)
ORACLES |= {
    "cmp_regex": _details(NAMES, NAME_PAIR, equal=f"{DIGITS.format(c='{a}')} = {DIGITS.format(c='{b}')}")
    + f" SELECT {DETAIL} FROM d",
    "cmp_segments": f"{_details(NAMES, NAME_PAIR)} SELECT {DETAIL}, {_piece_columns()} FROM d",
    "cmp_canonical": f"""
        WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS priority FROM orders),
        b AS ({CANONICAL_B}), j AS (SELECT a.key, priority, urgency,
            {CANON.format(c='priority')} = {CANON.format(c='urgency')} AS same FROM a JOIN b ON a.key = b.key)
        SELECT key, 0 AS mapping_idx, 'priority vs urgency' AS "column", {ALIASED.format(c='priority')} AS value_a,
               {ALIASED.format(c='urgency')} AS value_b, CASE WHEN same THEN 'match' ELSE 'mismatch' END AS status,
               CASE WHEN same THEN 'exact_match' ELSE 'value_diff' END AS diff_type FROM j
    """,
    "cmp_tolerance": _details(
        ORDERS,
        (("price", "amount"),),
        equal="abs(CAST({a} AS DECIMAL(18,2)) - CAST({b} AS DECIMAL(18,2))) <= 0.5",
    )
    + f" SELECT {DETAIL} FROM d",
}

# -- keys, numbers and lists at the edges ------------------------------------------

LINEITEM_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate"))
ORACLES |= {
    "typed_source": f"""
        SELECT {LINEITEM_TEXT}, CAST(CAST(l_discount AS DECIMAL(18,3)) AS VARCHAR) AS l_discount,
               l_returnflag, l_linestatus FROM lineitem
    """,
    "source_profile": """
        SELECT 'source_a' AS source, (SELECT count(*) FROM orders) AS rows,
               (SELECT count(*) FROM (DESCRIBE orders)) AS columns
        UNION ALL SELECT 'source_b', (SELECT count(*) FROM events), (SELECT count(*) FROM (DESCRIBE events))
    """,
    "cmp_tolerance_wide": f"""
        WITH a AS (SELECT k, CAST(v AS DECIMAL(38,11)) AS v, count(*) AS n FROM ({sides.WIDE_A.sql}) GROUP BY ALL),
        b AS (SELECT ref, CAST(w AS DECIMAL(38,11)) AS w, count(*) AS n FROM ({sides.WIDE_B.sql}) GROUP BY ALL),
        na AS (SELECT k, sum(n) AS n FROM a GROUP BY k), nb AS (SELECT ref, sum(n) AS n FROM b GROUP BY ref),
        p AS (SELECT k, sum(a.n * b.n) AS near FROM a JOIN b ON k = ref AND v - w <= 50.00000000003
              AND w - v <= 50.00000000003 GROUP BY k)
        SELECT na.k AS key, CAST(na.n AS BIGINT) AS n_a, CAST(nb.n AS BIGINT) AS n_b,
               CAST(na.n * nb.n AS BIGINT) AS pairs, CAST(coalesce(near, 0) AS BIGINT) AS near
        FROM na JOIN nb ON na.k = nb.ref LEFT JOIN p ON p.k = na.k
    """,
    "details_null_keys": f"""
        WITH a AS (SELECT * FROM ({sides.NULL_KEYS_A.sql}) WHERE k IS NOT NULL),
        b AS (SELECT * FROM ({sides.NULL_KEYS_B.sql}) WHERE ref IS NOT NULL)
        SELECT coalesce(k, ref) AS key, status AS value_a, state AS value_b,
               CASE WHEN status IS NOT DISTINCT FROM state THEN 'exact_match' WHEN status IS NULL THEN 'missing_in_a'
                    WHEN state IS NULL THEN 'missing_in_b' ELSE 'value_diff' END AS diff_type
        FROM a FULL JOIN b ON k = ref
    """,
    "details_empty_side": f"{_details(ORDERS, ORDER_PAIRS)} SELECT {DETAIL} FROM d WHERE value_a = 'no such cell'",
    "unmatched_ordered": f"""
        SELECT source, key, CAST(row_number() OVER (PARTITION BY source ORDER BY key) AS INTEGER) AS position
        FROM ({UNMATCHED})
    """,
    "nrm_array_nested": """
        SELECT CAST(event_id AS VARCHAR) AS k, 3 AS n,
               '["' || event_type || '","z"] / {"u":' || CAST(user_id AS VARCHAR) || '} / ' || event_type AS items FROM events
    """,
    "flt_regex_groups": f"""
        SELECT * FROM ({sides.CUSTOMERS.sql}) WHERE regexp_matches(segment, '^[AB-Z&]+$')
          AND list_contains(list_transform(range(10), lambda d: regexp_matches(name, '^Customer#0+' || d || d || '[0-9]*$')), true)
    """,
    "csv_options": "SELECT CAST(doc_id AS VARCHAR) AS id, '€ ''n'';' || lang AS \"naïve\" FROM documents",
}

# -- whole-column normalisers and judged cells by counts -----------------------------------

ORACLES |= {
    "nrm_fitted": f"""
        WITH b AS ({sides.ORDERS_B.sql}),
        most AS (SELECT prio FROM b WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)
        SELECT order_ref, state, coalesce(prio, (SELECT prio FROM most)) AS prio, amount, order_date FROM b
    """,
    "metrics_user_hot": f"""
        WITH a AS ({sides.HOT_A.sql}), b AS ({sides.HOT_B.sql}),
        cells_a AS (SELECT k, i, v, count(*) AS n FROM (SELECT k, 0 AS i, flag AS v FROM a UNION ALL SELECT k, 1, quantity FROM a) GROUP BY ALL),
        cells_b AS (SELECT ref, i, v, count(*) AS n FROM (SELECT ref, 0 AS i, flag_b AS v FROM b UNION ALL SELECT ref, 1, quantity_b FROM b) GROUP BY ALL),
        judged AS (SELECT x.i, CASE WHEN x.v IS NOT DISTINCT FROM y.v THEN 'same' WHEN x.v IS NULL OR y.v IS NULL THEN 'missing' ELSE 'other' END AS kind,
                          sum(x.n * y.n) AS n FROM cells_a x JOIN cells_b y ON x.k = y.ref AND x.i = y.i GROUP BY ALL),
        s AS (SELECT sum(n) FILTER (kind = 'missing') AS missing, sum(n) FILTER (kind = 'other') AS other, count(*) AS kinds FROM judged)
        SELECT CAST(missing AS BIGINT) AS missing_cells, CAST(other AS BIGINT) AS other_cells, kinds,
               round_even(100 * missing / CAST(missing + other AS DOUBLE), 2) AS missing_share FROM s
    """,
}

# -- operators that only tests reached before ------------------------------------------------

ORACLES |= {
    "details_page": f"""
        {D} {STATUS}, bad AS (SELECT key, mapping_idx, row_number() OVER (ORDER BY key, mapping_idx) AS position
                              FROM d WHERE status = 'mismatch')
        SELECT CAST(position AS BIGINT) AS position, key, mapping_idx FROM bad WHERE position BETWEEN 101 AND 150
    """,
    "csv_bom": sides.CUSTOMERS.sql,
    "nrm_elementwise": _each(sides.CUSTOMERS, {"name": "reverse(name)"}),
    "metrics_object": f"""
        {D} {STATUS} {BY_KEY} SELECT round_even(bad_cells / CAST(matched AS DOUBLE), 3) AS mismatches_per_key,
                                     matched AS matched_keys FROM m0
    """,
    "missing_mapping": f"""
        WITH a AS ({sides.ORDERS_A.sql}), b AS ({sides.ORDERS_B.sql}), j AS (SELECT * FROM a JOIN b ON k = order_ref),
        c AS (SELECT 'status vs state' AS "column", status IS NOT DISTINCT FROM state AS same FROM j
              UNION ALL SELECT 'odate vs order_date', odate IS NOT DISTINCT FROM order_date FROM j)
        SELECT "column", count(*) FILTER (same) AS matched, count(*) FILTER (NOT same) AS mismatched, NULL AS told FROM c GROUP BY "column"
        UNION ALL SELECT 'no_such_column', NULL, NULL, 'column_missing b'
    """,
    "filter_log_written": f"""
        WITH a AS ({sides.ORDERS_A.sql})
        SELECT 'source_a' AS source, 'equals' AS operator, 'skip' AS action, count(*) AS rows_before,
               count(*) FILTER (status <> 'P') AS rows_after, count(*) FILTER (status = 'P') AS rows_affected FROM a
        UNION ALL SELECT 'source_b', NULL, 'no_rules', count(*), count(*), 0 FROM ({sides.ORDERS_B.sql})
    """,
}
