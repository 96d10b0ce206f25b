"""Tolerances on numbers of any size, against exact arithmetic."""

import random
from decimal import Decimal, InvalidOperation, getcontext

import pytest
from pyspark.sql import functions as F

from counterfoil import reconcile
from counterfoil.operators import cells
from counterfoil.functions.numbers import exact_number, number_key
from counterfoil.operators.compare import close

getcontext().prec = 200

NUMBERS = [
    "0", "-0", "+0.0", "1", "1.", ".5", "-.5", "1e19", "10000000000000000000", "1E-3", "0.001", "-12.50", "-12.5e0",
    "1.00000000001", "1.00000000004", "1000000000000000000.0", "99999999999999999999999999999999999", "9e34", "1e35",
    "123456789012345678901234567890123456", "1e-30", "1e-31", " 7 ", "007", "1e400", "-1e-400", "0e99",
]
TEXTS = ["", "x", "1,5", "1e", "--1", None]


def value(text):
    try:
        return Decimal(text.strip()) if text and text.strip().replace("_", "x") == text.strip() else None
    except InvalidOperation:
        return None


def fits(number):
    sign, digits, power = number.normalize().as_tuple()
    return number == 0 or (len(digits) + power <= 35 and -power <= 30)


def test_exact_numbers(apply):
    got = apply(exact_number, NUMBERS + TEXTS)
    for text, parts in zip(NUMBERS + TEXTS, got):
        number = value(text)
        if number is None or not fits(number):
            assert parts is None, text
        else:
            assert parts.whole + parts.part == number and 0 <= parts.part < 1, text


def test_number_keys_are_equal_for_equal_numbers_only(apply):
    keys = apply(number_key, NUMBERS + TEXTS)
    for x, key_x in zip(NUMBERS + TEXTS, keys):
        for y, key_y in zip(NUMBERS + TEXTS, keys):
            a, b = value(x), value(y)
            assert (key_x == key_y) == (x == y if a is None or b is None else a == b), (x, y)


@pytest.mark.parametrize("tolerance", ["0", "1", "0.00000000003", "0.5", "10000000000000000000000000"])
def test_closeness(spark, tolerance):
    cells = NUMBERS + TEXTS
    df = spark.createDataFrame([(x, y) for x in cells for y in cells], "a string, b string")
    for row in df.select("a", "b", close(F.col("a"), F.col("b"), tolerance).alias("near")).collect():
        x, y = value(row.a), value(row.b)
        want = row.a == row.b
        if x is not None and y is not None:
            want = x == y or (fits(x) and fits(y) and abs(x - y) <= Decimal(tolerance))
        assert row.near == want, row


@pytest.mark.parametrize("few", [0, 64, 1 << 20])
def test_near_pairs_of_a_key_are_counted_exactly(spark, table, monkeypatch, few):
    """Once by running sums alone, once both ways, once in grouped rows alone."""
    monkeypatch.setattr(cells, "FEW_NUMBERS", few)
    draw = random.Random(4)
    number = lambda: f"{draw.randint(-40, 40)}.{draw.randint(0, 99999999999):011d}"
    a = [("k", number()) for _ in range(300)] + [("j", "1"), ("j", "1.0"), ("j", "x"), ("j", None)]
    b = [("k", number()) for _ in range(200)] + [("j", "1.5"), ("j", "x"), ("j", "1e40"), ("j", "10e39")]
    a += [("j", "1e40")]
    job = {"schema_version": "1.0", "compare": {"key_columns": ["k"], "column_mappings": [
        {"source_a": "v", "source_b": "v", "method": "tolerance", "tolerance": "10.00000000003"}]}}
    with reconcile(table("k v", a), table("k v", b), job) as recon:
        got = {r.key: r.m0 for r in recon.key_cells.collect()}
    def near(x, y):
        p, q = value(x), value(y)
        if p is None or q is None:
            return x == y
        return p == q or (fits(p) and fits(q) and abs(p - q) <= Decimal("10.00000000003"))
    want = {k: sum(near(x, y) for i, x in a if i == k for j, y in b if j == k) for k in "jk"}
    assert got == want
