"""Expression metrics against Python's own arithmetic."""

import random

import pytest

from counterfoil import SpecError
from counterfoil.operators.derived import FLOAT, INT, Typed, names_in, to_column

VALUES = {"a": 7, "b": -2, "z": 0, "big": 1_000_003, "f": 53.75, "g": -0.5}


def evaluate(spark, expressions):
    df = spark.createDataFrame([tuple(VALUES.values())], "a long, b long, z long, big long, f double, g double")
    known = {n: Typed(df[n], FLOAT if isinstance(v, float) else INT) for n, v in VALUES.items()}
    return list(df.select(*(to_column(e, known) for e in expressions)).first())


def plain(expression):
    try:
        return eval(expression, {"__builtins__": {}}, dict(VALUES))
    except ZeroDivisionError:
        return 0.0


FIXED = [
    "a + b * 3", "a / 2", "a // b", "a % b", "-a // 2", "-a % 2", "f // 3", "f % g", "g % 3", "a ** 2", "a ** b",
    "2 ** 0.5", "a / z", "1 + a // z", "a % z", "z ** -1", "f < 80", "1 < a < 8", "a == 7 != b", "a and b", "z and a",
    "z or f", "not a", "-f", "+a", "~a", "a & 3", "a | 8", "a ^ 2", "a << 3", "a >> 1", "a if f > 50 else b",
    "a / z if z else 5", "5 if a else a / z", "1 if a / z else 2", "(a > 1) + (b > 1)", "True + 1", "big * big",
    "z or a / z", "a or a / z", "'low' if f < 60 else 'high'", "'x' == 'x'", "f == 'x'", "a != 'x'",
    "1.5 + True", "f and 'yes'", "'' or 'no'",
]


def test_fixed_expressions(spark):
    for expression, got in zip(FIXED, evaluate(spark, FIXED)):
        want = plain(expression)
        if isinstance(want, float):
            assert got == pytest.approx(want), expression
        else:
            assert got == want, expression


def random_expression(rnd, depth):
    if depth == 0:
        return rnd.choice([*VALUES, "1", "2", "0", "3.5", "10"])
    x, y = random_expression(rnd, depth - 1), random_expression(rnd, depth - 1)
    kind = rnd.random()
    if kind < 0.6:
        return f"({x} {rnd.choice(['+', '-', '*', '/', '//', '%'])} {y})"
    if kind < 0.75:
        return f"({x} {rnd.choice(['<', '<=', '>', '>=', '==', '!='])} {y})"
    if kind < 0.9:
        return f"({x} if {y} else {random_expression(rnd, depth - 1)})"
    return f"({x} {rnd.choice(['and', 'or'])} {y})"


def test_random_expressions(spark):
    rnd = random.Random(11)
    expressions = [random_expression(rnd, rnd.randint(1, 2)) for _ in range(150)]
    for expression, got in zip(expressions, evaluate(spark, expressions)):
        assert float(got) == pytest.approx(float(plain(expression)), rel=1e-9, abs=1e-9), expression


@pytest.mark.parametrize("bad", [
    "a +", "unknown + 1", "abs(a)", "a.real", "a[0]", "[x for x in a]", "lambda: 1", "(*a,)", "[1, 2]",
    "__import__('os')", "a @ b", "'x' + 1", "'x' < 1", "f & 1", "a is b",
])
def test_refused_expressions(bad):
    from pyspark.sql import functions as F

    known = {n: Typed(F.lit(v), FLOAT if isinstance(v, float) else INT) for n, v in VALUES.items()}
    with pytest.raises(SpecError):
        to_column(bad, known)


def test_names():
    assert names_in("b + a * b if c else 1") == ["a", "b", "c"]
