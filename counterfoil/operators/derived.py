"""Metrics written as expressions over other metrics.

The text is a Python expression; Python's own parser reads it and an allow-list
of node types is turned into one Column over the one-row metrics table. Nothing
is evaluated, and the text never reaches Spark's SQL parser.

Null stands for a division by zero while an expression is built: it runs through
every operation that would have failed, and the finished expression shows it as
zero. A branch that is not taken does not count.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError

INT, FLOAT, BOOL, TEXT = "int", "float", "bool", "text"
ZERO = {INT: 0, FLOAT: 0.0, BOOL: False, TEXT: "0.0"}
SQL_TYPE = {INT: "bigint", FLOAT: "double", BOOL: "boolean", TEXT: "string"}
COMPARISONS = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
BITWISE = {
    ast.BitAnd: lambda a, b: a.bitwiseAND(b),
    ast.BitOr: lambda a, b: a.bitwiseOR(b),
    ast.BitXor: lambda a, b: a.bitwiseXOR(b),
    ast.LShift: lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    ast.RShift: lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}


@dataclass(frozen=True)
class Typed:
    """A column and the Python type that its value would have."""

    column: Column
    kind: str

    def to(self, kind: str) -> Column:
        return self.column if kind == self.kind else self.column.cast(SQL_TYPE[kind])

    @property
    def truth(self) -> Column:
        if self.kind == BOOL:
            return self.column
        return self.column != F.lit("") if self.kind == TEXT else self.column != F.lit(0)


def kind_of(data_type: T.DataType) -> str | None:
    """The kind of a scalar metric; null for lists and tables."""
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.IntegralType, T.DecimalType)):
        return INT
    if isinstance(data_type, T.FractionalType):
        return FLOAT
    return TEXT if isinstance(data_type, T.StringType) else None


def parse(expression: str) -> ast.expr:
    try:
        return ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as exc:
        raise SpecError(f"invalid expression {expression!r}") from exc


def names_in(expression: str) -> list[str]:
    """Metric names that the expression refers to."""
    nodes = ast.walk(parse(expression))
    return sorted({node.id for node in nodes if isinstance(node, ast.Name)})


def to_column(expression: str, known: Mapping[str, Typed]) -> Column:
    """The expression as a Column, with zero where something is divided by zero."""
    result = _Translator(expression, known).value(parse(expression))
    return F.coalesce(result.column, F.lit(ZERO[result.kind]))


class _Translator:
    def __init__(self, expression: str, known: Mapping[str, Typed]) -> None:
        self.expression = expression
        self.known = known

    def fail(self, what: str) -> SpecError:
        return SpecError(f"{what} in expression {self.expression!r}")

    def value(self, node: ast.expr) -> Typed:
        match node:
            case ast.Constant(value=bool() as v):
                return Typed(F.lit(v), BOOL)
            case ast.Constant(value=int() as v):
                return Typed(F.lit(v).cast("bigint"), INT)
            case ast.Constant(value=float() as v):
                return Typed(F.lit(v), FLOAT)
            case ast.Constant(value=str() as v):
                return Typed(F.lit(v), TEXT)
            case ast.Name(id=name):
                if name not in self.known:
                    raise self.fail(f"unknown metric {name!r}")
                return self.known[name]
            case ast.UnaryOp(op=ast.Not(), operand=operand):
                return Typed(~self.value(operand).truth, BOOL)
            case ast.UnaryOp(op=op, operand=operand):
                return self.signed(op, self.number(operand))
            case ast.BinOp(left=left, op=op, right=right):
                return self.arithmetic(op, left, right)
            case ast.Compare(left=left, ops=ops, comparators=others):
                return self.comparison(left, ops, others)
            case ast.BoolOp(op=op, values=values):
                return self.boolean(op, [self.value(v) for v in values])
            case ast.IfExp(test=test, body=body, orelse=orelse):
                return self.choice(self.value(test).truth, self.value(body), self.value(orelse))
        raise self.fail(f"{type(node).__name__} is not allowed")

    def number(self, node: ast.expr) -> Typed:
        value = self.value(node)
        if value.kind == TEXT:
            raise self.fail("arithmetic on text")
        return Typed(value.to(INT), INT) if value.kind == BOOL else value

    def signed(self, op: ast.unaryop, value: Typed) -> Typed:
        if isinstance(op, ast.USub):
            return Typed(-value.column, value.kind)
        if isinstance(op, ast.Invert) and value.kind == INT:
            return Typed(F.bitwise_not(value.column), INT)
        return value

    def arithmetic(self, op: ast.operator, left: ast.expr, right: ast.expr) -> Typed:
        a, b = self.number(left), self.number(right)
        kind = FLOAT if FLOAT in (a.kind, b.kind) else INT
        x, y = a.to(kind), b.to(kind)
        if type(op) in BITWISE:
            if kind != INT:
                raise self.fail("bit operation on a fraction")
            return Typed(BITWISE[type(op)](x, y), INT)
        match op:
            case ast.Add():
                return Typed(x + y, kind)
            case ast.Sub():
                return Typed(x - y, kind)
            case ast.Mult():
                return Typed(x * y, kind)
            case ast.Div():
                return Typed(F.try_divide(a.to(FLOAT), b.to(FLOAT)), FLOAT)
            case ast.Mod():
                return Typed(_modulo(x, y), kind)
            case ast.FloorDiv():
                whole = x - _modulo(x, y)
                if kind == INT:
                    quotient = F.when(y != 0, F.call_function("div", whole, y))
                else:
                    quotient = F.round(F.try_divide(whole, y))
                return Typed(quotient, kind)
            case ast.Pow():
                return self.power(a, b, right)
        raise self.fail(f"{type(op).__name__} is not allowed")

    def power(self, a: Typed, b: Typed, exponent: ast.expr) -> Typed:
        base, to = a.to(FLOAT), b.to(FLOAT)
        result = F.when((base != 0) | (to >= 0), F.pow(base, to))
        whole = isinstance(exponent, ast.Constant) and isinstance(exponent.value, int)
        if a.kind == INT and whole:
            return Typed(result.cast("bigint"), INT)
        return Typed(result, FLOAT)

    def comparison(self, left: ast.expr, ops: list, others: list[ast.expr]) -> Typed:
        values = [self.value(node) for node in (left, *others)]
        tests = []
        for op, a, b in zip(ops, values, values[1:]):
            if type(op) not in COMPARISONS:
                raise self.fail(f"{type(op).__name__} is not allowed")
            if (a.kind == TEXT) != (b.kind == TEXT):
                if not isinstance(op, (ast.Eq, ast.NotEq)):
                    raise self.fail("order of text and number")
                tests.append(Typed(F.lit(isinstance(op, ast.NotEq)), BOOL))
                continue
            kind = self.common(a, b)
            tests.append(Typed(COMPARISONS[type(op)](a.to(kind), b.to(kind)), BOOL))
        return self.boolean(ast.And(), tests)

    def boolean(self, op: ast.boolop, values: list[Typed]) -> Typed:
        """The first operand that decides, as in Python, not just true or false."""
        result = values[-1]
        for value in reversed(values[:-1]):
            if isinstance(op, ast.And):
                result = self.choice(value.truth, result, value)
            else:
                result = self.choice(value.truth, value, result)
        return result

    def choice(self, test: Column, yes: Typed, no: Typed) -> Typed:
        kind = self.common(yes, no)
        return Typed(F.when(test, yes.to(kind)).when(~test, no.to(kind)), kind)

    def common(self, a: Typed, b: Typed) -> str:
        kinds = {a.kind, b.kind}
        if len(kinds) == 1:
            return a.kind
        return TEXT if TEXT in kinds else FLOAT if FLOAT in kinds else INT


def _modulo(x: Column, y: Column) -> Column:
    """Remainder with the sign of the divisor; null for divisor zero."""
    rest = F.try_mod(x, y)
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)
