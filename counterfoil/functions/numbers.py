"""Numbers inside text cells, and the arithmetic of the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, let

# What counts as a number in a cell (fixed patterns).
PLAIN_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
INFINITE = r"(?i)\A[+-]?inf(inity)?\z"


def to_number(c: Column) -> Column:
    """Text as double; null for anything that is not a plain decimal number.

    A bare cast would also take ``1.0d`` or ``nan``, and NaN sorts above every
    number in Spark, so the text is checked first.
    """
    value = F.btrim(c, F.lit(" \t\n\r\f\v")).try_cast("double")
    return F.when(
        c.rlike(PLAIN_NUMBER), F.when(F.abs(value) < F.lit(float("inf")), value)
    ).when(c.rlike(INFINITE), c.try_cast("double"))


# Digits before and after the point that exact numbers may have.
WHOLE_DIGITS, FRACTION_DIGITS = 35, 30
WHOLE, FRACTION = "decimal(38,0)", f"decimal({FRACTION_DIGITS},{FRACTION_DIGITS})"
NUMBER_PARTS = r"\A[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z"


# Most cells hold plain numbers of a moderate size, which one cast reads exactly.
SHORT_DIGITS = 18
SHORT_NUMBER = r"\A[+-]?[0-9]{1,18}(?:\.[0-9]{1,18})?\z"
SHORT = f"decimal({2 * SHORT_DIGITS},{SHORT_DIGITS})"


def number_digits(c: Column) -> Column:
    """A plain number as ``struct<minus, digits, point>`` without outer zeros, else null.

    The value is 0.digits times ten to the power of point; zero has no digits.
    """
    t = F.btrim(c, F.lit(WHITESPACE))
    whole, fraction, power = (F.regexp_extract(t, NUMBER_PARTS, i) for i in (1, 2, 3))
    exponent = F.when(power == "", F.lit(0)).otherwise(power.try_cast("int"))
    every = F.concat(whole, fraction)
    digits = F.ltrim(every, F.lit("0"))
    point = F.length(whole) + exponent - (F.length(every) - F.length(digits))
    digits = F.rtrim(digits, F.lit("0"))
    parts = F.struct(
        (t.startswith("-") & (digits != "")).alias("minus"),
        digits.alias("digits"),
        F.when(digits == "", F.lit(0)).otherwise(point).alias("point"),
    )
    return F.when(c.rlike(PLAIN_NUMBER) & exponent.isNotNull(), parts)


def number_key(c: Column) -> Column:
    """One text per number, however it is written; other texts stay as they are."""

    def written(n: Column) -> Column:
        sign = F.when(n["minus"], F.lit("-")).otherwise(F.lit(""))
        text = F.concat(sign, F.lit("0."), n["digits"], F.lit("e"), n["point"].cast("string"))
        short = (n["point"] <= SHORT_DIGITS) & (F.length(n["digits"]) - n["point"] <= SHORT_DIGITS)
        return F.when(short, text.try_cast(SHORT).cast("string")).otherwise(text)

    # A branch, so that the digits are taken apart only where the cast does not do.
    return F.when(c.rlike(SHORT_NUMBER), c.try_cast(SHORT).cast("string")).otherwise(F.coalesce(let(number_digits(c), written), c))


def exact_number(c: Column) -> Column:
    """A plain number as ``struct<whole, part>`` with whole + part its value and 0 <= part < 1.

    Null for other texts, and for numbers of more than 35 digits before or 30
    after the point; nothing is rounded.
    """

    def split(n: Column) -> Column:
        digits, point = n["digits"], n["point"]
        fits = (point <= WHOLE_DIGITS) & (F.length(digits) - point <= FRACTION_DIGITS)
        before = F.greatest(point, F.lit(0))
        whole = F.rpad(F.substr(digits, F.lit(1), before), before, F.lit("0"))
        zeros = F.repeat(F.lit("0"), F.least(F.greatest(-point, F.lit(0)), F.lit(FRACTION_DIGITS)))
        part = F.concat(F.lit("0."), zeros, F.substr(digits, before + 1), F.lit("0"))
        whole = F.when(whole == "", F.lit("0")).otherwise(whole).try_cast(WHOLE)
        part = part.try_cast(FRACTION)
        below = n["minus"] & (part > 0)
        turned = F.when(below, -whole - 1).when(n["minus"], -whole).otherwise(whole)
        rest = F.when(below, 1 - part).otherwise(part)
        return F.when(fits, F.struct(turned.cast(WHOLE).alias("whole"), rest.cast(FRACTION).alias("part")))

    short = c.try_cast(SHORT)
    parts = F.struct(F.floor(short).cast(WHOLE).alias("whole"), (short - F.floor(short)).cast(FRACTION).alias("part"))
    return F.when(c.rlike(SHORT_NUMBER), parts).otherwise(let(number_digits(c), split))


def shifted(n: Column, distance: str, up: bool) -> Column:
    """An exact number plus or minus a plain number that is not negative."""
    by = exact_number(F.lit(distance))
    part = n["part"] + by["part"] if up else n["part"] - by["part"]
    carry = F.when(part >= 1, F.lit(1)).when(part < 0, F.lit(-1)).otherwise(F.lit(0))
    whole = n["whole"] + by["whole"] if up else n["whole"] - by["whole"]
    return F.struct(
        (whole + carry).cast(WHOLE).alias("whole"), (part - carry).cast(FRACTION).alias("part")
    )


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, 0.0 when the divisor is zero or either side is null."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def round2(x: Column) -> Column:
    """Two decimals, half to even on the exact binary value.

    ``bround`` works on the shortest decimal text, so it sees ties that the
    binary value does not have (1.015 lies below the tie). Near such a text
    tie the double is split into two halves whose products are exact, which
    gives the true side of the tie.
    """
    step = F.bround(x * 200)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    side = (high * 200 - step) + (x - high) * 200
    text_tie = (F.pmod(step, F.lit(2.0)) == 1) & (F.bround(x, 3) == step / 200) & (x == step / 200)
    return (
        F.when(text_tie & (side > 0), (step + 1) / 2 / 100)
        .when(text_tie & (side < 0), (step - 1) / 2 / 100)
        .otherwise(F.bround(x, 2))
    )


def number_text(x: Column) -> Column:
    """A double without exponent where it has one only for its size.

    Spark prints 12345678.5 as ``1.23456785E7``; between 1e-4 and 1e16 the
    digits are written out, outside it keeps the exponent form.
    """
    text = x.cast("string")
    size = F.abs(x)

    def plain(decimal_type: str) -> Column:
        digits = F.rtrim(text.try_cast(decimal_type).cast("string"), F.lit("0"))
        return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    return (
        F.when((size >= 1e7) & (size < 1e16), plain("decimal(38,10)"))
        .when((size >= 1e-4) & (size < 1e-3), plain("decimal(38,24)"))
        .otherwise(text)
    )
