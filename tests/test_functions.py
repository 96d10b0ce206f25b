"""Column functions against short plain definitions, on fixed and random cells."""

import json
import math
import random
import re
import unicodedata
import warnings

import pandas as pd
import pytest

from counterfoil.errors import SpecError
from counterfoil.functions import (
    blank,
    collapse_spaces,
    fixed_width,
    java_pattern,
    list_text,
    number_text,
    parse_array,
    round2,
    safe_divide,
    set_text,
    strip,
    title_case,
    to_number,
)

ATOMS = ["[", "]", '"', ",", " ", "a", "b", "'", "\\n", "\\", "true", "null", "1", "-0", "1.50", "2e1",
         "NaN", "-Infinity", '"a"', '"b c"', "\x01", "\\u00e9", "é", "01", "v", "12345678.5", "\t", "{",
         '"x\\"y"', " "]


def random_cells(n, seed):
    rnd = random.Random(seed)
    free = ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 7))) for _ in range(n)]
    listed = ["[%s]" % ",".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 4))) for _ in range(n)]
    return [None, "", "  ", *free, *listed]


def plain_list(cell):
    text = (cell or "").strip()
    if text.startswith("["):
        try:
            return [str(x).strip() for x in json.loads(text) if str(x).strip()]
        except ValueError:
            if text.endswith("]"):
                text = text[1:-1]
    return [part.strip() for part in text.split(",") if part.strip()]


def test_parse_array_on_random_cells(apply):
    cells = random_cells(800, 5)
    assert apply(parse_array, cells) == [plain_list(c) for c in cells]


@pytest.mark.parametrize(
    "cell, items",
    [
        ('["a"," b ",1,true,null]', ["a", "b", "1", "True", "None"]),
        ("[a, b]", ["a", "b"]),
        ('["a"', ['["a"']),
        ("a, b,,", ["a", "b"]),
        ('["a"] x]', ['"a"] x']),
        ("[]", []),
        ("[1.50, 2e1]", ["1.5", "20.0"]),
    ],
)
def test_parse_array_fixed(apply, cell, items):
    assert apply(parse_array, [cell]) == [items]


def test_parse_array_of_very_long_cells(apply):
    many = "[" + ",".join(['"ab"'] * 30000) + "]"
    escaped = '["' + "a\\n" * 30000 + '"]'
    assert [len(x) for x in apply(parse_array, [many, escaped])] == [30000, 1]


def test_list_text_prints_like_a_list(apply):
    lists = [["a"], [], ["it's"], ['"', "'"], ["a\\b", "c\nd", "x y"], ["'\""]]
    assert apply(list_text, lists, "array<string>") == [str(x) for x in lists]


def test_set_text_ignores_order_and_repeats(apply):
    assert apply(set_text, [["b", "a", "a"], [], None], "array<string>") == ['["a","b"]', "[]", None]


def test_strip_takes_all_unicode_space(apply):
    cells = [f"{w}x y{w}" for w in "\t 　\u001c  \x85"] + [None, ""]
    assert apply(strip, cells) == [c.strip() if c else c for c in cells]
    assert apply(blank, ["  ", " ", None, "", "x"]) == [True, True, True, True, False]
    assert apply(collapse_spaces, ["a  b \tc", "x"]) == ["a b c", "x"]


def test_title_case(apply):
    cells = ["o'neil heavy-duty a1b2 x_y", "ÉCOLE d'été", "", None, "日本 tōkyō"] + random_cells(200, 8)
    assert apply(title_case, cells) == [c.title() if c else c for c in cells]


def test_title_case_of_all_letters(apply):
    # Spark, Java and Python know different editions of Unicode: letters of an old one, but two that got an upper form lately.
    old = unicodedata.ucd_3_2_0.category
    letters = [chr(c) for c in range(0x11000) if old(chr(c)) not in ("Cn", "Cs") and c not in (0x19B, 0x264)]
    cells = [f"{c}b {c}{c} 1{c}" for c in letters] + ["ΟΔΟΣ ΑΣ Σ ΣΣ", "ǅ ǆA ßa ﬁX აბ"]
    differ = [c for c, got in zip(cells, apply(title_case, cells)) if got != c.title()]
    assert differ == []


def test_numbers_in_cells(apply):
    cells = [" 12 ", "1e3", "+5", ".5", "5.", "1.0d", "1f", "nan", "0x1F", "1_000", "1,000", "1e400",
             " inf ", "inf", "-Infinity", "", None, "12\n", " 5"]
    wanted = pd.to_numeric(pd.Series(cells, dtype=object), errors="coerce")
    assert apply(to_number, cells) == [None if math.isnan(x) else x for x in wanted]


def test_number_text(apply):
    values = [1.5, 100.0, 12345678.5, 1e15, 123456789012.25, 0.0001, 0.00025, 0.1, -12345678.0]
    assert apply(number_text, values, "double") == [str(x) for x in values]


def test_round2_is_exact_on_the_binary_value(apply):
    rnd = random.Random(3)
    values = [k / 20000 * 100 for k in range(0, 20001, 3)] + [k / 800 * 100 for k in range(801)]
    values += [rnd.randint(0, d) / d * 100 for d in (rnd.randint(1, 40000) for _ in range(3000))]
    assert apply(round2, values, "double") == [round(x, 2) for x in values]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(safe_divide(df.a, df.b)).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_fixed_width(apply):
    cells = ["ABCDE", "ABCD", "", None, "ÄÖÜ12"]
    assert apply(lambda c: fixed_width(c, [2, 3]), cells) == ["AB|CDE", "ABCD", "", "", "ÄÖ|Ü12"]
    assert apply(lambda c: fixed_width(c, [2, 0, 3]), cells[:1]) == ["AB|CDE"]


@pytest.mark.parametrize(
    "pattern, cells",
    [
        ("ab", ["xabx", "ab"]),
        ("ab$", ["ab\n", "ab"]),
        (r"(?P<n>a)(?P=n)", ["aa", "ab"]),
        (r"\w+\Z", ["é1", "a\n"]),
        ("(?i)É", ["é", "e"]),
        ("a.b", ["a\rb", "a\nb"]),
        (r"\d+", ["12", "٣", "x"]),
    ],
)
def test_patterns_match_whole_cells(apply, pattern, cells):
    wanted = [bool(re.fullmatch(pattern, c)) for c in cells]
    assert apply(lambda c: c.rlike(java_pattern(pattern)), cells) == wanted


def test_bad_pattern_fails_early():
    with pytest.raises(SpecError):
        java_pattern("(")


def test_the_space_class_is_the_white_space_set(spark):
    from pyspark.sql import functions as F

    from counterfoil.functions.text import SPACE, WHITESPACE

    df = spark.range(1, 0xD7FF).select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    found = [chr(r.id) for r in df.filter(F.col("c").rlike(f"(?U)[{SPACE}]")).orderBy("id").collect()]
    assert "".join(found) == WHITESPACE


PATTERNS = [
    r"(?P<order_id>\d+)-(?P=order_id)", r"[a&&b]+", r"[[a]+", r"[]a]+", r"[^]a]+", r"a\[b", r"[\w&]+x", r"(?x)ab # end",
    r"a.b\Z", r"[a-c[&]*", r"\\[ab]", r"x|y", r"(?i)AB", r"[^[&]+",
]
PATTERN_TEXTS = ["12-12", "12-13", "a&b", "ab", "[a", "]a", "b&", "x", "a[b", "w&x", "a\nb", "axb", "\\a", "c[&a", "é&x", "y", "["]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_match_alike(apply, pattern):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        wanted = [re.fullmatch(pattern, text) is not None for text in PATTERN_TEXTS]
    assert apply(lambda c: c.rlike(java_pattern(pattern)), PATTERN_TEXTS) == wanted


def test_conditional_groups_are_refused():
    with pytest.raises(SpecError):
        java_pattern(r"(a)?(?(1)b|c)")


def test_lists_inside_lists_are_single_items(apply):
    cells = ['[["a","b"],"c"]', '[{"k":1},2,null]', "[[1],[2]]", "[a,[b]]", '["a [b]", "c"]', '[["a"],""]']
    wanted = [['["a","b"]', "c"], ['{"k":1}', "2", "None"], ["[1]", "[2]"], ["a", "[b]"], ["a [b]", "c"], ['["a"]']]
    assert apply(parse_array, cells) == wanted
