"""List-valued cells: text to array, and arrays back to comparable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text
from .text import SPACE, WHITESPACE, let, nz, strip

# JSON scalars (fixed patterns). The quantifiers are possessive so that long
# cells are matched in a loop and not by recursion.
JSON_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
JSON_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
JSON_SCALAR = f"(?:{JSON_STRING}|-?Infinity|NaN|true|false|null|{JSON_NUMBER})"
# How a list of scalars can begin; sends most other bracketed texts away early.
JSON_START = r"\A\[[ \t\n\r]*(?:[\]\"0-9-]|true|false|null|NaN|Infinity)"
MARK = "\x01"


def _is_flat_json(t: Column, tokens: Column) -> Column:
    """Is the bracketed text one JSON list of scalars, with nothing before or after?

    Mostly the scalars between commas give back the text. With other white space
    every scalar is replaced by a mark, and what is left must be marks between
    commas. A raw control character is never valid JSON, so the mark is free.
    """

    def respelled(separator: str) -> Column:
        return F.concat(F.lit("["), F.array_join(tokens, separator), F.lit("]")) == t

    skeleton = F.regexp_replace(F.regexp_replace(t, JSON_SCALAR, MARK), r"[ \t\n\r]", "")

    def only_marks(s: Column) -> Column:
        inner = F.split(F.substr(s, F.lit(2), F.length(s) - 2), ",", -1)
        marks = F.forall(inner, lambda part: part == F.lit(MARK))
        return s.startswith("[") & s.endswith("]") & ((s == "[]") | marks)

    return respelled(",") | respelled(", ") | (~t.contains(MARK) & let(skeleton, only_marks))


def _scalar_text(token: Column) -> Column:
    """The text that a JSON scalar has once it is a string."""
    unescaped = F.try_element_at(
        F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(1)
    )
    unquoted = F.substr(token, F.lit(2), F.length(token) - 2)
    return (
        F.when(token.startswith('"'), F.when(token.contains("\\"), unescaped).otherwise(unquoted))
        .when(token == "true", F.lit("True"))
        .when(token == "false", F.lit("False"))
        .when(token == "null", F.lit("None"))
        .when(token == "NaN", F.lit("nan"))
        .when(token == "Infinity", F.lit("inf"))
        .when(token == "-Infinity", F.lit("-inf"))
        .when(token.rlike("[.eE]"), number_text(token.try_cast("double")))
        .when(token == "-0", F.lit("0"))
        .otherwise(token)
    )


def _json_items(t: Column) -> Column:
    """Items of a JSON list of scalars, trimmed and without empty ones; else null."""
    tokens = F.regexp_extract_all(t, F.lit(f"({JSON_SCALAR})"), F.lit(1))
    texts = let(tokens, lambda k: F.when(_is_flat_json(t, k), F.transform(k, _scalar_text)))
    return F.filter(F.transform(texts, strip), lambda item: item != "")


def _nested_items(t: Column) -> Column:
    """Top-level items of a JSON list that holds lists or objects; null for other texts."""
    # The parser stops after one value; inside an object and inside a list the text must be that value.
    held = F.concat(F.lit('{"v":'), t, F.lit("}")), F.concat(F.lit("["), t, F.lit("]"))
    valid = F.try_parse_json(held[0]).isNotNull() & F.try_parse_json(held[1]).isNotNull()
    items = F.when(valid, F.from_json(t, "array<string>"))
    shown = F.transform(items, lambda item: F.coalesce(strip(item), F.lit("None")))
    return F.filter(shown, lambda item: item != "")


def _comma_items(text: Column) -> Column:
    """Items between commas, trimmed and without empty ones.

    Separators are narrowed to single commas first, so that the items need no
    trimming one by one.
    """
    narrowed = F.regexp_replace(text, f"(?U)[{SPACE}]*+,[{SPACE},]*+", ",")
    items = F.split(F.btrim(narrowed, F.lit(WHITESPACE + ",")), ",", -1)
    return F.array_remove(items, "")


def parse_array(c: Column, stripped: Column | None = None) -> Column:
    """A cell as ``array<string>``: JSON list, else ``[a, b]``, else ``a, b``.

    Null and blank cells give an empty array. A list or object inside a JSON list
    is one item, shown as its JSON text. ``stripped`` is a column that
    holds the cell from ``list_source``; with it the generated code stays small.
    """
    t = list_source(c) if stripped is None else stripped
    bracketed = t.startswith("[") & t.endswith("]")
    plain = F.when(bracketed, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    json_items = F.when(bracketed & t.rlike(JSON_START), _json_items(t))
    nested = F.when(bracketed & t.rlike(r"\A\[.*[\[{]"), _nested_items(t))
    return F.coalesce(json_items, nested, _comma_items(plain))


def list_source(c: Column) -> Column:
    """The text that ``parse_array`` looks at; used many times, so worth a projection."""
    return strip(nz(c))


def set_text(items: Column) -> Column:
    """An array as the JSON text of its sorted distinct items; null stays null."""
    return F.to_json(F.sort_array(F.array_distinct(items)))


def list_text(items: Column) -> Column:
    """An array printed as a list of quoted texts: ``['a', 'b']``."""

    def quoted(item: Column) -> Column:
        body = F.replace(item, F.lit("\\"), F.lit("\\\\"))
        for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\xa0", "\\xa0")):
            body = F.replace(body, F.lit(char), F.lit(shown))
        return F.when(
            item.contains("'") & ~item.contains('"'), F.concat(F.lit('"'), body, F.lit('"'))
        ).otherwise(
            F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        )

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
