"""Text expressions with the cell semantics of a string-typed table.

Everything here takes and returns a Column, so it stays inside the generated
code of the stage that uses it.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Callable, Iterator, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SpecError

# Every code point that str.isspace accepts; none lies above U+3000.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# The same set for a character class under the Unicode flag ``(?U)``.
SPACE = r"\s\x1c-\x1f"


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def nz(c: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Both ends trimmed of all Unicode white space (``trim`` drops U+0020 only).

    Most cells begin and end with a visible ASCII character; they are passed
    through without the search in the white space list.
    """
    first, last = F.ascii(c), F.ascii(F.substring(c, -1, 1))
    visible = first.between(33, 126) & last.between(33, 126)
    return F.when(visible, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def blank(c: Column) -> Column:
    """Null, empty or white space only; never null itself."""
    return strip(nz(c)) == F.lit("")


@cache
def _title_forms() -> dict[str, str]:
    """Letters whose title form is not their upper form, such as those for dz, and the title forms."""
    letters = (chr(c) for c in range(128, sys.maxunicode + 1))
    return {c: c.title() for c in letters if c.title() != c.upper()}


def _title_form(letter: Column) -> Column:
    """The title form of one character; plain letters are not looked up."""
    forms = F.create_map(*[F.lit(part) for pair in _title_forms().items() for part in pair])
    return F.when(F.ascii(letter) < 128, F.upper(letter)).otherwise(
        F.coalesce(F.try_element_at(forms, letter), F.upper(letter))
    )


def title_case(c: Column) -> Column:
    """Title form for every letter that follows a non-letter, lower case for the rest.

    ``initcap`` restarts at blanks only; here ``o'neil`` becomes ``O'Neil``. Whether a
    sigma is the last of its word is seen from the letters that touch it.
    """
    cased = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
    runs = F.regexp_extract_all(c, F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(1))
    # The letter in front of the rest says to a sigma that it is inside a word.
    rest = lambda w: F.substr(F.lower(F.concat(F.lit("a"), F.substr(w, F.lit(2)))), F.lit(2))
    titled = F.transform(runs, lambda w: F.concat(_title_form(F.substring(w, 1, 1)), rest(w)))
    return F.array_join(titled, "")


def collapse_spaces(c: Column) -> Column:
    """Each inner run of white space as one blank."""
    return F.regexp_replace(c, f"(?U)[{SPACE}]++", " ")


def segments(c: Column, lengths: Sequence[int]) -> Column:
    """The pieces of a fixed-width text as an array (positive lengths only)."""
    pieces, start = [], 1
    for length in lengths:
        if length > 0:
            pieces.append(F.substring(c, start, length))
            start += length
    return F.array(*pieces) if pieces else F.array().cast("array<string>")


def fixed_width(c: Column, lengths: Sequence[int]) -> Column:
    """Pieces joined by a bar; a text of any other length stays as it is."""
    return F.when(nz(c) == "", F.lit("")).when(
        F.length(c) == F.lit(sum(lengths)), F.array_join(segments(c, lengths), "|")
    ).otherwise(c)


def java_pattern(pattern: str, full: bool = True) -> str:
    """A Python regular expression as one that Spark's ``rlike`` reads alike.

    ``d`` makes the line feed the only line end and ``U`` makes the character
    classes Unicode-aware, as they are in Python; ``full`` anchors both ends.
    Named groups get plain names, and inside a class the characters that Java
    takes for nested classes and intersections are escaped. Conditional groups,
    which Java lacks, are refused.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # it warns of what is escaped below
            groups = re.compile(pattern).groupindex
    except re.error as exc:
        raise SpecError(f"invalid regular expression {pattern!r}: {exc}") from exc
    names = {name: f"g{i}" for i, name in enumerate(groups, start=1)}
    body = "".join(_java_parts(pattern, names))
    # A comment under the x flag ends with its line.
    return f"(?dU)\\A(?:{body}\n)\\z" if full and "(?x" in body else rf"(?dU)\A(?:{body})\z" if full else f"(?dU){body}"


_PART = re.compile(r"\\.|\[\^?\]?|\(\?P<(\w+)>|\(\?P=(\w+)\)|\(\?\(|.", re.S)


def _java_parts(pattern: str, names: dict[str, str]) -> Iterator[str]:
    in_class = False
    for part in _PART.finditer(pattern):
        text = part[0]
        if in_class:
            in_class = text != "]"
            yield {"[": r"\[", "[^": r"\[^", "[]": r"\[]", "[^]": r"\[^]", "&": r"\&"}.get(text, text)
            in_class = in_class and text not in ("[]", "[^]")
        elif text.startswith("["):
            in_class = True
            yield text.replace("]", r"\]")
        elif part[1]:
            yield f"(?<{names[part[1]]}>"
        elif part[2]:
            yield rf"\k<{names[part[2]]}>"
        elif text == "(?(":
            raise SpecError(f"conditional groups are not supported: {pattern!r}")
        else:
            yield r"\z" if text == r"\Z" else text
