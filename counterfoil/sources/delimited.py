"""Delimited files as string tables.

Every cell is text and only an empty field is null. The header gives the
column names, blank lines and a byte order mark are dropped, short rows are
filled with nulls, and rows with too many fields are set apart as rejects.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError
from ..functions import col, nz
from ..spec import SourceOptions
from .records import Quoting, quoted_records

# Common spellings of the character sets that the reader knows (fixed values).
CHARSETS = {
    "utf8": "UTF-8",
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "utf-8-bom": "UTF-8",
    "latin1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "iso8859-1": "ISO-8859-1",
    "ascii": "US-ASCII",
    "us-ascii": "US-ASCII",
    "utf16": "UTF-16",
    "utf-16": "UTF-16",
    "utf-32": "UTF-32",
    "cp1252": "windows-1252",
    "windows-1252": "windows-1252",
}
# Spark does not read this set. It is ISO-8859-1 but for 32 code points, which are put right afterwards.
WINDOWS = "windows-1252"
WINDOWS_FROM = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS_TO = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")
RECORD = "_record"
EXTRA = "_extra"


def charset(name: str) -> str:
    if name.lower() == "auto":
        raise SourceError("name the encoding of the file; it is not guessed from the bytes")
    return CHARSETS.get(name.lower().replace("_", "-"), name)


def header_names(raw: Sequence[str | None]) -> list[str]:
    """Header cells as distinct names: ``a, a.1``; an unnamed cell gets its position."""
    names: list[str] = []
    for position, cell in enumerate(raw):
        base = cell or f"Unnamed: {position}"
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


@dataclass(frozen=True)
class Delimited:
    """A delimited source: the good rows, and the rows with too many fields."""

    table: DataFrame
    rejects: DataFrame


def _by_lines(encoding: str) -> bool:
    """Are line ends and quotes single bytes that stand for nothing else?"""
    return encoding.upper().startswith(("UTF-8", "ISO-8859", "US-ASCII"))


def _decoded(c: Column, encoding: str) -> Column:
    """Raw bytes that a scan of lines has taken for UTF-8; wrong ones become U+FFFD."""
    if encoding.upper().startswith("UTF-8"):
        return F.make_valid_utf8(c)
    if encoding.upper() == "US-ASCII":
        return F.regexp_replace(F.decode(c.cast("binary"), "ISO-8859-1"), "[\x80-\xff]", "\ufffd")
    return F.decode(c.cast("binary"), encoding)


def schema_text(schema: T.StructType) -> str:
    """The schema as text; a backtick in a name is doubled."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _look(spark: SparkSession, path: str, encoding: str, quote: str, whole: bool) -> bool:
    """Do all files begin with the same line, and can their records be cut at line ends?

    A different first line is an error, since columns go by position. A quoted
    field that spans lines leaves a line with an odd number of quotes. This is one
    pass over the raw lines, split over the cluster; without ``whole`` it reads
    the first block of each file only.
    """
    if not _by_lines(encoding):
        return False
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"),
    )
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit(quote)))
    at_start = (F.col("start") == 0) & (F.col("line") != "")
    files = (lines if whole else lines.filter(at_start)).groupBy("file").agg(
        F.first(F.when(at_start, F.col("line")), ignorenulls=True).alias("header"),
        F.max(quotes % 2).alias("odd"),
    )
    kinds = files.filter("header IS NOT NULL").groupBy("header")
    found = kinds.agg(F.min("file").alias("file"), F.max("odd").alias("odd")).orderBy("file").limit(2).collect()
    if len(found) > 1:
        raise SourceError(f"the headers of {found[0]['file']} and {found[1]['file']} differ")
    return not any(row["odd"] for row in found)


def _same_first_records(rows: DataFrame) -> None:
    """Files whose lines a plain scan can't read: their first records, as the parser gives them, must be equal.

    This is a pass over all files of the folder, with one record per file in the shuffle.
    """
    cells = F.to_json(F.array(*(F.ltrim(col(c), F.lit("\ufeff")) for c in rows.columns)))
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), cells.alias("header"))
    heads = placed.groupBy("file").agg(F.min_by("header", "at").alias("header"))
    found = heads.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").limit(2).collect()
    if len(found) > 1:
        raise SourceError(f"the headers of {found[0]['file']} and {found[1]['file']} differ")


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    quotechar: str = '"',
    encoding: str = "utf-8",
    use_columns: Sequence[str] | None = None,
    multi_line: bool | None = None,
    strict: bool = False,
) -> Delimited:
    """Read a file or folder of delimited text.

    All files must have the same header. ``multi_line=None`` looks whether quoted
    fields span lines. Large files are split either way: at line ends when they do
    not, and when they do, at the line ends that ``quoted_records`` finds outside of
    fields. False says so without looking, and True leaves each file to one
    task. ``strict`` stops the job that meets a row with too many fields, instead of
    setting such rows apart.
    """
    return _read(spark, path, delimiter, quotechar, encoding, use_columns, multi_line, strict)


def _read(
    spark: SparkSession,
    path: str,
    delimiter: str,
    quotechar: str,
    encoding: str,
    use_columns: Sequence[str] | None = None,
    multi_line: bool | None = None,
    strict: bool = False,
    decoder: Callable[[Column], Column] | None = None,
) -> Delimited:
    """What `read_delimited` does; a `decoder` makes the text of each line from its bytes, where lines can be cut."""
    encoding = charset(encoding)
    windows = encoding == WINDOWS
    if windows:
        encoding = "ISO-8859-1"
    splittable = _look(spark, path, encoding, quotechar, multi_line is None)
    cut = multi_line is None and (decoder is not None or not splittable) and _by_lines(encoding)
    if multi_line is None:
        multi_line = not splittable
    options = {
        "sep": delimiter,
        "quote": quotechar,
        "escape": quotechar,
        "encoding": encoding,
        "multiLine": str(multi_line).lower(),
        "nullValue": "",
        "mode": "PERMISSIVE",
        "maxColumns": "100000",
    }
    reader = spark.read.options(**options)
    first = reader.option("header", False).csv(path).limit(1).collect()
    if not first:
        raise SourceError(f"{path} is empty")
    if not _by_lines(encoding):
        _same_first_records(reader.option("header", False).csv(path))
    names = header_names([_as_windows(cell) if windows and cell else cell for cell in first[0]])
    unknown = [name for name in use_columns or () if name not in names]
    if unknown:
        raise SourceError(f"{path} has no columns {unknown}")

    # One spare column: a row of exactly one field too many parses cleanly, all
    # other lengths keep their raw text in the record column. The length of a
    # row is only known when the parser sees all its fields, so parser-level
    # pruning is off; columns that no one needs are still not converted.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, EXTRA, RECORD]])
    records = None
    if cut:
        records = quoted_records(spark, path, Quoting(delimiter, quotechar), decoder or (lambda c: _decoded(c, encoding)))
    if records is not None:
        parsed = F.from_csv("record", schema_text(schema), options | {"columnNameOfCorruptRecord": RECORD})
        raw = records.select(parsed.alias("row")).select("row.*")
    else:
        raw = (
            reader.option("header", True)
            .option("columnPruning", False)
            .option("columnNameOfCorruptRecord", RECORD)
            .schema(schema)
            .csv(path)
        )
    q, sep = re.escape(quotechar), re.escape(delimiter)
    unquoted = F.regexp_replace(F.col(RECORD), f"{q}(?:[^{q}]|{q}{q})*+{q}", "")
    too_long = (
        F.col(RECORD).isNull()
        | F.col(EXTRA).isNotNull()
        | (F.size(F.split(unquoted, sep, -1)) > len(names))
    )
    kept = [col(n) for n in (use_columns if use_columns is not None else names)]
    fields_again = F.concat_ws(delimiter, *(nz(col(n)) for n in [*names, EXTRA]))
    record = F.coalesce(F.col(RECORD), fields_again)
    decoded = _windows_text if windows else lambda c: c
    rejects = raw.filter(too_long).select(decoded(record).alias("record"))
    good = ~too_long
    if strict:
        told = F.raise_error(F.lit(f"{path} has rows with more fields than the header")).cast("boolean")
        good = F.when(too_long, told).otherwise(F.lit(True))
    table = raw.filter(good).select(*kept)
    if windows:
        table = table.select(*(_windows_text(col(n)).alias(n) for n in table.columns))
    return Delimited(table, rejects)


def _as_windows(text: str) -> str:
    return text.translate(str.maketrans(WINDOWS_FROM, WINDOWS_TO))


def _windows_text(c: Column) -> Column:
    return F.translate(c, WINDOWS_FROM, WINDOWS_TO)


def read_source(spark: SparkSession, options: SourceOptions, **reading: bool) -> Delimited:
    """Read the source that a job file describes."""
    return read_delimited(
        spark,
        options.path,
        delimiter=options.delimiter,
        quotechar=options.quotechar,
        encoding=options.encoding,
        use_columns=options.use_columns,
        **reading,
    )


def damaged_cells(
    spark: SparkSession, path: str, delimiter: str = ",", quotechar: str = '"', encoding: str = "utf-8"
) -> DataFrame:
    """``(column, damaged_cells)``: cells of a file that hold bytes which are no text in its character set.

    In UTF-8 the bytes themselves are looked at, so a U+FFFD that stands in the file is no
    damage. In character sets of one byte there is no such character. In UTF-16 and UTF-32, and in files
    with lone carriage returns, it can't be told from damage and counts as such. Rows with too many
    fields are not counted.
    """
    decoder = None
    if charset(encoding).upper().startswith("UTF-8"):
        # U+FFFE is no character, so it can stand for the genuine U+FFFD until the cells are counted.
        decoder = lambda c: F.make_valid_utf8(F.replace(c, F.lit("\ufffd"), F.lit("\ufffe")))
    return decode_audit(_read(spark, path, delimiter, quotechar, encoding, decoder=decoder).table)


def decode_audit(df: DataFrame) -> DataFrame:
    """``(column, damaged_cells)``: cells with characters lost in decoding.

    Bytes that are wrong for the chosen character set become U+FFFD, so a
    count above zero says that the encoding should be another one, unless the text
    held that character; ``damaged_cells`` looks at the bytes of the file instead.
    """
    counts = df.agg(
        F.array(
            *(
                F.struct(
                    F.lit(name).alias("column"),
                    F.count_if(F.coalesce(col(name).contains("�"), F.lit(False))).alias(
                        "damaged_cells"
                    ),
                )
                for name in df.columns
            )
        ).alias("counts")
    )
    return counts.select(F.inline("counts"))
