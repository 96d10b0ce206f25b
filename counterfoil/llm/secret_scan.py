r"""Secrets in texts: three fixed patterns, and strings that look random.

Strings of 20 or more ASCII letters, digits and `+/_-` with at least one letter and one digit are
candidates, and so are their parts: what follows a name with `=`, path parts, and groups of one alphabet
that dashes part. Dashes and low lines are no symbols. Of random strings inside each other the outer one
is given. Their encoding (hexadecimal, base 32, base 36 or base 64) is inferred from the characters,
and three tests run on the symbols: the chi-squared test of uniform use of the alphabet, a runs test on
changes between kinds of character, and the serial correlation of neighbours.

* A string must agree with random symbols: the smallest of the three p-values, times three, stays
  above `random_level`.
* Against written text, chi-squared and runs give a p-value each (how likely text is so even and so
  changeful), joined by adding their normal scores.

False discoveries are held to a share of `rate` over all documents by weighted Benjamini-Hochberg:
p-values are divided by a weight that grows with length, as short strings tell less, and the weights
have mean 1. The step is taken on a histogram of p-values, so one bounded row set reaches the driver.
Only DataFrame functions are used. A null text is empty; rows are judged alone, whatever their doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

# The base patterns, with the least length of a hit built in where that changes no match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
# Candidates: what stands before or after "=", parts of a path, parts between signs, and groups of one
# alphabet that "-" or "_" part, whatever stands before them.
GROUPS = r"(?<![A-Za-z0-9])(?=[A-Za-z0-9_-]{{20}})[{0}]++(?:[_-][{0}]++)+(?![A-Za-z0-9])"
CANDIDATES = (
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+", r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{20,}+=*+", r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+",
    *(GROUPS.format(alphabet) for alphabet in ("0-9a-f", "0-9A-F", "0-9a-z", "0-9A-Z")),
)
ASSIGN_VALUE = 8

SPAN = "array<struct<start: int, end: int, text: string>>"
# By alphabet: chance that two characters of something written in it are equal, and that neighbours
# of random symbols differ in kind. Few letters fit in the smaller alphabets, so these repeat more.
TEXT_COLLISION = {16: 0.15, 32: 0.07, 36: 0.065, 64: 0.065}
TEXT_CHANGE = 0.25  # chance that neighbours in something written differ in kind
CHANCE_OF_CHANGE = {16: 0.469, 32: 0.305, 36: 0.401, 64: 0.625}
BINS, BINS_PER_HALVING = 400, 4


def found(text: Column, pattern: str) -> Column:
    """start, end (code points, exclusive) and text of each match, left to right.

    The pieces between the matches, in turn with the matches, give the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(matches.alias("hit"), F.split(text, pattern, -1).alias("gap"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.array_append(done["spans"], span).alias("spans"))

    pairs = F.filter(pairs, lambda pair: pair["hit"].isNotNull())
    spans = F.aggregate(pairs, empty, step, lambda done: done["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def assigned(text: Column) -> Column:
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    spans = F.zip_with(found(text, ASSIGN), value, lambda s, v: F.when(F.length(v) >= ASSIGN_VALUE, s))
    return F.when(text.rlike(ASSIGN), F.filter(spans, lambda s: s.isNotNull())).otherwise(F.array().cast(SPAN))


def candidates(text: Column) -> Column:
    """Spans that may be random, each once; of texts without a long string, none are looked for."""
    every = F.array_distinct(F.concat(*[found(text, pattern) for pattern in CANDIDATES]))
    return F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), every).otherwise(F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z (a polynomial approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    series = F.lit(0.0)
    for factor in reversed(terms):
        series = (series + factor) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def battery(candidates: Column) -> Column:
    """p_random and p_text of each candidate, with start and end."""

    def symbols(span: Column) -> Column:
        body = F.regexp_replace(span["text"], "[=_-]", "")
        size = (
            F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
            .when(body.rlike("^[A-Z2-7]+$"), 32)
            .when(body.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36)
            .otherwise(64)
        )
        codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), F.ascii)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), size.alias("size"), codes.alias("codes"))

    def values(span: Column) -> Column:
        size = span["size"]

        def value(code: Column) -> Column:
            digit = F.when(size == 32, code - 24).otherwise(code - 48)
            upper = F.when(size == 32, code - 65).otherwise(code - 55)
            lower = F.when(size == 64, code - 61).otherwise(code - 87)
            return F.when(code.between(48, 57), digit).when(code.between(65, 90), upper).when(code.between(97, 122), lower).otherwise(
                F.when(code == 43, 62).otherwise(63)
            )

        kind = lambda code: F.when(code < 58, 0).when(code < 91, 1).otherwise(2)
        codes = span["codes"]
        kinds = F.transform(codes, kind)
        changed = F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds) - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
        return F.struct(
            span["start"].alias("start"), span["end"].alias("end"), size.cast("double").alias("size"),
            F.transform(codes, value).alias("x"), F.size(codes).cast("double").alias("n"), _total(changed).alias("changes"),
        )

    def sums(span: Column) -> Column:
        x, n = span["x"], span["n"]
        squares = _total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2))))
        mean = _total(F.transform(x, lambda v: v.cast("double"))) / n
        spread = _total(F.transform(x, lambda v: (v - mean) * (v - mean)))
        neighbours = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: (a - mean) * (b - mean))
        serial = F.when(spread > 0, _total(neighbours) / spread).otherwise(1.0)
        return F.struct(*[span[k].alias(k) for k in ("start", "end", "size", "n", "changes")], squares.alias("squares"), serial.alias("serial"))

    def judged(span: Column) -> Column:
        size, n = span["size"], span["n"]
        by_size = lambda known: F.element_at(F.create_map(*[F.lit(v) for k in known for v in (float(k), known[k])]), size)
        chance = by_size(CHANCE_OF_CHANGE)
        chi = size / n * span["squares"] - n
        excess = size * by_size(TEXT_COLLISION) - 1
        text_mean = (size - 1) + F.greatest((n - 1) * excess, F.lit(0.0))
        text_spread = F.sqrt(2 * (size - 1) + 4 * n * F.greatest(excess, F.lit(0.0)))
        even = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        expected = lambda p: (span["changes"] - (n - 1) * p) / F.sqrt((n - 1) * p * (1 - p))
        two_sided = lambda z: 2 * _tail(F.abs(z))
        least = F.least(_tail(even), two_sided(expected(chance)), two_sided(span["serial"] * F.sqrt(n)))
        score = ((text_mean - chi) / text_spread + expected(F.lit(TEXT_CHANGE))) / math.sqrt(2)
        return F.struct(
            span["start"].alias("start"), span["end"].alias("end"), n.alias("n"),
            F.least(3 * least, F.lit(1.0)).alias("p_random"), _tail(score).alias("p_text"),
        )

    mixed = F.filter(candidates, lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    out = mixed
    for turn in (symbols, values, sums, judged):
        out = F.transform(out, turn)
    return out


def _weight(n: Column) -> Column:
    """Longer strings get more of the error rate; up to a constant."""
    return F.least(n, F.lit(64.0)) / 32


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log2(F.greatest(p, F.lit(1e-300))) * BINS_PER_HALVING), F.lit(BINS)).cast("int")


def cutoff(scored: DataFrame, rate: float, random_level: float) -> tuple[float, float]:
    """Mean weight of all candidates, and the bin from which on weighted p-values are discoveries."""
    each = scored.select(F.explode("scores").alias("s")).select("s.*")
    known = each.agg(F.count("*").alias("n"), F.avg(_weight(F.col("n"))).alias("w")).first()
    if not known["n"]:
        return 1.0, BINS + 1
    weighted = F.col("p_text") * known["w"] / _weight(F.col("n"))
    bins = each.filter(F.col("p_random") >= random_level).groupBy(_bin(weighted).alias("bin")).agg(F.count("*").alias("n"))
    above = 0
    best = BINS + 1
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most BINS + 1 rows
        above += row["n"]
        if 2.0 ** (-row["bin"] / BINS_PER_HALVING) <= rate * above / known["n"]:
            best = row["bin"]
    return known["w"], best


def scan(docs: DataFrame, rate: float, random_level: float, *keep: str) -> DataFrame:
    """The columns in `keep` and the spans of each kind: assign, access, hex, random; arrays of start and end.

    Random strings inside a span of another kind are not given again.
    """
    text = F.coalesce("text", F.lit(""))
    spans = {"assign": assigned(text), "access": found(text, ACCESS), "hex": found(text, HEX)}
    short = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    columns = [F.transform(column, short).alias(kind) for kind, column in spans.items()]
    scored = stored(docs.select(*keep, *columns, battery(candidates(text)).alias("scores")))
    mean_weight, least_bin = cutoff(scored, rate, random_level)
    taken = F.concat("assign", "access", "hex")

    def discovered(s: Column) -> Column:
        inside = F.exists(taken, lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"]))
        strong = _bin(s["p_text"] * mean_weight / _weight(s["n"])) >= least_bin
        return (s["p_random"] >= random_level) & strong & ~inside

    def outermost(s: Column) -> Column:
        around = lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"]) & ((t["start"] != s["start"]) | (t["end"] != s["end"]))
        return ~F.exists("random", around)

    scored = scored.select(*keep, *spans, F.transform(F.filter("scores", discovered), short).alias("random"))
    return scored.select(*keep, *spans, F.filter("random", outermost).alias("random"))


def listed(*kinds: str) -> Column:
    """kind:start:end of all spans, by start and then in the order of the kinds, joined by commas."""
    def tagged(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end")))

    names = F.array(*map(F.lit, kinds))
    every = F.array_sort(F.concat(*[tagged(i, kind) for i, kind in enumerate(kinds)]))
    written = F.transform(every, lambda s: F.concat_ws(":", names[s["i"]], s["start"], s["end"]))
    return F.array_join(written, ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    base = ("assign", "access", "hex")
    return scan(docs, 0.01, 0.01, "doc_id").select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(listed(*base), 256).alias("base_sha256"),
        listed(*base, "random").alias("spans"),
    )


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All columns of docs, with every span of any kind replaced by `mark`; overlapping spans are one.

    n_chars, where docs has it, is the new number of code points of a text that changed.
    """
    row = docs.select(F.struct(*[docs[n] for n in docs.columns]).alias("_row"), "text")
    spans = scan(row, 0.01, 0.01, "_row")
    text, kept = F.col("_row")["text"], F.col("_row")
    every = F.array_sort(F.concat("assign", "access", "hex", "random"))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        before = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(done["out"], before, F.lit(mark)).alias("out"))
        further = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] < done["at"], further).otherwise(fresh)

    whole = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    changed = F.size(every) > 0
    out = spans.withColumn("_text", F.when(changed, F.aggregate(every, empty, step, whole)).otherwise(text))
    columns = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        count = F.when(changed, F.length("_text")).otherwise(kept["n_chars"])
        columns["n_chars"] = count.cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[columns.get(n, kept[n]).alias(n) for n in docs.columns])
