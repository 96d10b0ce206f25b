"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

The letters of a word are a multiset. As a binary vector it has a bit for each letter and each
occurrence of it ("the second e"). One inserted, deleted or replaced letter moves the vector by a
Hamming distance of at most two. PartEnum deals the bits to `PARTS` parts; two vectors that differ in
two bits agree in all parts but two, so a signature for every choice of parts but two meets its like
for certain. Signatures are made of distinct multisets only, met by an equi-join, and verified on the bits.

A verified pair of multisets says which letter goes and which one comes. So the words of one side
are rewritten at each place where that letter stands, and a last equi-join with the vocabulary keeps
the rewritten words that exist: no pair of words is ever made that is not a variant.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

PARTS = 8  # 28 signatures, each of six parts
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int = 97) -> DataFrame:
    """word, n of each word of the texts after slips; see `spelling_groups`."""
    run = f"([A-Za-zÀ-ÿ]{{{least_length},}})"  # shorter runs can't become long enough
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(run), F.lit(1)))
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = named.withColumn("h", h).select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def letters(word: Column) -> Column:
    """The sorted letters of a word as one text, which names its multiset."""
    return F.array_join(F.array_sort(F.split(word, "")), "")


def _bits(multiset: Column) -> Column:
    """Letter and number of its occurrence, for each letter of a sorted text."""
    found = F.split(multiset, "")
    return F.transform(found, lambda c, i: F.concat(c, (i - F.array_position(found, c)).cast("string")))


def _signatures(multisets: DataFrame, parts: int) -> DataFrame:
    """m, s, rest: for each multiset and each choice of all parts but two, their value s and the bits of the two left out."""

    def part(p: int) -> Column:
        return F.filter("bits", lambda b: F.pmod(F.xxhash64(b), F.lit(parts)) == p)

    dealt = multisets.select("m", _bits(F.col("m")).alias("bits")).select("m", *(part(p).alias(f"b{p}") for p in range(parts)))
    dealt = dealt.select("*", *(F.xxhash64(F.array_join(f"b{p}", " ")).alias(f"p{p}") for p in range(parts)))
    rows = [
        F.struct(F.xxhash64(F.lit(k), *(f"p{p}" for p in range(parts) if p not in out)).alias("s"), F.concat(*(f"b{p}" for p in out)).alias("rest"))
        for k, out in enumerate(combinations(range(parts), 2))
    ]
    return dealt.select("m", F.inline(F.array(*rows)))


def near_multisets(multisets: DataFrame, parts: int = PARTS) -> DataFrame:
    """m, gone, come: the letter that leaves a multiset, and the one that enters or null, on the way to another one.

    Of two multisets the way starts from the longer one, or from the smaller text where both have one length.
    As the parts of the signature agree, the bits left out tell all. Should two signatures be equal by
    accident, the way leads to no word.
    """
    signed = stored(_signatures(multisets, parts))
    other = signed.select(F.col("m").alias("m2"), "s", F.col("rest").alias("rest2"))
    more = F.length("m") - F.length("m2")
    met = signed.join(other, "s").filter((more == 1) | ((more == 0) & (F.col("m") < F.col("m2"))))
    ways = met.select("m", more.alias("more"), F.array_except("rest", "rest2").alias("gone"), F.array_except("rest2", "rest").alias("come"))
    close = ways.filter((F.size("gone") == 1) & (F.size("come") == 1 - F.col("more")))
    letter = lambda c: F.try_element_at(c, F.lit(1)).substr(1, 1)
    return close.select("m", letter(F.col("gone")).alias("gone"), letter(F.col("come")).alias("come")).distinct()


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that differ by one edit, once. `words` has distinct words and n."""
    named = words.withColumn("m", letters(F.col("word")))
    held = named.join(near_multisets(named.select("m").distinct(), parts), "m")
    word, rest = F.col("word"), F.length("word")
    places = F.filter(F.sequence(F.lit(1), rest), lambda i: word.substr(i, F.lit(1)) == F.col("gone"))
    new = F.coalesce("come", F.lit(""))
    turned = F.transform(places, lambda i: F.concat(word.substr(F.lit(1), i - 1), new, word.substr(i + 1, rest)))
    asked = held.select(word.alias("a"), F.col("n").alias("n_a"), F.explode(F.array_distinct(turned)).alias("b"))
    return asked.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of each (word, form): the end of its chain of forms. Chains have no cycles.

    Each round doubles the length of chain that a row has followed.
    """
    left = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = left.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = left.join(further, "root", "left")
        stepped = stored(stepped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        left = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return left


def spelling_groups(words: DataFrame, ratio: int = 2, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of distinct words with their counts n.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is
    its near word of largest n, ties to the smaller in code-point order, if that n is at least `ratio`
    times its own; `ratio` must be above 1. The root is the last form of its chain, or the word itself.

    With `vocabulary`: null and empty texts have no words, repeated rows count as often as they stand
    there, a null doc_id counts as an empty one, texts may be of any length, and an empty table gives none.
    """
    words = stored(words.select("word", "n"))
    pairs = stored(near_words(words, parts))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    order = F.struct((-F.col("near_n")).alias("back"), "near")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(order).alias("best"))
    joined = words.join(best, "word", "left")
    near_n = -F.col("best.back")
    strong = near_n >= ratio * F.col("n")
    marked = stored(
        joined.select(
            "word",
            F.when(strong, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, near_n).alias("form_n"),
        )
    )
    roots = last_forms(marked.filter("form IS NOT NULL"))
    return marked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
