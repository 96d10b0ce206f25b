"""URL filters: rules for sites, and a ratio of two character models for the urls that no rule fits.

The urls that rules allow train one model, those that rules block the other. Both are Markov models of
variable order: the chance of a character is mixed from all contexts of 0 to `order` characters
before it, each weighted by how often and with how many different characters it was seen
(Witten-Bell), so a context counts as far as the corpus knows it. Counts are tables of character strings with
one row per string; all orders are sums over the longest strings. Each url gets the difference of
its two log-likelihoods per character.

The threshold is calibrated on urls with rules: both models are trained without a fold of them, too,
and each url is scored by the models that have not seen its fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
BASE = 1 / 256  # chance of a character that no context knows
UNIT = 1_000_000  # log ratios are whole millionths, so that sums don't depend on their order
BIN, BINS = 10_000, 2_000  # the threshold is a multiple of 0.01 within +-20 per character
BLOCK = 4096  # characters whose strings a row holds at a time
MODELS = ("all", "without_0", "without_1")


@dataclass(frozen=True)
class Rule:
    """`site` is a host and a path, such as example.net/en/; it holds for the host's subdomains, too."""

    site: str
    verdict: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return self.site[len(self.host) :]

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")
        return host & F.col("path").startswith(self.path)


def parted(pages: DataFrame) -> DataFrame:
    """page_id, host, path of each row of page_id, url; both are empty without ``://``."""
    url = F.coalesce("url", F.lit(""))
    part = lambda k: F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def ruled(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The urls with rule and rule_verdict of the longest rule that fits (ties: the longer host), or null."""
    order = sorted(rules, key=lambda r: (-len(r.site), -len(r.host), r.site))
    none = F.lit(None).cast("string")
    rule = F.coalesce(*(F.when(r.fits(), F.lit(r.site)) for r in order), none)
    verdict = none
    for r in order:
        verdict = F.when(F.col("rule") == r.site, F.lit(r.verdict)) if verdict is none else verdict.when(F.col("rule") == r.site, F.lit(r.verdict))
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join by sorting both sides. All tables here grow with the corpus, and Spark takes them for far smaller than they are.

    Its estimate is that of packed Parquet, and strings of exploded urls count as few as their urls, so a broadcast would bring
    them to the driver as a whole.
    """
    return left.join(right.hint("merge"), on, how)


def _strings(addresses: DataFrame, order: int) -> DataFrame:
    """The addresses with a row for each character and the end: the character and `order` before it as `gram`."""
    marked = F.concat(F.lit(START * order), "host", "path", F.lit(END))
    starts = F.sequence(F.lit(1), F.length("marked") - order, F.lit(BLOCK))
    kept = [c for c in addresses.columns if c not in ("host", "path")]
    blocks = addresses.withColumn("marked", marked).select(*kept, "marked", F.explode(starts).alias("start"))
    blocks = blocks.select(*kept, F.col("marked").substr(F.col("start"), F.lit(BLOCK + order)).alias("block"))
    block = F.col("block")
    grams = F.transform(F.sequence(F.lit(1), F.length(block) - order), lambda i: block.substr(i, F.lit(order + 1)))
    return blocks.select(*kept, F.explode(grams).alias("gram"))


def counts(strings: DataFrame) -> DataFrame:
    """gram and, for each model, the weight of its allowed (`a_`) and blocked (`r_`) occurrences."""
    sums = []
    for side, verdict in (("a", "allow"), ("r", "block")):
        for model in MODELS:
            seen = F.col("rule_verdict") == verdict
            if model != "all":
                seen = seen & (F.col("fold") != int(model[-1]))
            sums.append(F.sum(F.when(seen, F.col("n")).otherwise(F.lit(0))).alias(f"{side}_{model}"))
    return strings.groupBy("gram").agg(*sums)


def ratios(grams: DataFrame, order: int) -> DataFrame:
    """gram and, for each model, the log of allowed over blocked chance of its last character, in millionths."""
    columns = [f"{side}_{model}" for side in "ar" for model in MODELS]
    below = None
    for k in range(order + 1):
        gram = F.col("gram")
        level = grams.groupBy(F.right(gram, F.lit(k + 1)).alias("gram")).agg(*(F.sum(c).alias(c) for c in columns))
        level = level.withColumn("context", F.left(gram, F.lit(k)))
        known = level.groupBy("context").agg(
            *(F.sum(c).alias(f"n_{c}") for c in columns), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in columns)
        )
        level = _met(level, known, "context")
        if below is None:
            level = level.select("*", *(F.lit(BASE).alias(f"low_{c}") for c in columns))
        else:
            level = _met(level.withColumn("suffix", F.right(gram, F.lit(k))), below, "suffix")
        chances = []
        for c in columns:
            total = F.col(f"n_{c}") + F.col(f"kinds_{c}")
            mixed = (F.col(c) + F.col(f"kinds_{c}") * F.col(f"low_{c}")) / F.nullif(total, F.lit(0))
            chances.append(F.coalesce(mixed, F.col(f"low_{c}")).alias(f"low_{c}"))
        below = level.select(F.col("gram").alias("suffix"), *chances)
    logs = [F.round(F.log(F.col(f"low_a_{m}") / F.col(f"low_r_{m}")) * UNIT).cast("long").alias(m) for m in MODELS]
    return below.select(F.col("suffix").alias("gram"), *logs)


def threshold(scored: DataFrame) -> float | None:
    """Least score that is allowed, in millionths; None without urls that rules allow and urls that rules block.

    Of the multiples of 0.01 it has the least sum of the share of allowed urls below it and the share of
    blocked urls from it on; ties go to the one nearest to 0, then to the larger one.
    """
    place = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS)).alias("place")
    weights = [F.sum(F.when(F.col("rule_verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]
    rows = scored.filter("rule_verdict IS NOT NULL").groupBy(place).agg(*weights).collect()  # at most 4001
    allow, block = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not allow or not block:
        return None
    held = {r["place"]: (r["allow"], r["block"]) for r in rows}
    best, lost, passed = None, 0, block
    for k in range(-BINS, BINS + 2):
        error = (lost / allow + passed / block, abs(k), -k)
        best = min(best, error) if best else error
        here = held.get(k, (0, 0))
        lost, passed = lost + here[0], passed - here[1]
    return float(-best[2] * BIN)


def judged(pages: DataFrame, rules: Sequence[Rule], order: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of page_id, url.

    The verdict is the rule's where one fits. Else it is block where the score, the difference of
    log-likelihoods per character, is below the calibrated threshold. Urls without host and path, and all
    urls while rules have not both allowed and blocked some, are allowed. A null url is an empty one, repeated
    rows are judged each and weigh in the counts each, urls may be of any length, an empty table gives none.
    """
    urls = stored(parted(pages))
    addresses = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(2)).alias("fold")
    addresses = stored(
        ruled(addresses, rules).filter("host != '' OR path != ''").select("*", fold, F.monotonically_increasing_id().alias("id"))
    )
    strings = _strings(addresses.select("id", "host", "path", "n", "rule_verdict", "fold"), order)
    table = stored(ratios(stored(counts(strings)), order))
    fitting = F.when(F.col("rule_verdict").isNull(), F.col("all")).when(F.col("fold") == 0, F.col("without_0")).otherwise(F.col("without_1"))
    sums = _met(strings.select("id", "gram", "rule_verdict", "fold"), table, "gram").groupBy("id")
    sums = sums.agg((F.sum(fitting) / F.count("*")).alias("score"))
    scored = stored(_met(addresses, sums, "id").drop("id", "fold"))
    least = threshold(scored)
    own = F.lit("allow") if least is None else F.when(F.col("score") < least, "block").otherwise("allow")
    verdicts = scored.select("host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), (F.col("score") / UNIT).alias("score"))
    return _met(urls, verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "score"
    )
