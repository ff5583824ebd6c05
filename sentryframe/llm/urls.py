"""URL filter: host and path rules, then the ratio of two character language models.

The longest rule that fits a url decides it.  The urls so decided are also the accepted and
rejected examples: character models of variable order (contexts of up to ``ORDER`` characters,
Witten-Bell smoothing of each order into the next shorter one, the shortest into a uniform
alphabet) are counted over all of them but every fifth by hash.  A url's score is the sum of the
log-likelihood differences of its characters, divided by their number.  The held-back fifth
calibrates the threshold: the score that gives the smallest sum of both error rates, found in a
histogram of fixed width.  Urls without a rule are allowed from the threshold on.

Everything is a join or an aggregation: counts are summed map-side, a model is a table of grams
and a table of contexts, each distinct window of a url is scored once, and scores are joined to
the windows.  Only the histogram reaches the driver.  Scores are summed as whole millionths, so
the order of rows does not matter.

Null url, or one without ``://``: host and path are empty; a null or empty url is blocked.
Without accepted or rejected examples every score is 0 and the threshold too: allowed.  Repeated
rows and ties are judged alike; null ids come back; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

ORDER = 4
ALPHABET = 256
BEGIN, END = "\x02", "\x03"
#: Width of a bin of the calibration's histogram, and the bins on either side of 0.
BIN, BINS = 0.01, 1000
#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path`` and ``body``, the text that the models read."""
    whole = F.col(f"`{url}`")
    after = F.regexp_extract(whole, r"(?s)^.*?://(.*)$", 1)
    has = F.coalesce(F.contains(whole, F.lit("://")), F.lit(False))
    rest = F.when(has, after).otherwise(F.lit(""))
    return pages.withColumns({
        "host": ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "body": ascii_lower(F.when(has, after).otherwise(F.coalesce(whole, F.lit("")))),
    })


def rule_of(rules=RULES) -> Column:
    """The longest fitting rule as ``rule, verdict``, or null."""
    def fit(verdict: str, host: str, path: str) -> Column:
        here = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        return F.when(here, F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.array_max(F.filter(F.array(*(fit(*r) for r in rules)), lambda x: x.isNotNull()))


def _windows(body: Column) -> Column:
    """Each character of a text with the contexts before it: up to ORDER characters and itself."""
    text = F.concat(F.lit(BEGIN), body, F.lit(END))
    return F.transform(
        F.sequence(F.lit(2), F.length(body) + 2),
        lambda i: F.substr(text, F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))))


def _suffixes(window: Column) -> Column:
    """``k, gram, context`` for each context length of a window."""
    return F.transform(F.sequence(F.lit(1), F.length(window)), lambda k: F.struct(
        (k - 1).alias("k"), F.substr(window, F.length(window) - k + 1, k).alias("gram"),
        F.substr(window, F.length(window) - k + 1, k - 1).alias("context")))


def count_grams(examples: DataFrame) -> DataFrame:
    """``gram, context, n_yes, n_no`` from ``body, verdict``."""
    yes = F.col("verdict") == "allow"
    windows = examples.select("verdict", F.explode(_windows(F.col("body"))).alias("window"))
    summed = windows.groupBy("window").agg(
        F.sum(F.when(yes, 1).otherwise(0)).alias("n_yes"), F.sum(F.when(yes, 0).otherwise(1)).alias("n_no"))
    parts = summed.select(F.inline(_suffixes(F.col("window"))), "n_yes", "n_no")
    return parts.groupBy("gram", "context").agg(F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no"))


def window_scores(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """``window, micro``: log-likelihood difference of a window's last character, in millionths."""
    contexts = grams.groupBy(F.col("context").alias("c")).agg(
        F.sum("n_yes").alias("all_yes"), F.sum(F.when(F.col("n_yes") > 0, 1).otherwise(0)).alias("kinds_yes"),
        F.sum("n_no").alias("all_no"), F.sum(F.when(F.col("n_no") > 0, 1).otherwise(0)).alias("kinds_no"))
    parts = windows.select("window", F.inline(_suffixes(F.col("window"))))
    known = parts.join(contexts, F.col("context") == F.col("c")).join(
        grams.select(F.col("gram").alias("g"), "n_yes", "n_no"), F.col("gram") == F.col("g"), "left")
    orders = known.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(
        "k", F.coalesce("n_yes", F.lit(0)).alias("n_yes"), "all_yes", "kinds_yes",
        F.coalesce("n_no", F.lit(0)).alias("n_no"), "all_no", "kinds_no"))).alias("orders"))

    def chance(side: str) -> Column:
        def finer(p: Column, o: Column) -> Column:
            whole = o[f"all_{side}"] + o[f"kinds_{side}"]
            return F.when(whole > 0, (o[f"n_{side}"] + o[f"kinds_{side}"] * p) / whole).otherwise(p)

        return F.aggregate("orders", F.lit(1.0 / ALPHABET), finer)

    return orders.select("window", F.round((F.log(chance("yes")) - F.log(chance("no"))) * 1_000_000).cast("long").alias("micro"))


def _scores(bodies: DataFrame, grams: DataFrame) -> DataFrame:
    """``body, score`` of distinct bodies."""
    windows = bodies.select("body", F.explode(_windows(F.col("body"))).alias("window"))
    counted = windows.groupBy("body", "window").agg(F.count(F.lit(1)).alias("times"))
    scored = window_scores(windows.select("window").distinct(), grams)
    return counted.join(scored, "window", "left").groupBy("body").agg(
        (F.sum(F.coalesce("micro", F.lit(0)) * F.col("times")) / F.sum("times") / 1_000_000).alias("score"))


def calibrated(examples: DataFrame) -> float:
    """The threshold, from ``verdict, score``, with the fewest errors of both kinds."""
    at = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / BIN))).alias("bin")
    bins: dict[int, dict[str, int]] = {}
    for r in examples.groupBy(at, "verdict").agg(F.count(F.lit(1)).alias("n")).collect():
        bins.setdefault(int(r["bin"]), {})[r["verdict"]] = r["n"]
    yes, no = (sum(b.get(v, 0) for b in bins.values()) for v in ("allow", "block"))
    if not yes or not no:
        return 0.0
    lost, passed, below = 0, no, None
    best, threshold = math.inf, 0.0
    for at_bin in sorted(bins):
        errors = lost / yes + passed / no
        if errors < best:  # half-way to the scores below, as no example tells where between to stop
            best, threshold = errors, BIN * (at_bin if below is None else (at_bin + below + 1) / 2)
        lost += bins[at_bin].get("allow", 0)
        passed -= bins[at_bin].get("block", 0)
        below = at_bin
    return threshold


def judge_urls(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id",), url: str = "url", rules=RULES) -> DataFrame:
    """The ``keep`` columns, ``host``, ``path``, ``rule``, ``score`` and ``verdict``."""
    parts = with_parts(pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{url}`").alias("url")))
    ruled = parts.withColumn("hit", rule_of(rules)).select(
        "kept", "host", "path", "body", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    held = F.pmod(F.xxhash64("body"), F.lit(5)) == 0
    examples = ruled.where(F.col("rule").isNotNull())
    grams = cut(count_grams(examples.where(~held)))
    asked = ruled.where((F.col("rule").isNull() | held) & (F.col("body") != "")).select("body").distinct()
    scores = cut(_scores(asked, grams))
    threshold = calibrated(examples.where(held).select("body", "verdict").join(scores, "body"))
    judged = ruled.join(scores, "body", "left")
    by_model = F.when(F.col("body") == "", "block").when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return judged.select(
        *(F.col("kept")[c].alias(c) for c in keep), "host", "path", "rule", "score",
        F.coalesce("verdict", by_model).alias("verdict"))
