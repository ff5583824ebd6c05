"""Quality rules as a bitmask ledger, in built-in functions only.

``measure`` takes each text once and stores its measurements and one failure bit per rule;
a policy is a named mask over those bits, so a new policy version never reads a text again.
``ablate`` counts, by bitwise aggregation, what each rule of a policy rejects on its own.

Every measure is taken inside the row's own arrays: no text is exploded and nothing is
shuffled.  Null text counts as empty: no words, every count zero, the short-text bit set.
Rows are judged one by one, so null ids, ties, repeated rows and empty tables need no care;
columns other than those named are not read and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[ \t-\r]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: name: failure, over the columns that ``measure`` makes; a rule's bit is its position here.
RULES: dict[str, Column] = {}


def rule(name: str):
    return lambda make: RULES.setdefault(name, make)


@rule("few_words")
def _few_words() -> Column:
    return F.col("n_words") < 20


@rule("repeated_words")
def _repeated_words() -> Column:
    return 100 * F.col("n_repeat_words") > 30 * F.col("n_words")


@rule("symbols")
def _symbols() -> Column:
    """More symbols than words; a table of one bar per cell stays below."""
    return F.col("n_symbols") > F.col("n_words")


@rule("repeated_lines")
def _repeated_lines() -> Column:
    """Three repeats at least: one line said twice in a short text is no fault."""
    return (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))


@rule("word_length")
def _word_length() -> Column:
    return ~F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words"))


#: Policy versions: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}


def mask_of(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(name) for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more.

    Windows are compared by two independent 64-bit hashes.  They are sorted by hash, those
    with an equal neighbour kept, and their positions merged into covered words.
    """

    def covered(keyed: Column) -> Column:
        twice = F.filter(
            keyed,
            lambda x, i: _same(x, F.get(keyed, i - 1)) | _same(x, F.get(keyed, i + 1)),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["at"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - at, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, x: total + x,
        ))

    def by_words(w: Column) -> Column:
        def key(i: Column) -> Column:
            part = F.slice(w, i + 1, WINDOW)
            return F.xxhash64(part)

        keys = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), key)
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(F.transform(k, lambda x, i: F.struct(
                x.alias("h"), F.hash(F.slice(w, i + 1, WINDOW)).alias("g"), i.alias("at"),
            ))), covered)))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(words, by_words))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))


def measure(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, the measurements of each text and ``fail_bits``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), body.alias("body"),
        F.filter(F.split(body, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda line: F.translate(line, SPACE_CHARS, "") != "").alias("lines"),
    )
    measured = rows.select(
        "kept",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    bits = sum(
        (F.when(make(), F.lit(1 << i)).otherwise(F.lit(0)) for i, make in enumerate(RULES.values())), F.lit(0)
    )
    ledger = measured.withColumn("fail_bits", bits.cast("long"))
    return ledger.select(*(F.col("kept")[c].alias(c) for c in keep), *(c for c in ledger.columns if c != "kept"))


def verdict(policy: str) -> Column:
    """True where no rule of the policy has failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) == 0


def ablate(ledger: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: rows that fail it, and rows that only it rejects.

    One pass: the bits that matter are aggregated by their value first, so at most two to the
    number of rules rows are expanded.
    """
    counts = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*(
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask_of(p)).cast("long").alias("mask"),
                 F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
        for p in policies for r in POLICIES[p]
    ))
    each = counts.select("fail_bits", "n", F.inline(wanted))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum("n").alias("n_rows"),
    )
