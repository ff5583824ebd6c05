"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, first=0):
    rows = [(first + i, t, (langs or {}).get(i), "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=None):
    rng = random.Random(seed)
    vocabulary = words or [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "r", "st", "")]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def awkward(spark):
    """Rows that any operator must take."""
    long_text = prose(1, 40_000)
    texts = ["", None, " \t\n", "one", "a b c", long_text, long_text, "x\n\ny\n", "\x00\x01", "é 日本 😀", "%%% ### ***"]
    df = documents(spark, texts, {5: "en", 6: None, 3: "xx"})
    more = spark.createDataFrame([(None, "no id here", None, None, None), (3, "one", "xx", "s", 3)], SCHEMA)
    return df.unionByName(more)


#: Names that operators use inside or give to results.
CLASHES = ("key", "kept", "body", "n_words", "item_ids", "spans", "n", "digest", "sketch", "u", "v", "component", "score",
           "lang_pred", "words", "lines", "h", "g", "at", "k0", "t0", "base", "ids", "decoded", "host", "path", "rule", "verdict", "hit",
           "n_lines", "n_removed", "thread", "msg", "formatted", "raw")


def clashing(df):
    names = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in names})
