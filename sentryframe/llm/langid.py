"""Language identification by rank-order profiles of character n-grams.

A document's most frequent 1- to 3-grams, in order of count, are compared with each language's
profile: the out-of-place distance sums how far each gram stands from its place in the
profile, and a gram the profile lacks counts the profile's whole length.  The language with the
smallest distance wins (ties: the smaller name).  Every text is counted whole.

Profiles come from labelled rows only, from a sample of about ``sample_per_language`` rows of
each language, drawn by a hash of the row's key; this bound is a parameter, as profiles settle after a few
hundred texts.  Counts of the sample are aggregated in Spark; only the profiles, at most
``profile_size`` grams for each language, reach the driver.

Null text and text without a letter are ``und`` with score 0; so is everything when no labelled
row exists.  Rows are judged one by one: null ids, ties and repeated rows come back as they
are; other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import held, map_batches, send, ship

UNKNOWN = "und"
RUNS = re.compile(r"[^\W\d_]+")
#: Code points take 21 bits, so three of them fill one integer.
BITS = 21


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """1-, 2- and 3-grams of a text's words between blanks, as packed code points, and their counts.

    Distinct words are laid side by side with one blank between them, so all grams are formed at
    once: every pair lies in a word and its blanks, and so does a triple unless its middle is a blank.
    """
    words = Counter(RUNS.findall(text.lower()))
    names = [w for w in words if w.isalpha() or any(map(str.isalpha, w))]
    if not names:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {' '.join(names)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    times = np.zeros(len(codes), np.int64)
    times[1:] = np.repeat([words[w] for w in names], [len(w) + 1 for w in names])
    blank = codes == 32
    pairs = (codes[:-1] << BITS) | codes[1:]
    triples, inside = (pairs[:-1] << BITS) | codes[2:], ~blank[1:-1]
    grams = np.concatenate([codes[~blank], pairs, triples[inside]])
    counts = np.concatenate([times[~blank], np.where(blank[:-1], times[1:], times[:-1]), times[1:-1][inside]])
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams first; ties by gram."""
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Places of grams in each language's profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.languages = size, sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.place = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for row, name in enumerate(self.languages):
            at = np.searchsorted(self.grams, np.array(profiles[name], np.int64))
            self.place[row, at] = np.arange(len(at))

    def judge(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.size)
        at = np.searchsorted(self.grams, top)
        at[(at >= len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        place = self.place[:, at]
        distance = np.where(place < 0, self.size, np.abs(place - np.arange(len(top)))).sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(top))


def _counter(batch: pa.RecordBatch) -> pa.RecordBatch:
    sums: dict[str, list] = {}
    for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        codes, counts = count_grams(text.as_py())
        sums.setdefault(language, []).append((codes, counts))
    names, all_codes, all_counts = [], [], []
    for language, parts in sums.items():
        codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        names += [language] * len(codes)
        all_codes.append(codes)
        all_counts.append(np.bincount(back, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64))
    join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), join(all_codes), join(all_counts)], ["language", "gram", "n"])


def learn(
    docs: DataFrame, usable: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
    profile_size: int = 300, sample_per_language: int = 2000,
) -> Profiles:
    """Profiles from the rows for which ``usable`` holds."""
    labelled = docs.where(usable).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("language"), F.col(f"`{text}`").alias("body"),
    ).where("language is not null and body is not null")
    sizes = {r["language"]: r["n"] for r in labelled.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({}, profile_size)
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    drawn = F.lit(False)
    for name, n in sorted(sizes.items()):
        drawn = drawn | ((F.col("language") == name) & (share < max(1, (sample_per_language << 40) // n)))
    counts = map_batches(labelled.where(drawn).select("language", "body"), _counter, "language string, gram long, n long")
    summed = counts.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("language").orderBy(F.col("n").desc(), "gram"))
    top = summed.withColumn("place", place).where(F.col("place") <= profile_size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["language"], r["place"])):
        profiles.setdefault(r["language"], []).append(r["gram"])
    return Profiles(profiles, profile_size)


def _judge(profiles):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for text in batch.column(1):
            value = text.as_py()
            name, score = held(profiles).judge(*count_grams(value)) if value else (UNKNOWN, 0.0)
            names.append(name)
            scores.append(score)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["kept", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score`` (1: every gram in its place)."""
    sent = send(docs.sparkSession, profiles)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{text}`").alias("body"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    judged = map_batches(rows, _judge(sent), f"kept {kept_type}, lang_pred string, score double")
    return judged.select(*(F.col("kept")[c].alias(c) for c in keep), "lang_pred", "score")


def held_out(key: str = "doc_id") -> Column:
    """Rows kept away from learning: crc32 of the id's text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


ship(__name__)
