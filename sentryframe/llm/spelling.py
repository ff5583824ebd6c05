"""Groups of spelling variants among the words of a corpus, by blocked Gram matrices.

1. Words (runs of letters) are counted: each task sums what it has read, Spark adds the sums.
2. A word is its vector of letter counts.  One inserted or deleted letter moves that vector by a
   squared distance of 1, one replaced letter by 2, so only pairs at most 2 apart, of equal or
   adjacent length, can be near.
3. Length blocks are cut further by the sums of ten classes of letters, which an edit moves as
   little: a word is at home in its cell of (length, class sums) and a guest in the cells one
   letter shorter, or as long and earlier in order.  Which cells meet is settled on the table of
   cells; their words are then dealt in blocks (``blocks``) by one shuffle.
4. In a unit, a matrix product of the letter counts gives all squared distances, and the pairs
   left are verified position by position.  A unit returns sums per word, no pairs.
5. A word's form is its near word that occurs most; roots follow forms word by word.

Work grows with the pairs inside neighbouring cells, what is shuffled with the words (at most 56
short rows each) and, for cells beyond a block, with the pairs of blocks.

Null text has no words.  A null id alters no word.  Repeated rows count again.  Ties between
forms go to the smallest word in code-point order.  Other columns are not read, so their names
do not matter.  Very long words weigh more in a block.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, each_unit, place, turns
from .common import cut, map_tasks, ship

#: Words that a task sums before it hands them on, words of a block, and homes multiplied at once.
HELD, BLOCK, ROWS = 200_000, 4096, 256

#: Classes of common letters; all other letters are one more class.
CLASSES = ("e", "t", "a", "oy", "i", "nv", "sp", "rg", "lh")

#: Weight of a class in a cell's key.  Counts of 128 and more run over and merge cells of one length,
#: which costs comparisons only: words one edit apart differ by one move, whatever the key means.
WEIGHTS = tuple(1 << 7 * i for i in range(len(CLASSES)))

#: Letters: a-z, then the code points from C0 to FF.
LETTERS = 26 + 64

#: Bytes of letters gathered at once when pairs are verified.
GATHER = 4 << 20


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2,
                typo_every: int | None = None) -> DataFrame:
    """``word, n``: words of at least ``shortest`` letters that occur at least ``least`` times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased.  With
    ``typo_every``, a run whose crc32 together with the id is divisible by that number loses the
    letter that the crc32 names.
    """
    found = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}").findall

    def words_of(name, value: str, into: Counter) -> None:
        runs = Counter(found(value.encode().lower().decode()))  # bytes: only A-Z are lowered
        if not typo_every or name is None:
            into.update(runs)
            return
        seed = zlib.crc32(f"{name}:".encode())
        for run, n in runs.items():
            h = zlib.crc32(run.encode(), seed)
            if h % typo_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < shortest:
                    continue
            into[run] += n

    def sums(total: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                if value.is_valid:
                    words_of(name.as_py(), value.as_py(), total)
                if len(total) > HELD:
                    yield sums(total)
                    total.clear()
        if total:
            yield sums(total)

    slim = docs.select(F.col(doc_id).alias("name"), F.col(text).alias("value"))
    counted = map_tasks(slim, count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _homes(words: DataFrame) -> DataFrame:
    """The words with the cell they are at home in, ``size`` and ``key``."""
    held = [F.length("word") - F.length(F.translate("word", letters, "")) for letters in CLASSES]
    key = sum((n.cast("long") * F.lit(w).cast("long") for n, w in zip(held, WEIGHTS)), F.lit(0).cast("long"))
    return words.withColumn("size", F.length("word")).withColumn("key", key)


def _routes(homes: DataFrame, weight: Column) -> DataFrame:
    """``size, key, to_size, to_key, home, homes, guests, turn``: where the words of a cell go.

    A word of a deleted letter is a guest one letter shorter; a word of a replaced one in the cell
    that holds a letter of a later class instead.
    """
    cells = cut(homes.groupBy("size", "key").agg(F.sum(weight).alias("heavy")))
    moves = [(-1, -w) for w in (*WEIGHTS, 0)]
    moves += [(0, v - w) for i, w in enumerate(WEIGHTS) for v in (*WEIGHTS[i + 1:], 0)]
    # One constant array: the moves are added after the explosion.
    steps = F.array(*[F.struct(F.lit(by).alias("by"), F.lit(of).cast("long").alias("of")) for by, of in moves])
    guests = cells.withColumn("_m", F.explode(steps)).select(
        "size", "key", "heavy", (F.col("size") + F.col("_m.by")).alias("to_size"), (F.col("key") + F.col("_m.of")).alias("to_key"))
    there = cells.select(F.col("size").alias("to_size"), F.col("key").alias("to_key"), F.col("heavy").alias("held"))
    met = cut(guests.join(there, ["to_key", "to_size"]))
    own = cells.select("size", "key", "heavy", F.col("size").alias("to_size"), F.col("key").alias("to_key"))
    load = met.groupBy("to_size", "to_key").agg(F.sum("heavy").alias("come"))
    n_homes, n_guests = blocks(F.col("held"), F.coalesce("come", F.lit(0.0)), BLOCK)
    sized = there.join(load, ["to_size", "to_key"], "left").select(
        "to_size", "to_key", n_homes.alias("homes"), n_guests.alias("guests"))
    ways = met.select("size", "key", "to_size", "to_key", F.lit(False).alias("home")).unionByName(
        own.select("size", "key", "to_size", "to_key", F.lit(True).alias("home"))).join(sized, ["to_size", "to_key"])
    return ways.withColumn("turn", F.explode(turns(F.col("home"), F.col("homes"), F.col("guests"))))


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of letter counts, the letters of all words one after another, and where each word begins."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    code = np.where(letters >= 0xC0, letters.astype(np.int64) - 0xC0 + 26, letters.astype(np.int64) - 97)
    row = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(row * LETTERS + code, minlength=len(words) * LETTERS).reshape(-1, LETTERS)
    return counts.astype(np.float64), letters, np.concatenate([[0], np.cumsum(sizes)])


def near_pairs(words: list[str], homes: int, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs exactly one edit apart, of the first ``homes`` words (of one length)
    with the others, and with each other if ``inner``."""
    counts, letters, start = letter_counts(words)
    size = int(start[1] - start[0])
    # Whole numbers below 2^24: single precision is exact.
    counts = counts[:, counts.any(0)].astype(np.float32 if size < 2000 else np.float64)
    square, one = (counts * counts).sum(1, keepdims=True), np.ones((len(words), 1), counts.dtype)
    left_side, right_side = np.hstack([counts[:homes], square[:homes], one[:homes]]), np.hstack([-2 * counts, one, square]).T
    first, spread, out = 0 if inner else homes, np.arange(size), []
    for lo in range(0, homes, ROWS):
        skip = max(first, lo if inner else 0)
        apart = left_side[lo:lo + ROWS] @ right_side[:, skip:]
        a, b = np.nonzero(apart <= 2)
        a, b = a + lo, b + skip
        later = b > a
        out.append(_verified(a[later], b[later], letters, start, spread))
    left, right = (np.concatenate(x) for x in zip(*out))
    return left, right


def _verified(left, right, letters, start, spread) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are one edit apart; words of ``right`` are as long as those of ``left`` or one letter longer."""
    size, keep = len(spread), np.zeros(len(left), bool)
    step = max(1, GATHER // (size + 1))
    for lo in range(0, len(left), step):
        a, b = left[lo:lo + step], right[lo:lo + step]
        first = letters[start[a][:, None] + spread]
        ahead = first == letters[start[b][:, None] + spread]
        longer = start[b + 1] - start[b] > size
        # One place differs; or what goes before and what goes behind the added letter cover the shorter word.
        near = (size - ahead.sum(1)) == 1
        if longer.any():
            behind = first[longer] == letters[start[b[longer]][:, None] + spread + 1]
            before = np.logical_and.accumulate(ahead[longer], 1).sum(1)
            after = np.logical_and.accumulate(behind[:, ::-1], 1).sum(1)
            near[longer] = before + after >= size
        keep[lo:lo + step] = near
    return left[keep], right[keep]


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: near words of each word that has any, and the one that occurs most."""

    def unit(table: pa.Table, homes: int, inner: bool) -> pa.RecordBatch | None:
        names, n = table["word"].to_pylist(), table["n"].to_pylist()
        left, right = near_pairs(names, homes, inner)
        if not len(left):
            return None
        one, other = np.concatenate([left, right]), np.concatenate([right, left])
        met = np.unique(one)
        order = np.array(sorted(met.tolist(), key=lambda x: (-n[x], names[x])))
        rank, best = np.empty(len(names), np.int64), np.full(len(names), len(names))
        rank[order] = np.arange(len(order))
        np.minimum.at(best, one, rank[other])
        first = order[best[met]].tolist()
        return pa.record_batch(
            [pa.array([names[x] for x in met.tolist()]), pa.array(np.bincount(one)[met]), pa.array([n[x] for x in first]),
             pa.array([names[x] for x in first])], ["word", "n_near", "best_n", "best"])

    homes = cut(_homes(words))
    # A long word weighs by its letters: they are held beside the counts.
    routes = _routes(homes, F.greatest(F.lit(1.0), F.col("size") / 256.0))
    way = homes.join(routes, ["size", "key"]).select(
        F.col("to_key").alias("key"), F.col("to_size").alias("size"), "word", "n",
        *place(F.col("home"), F.col("turn"), F.xxhash64("word"), F.col("homes"), F.col("guests")))
    parts = each_unit(way, ["key", "size"], unit, "word string, n_near long, best_n long, best string")
    return parts.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"),
    ).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for a table ``word, form``: the end of the way from form to form.

    A form occurs at least twice as often as its word (see ``group_variants``), so a way ends
    after a number of steps bounded by the logarithm of the largest count.
    """
    way = forms.select("word", F.col("form").alias("root"))
    while True:
        step = forms.select(F.col("word").alias("root"), F.col("form").alias("further"))
        way = cut(way.join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")))
        if way.where("open").isEmpty():
            return way.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct ``word, n``.

    The form of a word is its near word of largest ``n``, if that is at least ``ratio`` (two or
    more) times the word's own; the root is where forms lead.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often as its word")
    words = cut(words)
    has = F.col("best_n") >= ratio * F.col("n")
    found = cut(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ship(__name__)
