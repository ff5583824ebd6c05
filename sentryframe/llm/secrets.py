"""Secret scans: fixed forms, and formats learned by grammar inference.

Three fixed forms are searched in every whole text: an assignment to a credential's name, an
access key, a long hex run.  Their values are the labelled credentials.  For each form all its
distinct values of ``SHORTEST`` characters and more, of any length, make a prefix tree over character
classes: every prefix is a state of its own, and what follows it is counted over all values.
Statistically compatible states are merged (Hoeffding bound, red and blue states, whatever
follows them compared to the end), and the automaton's length-normalised log-likelihood scores every other token
of eight characters and more.  A token that reaches the form's threshold, a low quantile of the
scores of all its values, becomes a span as well; one under 16 characters, or without both a
digit and another character, must also be likelier in the form than among the texts' tokens
(character pairs of all distinct tokens, the token itself left out).

A form with under eight distinct values is not learned: a merge cannot be tested on so few.  What
looks like the texts' own words is not found by its format, only behind a name.  The texts are
read twice: once for the distinct values and tokens, once for the spans.  Spark counts; the
driver gets a count for each distinct value in classes, each pair of characters and each score in
``GRAINS``ths: the first grow with the labelled values, none with the tokens or texts.

Offsets are code points, ends exclusive.  Null and empty text have no spans.  Rows are judged
one by one: null ids, ties and repeated rows come back as they are; other columns are not read.
An empty table gives no rows; without labelled values nothing is learned.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, map_batches, map_tasks, send, ship

KINDS = ("assign", "access", "hex")
#: The base forms, over bytes (all of them are ASCII).
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: Values of fewer characters are neither fitted nor scored.
SHORTEST = 8
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{8,}")
TOKEN_TABLE = bytes(b if chr(b).isascii() and (chr(b).isalnum() or b in b"+/_.=-") else 0x20 for b in range(256))
FOLLOWS = bytes(range(0x80, 0xC0))

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def scan_text(raw: bytes) -> tuple[list[tuple[str, int, int, bytes]], list[tuple[str, int, int, bytes]]]:
    """Base spans (kind, start, end, credential) and candidate tokens, by byte offsets."""
    base: list[tuple[str, int, int, bytes]] = []
    lower = raw.lower()
    if any(name in lower for name in NAMES):
        base += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        base += [("access", *m.span(), m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    longest = max(map(len, raw.translate(TOKEN_TABLE).split()), default=0)
    if longest >= 24:
        base += [("hex", *m.span(), m[0]) for m in HEX.finditer(raw)]
    others = []
    if longest >= SHORTEST:
        others = [("format", *m.span(), m[0]) for m in TOKEN.finditer(raw)]
    order = {kind: i for i, kind in enumerate(KINDS)}
    base.sort(key=lambda s: (s[1], order[s[0]]))
    if base:
        others = [s for s in others if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
    return base, others


def in_code_points(raw: bytes, spans: list[tuple[str, int, int, bytes]]) -> list[dict]:
    """Offsets are counted onward from one boundary to the next, so a text is counted once."""
    at, points, where = 0, 0, {}
    for offset in sorted({o for s in spans for o in s[1:3]}):
        points += len(raw[at:offset].translate(None, FOLLOWS))
        at, where[offset] = offset, points
    return [{"kind": k, "start": where[a], "end": where[b], "value": v.decode()} for k, a, b, v in spans]


def _collector(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct labelled values by kind, and the other tokens (no kind)."""
    rows = set()
    for value in batch.column(0):
        base, others = scan_text(value.as_py() or b"")
        rows.update((k, v) for k, _, _, v in base if len(v) >= SHORTEST)
        rows.update(("", v) for _, _, _, v in others)
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.string()), pa.array([v.decode() for _, v in rows], pa.string())], ["kind", "value"])


# ---- grammar inference -------------------------------------------------------------------


def symbols(value: str) -> str:
    """Character classes: d digit, h a-f, l other lower case, u upper case, else the character."""
    return "".join(
        "d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else c
        for c in value
    )


#: How many characters a class stands for.
CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "u": 26}


#: A state is a whole prefix, whatever its length: all its classes tell it.
PLACES = ENDS = sys.maxsize
#: Pairs of states that a test looks at together, and up to how many it follows one by one.
TESTED, FEW = 1 << 16, 16


class Automaton:
    """A probabilistic automaton inferred by merging the states of the prefix tree of all values.

    ``steps`` counts what follows each prefix, ``(length, prefix, class)``, no class at the end of a
    value; the ends say it all, so the others need not be given.  The tree itself is never laid
    out: a blue state is a sorted list of the rests of values that begin there, places in one
    text, and a state under it a slice of that list.  So memory goes with the distinct values (in
    classes), not with their prefixes.
    """

    def __init__(self, steps: dict[tuple[int, str, str], int], alpha: float = 0.05):
        self.scale = math.sqrt(0.5 * math.log(2 / alpha))
        words = sorted((word, n) for (_, word, c), n in steps.items() if not c)
        self.raw = "".join(f"{word}\0" for word, _ in words).encode()
        codes = sorted(set(self.raw))  # the end of a value is class 0
        self.classes = [chr(code) for code in codes]
        table = np.zeros(256, np.uint8)
        table[codes] = np.arange(len(codes))
        self.text = table[np.frombuffer(self.raw, np.uint8)]
        end = np.flatnonzero(self.text == 0)
        self.at, self.end = np.append(0, end[:-1] + 1), end
        self.n = np.array([n for _, n in words], np.int64)
        self.sums = np.append(0, np.cumsum(self.n))
        # Of red states: counts by class, and the state that follows, -1 none and -2 a blue one;
        # of blue ones the slice, the characters behind its places, and rests not sorted in yet.
        wide = len(codes)
        self.rows = self.follows = ()  # the first two as lists
        self.reds, self.count, self.next, self.slice = 0, np.zeros((64, wide), np.int64), np.full((64, wide), -1), np.zeros((64, wide, 3), np.int64)
        self.waiting: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        self.blue: list[tuple[int, int]] = []
        self._merge_all(len(words))
        self._freeze()

    def _split(self, spans: np.ndarray) -> np.ndarray:
        """Where the rests of each class begin in slices (from, to, characters on); the last column is their end."""
        low, high, on = spans.T
        a, z = (np.repeat(x[:, None], len(self.classes) - 1, 1) for x in (low, high))
        last = len(self.at) - 1
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (a + z) >> 1
            undone = a < z
            less = undone & (self.text.take(self.at[np.minimum(middle, last)] + on[:, None], mode="clip") < np.arange(1, len(self.classes)))
            a, z = np.where(less, middle + 1, a), np.where(undone & ~less, middle, z)
        return np.column_stack([low, a, high])

    def _slice_of(self, red: np.ndarray, c: np.ndarray) -> np.ndarray:
        for key in sorted({*zip(red.tolist(), c.tolist(), strict=True)} & self.waiting.keys()) if self.waiting else ():
            self._sort_in(*key)
        return self.slice[red, c]

    def _sort_in(self, red: int, c: int) -> None:
        """The rests that came to a blue state; equal ones become one."""
        low, high, on = self.slice[red, c]
        rests: dict[bytes, list[int]] = {}
        for at, end, n in [(self.at[low:high] + on, self.end[low:high], self.n[low:high]), *self.waiting.pop((red, c))]:
            for p, e, k in zip(at.tolist(), end.tolist(), n.tolist(), strict=True):
                rests.setdefault(self.raw[p:e], [p, e, 0])[2] += k
        at, end, n = np.array([rests[rest] for rest in sorted(rests)], np.int64).T
        self.slice[red, c] = len(self.at), len(self.at) + len(at), 0
        self._lay(np.append(self.at, at), np.append(self.end, end), np.append(self.n, n))

    def _lay(self, at: np.ndarray, end: np.ndarray, n: np.ndarray) -> None:
        self.at, self.end, self.n, self.sums = at, end, n, np.append(0, np.cumsum(n))

    def _close_up(self) -> None:
        """Only the slices of blue states are kept."""
        used, parts = 0, []
        for red, c in self.blue:
            low, high, _ = self.slice[red, c]
            parts.append(np.arange(low, high))
            self.slice[red, c, :2] = used, used + high - low
            used += high - low
        some = np.concatenate(parts)
        self._lay(self.at[some], self.end[some], self.n[some])
        self.room = 4 * used + 1024

    def _differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the shares of what follows differ, by rows of counts."""
        na, nb = a.sum(-1, keepdims=True), b.sum(-1, keepdims=True)
        return (np.abs(a / na - b / nb) > self.scale * (1 / np.sqrt(na) + 1 / np.sqrt(nb))).any(-1)

    def _compatible(self, red: int, span: np.ndarray) -> bool:
        """Nothing that follows both differs, however far on; one value differs from nothing."""
        todo = [(span[None], np.array([red]), np.zeros((1, 3), np.int64))]
        while todo:
            blue, reds, other = todo.pop()
            if len(blue) > TESTED:
                todo.append((blue[TESTED:], reds[TESTED:], other[TESTED:]))
                blue, reds, other = blue[:TESTED], reds[:TESTED], other[:TESTED]
            begin, free = self._split(blue), np.flatnonzero(reds < 0)
            mine, theirs = np.diff(self.sums[begin]), self.count[reds]
            under = np.zeros_like(begin)
            if len(free):
                under[free] = self._split(other[free])
                theirs[free] = np.diff(self.sums[under[free]])
            if self._differ(mine, theirs).any():
                return False
            i, c = np.nonzero((mine[:, 1:] > 1) & (theirs[:, 1:] > 0))
            c += 1
            follows, spans = np.full(len(i), -1), np.column_stack([under[i, c], under[i, c + 1], other[i, 2] + 1])
            known = np.flatnonzero(reds[i] >= 0)
            follows[known] = self.next[reds[i[known]], c[known]]
            leave = np.flatnonzero(follows == -2)
            spans[leave] = self._slice_of(reds[i[leave]], c[leave])
            follows[leave] = -1
            on = (follows >= 0) | (self.sums[spans[:, 1]] - self.sums[spans[:, 0]] > 1)
            if not on.any():
                continue
            blue, reds = np.column_stack([begin[i, c], begin[i, c + 1], blue[i, 2] + 1])[on], follows[on]
            other = np.where(reds[:, None] < 0, spans[on], 0)
            alone = blue[:, 1] - blue[:, 0] == 1
            if len(blue) <= FEW and alone.any():
                if not all(map(self._goes_on, blue[alone].tolist(), reds[alone].tolist(), other[alone].tolist())):
                    return False
                blue, reds, other = blue[~alone], reds[~alone], other[~alone]
            if len(blue):
                todo.append((blue, reds, other))
        return True

    def _goes_on(self, span: list[int], red: int, other: list[int]) -> bool:
        """The same for a slice that is one rest, step by step."""
        at, end, n = int(self.at[span[0]]) + span[2], int(self.end[span[0]]), int(self.n[span[0]])
        while red >= 0:
            c, counts = int(self.text[at]), self.rows[red]
            m = sum(counts)
            if 1 - counts[c] / m > self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m)):
                return False
            if not c or not counts[c]:
                return True
            at, red, state = at + 1, self.follows[red][c], red
            if red == -2:
                other = self._slice_of(np.array([state]), np.array([c]))[0].tolist()
        low, high, on = other
        while high - low > 1:
            c, begin = int(self.text[at]), self._split(np.array([[low, high, on]]))[0]
            counts = np.diff(self.sums[begin])
            m = int(counts.sum())
            if m < 2:
                return True
            if 1 - int(counts[c]) / m > self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m)):
                return False
            if not c or not counts[c]:
                return True
            low, high, on, at = int(begin[c]), int(begin[c + 1]), on + 1, at + 1
        m = int(self.n[low])
        same = self.raw[at:end] == self.raw[int(self.at[low]) + on:int(self.end[low])]
        return same or self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1

    def _redden(self, span: np.ndarray) -> int:
        """A red state with the slice's counts; what follows it is blue."""
        state = self.reds
        if state == len(self.count):
            grow = lambda x, fill: np.concatenate([x, np.full_like(x, fill)])
            self.count, self.next, self.slice = grow(self.count, 0), grow(self.next, -1), grow(self.slice, 0)
        self.reds += 1
        begin = self._split(span[None])[0]
        self.count[state] = np.diff(self.sums[begin])
        for c in np.flatnonzero(self.count[state, 1:]).tolist():
            self.next[state, c + 1], self.slice[state, c + 1] = -2, (begin[c + 1], begin[c + 2], span[2] + 1)
            heapq.heappush(self.blue, (state, c + 1))
        return state

    def _fold(self, red: int, span: np.ndarray) -> None:
        """The rests of the slice go on from ``red``: counted while states are red, else they wait at a blue one."""
        low, high, on = span
        at, end, n, state = self.at[low:high] + on, self.end[low:high], self.n[low:high], np.full(high - low, red)
        while len(at):
            c = self.text[at].astype(np.int64)
            np.add.at(self.count, (state, c), n)
            more = c > 0
            at, end, n, state, c = at[more] + 1, end[more], n[more], state[more], c[more]
            follows = self.next[state, c]
            leave = np.flatnonzero(follows < 0)
            place = state[leave] * len(self.classes) + c[leave]
            leave = leave[np.argsort(place, kind="stable")]
            for some in np.split(leave, np.flatnonzero(np.diff(np.sort(place))) + 1) if len(leave) else ():
                key = int(state[some[0]]), int(c[some[0]])
                if self.next[key] == -1:
                    self.next[key] = -2
                    heapq.heappush(self.blue, key)
                self.waiting.setdefault(key, []).append((at[some], end[some], n[some]))
            stay = follows >= 0
            at, end, n, state = at[stay], end[stay], n[stay], follows[stay]

    def _merge_all(self, values: int) -> None:
        """From the start onward; a state joins the latest red one that it does not differ from."""
        self.room = 4 * values + 1024
        self._redden(np.array([0, values, 0]))
        while self.blue:
            if len(self.at) > self.room:
                self._close_up()
            source, c = self.blue[0]
            self._slice_of(np.array([source]), np.array([c]))
            heapq.heappop(self.blue)
            span = self.slice[source, c].copy()
            mine = np.diff(self.sums[self._split(span[None])])
            self.rows, self.follows = self.count[:self.reds].tolist(), self.next[:self.reds].tolist()
            for red in np.flatnonzero(~self._differ(mine, self.count[:self.reds]))[::-1].tolist():
                if self._compatible(red, span):
                    self.next[source, c] = red
                    self._fold(red, span)
                    break
            else:
                self.next[source, c] = self._redden(span)

    def _freeze(self) -> None:
        """What scoring needs, by state: cost and next state of each class, cost of the end."""
        self.cost: dict[int, tuple[dict[str, tuple[float, int]], float]] = {}
        for state in range(self.reds):
            stop, *counts = self.count[state].tolist()
            n = stop + sum(counts)
            of = {c: (math.log(k / n / CLASS_SIZE.get(c, 1)), int(self.next[state, i]))
                  for i, (c, k) in enumerate(zip(self.classes[1:], counts, strict=True), 1) if k}
            self.cost[state] = (of, math.log(stop / n) if stop else -math.inf)
        del self.raw, self.text, self.at, self.end, self.n, self.sums, self.count, self.next, self.slice, self.waiting, self.blue
        del self.rows, self.follows

    def score(self, value: str) -> float:
        """Mean log-likelihood of a character; minus infinity outside the language."""
        state, total = 0, 0.0
        for c in symbols(value):
            step = self.cost[state][0].get(c)
            if step is None:
                return -math.inf
            total += step[0]
            state = step[1]
        return (total + self.cost[state][1]) / (len(value) + 1)


class Pairs:
    """Character pairs of all tokens, a space at both ends; a token is scored without its own."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pair = Counter(pairs)
        self.single: Counter[str] = Counter()
        self.before: Counter[str] = Counter()
        for (a, b), n in pairs.items():
            self.single[b] += n
            self.before[a] += n
        self.all = sum(self.single.values())

    def score(self, value: str) -> float:
        """Mean log-likelihood of a character of one of the tokens."""
        own = list(pairwise(f" {value} "))
        pair, single, before = Counter(own), Counter(b for _, b in own), Counter(a for a, _ in own)
        total = 0.0
        for a, b in own:
            alone = (self.single[b] - single[b] + 1) / (self.all - len(own) + TOKEN_CHARS + 1)
            total += math.log((self.pair[a, b] - pair[a, b] + PRIOR * alone) / (self.before[a] - before[a] + PRIOR))
        return total / len(own)


#: Characters of a token; weight of the single character against the pair, in counts.
TOKEN_CHARS, PRIOR = 68, 8.0


#: Scores are counted in steps of 1 / GRAINS, thresholds rounded down to one.
GRAINS = 10_000


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values in classes by kind, and character pairs of the tokens (no kind)."""
    counts = lambda rows: pa.RecordBatch.from_arrays(
        [*(pa.array([row[i] for row in rows], pa.string()) for i in range(3)), pa.array(rows.values(), pa.int64())], ["kind", "word", "follows", "n"])
    pairs = np.zeros(1 << 16, np.int64)
    for batch in batches:
        tokens, words = [], Counter()
        for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if kind:
                words[kind, symbols(value), ""] += 1
            else:
                tokens.append(value)
        if tokens:
            raw = np.frombuffer(f" {' '.join(tokens)} ".encode(), np.uint8).astype(np.int64)
            pairs += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)
        yield counts(words)
    yield counts({("", chr(i >> 8), chr(i & 255)): int(pairs[i]) for i in pairs.nonzero()[0]})


def _grader(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, seen = held(sent), Counter()
        for batch in batches:
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[kind, math.floor(models[kind].score(value) * GRAINS)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.string()), pa.array([g for _, g in seen], pa.int64()), pa.array(seen.values(), pa.int64())],
            ["kind", "grade", "n"])

    return run


def fit(seen: DataFrame, quantile: float) -> Formats:
    """The formats of distinct ``kind, value`` rows: counts and thresholds over all of them."""
    counted = map_tasks(seen, _counter, "kind string, word string, follows string, n long")
    counts: dict[str, dict] = {}
    for part in counted.groupBy("kind", "word", "follows").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for kind, word, follows, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            counts.setdefault(kind, {})[(len(word), word, follows) if kind else (word, follows)] = n
    ordinary = Pairs(counts.pop("", {}))
    size = {kind: sum(of.values()) for kind, of in counts.items()}
    models = {kind: Automaton(counts.pop(kind)) for kind in sorted(counts) if size[kind] >= 8}
    if not models:
        return Formats({}, ordinary)
    graded = map_tasks(seen.where(F.col("kind").isin(*models)), _grader(send(seen.sparkSession, models)), "kind string, grade long, n long")
    grades: dict[str, list[tuple[int, int]]] = {}
    for r in graded.groupBy("kind", "grade").agg(F.sum("n").alias("n")).collect():
        grades.setdefault(r["kind"], []).append((r["grade"], r["n"]))
    return Formats({k: (m, least(grades[k], int(quantile * size[k])) / GRAINS) for k, m in models.items()}, ordinary)


def least(grades: list[tuple[int, int]], below: int) -> int:
    """The grade that has at most ``below`` values under it and, with its own, more."""
    for grade, n in sorted(grades):
        if below < n:
            break
        below -= n
    return grade


class Formats:
    """The learned formats beside the ordinary tokens."""

    def __init__(self, models: dict[str, tuple[Automaton, float]], ordinary: Pairs):
        self.models, self.ordinary = models, ordinary

    def accepts(self, token: str) -> bool:
        scores = [score for model, least in self.models.values() if (score := model.score(token)) >= least]
        if not scores:
            return False
        if len(token) >= 16 and any("0" <= c <= "9" for c in token) and any(c > "9" for c in token):
            return True
        return max(scores) > self.ordinary.score(token)


def _scanner(formats):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, learned, said = [], [], {}
        accepts = held(formats).accepts
        for value in batch.column(1):
            raw = value.as_py() or b""
            first, others = scan_text(raw)
            found = []
            for span in others:
                token = span[3]
                if token not in said:
                    said[token] = accepts(token.decode())
                if said[token]:
                    found.append(span)
            base.append(in_code_points(raw, first))
            learned.append(in_code_points(raw, found))
        kind = pa.list_(SPAN)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, kind), pa.array(learned, kind)], ["kept", "base", "learned"])

    return run


def find_secrets(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", quantile: float = 0.02) -> DataFrame:
    """The ``keep`` columns with ``base`` and ``learned``: arrays of ``kind, start, end, value``."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{text}`").cast("binary").alias("raw"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    seen = cut(map_batches(rows.select("raw"), _collector, "kind string, value string").distinct())
    formats = send(docs.sparkSession, fit(seen, quantile))
    found = map_batches(rows, _scanner(formats), f"kept {kept_type}, base {SPANS}, learned {SPANS}")
    return found.select(*(F.col("kept")[c].alias(c) for c in keep), "base", "learned")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined, in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column) -> Column:
    """By start, then kind as listed, learned formats last."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit(0)), F.lit(len(KINDS) + 1))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


ship(__name__)
