"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

Patterns are windows of ``window`` consecutive words of each benchmark item (a shorter item is
one window).  A table over blocks of two words tells how far the search may jump; a jump of
zero names a bucket of windows that end in that block, which are then compared word by word.

Benchmark items are dealt by hash to blocks of about ``block_bytes``.  Each block is one pass over
the rows: the driver holds the texts of that block only, tasks build its tables, and between two
passes the rows with the spans found so far are written to the checkpoint folder.  No document is
shuffled.  Per document the state is its own hits only.

Null or empty text has no words.  Items without words match nothing; items
without an id mark the words they hit and are named nowhere.  Rows are judged one by
one, so null ids, ties and repeated rows come back as they are; other columns are not read.
An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, map_batches, send, ship

#: Lower-cases A-Z and turns every other ASCII character but a-z and 0-9 into a blank.
WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
HITS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class WuManber:
    """Shift table and suffix buckets for word patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str | None]]):
        self.length, self.width = length, min(2, length)
        self.far = length - self.width + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = defaultdict(dict)
        for words, items in patterns.items():
            for end in range(self.width, length + 1):
                block = words[end - self.width:end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.bucket[words[-self.width:]][words] = sorted(items - {None})

    def search(self, words: list[bytes]):
        """Start of each occurrence and the items it belongs to."""
        length, width, far, shift = self.length, self.width, self.far, self.shift
        end, count = length, len(words)
        while end <= count:
            block = tuple(words[end - width:end])
            jump = shift.get(block, far)
            if jump:
                end += jump
                continue
            items = self.bucket[block].get(tuple(words[end - length:end]))
            if items is not None:
                yield end - length, items
            end += 1


def matchers(rows: list[tuple[str | None, bytes]], window: int) -> list[WuManber]:
    """One matcher for each pattern length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for item, text in rows:
        words = words_of(text)
        length = min(window, len(words))
        if length:
            for start in range(len(words) - length + 1):
                by_length[length][tuple(words[start:start + length])].add(item)
    return [WuManber(length, patterns) for length, patterns in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


class Block:
    """The items of one block; a worker builds their tables once."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int):
        self.rows, self.window = rows, window
        self.built: list[WuManber] | None = None

    def tables(self) -> list[WuManber]:
        if self.built is None:
            self.built, self.rows = matchers(self.rows, self.window), []
        return self.built


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """How many blocks there are, and a function that reads one of them."""
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("words")
    ).where("words is not null")
    size = items.agg(F.sum(F.length("words"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    return count, lambda block: [tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == block).collect()]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20,
) -> DataFrame:
    """The ``keep`` columns of each document with ``n_words``, ``n_hit``, ``item_ids``, ``spans``.

    ``spans`` are merged half-open ranges of word positions.  ``block_bytes`` bounds the
    benchmark text that is sent to the tasks at once.
    """
    spark = docs.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    kept = ", ".join(f"`k{i}` {fields[name]}" for i, name in enumerate(keep))
    first = [F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(keep)]
    found = docs.select(*first, F.col(text).cast("binary").alias("body"))
    for name, kind in (("item_ids", "array<string>"), ("spans", "array<struct<start:int,end:int>>")):
        found = found.withColumn(name, F.array().cast(kind))
    found = found.withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long")})
    order = [*(f"k{i}" for i in range(len(keep))), "body", "n_words", "n_hit", "item_ids", "spans"]
    schema = f"{kept}, body binary, {HITS}"
    count, block_of = _blocks(benchmark, item_id, item_text, block_bytes)
    for number in range(count):
        sent = send(spark, Block(block_of(number), window))
        last = number == count - 1
        found = map_batches(found.select(*order), _scanner(sent, last), schema)
        if not last:
            found = cut(found)
            sent.unpersist()
    return found.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(keep)), "n_words", "n_hit", "item_ids", "spans")


def _scanner(block, last: bool):
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        n_words, n_hit, item_ids, spans = [], [], [], []
        before_items, before_spans = col["item_ids"].to_pylist(), col["spans"].to_pylist()
        for body, had, covered in zip(col["body"], before_items, before_spans):
            words = words_of(body.as_py())
            items, hits = set(had), [(x["start"], x["end"]) for x in covered]
            for matcher in held(block).tables():
                for start, names in matcher.search(words):
                    items.update(names)
                    hits.append((start, start + matcher.length))
            hits = merged(hits)
            n_words.append(len(words))
            n_hit.append(sum(end - start for start, end in hits))
            item_ids.append(sorted(items))
            spans.append([{"start": start, "end": end} for start, end in hits])
        body = pa.nulls(batch.num_rows, pa.binary()) if last else col["body"]
        kept = [(name, value) for name, value in col.items() if name.startswith("k")]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        arrays = [value for _, value in kept] + [
            body, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array(item_ids, pa.list_(pa.string())), pa.array(spans, span),
        ]
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in kept] + ["body", "n_words", "n_hit", "item_ids", "spans"])

    return scan


def items_digest(item_ids: Column) -> Column:
    """SHA-256 of the sorted item ids, joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(item_ids)).cast("binary"), 256)


ship(__name__)
