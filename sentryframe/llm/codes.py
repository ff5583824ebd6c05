"""Vector codes by product quantisation in whole numbers, with memoised grid cells.

Components become integers, vectors are cut into equal parts and each part position has a
codebook.  A round assigns every part to the nearest entry and replaces the entries by the
floored means of their parts.  Finding the nearest entry:

1. A part falls into a coarse cell of a grid over its space (``CELL`` wide in each direction).
2. For a cell seen first, the least and greatest distance of every entry to its box are found;
   an entry whose least distance exceeds some other's greatest is dominated in the whole cell.
   The entries that are left are remembered under the cell.
3. Only those are evaluated exactly, in order of their index, so that ties go to the lower one.

Tasks return sums and counts per entry, which Spark adds up; only the codebooks (parts x
entries) reach the driver and go out with the next round.  No key deals out vectors.

Vectors that are null or hold null or non-finite components are dropped.  The largest length
among the others counts; shorter ones cannot be cut into the same parts: they get a null code
and error and take no part in codebooks.  A length that is no multiple of the parts is an error, as is
a component too large for exact 64-bit distances.  Codebooks start from the smallest ids; of
repeated ids the smallest vector counts, a null id is coded but starts nothing.  With fewer vectors than
entries, codebooks are smaller.  Other columns pass through ``keep`` only; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, held, send, sha256_hex, ship

#: Width of a grid cell, and cells remembered per part before a task starts anew.
CELL, REMEMBERED = 1024, 1 << 16


def usable(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


class Nearest:
    """The nearest entry of one codebook for parts of vectors."""

    def __init__(self, entries: np.ndarray, cell: int = CELL):
        self.entries, self.cell, self.known = entries, cell, {}

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, bits of the entries that no other entry dominates in its whole box."""
        low = cells[:, None, :] * self.cell
        high = low + (self.cell - 1)
        least = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
        most = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
        least, most = (least * least).sum(2), (most * most).sum(2)
        return ((least <= most.min(1, keepdims=True)) << np.arange(len(self.entries))).sum(1)

    def masks(self, parts: np.ndarray) -> np.ndarray:
        cells, place = np.unique(parts // self.cell, axis=0, return_inverse=True)
        names = [c.tobytes() for c in cells]
        fresh = [i for i, name in enumerate(names) if name not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, list(range(len(names)))
        for lo in range(0, len(fresh), 1024):
            some = fresh[lo:lo + 1024]
            self.known.update(zip((names[i] for i in some), self.candidates(cells[some]).tolist()))
        return np.array([self.known[name] for name in names], np.int64)[place.ravel()]

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance; ties go to the lower index."""
        masks = self.masks(parts)
        index, least = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks >> e & 1)
            away = parts[rows] - entry
            away = (away * away).sum(1)
            closer = away < least[rows]
            index[rows[closer]], least[rows[closer]] = e, away[closer]
        return index, least


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number vectors of the given length as rows, and which rows those are."""
    lengths = np.diff(column.offsets.to_numpy())
    fits = (lengths == size) & (size > 0)
    rows = np.flatnonzero(fits)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values[np.repeat(fits, lengths)].reshape(len(rows), size), rows


def _sums(vectors: DataFrame, codebooks: list[np.ndarray], size: int) -> DataFrame:
    """``part, entry, sums, count``: what each task's parts add to the entries nearest to them."""
    books, width = send(vectors.sparkSession, codebooks), size // len(codebooks)

    def run(batches):
        find = [Nearest(book) for book in held(books)]
        sums = np.zeros((len(find), len(find[0].entries), width), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for batch in batches:
            rows, _ = _matrix(batch.column(0), size)
            for p, nearest in enumerate(find if len(rows) else ()):
                parts = rows[:, p * width:(p + 1) * width]
                index, _ = nearest(parts)
                counts[p] += np.bincount(index, minlength=counts.shape[1])
                for e in np.unique(index):
                    sums[p, e] += parts[index == e].sum(0)
        p, e = np.nonzero(counts)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(list(sums[p, e]), pa.list_(pa.int64())),
                               pa.array(counts[p, e])], ["part", "entry", "sums", "count"])

    added = vectors.select("whole").mapInArrow(run, "part int, entry int, sums array<long>, count long")
    return added.select("part", "entry", "count", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(
        F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("count").alias("count"))


def learn(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` of assignment and flooring of means."""
    start = vectors.where(F.col("_id").isNotNull() & (F.size("whole") == size) & (F.size("whole") > 0)).groupBy("_id").agg(
        F.min("whole").alias("whole")).orderBy("_id").limit(entries).collect()
    width = size // parts
    first = np.array([r["whole"] for r in start], np.int64).reshape(len(start), parts, width)
    codebooks = [first[:, p].copy() for p in range(parts)]
    for _ in range(rounds if start else 0):
        # Bounded: a row for each component of each entry.
        for r in _sums(vectors, codebooks, size).collect():
            codebooks[r["part"]][r["entry"], r["at"]] = int(r["sum"]) // r["count"]
    return codebooks


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (),
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """The kept rows with ``code`` (index of the entry of each part), ``error`` and the columns of ``keep``,
    and the codebooks.  ``error`` sums the squared distances of the parts."""
    if entries > 62:
        raise ValueError("the bits of a cell's entries are one long")
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    vectors = cut(df.where(usable(F.col(vector))).select(
        F.col(vec_id).alias("_id"), whole.alias("whole"), F.struct(*[df[c].alias(c) for c in keep] or [F.lit(0)]).alias("_keep")))
    at = vectors.select(F.max(F.size("whole")).alias("size"), F.max(F.array_max(F.transform("whole", F.abs))).alias("most")).first()
    size, most = at["size"] or 0, at["most"] or 0
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    if 16 * size * (most + CELL) ** 2 >= 2**63:
        raise ValueError(f"components up to {most / scale} are too large for exact distances")
    codebooks = learn(vectors, size, parts, entries, rounds)
    books, width = send(df.sparkSession, codebooks), size // parts

    def run(batches):
        find = [Nearest(book) for book in held(books)]
        for batch in batches:
            rows, where = _matrix(batch.column("whole"), size)
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            found = [nearest(rows[:, p * width:(p + 1) * width]) for p, nearest in enumerate(find)] if len(rows) else [((), ())]
            for at, error, *code in zip(where.tolist(), sum(np.asarray(d) for _, d in found).tolist(), *(i for i, _ in found)):
                codes[at], errors[at] = [int(i) for i in code], error
            yield pa.record_batch([batch.column("_id"), batch.column("_keep"), pa.array(codes, pa.list_(pa.int32())),
                                   pa.array(errors, pa.int64())], ["_id", "_keep", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    coded = vectors.mapInArrow(run, f"_id {kinds['_id']}, _keep {kinds['_keep']}, code array<int>, error long")
    return coded.select(F.col("_id").alias(vec_id), *[F.col("_keep")[c].alias(c) for c in keep], "code", "error"), codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return sha256_hex(",".join(str(x) for book in codebooks for x in book.ravel().tolist()))


ship(__name__)
