"""Helpers shared by the operators: batches, column names, tables, lineage."""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage_cut import cut

#: Bytes of a batch that a Python function sees at once; a longer single row still comes whole.
PIECE_BYTES = 4 << 20

#: Rows of an Arrow batch: both sides hold batches of whole texts outside the JVM's heap.
BATCH_ROWS = 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["PIECE_BYTES", "ascii_lower", "cut", "held", "let", "map_batches", "map_tasks", "pieces", "read", "send", "sha256_hex", "ship"]


def ship(module: str) -> None:
    """Send a module's functions with the task, so that executors need no copy of this package."""
    register_pickle_by_value(sys.modules[module])


def send(spark, value):
    """Broadcast an object of this package by value, for :func:`held` to unpack."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(value)])


def held(sent):
    """The object that was sent; a worker unpacks it once and keeps it from task to task."""
    box = sent.value
    if isinstance(box[0], bytes):
        box[0] = pickle.loads(box[0])
    return box[0]


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes each."""
    rows = batch.num_rows
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, min(step, rows - start))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to every batch of the rows, a few megabytes at a time.

    Arrow batches hold at most BATCH_ROWS rows, unless the session names a number itself.
    """
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(rows, None) in (None, "10000"):
        conf.set(rows, str(BATCH_ROWS))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                yield function(piece)

    return df.mapInArrow(run, schema)


def map_tasks(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function to all batches of a task one after another, sized as in :func:`map_batches`."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(rows, None) in (None, "10000"):
        conf.set(rows, str(BATCH_ROWS))

    def run(batches):
        yield from function(piece for batch in batches for piece in pieces(batch))

    return df.mapInArrow(run, schema)


ship(__name__)
