"""Cells of rows that are compared with each other, dealt to tasks in blocks of bounded size.

A row is at *home* in one cell and a *guest* in others; a pair is met where one of its rows is
at home and the other is at home or a guest.  A cell of any size is cut into blocks: every
block of homes meets itself, each other block of homes and each block of guests in a unit of
its own, so a hot cell spreads over as many tasks as it has pairs of blocks and no unit holds
more than about two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Place of a unit among those of its cell, and of a row in it: 0 for homes of block _a, else 1.
PLACE = ("_a", "_b", "_side")


def blocks(homes: Column, guests: Column, block: int) -> tuple[Column, Column]:
    """Numbers of blocks of a cell's homes and guests; the guests of a small cell (0) join its only unit."""
    count = lambda n: F.ceil(n / F.lit(block)).cast("int")
    return count(homes), F.when(homes + guests <= block, 0).otherwise(count(guests))


def turns(home: Column, homes: Column, guests: Column) -> Column:
    """The turns of a row in a cell of so many blocks, one unit each: to be exploded."""
    return F.sequence(F.lit(0), F.when(home, homes + guests - 1).otherwise(homes - 1))


def place(home: Column, turn: Column, spread: Column, homes: Column, guests: Column) -> list[Column]:
    """``_a, _b, _side`` of a row at a turn.  ``spread`` is a hash that cuts the cell into blocks.

    Homes of a unit with ``_a == _b`` meet each other; in every unit side 0 meets side 1.
    """
    mine = F.pmod(spread, homes)
    theirs = F.when(guests > 0, homes + F.pmod(spread, F.greatest(guests, F.lit(1)))).otherwise(turn)
    return [
        F.when(home, F.least(mine, turn)).otherwise(turn).cast("int").alias("_a"),
        F.when(home, F.greatest(mine, turn)).otherwise(theirs).cast("int").alias("_b"),
        F.when(home & (mine <= turn), 0).otherwise(1).alias("_side"),
    ]


def each_unit(dealt: DataFrame, cell: list[str], function: Callable[[pa.Table, int, bool], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function(rows of the unit, homes first; number of homes; whether they meet each other)`` for every unit.

    ``cell`` are integer columns, the most telling first.  Rows stream sorted by unit: a task holds
    one unit at a time.
    """
    unit = [*cell, *PLACE[:2]]
    columns = [c for c in dealt.columns if c not in (*unit, PLACE[2])]

    def made(parts: list[pa.RecordBatch], inner: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        homes = int((table[PLACE[2]].to_numpy() == 0).sum())
        if homes and (out := function(table.select(columns), homes, inner)) is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in unit])
            for lo, hi in zip(starts := [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()], [*starts[1:], batch.num_rows]):
                key = keys[:, lo].tolist()
                if key != head and held:
                    yield from made(held, head[-1] == head[-2])
                    held = []
                held.append(batch.slice(lo, hi - lo))
                head = key
        if held:
            yield from made(held, head[-1] == head[-2])

    return dealt.repartition(*unit).sortWithinPartitions(*unit, PLACE[2]).mapInArrow(run, schema)


ship(__name__)
