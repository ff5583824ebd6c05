"""Line dedup by overlapping three-line windows.

A text is split at ``\\n``; lines of white space only take no part.  Every three consecutive lines
are one window, named by two 64-bit hashes.  Of a window that occurs more than once anywhere,
all but the first occurrence, by id and place, mark their three lines; marked lines go, however
many windows cover them.  Texts with fewer than three such lines have no window and stay whole.

Windows, not texts, are aggregated (map-side first) to the first place of each; a window that
many texts share is one row there, and its occurrences are joined back, where a hot key can be
split.  Nothing is collected but the window places of one document.

Null text stays null with no lines.  Rows with the same id and the same text count as one
document and keep or lose the same lines; a null id comes first.  Ties do not arise: an
occurrence is named by id, text hash and place.  An empty table gives no rows.  All columns
come back; ``n_lines`` and ``n_removed`` are added, in place of columns of that name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches, ship

WINDOW = 3
BLANK = " \t\n\x0b\x0c\r"


def _is_solid(line: str) -> bool:
    return bool(line.strip(BLANK))


def _windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tag, at, h, g``: each window of each document."""
    solid = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda line: F.translate(line, BLANK, "") != "")
    hashed = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("tag"),
        F.transform(solid, lambda line: F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))).alias("lines"),
    ).where(F.size("lines") >= WINDOW)
    near = lambda i, part: [F.get("lines", i + j)[part] for j in range(WINDOW)]
    every = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), lambda i: F.struct(
        i.alias("at"), F.xxhash64(*near(i, "h")).alias("h"), F.xxhash64(*near(i, "g")).alias("g")))
    return hashed.select("key", "tag", F.inline(every))


def _remover(n: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, removed = [], [], []
        for value, places in zip(batch.column(1), batch.column(2)):
            text = value.as_py()
            parts = [] if text is None else text.split("\n")
            lines.append(len(parts))
            if text is None or not places.is_valid:
                texts.append(text)
                removed.append(0)
                continue
            gone = {i + j for i in places.as_py() for j in range(n)}
            kept, at = [], 0
            for part in parts:
                if _is_solid(part):
                    if at not in gone:
                        kept.append(part)
                    at += 1
                else:
                    kept.append(part)
            texts.append("\n".join(kept))
            removed.append(len(parts) - len(kept))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())],
            ["kept", "body", "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with later copies of repeated windows taken out of ``text``."""
    windows = cut(_windows(docs, key, text))
    place = F.struct("key", "tag", "at")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    later = windows.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    marked = later.groupBy(F.col("key").alias("k"), F.col("tag").alias("t")).agg(F.collect_set("at").alias("places"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others if c != text), F.lit(0).alias("row_")).alias("kept"),
        F.col(f"`{text}`").alias("body"), F.col(f"`{key}`").alias("k0"), F.xxhash64(F.col(f"`{text}`")).alias("t0"))
    joined = rows.join(marked, F.col("k0").eqNullSafe(F.col("k")) & (F.col("t0") == F.col("t")), "left").select("kept", "body", "places")
    schema = T.StructType([joined.schema["kept"], T.StructField("body", T.StringType())])
    schema = schema.add("n_lines", "long").add("n_removed", "long")
    out = map_batches(joined, _remover(WINDOW), schema)
    return out.select(
        *(F.col("body").alias(c) if c == text else F.col("kept")[c].alias(c) for c in others), "n_lines", "n_removed")


ship(__name__)
