"""Text files as records: reading, sniffing and admitting them.

Lines are read with their file name, so a large line-delimited file splits over many tasks.
A file that opens and closes with a lone bracket may be one document spread over lines; its
records are cut out where they are (``scan``), and only a document without a list of records is
put together, and only if the whole then parses.  Typed records are written to
one staging table, which admissions, tables and issues all read.
"""

from __future__ import annotations

import io
import sys
import tarfile
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage_cut import cut
from ..schemas import Telemetry
from .scan import by_file, list_documents

# The functions travel with the task: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
#: Files spread over lines that are few enough to be known in every task.
FEW_FILES = 100_000
# Reasons a file is refused (fixed values).
WRONG_SHAPE = "extension matched but content is not this source's telemetry"
UNPARSEABLE = "file does not parse in any shape this source accepts"
EMPTY = "file holds no records"


@dataclass(frozen=True)
class Ingest:
    """Canonical tables of one import and the ways input was lost.

    ``issues``: refused records with a reason.  ``admissions``: one row per file.
    ``unmapped``: records of classes no table represents, counted.  ``gaps``: kept rows
    with an empty column, by reason.
    """

    tables: Telemetry
    issues: DataFrame
    admissions: DataFrame
    unmapped: DataFrame | None = None
    gaps: DataFrame | None = None


def read_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``file, block, seq, line`` of every non-empty line; gzip and bz2 are read natively.

    ``(block, seq)`` orders the lines of a file: the split's start, then the order inside it.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(path)
    return raw.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.trim("value").alias("line"),
    ).where(F.col("line") != "")


def _frame(name: str, text: str) -> pd.DataFrame:
    return pd.DataFrame([(name, text)], columns=["file", "text"]).astype(object)


def _members(kinds: tuple[str, ...]):
    def expand(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if not member.isfile() or not member.name.lower().endswith(kinds):
                            continue
                        data = archive.extractfile(member).read()
                        if member.name.lower().endswith(".gz"):
                            data = zlib.decompress(data, 31)
                        yield _frame(f"{name}:{member.name}", data.decode("utf-8", "replace"))

    return expand


def _archives(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_tar_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the JSON members of tar archives; each archive is opened in one task, member by member."""
    return _text_lines(_archives(spark, path, "*.tar").mapInPandas(
        _members((".json", ".json.gz")), "file string, text string"))


def read_deflated_lines(spark: SparkSession, path: str, glob: str = "*.bz2") -> DataFrame:
    """Lines of bz2 files that were wrapped once more in a raw deflate stream, inflated piece by piece."""
    import bz2

    def chunks(content: bytes, size: int = 1 << 20):
        inflate = None if content.startswith(b"BZh") else zlib.decompressobj(-15)
        for at in range(0, len(content), size):
            part = content[at:at + size]
            yield part if inflate is None else inflate.decompress(part)
        if inflate is not None:
            yield inflate.flush()

    def unpack(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                name, rest, stream = path.rsplit("/", 1)[-1], b"", bz2.BZ2Decompressor()
                for part in chunks(content):
                    while part:
                        if stream.eof:
                            stream = bz2.BZ2Decompressor()
                        rest += stream.decompress(part)
                        part = stream.unused_data if stream.eof else b""
                        whole, cut_at, tail = rest.rpartition(b"\n")
                        if cut_at:
                            yield _frame(name, whole.decode("utf-8", "replace"))
                            rest = tail
                if rest:
                    yield _frame(name, rest.decode("utf-8", "replace"))

    return _text_lines(_archives(spark, path, glob).mapInPandas(unpack, "file string, text string"))


def _text_lines(texts: DataFrame) -> DataFrame:
    exploded = texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))
    return exploded.select(
        "file", F.lit(0).cast("long").alias("block"), F.col("seq").cast("long").alias("seq"),
        F.trim("line").alias("line")).where(F.col("line") != "")


def with_parsed(lines: DataFrame, column: str, schema: str, shape: str = "one JSON record per line") -> DataFrame:
    """The fields of one JSON record beside its text, and ``shape`` (null when it did not parse).

    The record goes through a generator, which the optimizer does not inline: each line is
    parsed once however many columns are read from it.
    """
    ok = F.when(F.try_parse_json(column).isNotNull(), shape).alias("shape")
    keep = [c for c in lines.columns if c != "shape"]
    kind = F.col("shape") if "shape" in lines.columns else ok
    return lines.select(*keep, kind, F.inline(F.array(F.from_json(column, schema))))


def settle(df: DataFrame, columns: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Evaluate derived columns once, before anything filters on them.

    A plain projection would be inlined into every later filter; a generator is not.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _pieces(lines: DataFrame) -> DataFrame:
    """Files that may be one document spread over lines.

    Neither the first nor the last line is a bracketed value by itself, and at most half of all
    lines are: a record log with broken ends is not taken for a document.
    """
    line = F.col("line")
    closed = (line.startswith("{") & line.endswith("}")) | (line.startswith("[") & line.endswith("]"))
    place = F.struct("block", "seq", closed.alias("closed"))
    ends = lines.groupBy("file").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count_if(closed).alias("closed"), F.count(F.lit(1)).alias("n"))
    return ends.where("NOT first.closed AND NOT last.closed AND n > 1 AND 2 * closed <= n").select("file")


def documents(lines: DataFrame, key: str) -> DataFrame:
    """Lines as units that parse: ``file, line, value`` (a VARIANT, null where the text is not JSON).

    A file spread over lines that lists records in its field ``key`` gives one unit per record,
    the document with that record alone in the list; another one is put together, and kept so
    if it parses (one record, as a rule); any other file is one unit per line.  Lines of ordinary
    files are not shuffled, and each unit is parsed once.
    """
    parse = lambda df: df.select("file", "line", F.inline(F.array(F.struct(F.try_parse_json("line").alias("value")))))
    pieces = cut(_pieces(lines))
    n = pieces.count()
    if not n:
        return parse(lines)
    few = n <= FEW_FILES
    likely = lines.join(by_file(pieces, few), "file", "left_semi")
    listed, single = list_documents(likely, key, few)
    joined = likely.join(by_file(single, few), "file", "left_semi").groupBy("file").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("block", "seq", "line"))), lambda s: s["line"]), "\n").alias("line"))
    whole = cut(parse(joined).where("value IS NOT NULL"))
    settled = whole.select("file").unionByName(listed.select("file").distinct())
    by_line = parse(lines.join(by_file(settled, few), "file", "left_anti"))
    return by_line.unionByName(whole).unionByName(listed)


def number_copies(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``record_key``, a digest of file and text, and ``copy``, which numbers equal texts of a file.

    Both depend on what the files hold, not on how they were split.  Only rows that have an
    equal are shuffled.
    """
    keyed = cut(rows.withColumn("record_key", F.sha2(F.concat_ws("#", F.col("file"), text), 256)))
    again = keyed.groupBy("record_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record_key")
    number = F.row_number().over(Window.partitionBy("record_key").orderBy(F.lit(1)))
    many = keyed.join(again, "record_key", "left_semi").withColumn("copy", number)
    return keyed.join(again, "record_key", "left_anti").withColumn("copy", F.lit(1)).unionByName(many)


def admit(records: DataFrame, identifies: Column, shape: Column, telemetry: str) -> DataFrame:
    """One row per file: is any of its records this telemetry.

    ``records`` has ``file`` and the parsed columns the predicate reads; a record that did not
    parse has a null ``shape``, and a file of such records only is refused.
    ``file, admitted, reason, shape, records``, written once: every table of an import reads it.
    """
    found = records.groupBy("file").agg(
        F.bool_or(F.coalesce(identifies, F.lit(False))).alias("_hit"), F.max(shape).alias("shape"), F.count(F.lit(1)).alias("records"))
    unreadable = F.col("shape").isNull()
    return cut(found.select(
        "file", (F.col("_hit") & ~unreadable).alias("admitted"),
        F.when(unreadable, UNPARSEABLE).when(~F.col("_hit"), WRONG_SHAPE)
        .otherwise(f"recognised as {telemetry}").alias("reason"),
        F.coalesce("shape", F.lit("")).alias("shape"), "records"))


def keep_admitted(records: DataFrame, admissions: DataFrame) -> DataFrame:
    return records.join(admissions.where("admitted").select("file"), "file", "left_semi")


def issue_rows(df: DataFrame, event_type: str | Column, reason: Column, reference: Column, field: str = "") -> DataFrame:
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    return df.select(
        kind.alias("event_type"), F.lit(field).alias("field"), reason.alias("reason"),
        reference.alias("reference"))


def slice_source(records: DataFrame, channel: str, event_id: str, keep: list[tuple[str, str]]):
    """Records of the listed (channel, event id) classes, and seen/kept counts of every class."""
    wanted = F.struct(F.col(channel).cast("string"), F.col(event_id).cast("string")).isin(
        *[F.struct(F.lit(a), F.lit(b)) for a, b in keep])
    counts = records.groupBy(channel, event_id).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(wanted).alias("kept"))
    return records.where(wanted), counts


def split_by_delivery_time(files: DataFrame, start: str, days: int = 10) -> DataFrame:
    """Mark object keys as development or holdout by the instant in their name.

    ``files`` has ``path``; delivery before ``start`` plus ``days`` is development.  The
    decision reads the key, never the content.
    """
    stamp = F.regexp_extract("path", r"_(\d{8}T\d{4})Z", 1)
    at = F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmm"))
    boundary = F.lit(start).cast("timestamp") + F.expr(f"INTERVAL {days} DAYS")
    return files.withColumn("delivered_at", at).withColumn(
        "part", F.when(at.isNull(), "unreadable").when(at < boundary, "dev").otherwise("holdout"))


def source_ledger(ingest: Ingest) -> DataFrame:
    """One table of everything an import kept and lost: ``measure, class, n``."""
    one = F.count(F.lit(1)).alias("n")
    parts = [
        ingest.admissions.groupBy(
            F.when(F.col("admitted"), "files_admitted").otherwise("files_rejected").alias("measure"),
            F.col("reason").alias("class")).agg(one),
        ingest.admissions.where("admitted").groupBy(
            F.lit("records_read").alias("measure"), F.lit("").alias("class")).agg(F.sum("records").alias("n")),
        ingest.admissions.where(~F.col("admitted")).groupBy(
            F.lit("records_refused").alias("measure"), F.lit("").alias("class")).agg(F.sum("records").alias("n")),
        ingest.issues.groupBy(F.lit("issues").alias("measure"), F.col("reason").alias("class")).agg(one),
    ]
    for name, df in ingest.tables.tables().items():
        parts.append(df.groupBy(F.lit("rows").alias("measure"), F.lit(name).alias("class")).agg(one))
    if ingest.unmapped is not None:
        parts.append(ingest.unmapped.select(F.lit("unmapped").alias("measure"), "class", "n"))
    if ingest.gaps is not None:
        parts.append(ingest.gaps.select(F.lit("field_gaps").alias("measure"), F.col("reason").alias("class"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
