"""Stored tables, label files and verdict logs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sentryframe.plans import evaluate
from sentryframe.schemas import TABLE_STEMS, empty_telemetry
from sentryframe.sources import canonical
from sentryframe.sources.normalise import coerce


def telemetry(spark, n=4000):
    rows = spark.range(n).select(
        F.format_string("e%05d", "id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1704067200).alias("timestamp"),
        F.lit("logon").alias("event_type"), F.when(F.col("id") % 3 == 0, F.format_string("h%03d", F.col("id") % 200)).otherwise("hot").alias("device"),
        F.when(F.col("id") % 7 == 0, 'says "no",\nthen').otherwise("").alias("failure_reason"))
    undated = rows.limit(1).withColumns({"event_id": F.lit("none"), "timestamp": F.lit(None).cast("timestamp")})
    return empty_telemetry(spark).with_table("logon", coerce(rows.unionByName(undated), "logon"))


def files_of(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_stored_tables_come_back_whole(spark, tmp_path, fmt):
    tel = telemetry(spark)
    canonical.write_canonical(tel, str(tmp_path), fmt, file_rows=300)
    back = canonical.read_canonical(spark, str(tmp_path), fmt)
    assert sorted(map(tuple, back.logons.collect()), key=str) == sorted(map(tuple, tel.logons.collect()), key=str)
    assert all(back.table(t).columns == tel.table(t).columns for t in TABLE_STEMS)
    sizes = [r["n"] for r in back.logons.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 300 and len(sizes) < 40


def test_a_slice_reads_the_files_of_its_days_only(spark, tmp_path):
    tel = telemetry(spark)
    canonical.write_canonical(tel, str(tmp_path), file_rows=300)
    lo, hi = "2024-01-02 06:00:00", "2024-01-02 18:00:00"
    part, _ = canonical.read_canonical_parquet(spark, str(tmp_path), lo, hi, ["hot"])
    want = tel.logons.where(f"timestamp between '{lo}' and '{hi}' and device = 'hot'")
    assert sorted(r[0] for r in part.logons.select("event_id").collect()) == sorted(r[0] for r in want.select("event_id").collect())
    assert all("event_date=2024-01-02" in f for f in files_of(part.logons))
    plan = part.logons._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0] and "device" in plan.split("PushedFilters:")[1].split("\n")[0]


def test_older_layouts_lie_beside_todays(spark, tmp_path):
    """Columns of all files count; those that no file has are named and empty."""
    tel = telemetry(spark, 50)
    folder = f"{tmp_path}/{TABLE_STEMS['logon']}"
    tel.logons.drop("failure_reason", "source_device").withColumn("event_date", F.lit("2023-12-31").cast("date")).write.partitionBy("event_date").parquet(folder)
    tel.logons.drop("source_device").withColumns({"event_date": F.to_date("timestamp"), "event_id": F.concat(F.lit("b"), "event_id")}).write.mode(
        "append").partitionBy("event_date").parquet(folder)
    back, added = canonical.read_canonical_parquet(spark, str(tmp_path))
    assert added == {"logon": ["source_device"]}
    assert back.logons.count() == 102 and back.logons.where("source_device <> '' or failure_reason is null").count() == 0
    assert back.logons.where("failure_reason <> ''").count() == 8 + (1 if tel.logons.where("timestamp is null and failure_reason <> ''").count() else 0)


def test_label_files_name_their_origin(spark, tmp_path):
    def stored(document):
        path = os.path.join(tmp_path, f"{len(os.listdir(tmp_path))}.json")
        with open(path, "w") as f:
            json.dump(document, f, indent=1)
        return path

    scenarios = {
        "intrusion": {"malicious": True, "stages": {"2-execution": {"refs": ["a=1;b=2", "a=3"]}, "9-empty": {"note": "nothing"}}},
        "lookalike": {"malicious": False, "stages": {"1-normal": {"event_ids": ["e7"]}}}}
    got = evaluate.read_labels(spark, stored({"dataset": "d", "provenance": "emulated-testbed", "scenarios": scenarios}))
    assert sorted(map(tuple, got.select("scenario", "malicious", "stage", "ref").collect())) == [
        ("intrusion", True, "2-execution", "a=1;b=2"), ("intrusion", True, "2-execution", "a=3"), ("lookalike", False, "1-normal", "e7")]
    for document in ({"dataset": "d", "scenarios": scenarios}, {"dataset": "d", "provenance": "guessed", "scenarios": scenarios},
                     {"dataset": "d", "provenance": "real", "scenarios": {"x": {"stages": {}}}}):
        with pytest.raises(ValueError):
            evaluate.read_labels(spark, stored(document)).collect()


def test_verdict_log_is_appended_and_skips_broken_lines(spark, tmp_path):
    log = f"{tmp_path}/log"
    record = lambda f, v, at: (f, "R", v, "a", "", "needs_review", at)
    for rows in ([record("F1", "true_positive", "2024-01-01"), record("F2", "false_positive", "2024-01-03")],
                 [record("F1", "false_positive", "2024-01-02"), record("F2", "true_positive", "2024-01-02")]):
        evaluate.append_verdicts(spark.createDataFrame(rows, evaluate.VERDICT), log)
    with open(f"{log}/part-broken.json", "w") as f:
        f.write('{"finding_id": "F1", "verd\nnot json\n{"finding_id": "F3"}\n\n')
    read = evaluate.read_verdicts(spark, log)
    assert read.count() == 4
    assert {r["finding_id"]: r["verdict"] for r in evaluate.latest_verdict(read).collect()} == {"F1": "false_positive", "F2": "false_positive"}
