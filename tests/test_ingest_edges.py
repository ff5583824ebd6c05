"""Ingest keeps every record, whatever the shape of a file and however it is split."""

import bz2
import json
import zlib

from pyspark.sql import functions as F

from sentryframe.sources import cloudtrail, k8s
from sentryframe.sources.files import read_deflated_lines

LOAD = "2024-02-01"


def record(n, **more):
    return {"eventVersion": "1.08", "eventTime": "2024-01-02T03:04:05Z", "eventSource": "ec2.amazonaws.com", "eventName": "DescribeInstances",
            "awsRegion": "r", "userIdentity": {"userName": f"u{n}"}, "eventID": f"e{n}", **more}


def event(n, **more):
    return {"kind": "Event", "apiVersion": "audit.k8s.io/v1", "auditID": f"a{n}", "stage": "ResponseComplete", "verb": "create",
            "user": {"username": f"u{n}"}, "objectRef": {"resource": "pods", "subresource": "exec", "name": "p", "namespace": "n"},
            "responseStatus": {"code": 201}, "stageTimestamp": "2024-01-02T03:04:05Z", **more}


def test_cloudtrail_over_1200_partitions(spark):
    lines = spark.range(0, 2400, 1, 1200).select(
        F.lit("f.json").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("seq"),
        F.replace(F.lit(json.dumps(record(0))), F.lit('"e0"'), F.concat(F.lit('"e'), F.col("id").cast("string"), F.lit('"'))).alias("line"))
    got = cloudtrail._ingest(lines, LOAD)
    assert got.tables.controls.select("event_id").distinct().count() == 2400


def test_broken_first_line_costs_one_issue(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(['{"eventVersion": "1.0', *(json.dumps(record(n)) for n in range(3))]))
    got = cloudtrail.read_cloudtrail(spark, str(tmp_path), LOAD)
    assert got.tables.controls.count() == 3
    assert [(r["reason"], r["reference"]) for r in got.issues.collect()] == [("line is not valid JSON", "a.json")]


def test_identifying_record_behind_many_others(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([*(json.dumps({"x": n}) for n in range(60)), json.dumps(record(1))]))
    assert cloudtrail.read_cloudtrail(spark, str(tmp_path), LOAD).tables.controls.count() == 1


def test_k8s_event_with_an_items_field_is_an_event(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(json.dumps(event(n, **({"items": [1, 2]} if n == 1 else {}))) for n in range(3)))
    assert k8s.read_k8s_audit(spark, str(tmp_path), LOAD).tables.controls.count() == 3


def test_k8s_list_with_long_metadata(spark, tmp_path):
    whole = {"kind": "EventList", "metadata": {"note": "x" * 500}, "items": [event(0), event(1)]}
    (tmp_path / "one_line.json").write_text(json.dumps(whole))
    (tmp_path / "pretty.json").write_text(json.dumps(whole, indent=1))
    (tmp_path / "array_lines.json").write_text('{"kind": "EventList", "items": [\n' + ",\n".join(json.dumps(event(n)) for n in range(2)) + "\n]}")
    got = k8s.read_k8s_audit(spark, str(tmp_path), LOAD)
    assert got.tables.controls.count() == 6 and got.issues.count() == 0


def test_equal_ids_under_two_split_sizes(spark, tmp_path):
    rows = [record(n) for n in range(40)] + [record(7), record(7), {**record(0), "eventID": None}, {**record(0), "eventID": None}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(record(n)) for n in range(5)))

    def ids(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            return sorted(r[0] for r in cloudtrail.read_cloudtrail(spark, str(tmp_path), LOAD).tables.controls.select("event_id").collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    small, large = ids("900b"), ids("128m")
    assert small == large and len(set(small)) == len(rows) + 5


def test_deflated_bz2_is_inflated_piece_by_piece(spark, tmp_path):
    text = "\n".join(f'{{"n": {n}}}' for n in range(50_000))
    packer = zlib.compressobj(wbits=-15)
    (tmp_path / "a.bz2").write_bytes(packer.compress(bz2.compress(text[:300_000].encode()) + bz2.compress(text[300_000:].encode())) + packer.flush())
    got = read_deflated_lines(spark, str(tmp_path))
    assert got.count() == 50_000 and got.select("line").distinct().count() == 50_000
