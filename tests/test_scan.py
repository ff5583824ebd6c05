"""Documents spread over lines are cut into their records, equal to what a JSON parser reads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sentryframe.sources import cloudtrail, files, scan
from sentryframe.sources.files import documents, read_lines

from .test_ingest_edges import LOAD, record


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    texts = ['a"b', "back\\", '\\"', "{[", "]}", '"Records": [', "},{", "", "x\ny", "é ", '"}],']
    if kind < 3:
        return rng.choice(texts)
    if kind < 6:
        return rng.choice([0, 1.5, None, True, -3])
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}{rng.choice(['', '{', chr(34)])}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def layouts(head, records, tail):
    """The same document as different writers print it."""
    doc = {**head, "Records": records, **tail}
    yield json.dumps(doc, indent=1)
    yield json.dumps(doc, indent=4, separators=(" ,", " : "))
    yield json.dumps(doc, indent=1, ensure_ascii=False).replace("},\n  {", "}, {").replace("[\n  {", "[{").replace("}\n ]", "}]")
    before = json.dumps(head)[:-1] + (", " if head else "")
    after = (", " + json.dumps(tail)[1:-1]) if tail else ""
    yield before + '"Records": [\n' + ",\n".join(map(json.dumps, records)) + "\n]" + after + "\n}"
    yield before + '"Records":\t[\n' + "\n,\n".join(map(json.dumps, records)) + "]" + after + "\n}"


def read(spark, folder, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = documents(read_lines(spark, str(folder), "*.json"), "Records").select(
            "file", F.to_json("value").alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r.file, []).append(None if r.v is None else json.loads(r.v))
    return got


@pytest.mark.parametrize("size", ["300b", "64m"])
def test_records_equal_a_json_parser(spark, tmp_path, size):
    rng, want = random.Random(11), {}
    for n in range(8):
        head = {"kind": "X", "metadata": {"items": [{"a": 1}], "b": value(rng)}} if n % 3 else {}
        tail = {"next": value(rng)} if n % 2 else {}
        records = [{"n": i, "v": value(rng), "w": {"x": value(rng)}} for i in range(rng.randrange(1, 12))]
        for k, text in enumerate(layouts(head, records, tail)):
            name = f"d{n}-{k}.json"
            (tmp_path / name).write_text(text)
            want[name] = sorted(json.dumps({**head, "Records": [r], **tail}, sort_keys=True) for r in records)
    got = read(spark, tmp_path, size)
    for name, rows in want.items():
        assert sorted(json.dumps(v, sort_keys=True) for v in got[name]) == rows, name


def test_what_is_no_list_of_records_stays_as_it_was(spark, tmp_path):
    """Broken documents are lines, other documents are one unit, whatever they hold."""
    good = json.dumps({"Records": [{"a": 1}, {"a": 2}]}, indent=1)
    whole = {
        "bare.json": json.dumps({"a": {"b": [1, {"c": 2}]}}, indent=1),
        "empty.json": '{"Records": [\n]\n}',
        "scalars.json": '{"Records": [\n1,\n2\n]\n}',
        "deep.json": '{"x":\n{"Records": [\n{"a": 1}\n]\n}\n}',
    }
    broken = {
        "no_comma.json": good.replace("},", "}"), "two_commas.json": good.replace("},", "},,"), "open.json": good[:-1],
        "comma_at_end.json": good.replace("}\n ]", "},\n ]"), "bad_record.json": good.replace(": 2", ": 2x"),
        "twice.json": '{"Records": [\n{"a": 1}\n],\n"Records": [\n{"a": 2}\n]\n}', "quote.json": good.replace("1", '1"'),
        "control.json": good.replace("1", '"\x01"'), "bad_tail.json": good[:-1] + ', "x": y\n}',
    }
    mixed = '{"Records": [\n{"a": 1},\nnull,\n{"a": 2}\n]\n}'
    for name, text in {**whole, **broken, "mixed.json": mixed}.items():
        (tmp_path / name).write_text(text)
    got = read(spark, tmp_path, "64m")
    for name, text in whole.items():
        assert got[name] == [json.loads(text)], name
    # What is no object stays with the record before it.
    assert sorted(map(str, got["mixed.json"])) == ["{'Records': [{'a': 1}, None]}", "{'Records': [{'a': 2}]}"]
    for name, text in broken.items():
        assert len(got[name]) == len([x for x in text.split("\n") if x.strip()]), name


def test_a_document_beyond_the_size_of_a_value(spark, tmp_path):
    """Some 180 MB in one pretty document, read in splits of 8 MB: every record, and no task with all of it."""
    text = json.dumps(record(0, requestParameters={"note": "x" * 9000}), indent=2)
    with open(tmp_path / "a.json", "w") as out:
        out.write('{"Records": [\n')
        for n in range(20_000):
            out.write(text.replace('"e0"', f'"e{n}"') + (",\n" if n < 19_999 else "\n"))
        out.write("]}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        got = cloudtrail.read_cloudtrail(spark, str(tmp_path), LOAD)
        assert got.tables.controls.select("source_ref").distinct().count() == 20_000
        assert [(r.admitted, r.records, r["shape"]) for r in got.admissions.collect()] == [(True, 20_000, "a top-level 'Records' array")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_not_shuffled_by_their_few_files(spark, tmp_path, monkeypatch):
    """Which files are documents is known in every task, whatever the sizes; many files are joined as before, with the same rows."""
    (tmp_path / "a.json").write_text(json.dumps({"Records": [{"a": 1}, {"a": 2}]}, indent=1))
    (tmp_path / "b.json").write_text('{"c": 3}\n{"d": 4}')
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for few in (100, 0):
            monkeypatch.setattr(files, "FEW_FILES", few)
            found = documents(read_lines(spark, str(tmp_path), "*.json"), "Records")
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert ("strategy=broadcast" in plan) == bool(few)
            assert sorted(texts_of(found)) == ['{"Records":[{"a":1}]}', '{"Records":[{"a":2}]}', '{"c":3}', '{"d":4}']
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def texts_of(found):
    return [r.v for r in found.select(F.to_json("value").alias("v")).collect()]


def test_lines_without_brackets_are_tokens_as_they_are(spark):
    lines = ['"a": "b\\\\",', "{", '"x": "q\\"[",', '"Records": [', "\x01", "1, 2", "[{},{}]"]
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines)], "file string, block long, seq long, line string")
    got = sorted((r.seq, r["sub"], r.text, r.opened, r.opens_list, r.brace, r.strange) for r in scan.tokens(df, "Records").collect())
    assert got[:6] == [
        (0, 0, lines[0], 0, False, False, False), (1, 0, "{", 1, False, True, False), (2, 0, lines[2], 0, False, False, False),
        (3, 0, lines[3], 1, True, False, False), (4, 0, "\x01", 0, False, False, True), (5, 0, "1, 2", 0, False, False, False)]
    assert "".join(x[2] for x in got[6:]) == lines[6] and sum(x[3] for x in got) == 2
