"""Scans, sinks, the stream and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.plans import cloze
from quern.sources import scan, sinks
from quern.streaming import cloze as stream


def test_malformed_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2} x\n  \n{"a": "3"}\n', encoding="utf-8")
    s = scan.captured(scan.numbered_lines(spark, str(tmp_path / "a.jsonl")))
    assert [r.source_id for r in scan.malformed_rows(s).collect()] == ["line-3"]
    got = {r.line_no: (r.a, r.t) for r in s.kept.select("line_no", scan.field("v", "a").alias("a"), scan.type_name(F.col("v"), "a").alias("t")).collect()}
    assert got == {1: ("1", "BIGINT"), 5: ("3", "STRING")}
    with pytest.raises(Exception, match="invalid JSON on line 3"):
        scan.strict_lines(s).collect()
    with pytest.raises(Exception):
        scan.jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()


def test_benchmark_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.jsonl").write_text('{"q": 1}\n')
    (tmp_path / "a.jsonl").write_text('{"q": 2}\n')
    (tmp_path / "c.txt").write_text("no")
    assert scan.benchmark_lines(spark, str(tmp_path)).kept.count() == 2
    with pytest.raises(scan.SourceError):
        scan.benchmark_lines(spark, str(tmp_path / "none"))
    assert scan.benchmark_lines(spark, str(tmp_path / "none"), allow_missing=True).rows.count() == 0


def test_splits_and_shards(spark, tmp_path):
    for s in ("train", "test"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / s))
    both = scan.splits(spark, {s: str(tmp_path / s) for s in ("train", "test")})
    assert both.groupBy("source_split").count().count() == 2 and both.agg(F.max("_pos")).first()[0] == 2
    assert scan.first_or_all(spark, str(tmp_path / "none"), str(tmp_path / "train")).count() == 3
    with pytest.raises(scan.SourceError):
        scan.first_or_all(spark, str(tmp_path / "none"), str(tmp_path / "nor"))
    with pytest.raises(scan.SourceError):
        scan.splits(spark, {})


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a"b,\nc', None), (1, "chữ", "x")], "p int, t string, n string")
    sinks.write_jsonl(df, str(tmp_path / "j"), "p")
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("*.json")) for x in f.read_text().splitlines()]
    assert lines == [{"t": "chữ", "n": "x"}, {"t": 'a"b,\nc', "n": None}]
    for sep in (",", "\t"):
        sinks.write_csv(df, str(tmp_path / "c"), sep)
        assert {r.t for r in scan.csv(spark, str(tmp_path / "c"), "p int, t string, n string", sep).collect()} == {"chữ", 'a"b,\nc'}
    assert sinks.written(df, str(tmp_path / "w")).count() == 2
    with pytest.raises(RuntimeError):
        sinks.written(df, str(tmp_path / "w"), rows=3)
    sinks.write_report(df.groupBy("t").count(), str(tmp_path / "r"))
    assert len(json.loads(spark.read.text(str(tmp_path / "r"), wholetext=True).first()[0])) == 2


def test_json_array_and_word_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "x", "o": ["1", "2"]}, {"q": "y", "o": null}]')
    assert scan.json_array(spark, str(tmp_path / "a.json"), "q string, o array<string>").count() == 2
    (tmp_path / "w.txt").write_text("# nghĩa\nVà\n\nlà\nvà\n")
    assert sorted(r.word for r in scan.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["là", "và"]
    with pytest.raises(Exception, match="empty"):
        scan.expect_rows(spark.range(0), "empty").collect()


@pytest.fixture
def folder(spark, tmp_path):
    words = " ".join(["chữ"] * 25)
    for n in range(4):
        spark.createDataFrame([(n * 10 + k, f"{words} {w}") for k, w in enumerate(("một", "hai", "ba"[: 1 + n % 2], "9"))], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def test_stream_equals_batch(spark, folder):
    schema = "doc_id bigint, text string"
    src = lambda: stream.source(spark, str(folder / "in"), schema)
    stream.run(stream.unique_pairs(src()), str(folder / "out"), str(folder / "ck")).awaitTermination()
    batch = cloze.stage(spark.read.schema(schema).parquet(str(folder / "in")))
    assert {r.dedup_hash for r in spark.read.parquet(str(folder / "out")).collect()} == {r.dedup_hash for r in batch.kept.collect()}
    q = stream.reason_counts(src()).writeStream.format("memory").queryName("reasons").outputMode("complete").option("checkpointLocation", str(folder / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.reason: r["count"] for r in spark.table("reasons").collect()} == {None: 12, "invalid_target_word": 4}


def test_stream_stops_at_the_cap(spark, folder):
    pairs = stream.unique_pairs(stream.source(spark, str(folder / "in"), "doc_id bigint, text string"))
    whole = {r.dedup_hash for r in spark.read.parquet(str(folder / "out")).collect()} if (folder / "out").exists() else None
    n = stream.run_until(pairs, str(folder / "capped"), str(folder / "ck3"), 2)
    got = spark.read.parquet(str(folder / "capped"))
    assert n == 2 == got.count() and (whole is None or {r.dedup_hash for r in got.collect()} <= whole)
    # a restart from the checkpoint counts what is written
    assert stream.run_until(pairs, str(folder / "capped"), str(folder / "ck3"), 2) == 2
    more = stream.run_until(pairs, str(folder / "capped"), str(folder / "ck3"), 3)
    assert 2 <= more <= 3 and spark.read.parquet(str(folder / "capped")).count() == more


def test_command_line(spark, folder):
    assert main(["cloze", "--input", str(folder / "in"), "--output", str(folder / "o"), "--report", str(folder / "rep")]) == 0
    assert main(["cloze", "--input", str(folder / "none"), "--output", str(folder / "o")]) == 1
