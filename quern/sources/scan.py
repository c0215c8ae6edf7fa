"""Scans that carry a row position, and capture lines that don't parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.pyudf import is_json
from quern.functions.text import preview, strip
from quern.operators.stage import Stage, expect


class SourceError(RuntimeError):
    """A source that can't be read."""


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines; blank lines are skipped, a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, line_no (from 1 within the file, blank lines counted), raw (never blank).

    A directory is read recursively; files are ordered by path. Line numbers come from
    positions within each file's one split, so files are read whole.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "raw"))
    return lines.select("path", (F.col("n") + 1).alias("line_no"), "raw").filter(strip("raw") != "")


def captured(lines: DataFrame, raw: str = "raw") -> Stage:
    """Lines with reason 'invalid_json' where they aren't JSON, and a variant column v of the others."""
    ok = is_json(F.col(raw))
    return Stage(lines.withColumn("reason", F.when(~ok, "invalid_json")).withColumn("v", F.when(F.col("reason").isNull(), F.try_parse_json(raw))))


def malformed_rows(stage: Stage, raw: str = "raw") -> DataFrame:
    """Reject rows of captured lines."""
    return stage.rejects.select("reason", F.concat(F.lit("line-"), "line_no").alias("source_id"), F.lit("unknown").alias("source_split"), preview(raw).alias("raw_preview"))


def strict_lines(stage: Stage) -> DataFrame:
    """The parsed lines; using them fails with the line number if one is malformed."""
    bad = F.concat(F.lit("invalid JSON on line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("path"))
    checked = stage.rows.filter(F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))
    return checked.drop("reason")


def field(v: str | Column, path: str, kind: str = "string") -> Column:
    """A field of a variant; null if it is missing or can't be that type."""
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, f"$.{path}", kind)


def type_name(v: Column, path: str) -> Column:
    """Type of a field as it was written, 'VOID' for null; null if missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array; nested lists are kept."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def splits(spark: SparkSession, paths: dict[str, str], column: str = "source_split") -> DataFrame:
    """Parquet files by split, with the split as a column and a position within the split."""
    if not paths:
        raise SourceError("no split given")
    out = None
    for n, (split, path) in enumerate(paths.items()):
        try:
            df = spark.read.parquet(path).select("*", F.lit(split).alias(column), F.lit(n).alias("_split_no"), F.col("_metadata.row_index").alias("_pos"))
        except Exception as e:
            raise SourceError(f"{split}: {e}") from e
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_or_all(spark: SparkSession, first: str, everything: str) -> DataFrame:
    """The first shard; all of them if it can't be read."""
    for path in (first, everything):
        try:
            return spark.read.parquet(path)
        except Exception as e:  # noqa: PERF203
            error = e
    raise SourceError(str(error))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: lower-case lines of a text file, without blank ones and those that start with #."""
    t = F.lower(strip("value"))
    return spark.read.text(path).select(t.alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def benchmark_lines(spark: SparkSession, path: str, allow_missing: bool = False) -> Stage:
    """captured lines of all *.jsonl below a path; nothing there is an error unless allowed."""
    try:
        lines = numbered_lines(spark, path, "*.jsonl")
        empty = lines.isEmpty()
    except Exception as e:
        if not allow_missing:
            raise SourceError(str(e)) from e
        lines, empty = spark.createDataFrame([], "path string, line_no int, raw string"), False
    if empty and not allow_missing:
        raise SourceError(f"no benchmark lines in {path}")
    return captured(lines)


def expect_rows(df: DataFrame, message: str) -> DataFrame:
    """df; using it fails if it has no rows."""
    one = expect(df.agg(F.count("*").alias("_n")), F.col("_n") > 0, message)
    return df.join(F.broadcast(one), F.lit(True)).drop("_n")
