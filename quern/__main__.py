"""Command line: python -m quern STAGE --input ... --output ... [--rejects ...] [--report ...]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from quern.operators.stage import Stage
from quern.plans import cloze, comprehension, instruction, recheck
from quern.schema import RAW
from quern.session import local_session
from quern.sources.scan import SourceError, captured, malformed_rows, numbered_lines
from quern.sources.sinks import write_jsonl, write_report


def _raw(spark, path: str):
    """Raw records of a JSON-lines file; lines that don't parse are counted as rejects."""
    lines = captured(numbered_lines(spark, path))
    rows = lines.kept.select(F.col("line_no").alias("_pos"), F.from_json("raw", RAW).alias("r")).select("_pos", "r.*")
    return rows, malformed_rows(lines)


STAGES = {
    "slice": lambda rows, a: comprehension.slice_of(rows, a.source_dataset),
    "short-answer": lambda rows, a: comprehension.short_answers(rows, a.source_dataset, "_pos"),
    "generation-requests": lambda rows, a: comprehension.generation_requests(rows),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("stage", choices=[*STAGES, "cloze", "instruction", "check-raw"])
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--rejects")
    p.add_argument("--report")
    p.add_argument("--source-dataset", default="")
    p.add_argument("--sample", type=int, default=5)
    a = p.parse_args(argv)
    spark = local_session()
    try:
        bad = None
        if a.stage == "cloze":
            stage = cloze.stage(spark.read.parquet(a.input))
        elif a.stage == "instruction":
            stage = instruction.single_turns(spark.read.parquet(a.input))
        else:
            rows, bad = _raw(spark, a.input)
            if a.stage == "check-raw":
                errors = comprehension.raw_errors()
                recheck.spot_check(rows, F.col("question"), a.sample).show(truncate=80)
                return recheck.exit_code(rows, errors) or int(not bad.isEmpty())
            stage = STAGES[a.stage](rows, a)
        if a.output:
            write_jsonl(stage.kept, a.output)
        if a.rejects:
            rejects = stage.reject_rows({"question": F.col("question")} if "question" in stage.rows.columns else {})
            write_jsonl(rejects.unionByName(bad, allowMissingColumns=True) if bad is not None else rejects, a.rejects)
        if a.report:
            whole = Stage(stage.rows.select("reason").unionByName(bad.select("reason"))) if bad is not None else stage
            write_report(whole.report(), a.report)
    except (SourceError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            print(e, file=sys.stderr)
            return 1
        raise
    return 0


if __name__ == "__main__":
    sys.exit(main())
