"""Cutting lineage through a table in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side of a few narrow columns may be broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session that names neither (tests, one machine) gets a temporary folder;
    on a cluster, whose executors don't share one, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("no shared folder: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and return the table that reads it.

    What follows neither recomputes df nor depends on an executor's local disk. The rows
    are counted as they are written (rows_of).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._quern_rows = seen.get["rows"]
    return again


def rows_of(df: DataFrame) -> int | None:
    """Number of rows of a table that materialize returned; None of any other."""
    return getattr(df, "_quern_rows", None)


def salted_join(left: DataFrame, right: DataFrame, key: str, unit: str, rows: int | None = None, chunk: int = 100_000) -> DataFrame:
    """left joined with right by a key column of both; a key with many rows on the right is spread over several partitions.

    Rows of such a key go to one of ceil(rows / chunk) salts by the hash of right's column
    unit, and left's rows to all of them; the salts are few, since there are at most
    rows / chunk such keys. right is read twice: it should be materialized or cheap. rows
    is how many it has, if that is known: no key of a smaller table can be hot.
    """
    rows = rows_of(right) if rows is None else rows
    if rows is not None and rows <= chunk:
        return left.join(right, key)
    heavy = right.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk).select("_hot", F.ceil(F.col("_n") / chunk).cast("int").alias("_salts"))
    heavy = materialize(heavy, "hot-keys")
    if not rows_of(heavy):
        return left.join(right, key)
    heavy = broadcast_if_small(heavy)
    salts = F.coalesce("_salts", F.lit(1))
    l = left.join(heavy, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    r = right.join(heavy, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(unit), salts).cast("int")).drop("_hot", "_salts")
    return l.join(r, [key, "_salt"]).drop("_salt")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; unchanged, for a shuffled join, otherwise.

    The rows of a materialized table are known, those of another are counted, up to limit
    + 1, unless an upper bound is given.
    """
    n = rows_of(df) if rows is None else rows
    n = df.limit(limit + 1).count() if n is None else n
    return F.broadcast(df) if n <= limit else df
