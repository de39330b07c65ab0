"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A wide validation aggregate and a table of 125 codes both exceed Spark's
# default of 100 fields, beyond which whole-stage code generation is given up.
WIDE_TABLE_FIELDS = 400

# The JVM never compiles a method above this many bytes of bytecode to machine
# code. Spark's own limit is far higher, so a stage with many long expressions
# would run interpreted. At the JVM's limit Spark falls back to generating code
# per expression, in small methods, which measured three times faster.
COMPILED_METHOD_BYTES = 8_000


def prepare(spark: SparkSession) -> SparkSession:
    """Set the code generation limits that suit wide tables, unless they are already tighter or wider."""
    if int(spark.conf.get("spark.sql.codegen.maxFields")) < WIDE_TABLE_FIELDS:
        spark.conf.set("spark.sql.codegen.maxFields", str(WIDE_TABLE_FIELDS))
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > COMPILED_METHOD_BYTES:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_METHOD_BYTES))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table.

    It lies in the shared folder named by ``spark.checkpoint.dir``, so that a
    lost executor does not take the data with it. A session that runs in one
    process, such as a test, may leave the setting out and gets a folder of its
    own; on a cluster a missing setting is an error, because executors would
    each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wardbook-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Spark keeps the files of a shuffle until the driver happens to collect its
# plan; with this setting they go as soon as the query that made them ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an aggregated table once and read it back.

    A plan that uses a grouped table several times would scan the source once
    per use, as the optimiser pushes different filters into each of them. A
    written table is read instead, and it survives the loss of executors. The
    files of the shuffles that made it are freed when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: neither a plan still to run nor the caller."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
