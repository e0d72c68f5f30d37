"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every scale; cluster size and memory stay with the submitter.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(partitions),
        spark__driver__memory=memory,
        spark__ui__enabled="false",
    )


#: Bytes of tables that are dealt to all cores before work begins.
SPREAD = (4 << 20, 64 << 20)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt to all cores; any other table as it is.

    A file of some megabytes mostly is one row group and thus one task, whatever is computed on it. Dealing it out
    costs one shuffle of at most 64 MB of file; larger tables have row groups enough and are never moved here.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if SPREAD[0] <= size <= SPREAD[1] else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; the path may be on any file system Spark knows."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
