"""Readers: dated slices, JDBC options, fallbacks, JSON logs and streams."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import for_date
from ..schemas import JOB_LOG, RUN_HISTORY, schema

log = logging.getLogger(__name__)

# URL pattern, driver class and environment names per database.
JDBC = {
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", "oracle.jdbc.OracleDriver",
               "ORACLE", "oracle", "1521", "SERVICE", "XEPDB1", "market"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true;trustServerCertificate=true",
                  "com.microsoft.sqlserver.jdbc.SQLServerDriver",
                  "SQLSERVER", "sqlserver", "1433", "DATABASE", "market", "sa"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver",
              "MYSQL", "mysql", "3306", "DATABASE", "exchange", "root"),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver",
                 "POSTGRES", "postgres", "5432", "DB", "demo", "demo"),
}


def jdbc_options(kind: str, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Connection options of one database, read from the environment.

    Credentials have no default: an unset password is simply not sent.
    """
    if kind not in JDBC:
        raise ValueError(f"unsupported database: {kind}")
    env = os.environ if env is None else env
    url, driver, prefix, host, port, db_key, database, user = JDBC[kind]
    options = {
        "url": url.format(
            host=env.get(f"{prefix}_HOST", host),
            port=env.get(f"{prefix}_PORT", port),
            database=env.get(f"{prefix}_{db_key}", database),
        ),
        "driver": driver,
        "user": env.get(f"{prefix}_USER", user),
        "fetchsize": "10000",
    }
    if env.get(f"{prefix}_PASSWORD"):
        options["password"] = env[f"{prefix}_PASSWORD"]
    return options


def read_jdbc(
    spark: SparkSession,
    kind: str,
    table: str,
    env: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
) -> DataFrame:
    """A database table; with a partition column the read is split over tasks."""
    reader = spark.read.format("jdbc").options(**jdbc_options(kind, env)).option("dbtable", table)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
            numPartitions=str(partitions),
        )
    return reader.load()


def equal_depth_sql(table: str, column: str, partitions: int) -> str:
    """Query for the least keys of ``partitions`` tiles with about equal numbers of rows each."""
    return (f"SELECT tile, min({column}) AS low FROM (SELECT {column}, ntile({partitions}) OVER (ORDER BY {column}) AS tile "
            f"FROM {table} WHERE {column} IS NOT NULL) tiles GROUP BY tile")


def sql_literal(value) -> str:
    """A number, or a text, date or timestamp in quotes."""
    return str(value) if isinstance(value, (int, float, Decimal)) else "'" + str(value).replace("'", "''") + "'"


def equal_depth_predicates(column: str, lows: Iterable) -> list[str]:
    """Conditions that hold every row once: a tile from each low key to the next, NULLs with the first.

    ``lows`` are the least keys of the tiles in any order; a key that fills several tiles
    counts once, so all its rows are in one of them.
    """
    cuts = sorted(set(lows))[1:]
    if not cuts:
        return ["1 = 1"]
    first = f"{column} < {sql_literal(cuts[0])} OR {column} IS NULL"
    between = [f"{column} >= {sql_literal(a)} AND {column} < {sql_literal(b)}" for a, b in zip(cuts, cuts[1:])]
    return [first, *between, f"{column} >= {sql_literal(cuts[-1])}"]


def read_jdbc_equal_depth(spark: SparkSession, kind: str, table: str, column: str, env: Mapping[str, str] | None = None,
                          partitions: int = 64) -> DataFrame:
    """A database table read by tasks with about equal numbers of rows, however the keys are spread.

    The database cuts its key into tiles; one row per tile comes to the driver.
    """
    options = jdbc_options(kind, env)
    tiles = spark.read.format("jdbc").options(**options).option("query", equal_depth_sql(table, column, partitions)).load()
    predicates = equal_depth_predicates(column, [r["low"] for r in tiles.select("low").collect()])
    properties = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=predicates, properties=properties)


def read_slice(spark: SparkSession, src: str | DataFrame, table: str | None, date_col: str, business_date: str,
               partition_column: str | None = None, bounds: tuple[str, str] | None = None,
               partitions: int = 16) -> DataFrame:
    """Rows of one business date from a Parquet root, a JDBC kind or a frame.

    With a partition column and its bounds a database slice is read by many tasks.
    """
    if isinstance(src, DataFrame):
        df = src
    elif src in JDBC:
        df = read_jdbc(spark, src, table, partition_column=partition_column, bounds=bounds, partitions=partitions)
    else:
        df = spark.read.parquet(f"{src}/{table}" if table else src)
    return for_date(df, date_col, business_date)


# Conditions of a source that is away; any other (a misspelt column or table) is a fault of the loader.
AWAY = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def _away(exc: Exception) -> bool:
    """Whether a source cannot be reached, rather than asked for something it does not hold."""
    if isinstance(exc, AnalysisException):
        return exc.getCondition() in AWAY
    cause = getattr(exc, "java_exception", None)
    while cause is not None:
        kinds, kind = [], cause.getClass()
        while kind is not None:
            kinds.append(kind.getName())
            kind = kind.getSuperclass()
        if "java.lang.ClassNotFoundException" in kinds or kinds[0].startswith("java.net."):  # no driver, no network
            return True
        if "java.sql.SQLException" in kinds and (cause.getSQLState() or "").startswith("08"):  # connection exceptions
            return True
        cause = cause.getCause()
    return not isinstance(exc, Py4JJavaError)


def first_available(loaders: Iterable[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """The first source that can be opened, with its label in ``dw_source``.

    A missing database or folder surfaces while its schema is resolved, so no
    rows are read to find out.
    """
    failures = []
    for label, load in loaders:
        try:
            df = load()
            df.schema
        except (AnalysisException, Py4JError, OSError) as exc:  # away or unreachable: try the next
            if not _away(exc):
                raise
            failures.append(f"{label}: {type(exc).__name__}")
            continue
        if failures:
            log.warning("source %s stands in for %s", label, "; ".join(failures))
        return df.withColumn("dw_source", F.lit(label))
    raise RuntimeError("no source available (" + "; ".join(failures) + ")")


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """Run records, one JSON object per line; blank and broken lines are skipped."""
    return spark.read.schema(schema(RUN_HISTORY)).option("mode", "DROPMALFORMED").json(path)


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema(JOB_LOG)).option("mode", "DROPMALFORMED").json(path)


def stream_job_logs(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Job log lines as they arrive in a folder."""
    return (
        spark.readStream.schema(schema(JOB_LOG))
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
