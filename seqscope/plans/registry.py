"""The catalogue's register: queries over the driver tables by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def longs(sql: str) -> str:
    """The SQL with each count_if cast to BIGINT (it is a wider type there)."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
            if not depth:
                break
        out += [sql[at:start], f"CAST({sql[start:end]} AS BIGINT)"]
        at = end
    return "".join([*out, sql[at:]])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = longs(sql)
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table up to which it is dealt to all cores.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is a small table, which may be a single split; a large one has splits enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2) if size <= SMALL else df


def r(name: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(name) if isinstance(name, str) else name, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """df with its doubles rounded, and its whole numbers as longs."""
    out = [r(F.col(c), own.get(c, digits)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes]
    return df.select(*out)
