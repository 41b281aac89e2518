"""Scans of tables under a contract: declared columns and keys, held against what the files say before any row is read.

What is wrong with a table comes back as rows with a reason; no task fails on it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REASONS = "table_name string, column_name string, reason string"


def contract_faults(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    """A table's files against its declared columns ("a bigint, b string not null"): MISSING_TABLE, MISSING_COLUMN, WRONG_TYPE.

    The schema is that of the files' footers; columns that are not declared are no fault.
    """
    want = StructType.fromDDL(columns)
    try:
        have = {f.name.lower(): f for f in spark.read.option("mergeSchema", "true").parquet(path).schema}
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return spark.createDataFrame([(name, None, "MISSING_TABLE")], REASONS)
    faults = [(name, f.name, "MISSING_COLUMN" if f.name.lower() not in have else "WRONG_TYPE") for f in want if f.name.lower() not in have or have[f.name.lower()].dataType != f.dataType]
    return spark.createDataFrame(faults, REASONS)


def table(spark: SparkSession, path: str, name: str, columns: str) -> tuple[DataFrame, DataFrame]:
    """The declared columns of a table, and its faults; with faults a column that is missing or of another type is null where it can't be cast."""
    faults = contract_faults(spark, path, name, columns)
    want = StructType.fromDDL(columns)
    found = {r["column_name"] or "": r["reason"] for r in faults.collect()}  # a row for each declared column at most
    if "" in found:
        return spark.createDataFrame([], want), faults
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    one = lambda f: F.lit(None).cast(f.dataType) if found.get(f.name) == "MISSING_COLUMN" else F.col(f.name).try_cast(f.dataType)
    return rows.select(*(one(f).alias(f.name) for f in want)), faults


def key_faults(rows: DataFrame, name: str, columns: str, key: list[str]) -> DataFrame:
    """(table_name, column_name, reason, n): nulls in columns declared not null, and keys that occur more than once; one pass and one sum."""
    required = [f.name for f in StructType.fromDDL(columns) if not f.nullable]
    nulls = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)) if required else None
    again = rows.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(",".join(key)).alias("column_name"), F.lit("REPEATED_KEY").alias("reason"), "n")
    if nulls is None:
        return again
    each = nulls.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in required))).alias("x"))
    return again.unionByName(each.select(F.lit(name).alias("table_name"), "x.column_name", F.lit("NULL_VALUE").alias("reason"), "x.n"))


def jdbc_table(spark: SparkSession, url: str, name: str, columns: str, key: str, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in parts by ranges of a number column; the bounds are asked of the database first."""
    read = spark.read.format("jdbc").options(url=url, **options)
    low, high = read.option("query", f"select min({key}) as low, max({key}) as high from {name}").load().first()
    read = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if low is not None:
        read = read.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))
    want = StructType.fromDDL(columns)
    return read.load().select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))
