"""Writing: only what is not there yet, whole batches or nothing.

A table is a folder: ``data/batch=<id>`` holds what a batch wrote, ``commits/<id>`` says that it is whole. A batch is
written first and committed by one small file, so one that is killed in between has written nothing that readers
see, and run again under the same id it replaces what it left. Two runs of one id can't both commit.
"""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the maker of paths."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def committed(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches that are whole."""
    fs, to_path = _files(spark, path)
    folder = to_path(f"{path}/commits")
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def read_committed(spark: SparkSession, path: str, without: str | None = None) -> DataFrame | None:
    """The rows of all whole batches; None before the first."""
    ids = [x for x in committed(spark, path) if x != without]
    return spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/batch={x}" for x in ids)).drop("batch") if ids else None


def stage(rows: DataFrame, path: str, batch: str) -> None:
    """Writes a batch; readers don't see it yet."""
    rows.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")


def commit(spark: SparkSession, path: str, batch: str) -> None:
    """Makes a staged batch a part of the table; a batch that is one already stays as it is."""
    fs, to_path = _files(spark, path)
    if batch not in committed(spark, path):
        fs.create(to_path(f"{path}/commits/{batch}"), False).close()


def append_new(rows: DataFrame, path: str, keys: list[str], batch: int | str | None = None) -> None:
    """Appends the rows whose keys the table at a path does not hold, one for each key.

    batch: the id of a streaming batch; a call with an id that is committed does nothing.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    batch = uuid.uuid4().hex if batch is None else re.sub(r"\W", "_", str(batch))
    if batch in committed(spark, path):
        return
    rows = rows.dropDuplicates(keys)
    stored = read_committed(spark, path, without=batch)
    if stored is not None:
        rows = rows.join(stored.select(*keys), keys, "left_anti")
    stage(rows, path, batch)
    commit(spark, path, batch)


def eval_report(items: DataFrame, metrics: DataFrame, path: str) -> None:
    """One JSON record per metrics row, with its items (by corpus) inside."""
    nested = items.groupBy("corpus_id").agg(F.collect_list(F.struct(*[c for c in items.columns if c != "corpus_id"])).alias("items"))
    metrics.join(nested, "corpus_id", "left").write.mode("overwrite").json(path)
