"""The shared folder that the cluster names, tables written there, and byte ranges of files in it."""

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one numpy step works on at once; a longer text is a step of its own.
STEP_CHARS = 1 << 19


#: Folders of local sessions that name none.
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its scheme. Where that is unset a local test session gets a temporary one, removed at exit; a cluster has to name one.

    A folder without scheme is one of the default file system, for Spark's tables and for files that tasks open alike.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(spark.sparkContext.applicationId)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = _temporary[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-attest-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return qualified(spark, found)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme and host: one without is in the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub("^file:/(?!/)", "file:///", found)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that one file of it may hold.
FILE_ROWS = 1 << 17


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: lineage ends there, so a lost executor repeats nothing before it.

    rows: about how many small rows there are, where that is known; a table of few rows then gets few files.
    """
    path = new_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.lru_cache(8)
def _file_system(prefix: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(prefix)[0]


def opened(uri: str):
    """A file system of pyarrow and the path in it, for a path or a URI such as file:, hdfs: or s3:."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    scheme, _, rest = uri.partition("://")
    host = rest.partition("/")[0]
    if scheme == "file":
        return _file_system("file:///"), "/" + rest.partition("/")[2]
    system = _file_system(f"{scheme}://{host}/")
    return system, rest if scheme in ("s3", "gs", "gcs") else "/" + rest.partition("/")[2]


def make_folder(uri: str) -> str:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
    return uri


def parts_of(lengths: list[int], most: int = STEP_CHARS) -> list[int]:
    """How many rows, in order, make parts of about so many characters each."""
    return np.unique(np.cumsum(lengths) // most, return_counts=True)[1].tolist()


def steps(frame: pd.DataFrame, column: str, most: int = STEP_CHARS) -> Iterator[pd.DataFrame]:
    """The rows in order, in parts of about so many characters of a text column."""
    if len(frame):
        part = np.cumsum([len(x) if isinstance(x, str) else 0 for x in frame[column]]) // most
        for _, rows in frame.groupby(part, sort=True):
            yield rows


def few_parts(df: DataFrame, text: str, size: int) -> int:
    """How many parts of about so many bytes a table makes; some for every core at least.

    Tables of files are known by the length of these. Where the plan knows no length (rows of the driver, a table that is
    kept but not made yet) its estimate is beyond all bounds, and the text is counted.
    """
    there = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if there >= 1 << 50:
        there = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-there // size))


def range_bounds(rows: DataFrame, key: str, n: int) -> list:
    """Values of a number column that cut its rows into n ranges of about equal size; numbers, so every plan that uses them cuts alike."""
    if n < 2:
        return []
    found = rows.agg(F.percentile_approx(key, [(k + 1) / n for k in range(n - 1)], 20 * n)).first()[0]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list) -> Column:
    """How many bounds lie below a value (null: 0), by a search in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda x: x < key
    every = F.lit(bounds[step - 1 :: step]) if len(bounds) >= step else F.array()
    coarse = F.size(F.filter(every, below)) * step
    fine = F.size(F.filter(F.slice(F.lit(bounds), coarse + 1, step), below))
    return F.coalesce(F.when(key.isNotNull(), coarse + fine), F.lit(0)).cast("int")


def tree_sum(parts: DataFrame, keys: list[str], numbers: str, fan_in: int = 32) -> DataFrame:
    """Adds up packed int64 vectors by key. parts: keys, part long, and the vectors as binary.

    Partial sums of at most fan_in vectors form a level, so no task holds more than that many,
    however many partitions the input has.
    """
    schema = ", ".join([*(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys), "part long", f"{numbers} binary"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i8") for x in rows[numbers])
        out = rows.iloc[:1][keys].copy()
        out["part"] = rows["up"].iloc[0]
        out[numbers] = [total.tobytes()]
        return out

    n = parts.select(F.max("part")).first()[0]
    while n is not None:
        up = (F.col("part") / fan_in).cast("long")
        parts = parts.withColumn("up", up).groupBy(*keys, "up").applyInPandas(add, schema)
        if n < fan_in:
            break
        n //= fan_in
    return parts.drop("part")
