"""Tables in the shared folder that the cluster names: lineage ends there, so a lost executor repeats little."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that name none.
_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _temporary.get(spark.sparkContext.applicationId)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = _temporary[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-attest-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a Parquet table written once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
