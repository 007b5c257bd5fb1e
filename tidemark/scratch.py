"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine (a local master, as in tests) may have none:
    a temporary folder is then set, once. On a cluster that is an error, as
    executors would not find each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.scratch", None)
    if not given:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        given = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.scratch", given)
    return given.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application's folders lie in."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's folder; nothing is created yet."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to a fresh folder and read back: what is made of it neither plans nor runs its upstream again."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str | None = None) -> None:
    """Removes one of the session's folders, or all of them: call it when what reads them has been written."""
    path = path or session_dir(spark)
    if not path.startswith(session_dir(spark)):
        raise ValueError(f"{path} is not of this session")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
