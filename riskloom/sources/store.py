"""Materialised derived tables in the shared checkpoint folder.

Reports share one derived input (the transaction table with its trailing-window
features).  Building it once per application and writing it as parquet under
the cluster's ``spark.checkpoint.dir`` cuts the lineage (executor loss re-reads
files instead of recomputing windows) and lets every later job prune columns
and push filters into a plain parquet scan.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import ensure_checkpoint_dir

_BUILT: dict[tuple[str, str], str] = {}
_LOCK = threading.Lock()          # jobs may be started from several driver threads


def _root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/riskloom-tables"


def spill(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what stands below runs once, whatever reads it."""
    path = f"{_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spilled(df: DataFrame) -> None:
    """Delete a table of ``spill`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/riskloom-tables/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_state(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of the files below ``source``: a derived table is rebuilt when they change."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files, it = [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        files.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(files)).encode()).hexdigest()


def materialized(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """Return table ``name`` derived from ``source``; build and write it on first use
    in this application, afterwards read the written files."""
    app = spark.sparkContext.applicationId
    place = os.path.abspath(source) if "://" not in source else source
    key = (app, f"{name}@{place}@{file_state(spark, place)}")
    with _LOCK:
        path = _BUILT.get(key)
        if path is None:
            digest = hashlib.sha1(key[1].encode()).hexdigest()[:12]
            path = f"{_root(spark)}/{name}-{digest}"
            build().write.mode("overwrite").parquet(path)
            _BUILT[key] = path
    return spark.read.parquet(path)
