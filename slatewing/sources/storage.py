"""Folders that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Paths handed out by ``scratch`` and not yet removed.
CREATED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary folder
    is set on one machine (tests); on a cluster it is an error, since executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='slatewing-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    CREATED.append(f"{shared_dir(spark)}/slatewing-{label}-{uuid.uuid4().hex}")
    return CREATED[-1]


def release(spark: SparkSession, *keep: str, since: int = 0) -> None:
    """Removes what lies at the scratch paths handed out from number ``since`` on, but for those to keep.
    For use once the results that read them have been written."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for x in [x for x in CREATED[since:] if x not in keep]:
        path = path_of(x)
        path.getFileSystem(conf).delete(path, True)
        CREATED.remove(x)
