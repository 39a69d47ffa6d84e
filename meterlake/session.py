"""Session and table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "meterlake", **conf: str) -> SparkSession:
    """A session with the settings that the catalogue assumes: UTC, adaptive execution, last-wins maps."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='meterlake-')}"
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: What applications have made by new_folder and new_table, by their ids.
_MADE: dict[str, tuple[list[str], list[str]]] = {}


def _made(spark: SparkSession) -> tuple[list[str], list[str]]:
    return _MADE.setdefault(spark.sparkContext.applicationId, ([], []))


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that no other has; it is noted for drop_made."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made(spark)[0].append(path)
    return path


def new_table(spark: SparkSession, name: str) -> str:
    """A table's name that no other has; it is noted for drop_made."""
    table_name = f"{name}_{uuid.uuid4().hex}"
    _made(spark)[1].append(table_name)
    return table_name


def drop_made(spark: SparkSession) -> int:
    """Deletes the folders and tables that this application has made on the way, and says how many. Frames that read them, such as results of queries, can be read no more."""
    folders, tables = _MADE.pop(spark.sparkContext.applicationId, ([], []))
    for path in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(folders) + len(tables)
