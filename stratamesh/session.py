"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(cpus: int | str = "*", name: str = "stratamesh", **conf: str) -> SparkSession:
    """A local session with the settings that the results rely on (UTC, ANSI, AQE)."""
    n = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STRATAMESH_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the cluster names in ``spark.checkpoint.dir``. Only a local
    master, whose executors are this process, gets a temporary folder where none is set; a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="stratamesh-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back, so that loops keep a short lineage, lost executors
    lose nothing, and the next plan knows the true size. ``drop`` deletes the table when it is no longer needed."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _read(df.sparkSession, df.schema, path)


def cut_by(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """As ``cut``, but the rows for which ``flag`` holds in one table and the others in another, in one pass."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(flag).parquet(path)
    schema = df.drop(flag).schema
    for value in ("true", "false"):
        _path(spark, f"{path}/{flag}={value}").mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{flag}={value}"))
    return _read(spark, schema, f"{path}/{flag}=true"), _read(spark, schema, f"{path}/{flag}=false")


def gather(tables: list[DataFrame]) -> DataFrame:
    """The rows of several tables of one schema made by ``cut``, as one scan (a union of many would be a long plan)."""
    return _read(tables[0].sparkSession, tables[0].schema, *[p for t in tables for p in t._cut])


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut``; frames that still read them can no longer run."""
    for t in tables:
        for p in t._cut:
            _path(t.sparkSession, p).delete(t.sparkSession._jvm.org.apache.hadoop.fs.Path(p), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    df = spark.read.schema(schema).parquet(*paths)
    df._cut = paths
    return df
