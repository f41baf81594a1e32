"""Session helpers: local session builder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    folder = os.path.join(tempfile.gettempdir(), f"threadgraph-{sc.applicationId}")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` once to the checkpoint folder and reading it back.

    One pass over the plan (``DataFrame.checkpoint`` runs it twice), the files outlive
    lost executors, and their known size lets the optimizer choose join strategies.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``materialize`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        base = path(checkpoint_dir(spark))
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path(folder).toUri().getPath().startswith(base.toUri().getPath() + "/"):
                fs.delete(path(folder), True)
