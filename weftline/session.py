"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder where that is unset and one machine does it all (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        folder = Path(__file__).resolve().parent
        target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="weftline-")), "weftline.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(folder.rglob("*.py")):
                z.write(f, f"{folder.name}/{f.relative_to(folder).as_posix()}")
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)


def shipped(f: Callable) -> Callable:
    """f(spark, ...) with the package sent ahead."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that materialize wrote in this process; frames that read them are of no use afterwards."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for p in paths:
        _delete(spark, p)
    return len(paths)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize wrote, once nothing reads it any more."""
    path = getattr(df, "written_to", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, p: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(p)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by key whatever size Spark expects of it.

    Sides made of written tables are sized by these tables' compressed files, which take far less than the rows: Spark
    would send hundreds of megabytes to all tasks, by way of the driver.
    """
    return df.hint("merge")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back.

    Written tables survive lost executors, unlike cached blocks; they stay until release() or until the folder is cleaned.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out
