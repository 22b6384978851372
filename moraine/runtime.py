"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


@atexit.register
def _clean() -> None:
    for path in _OWN:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, wherever they were started."""
    context = spark.sparkContext
    if getattr(context, "_moraine", None):
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="moraine-"), "moraine.zip")
    _OWN.append(os.path.dirname(path))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    context.addPyFile(path)
    context._moraine = path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A temporary folder of this process stands in only where the setting is
    unset, that is, in tests on one machine.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors of {master} share")
        got = "file://" + tempfile.mkdtemp(prefix="moraine-")
        _OWN.append(got)
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def materialize(df: DataFrame, tag: str = "step", by: str | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder, in folders ``by`` the values of a column, and read it back.

    ``options`` are the writer's.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and consumers that use the result twice do not compute it twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.options(**(options or {}))
    (writer.partitionBy(by) if by else writer).parquet(path)
    if os.path.isdir(path.removeprefix("file://")):
        _OWN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step = path
    return out


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as that knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, which gets its name when it is complete; one of that name is replaced."""
    fs, at = file_system(spark, path)
    new = file_system(spark, path + ".new")[1]
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{path} could not be put in place")


def discard(step: DataFrame) -> None:
    """Remove a written step, wherever it lies, once all that reads it has been written itself."""
    path = getattr(step, "_step", None)
    if path:
        fs, at = file_system(step.sparkSession, path)
        fs.delete(at, True)


def width(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
