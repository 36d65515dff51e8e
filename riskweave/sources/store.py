"""Small files and folders on the store that a path names, reached as Spark reaches it.

Manifests, policies and registries lie beside the models and tables that Spark
writes, so they go through the same Hadoop file systems: a path without a
scheme means the default one, whichever that is.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def located(path: object):
    """The file system and the Hadoop path of ``path``."""
    spark = session()
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs.getRaw() if fs.getScheme() == "file" else fs), where


def exists(path: object) -> bool:
    fs, where = located(path)
    return fs.exists(where)


def is_file(path: object) -> bool:
    fs, where = located(path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def children(path: object) -> list[str]:
    """Names of what a folder holds, in order; none if there is no such folder."""
    fs, where = located(path)
    return sorted(status.getPath().getName() for status in fs.listStatus(where)) if fs.exists(where) else []


def read_text(path: object) -> str:
    fs, where = located(path)
    stream = fs.open(where)
    try:
        return session()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: object, text: str) -> None:
    """Write beside the place first, then rename over it, so that readers see the old or the new text."""
    fs, where = located(path)
    beside = where.getParent().suffix(f"/.{where.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, True)
    try:
        session()._jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
    finally:
        stream.close()
    replace(beside.toString(), path)


def replace(source: object, target: object) -> None:
    """Rename, over a file that is there."""
    spark = session()
    jvm = spark._jvm
    fs, where = located(target)
    modes = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    modes[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(located(source)[1], where, modes)


def copy(source: object, target: object) -> None:
    """Copy a file or a folder with all it holds."""
    (a, x), (b, y) = located(source), located(target)
    b.mkdirs(y.getParent())
    spark = session()
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} could not be copied")


def move(source: object, target: object) -> None:
    """Rename to a place where nothing is yet."""
    fs, where = located(target)
    if fs.exists(where) or not fs.rename(located(source)[1], where):
        raise FileExistsError(f"{target} is taken")


def delete(path: object) -> None:
    fs, where = located(path)
    fs.delete(where, True)


def scratch(spark) -> str:
    """A new folder that all executors share; removed when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    folder = f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/riskweave-{uuid.uuid4().hex}"
    fs, where = located(folder)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return folder
