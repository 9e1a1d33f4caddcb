"""Tables that outlive a query: indexes and intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file:///tmp/tessella-{os.getuid()}"
    return where.rstrip("/")


def parked(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.parked_at = path
    return out


def fingerprint(df: DataFrame) -> str:
    """Of the files that ``df`` reads: their paths, and the sizes and times of change that their file system gives, a listing a folder."""
    spark, out = df.sparkSession, []
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = sorted(df.inputFiles())
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = path_of(folder)
        for status in path.getFileSystem(conf).listStatus(path):
            out.append(f"{status.getPath().toUri().getPath()}\0{status.getLen()}\0{status.getModificationTime()}")
    names = {spark._jvm.java.net.URI(f).getPath() for f in files} if len(files) < 10_000 else None
    kept = out if names is None else [x for x in out if x.split("\0")[0] in names]
    return hashlib.sha256("\n".join(sorted(kept)).encode()).hexdigest()


@functools.cache
def _code() -> str:
    """The digest of the library's sources: an index that other code made is not this code's index."""
    here = os.path.dirname(os.path.abspath(__file__))
    out = hashlib.sha256()
    for folder, folders, names in os.walk(here):
        folders[:] = sorted(f for f in folders if f not in ("llm", "__pycache__"))
        for name in sorted(n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                out.update(f.read())
    return out.hexdigest()


def _place(source: DataFrame, name: str, mark: str | None) -> str:
    key = hashlib.sha256("\0".join((name, mark or fingerprint(source), _code())).encode()).hexdigest()[:32]
    return f"{shared_dir(source.sparkSession)}/tessella-{name}-{key}"


def built(source: DataFrame, name: str, make: Callable[[], DataFrame], mark: str | None = None) -> DataFrame:
    """The table that ``make`` gives for ``source``, written once and read wherever, and by whatever session, it is asked for again.

    It is made anew if a file of ``source`` or the library's code changes, or if the written table has been deleted. It is
    written beside its place and renamed, so what is there is whole. ``mark`` is the source's fingerprint where it is known.
    """
    spark, path = source.sparkSession, _place(source, name, mark)
    if not exists(spark, f"{path}/_SUCCESS"):
        beside = f"{path}-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(beside)
        if exists(spark, path):  # another run was faster, or an older one left a part
            delete(spark, path if not exists(spark, f"{path}/_SUCCESS") else beside)
        if exists(spark, beside):
            rename(spark, beside, path)
    return spark.read.parquet(path)


def found(source: DataFrame, name: str, mark: str | None = None) -> DataFrame | None:
    """The table that :func:`built` has written for ``source``, if it is there."""
    spark, path = source.sparkSession, _place(source, name, mark)
    return spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None


def discard(df: DataFrame) -> None:
    """Delete the files of a parked table that no later step and no result reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.parked_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    fs, where = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it isn't there."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, where = _file_system(spark, beside)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(where, spark._jvm.org.apache.hadoop.fs.Path(path), options)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _file_system(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not become {new}")
