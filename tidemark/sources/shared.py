"""The shared folder, and the few file operations the engine needs there.

All of it goes through Hadoop's FileSystem, so the folder may be on any store
the cluster can reach. Files and folders made here are removed when the JVM
ends, at the latest.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(KEY, made)
    path(spark, made)[0].deleteOnExit(path(spark, made)[1])
    return made


def path(spark: SparkSession, at: str):
    """(FileSystem, Path) of Hadoop for a location."""
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def fresh_folder(spark: SparkSession, name: str) -> str:
    at = f"{folder(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = path(spark, at)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return at


def release(spark: SparkSession) -> None:
    """Remove everything this engine wrote to the shared folder; only when no result that reads it is in use."""
    remove(spark, f"{folder(spark)}/tidemark")


def exists(spark: SparkSession, at: str) -> bool:
    fs, p = path(spark, at)
    return fs.exists(p)


def remove(spark: SparkSession, at: str) -> None:
    fs, p = path(spark, at)
    fs.delete(p, True)


def names(spark: SparkSession, at: str) -> list[str]:
    fs, p = path(spark, at)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _stage(spark: SparkSession, at: str, text: str):
    """``text`` in a file of its own beside ``at``: (local file or null, FileSystem, Path of the file, Path of ``at``)."""
    fs = path(spark, at)[0]
    p, tmp = (fs.makeQualified(path(spark, x)[1]) for x in (at, f"{at}.{uuid.uuid4().hex[:12]}.tmp"))
    if fs.getUri().getScheme() == "file":  # without the checksum files that Hadoop adds to local ones
        io = spark._jvm.java.nio.file
        local = io.Path.of(p.toUri()), io.Path.of(tmp.toUri())
        io.Files.createDirectories(local[0].getParent(), spark._sc._gateway.new_array(io.attribute.FileAttribute, 0))
        io.Files.write(local[1], bytearray(text.encode()), spark._sc._gateway.new_array(io.OpenOption, 0))
        return local, fs, tmp, p
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return None, fs, tmp, p


def _rename(spark: SparkSession, tmp, p, option: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(getattr(hadoop, "Options$Rename"), option)
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(tmp, p, options)


def write_text(spark: SparkSession, at: str, text: str) -> None:
    """Write a small file, in place of what is there, so that it is there whole or not at all."""
    local, _, tmp, p = _stage(spark, at, text)
    if local:
        io = spark._jvm.java.nio.file
        options = spark._sc._gateway.new_array(io.CopyOption, 1)
        options[0] = io.StandardCopyOption.ATOMIC_MOVE
        io.Files.move(local[1], local[0], options)
    else:
        _rename(spark, tmp, p, "OVERWRITE")


def create_text(spark: SparkSession, at: str, text: str) -> bool:
    """Write a small file whole if there is none of that name; false, and nothing written, if there is one. Of several
    writers of one name a single one gets true."""
    local, fs, tmp, p = _stage(spark, at, text)
    try:
        if local:
            spark._jvm.java.nio.file.Files.createLink(*local)  # fails where the name is taken
        else:
            _rename(spark, tmp, p, "NONE")
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        if local:
            spark._jvm.java.nio.file.Files.deleteIfExists(local[1])
        elif fs.exists(tmp):
            fs.delete(tmp, False)


def read_text(spark: SparkSession, at: str) -> str:
    fs, p = path(spark, at)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def size(spark: SparkSession, at: str) -> int:
    fs, p = path(spark, at)
    return fs.getContentSummary(p).getLength()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: a cut of the lineage
    that outlives any executor."""
    spark = df.sparkSession
    at = f"{fresh_folder(spark, name)}/t"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
