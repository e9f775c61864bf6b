"""Small files of a run by Hadoop's file systems, so that a path means the same to the driver and to Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    """(file context, path, gateway) of a path; a relative one stands in the working folder of the default file system."""
    jvm, hadoop = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    given = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(given.getFileSystem(hadoop).getUri(), hadoop), given, spark.sparkContext._gateway


def _flags(spark: SparkSession, gateway, kind: str, name: str):
    options = getattr(getattr(spark._jvm.org.apache.hadoop.fs, "Options"), kind)
    array = gateway.new_array(options, 1)
    array[0] = getattr(options, name)
    return array


def exists(spark: SparkSession, path: str) -> bool:
    context, given, _ = _context(spark, path)
    return bool(context.util().exists(given))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no folder."""
    if not exists(spark, folder):
        return []
    context, given, _ = _context(spark, folder)
    return sorted(s.getPath().getName() for s in context.util().listStatus(given))


def read_text(spark: SparkSession, path: str) -> str:
    context, given, _ = _context(spark, path)
    stream = context.open(given)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a file under a name of its own and rename it, so that readers see all of it or nothing.

    Returns False, and leaves what is there, if the file exists and may not be replaced.
    """
    context, given, gateway = _context(spark, path)
    folder, tmp = given.getParent(), spark._jvm.org.apache.hadoop.fs.Path(given.getParent(), f"_{given.getName()}.{uuid.uuid4().hex}")
    fs = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(folder)
    # No sums beside a local file, which others may go on to write.
    fs.setWriteChecksum(False)
    try:
        stream = fs.create(tmp, False)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()
    finally:
        fs.setWriteChecksum(True)
    try:
        context.rename(tmp, given, _flags(spark, gateway, "Rename", "OVERWRITE" if replace else "NONE"))
    except Exception as e:
        fs.delete(tmp, False)
        if not replace and "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    context, given, _ = _context(spark, path)
    given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(given, True)


def join(folder: str, *names_: str) -> str:
    return "/".join([folder.rstrip("/") or "/", *names_])
