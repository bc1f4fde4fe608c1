"""Small files and folders of any store that Spark can write to, by its own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """What is in a folder, by name, with the time of its last change in seconds."""
    fs, p = _at(spark, path)
    return dict(sorted((s.getPath().getName(), s.getModificationTime() // 1000) for s in fs.listStatus(p))) if fs.exists(p) else {}


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new file with the whole text, or False if there is one of this name already.

    The text is written aside and renamed without overwriting, so readers never see a
    part of it. That only one of two writers wins is up to the store's rename: it holds
    for HDFS, not for object stores without a conditional put.
    """
    fs, p = _at(spark, path)
    aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    _, q = _at(spark, aside)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stream = fs.create(q, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(q, p, none)
        return True
    except Exception as error:
        fs.delete(q, False)
        if fs.exists(p):
            return False
        raise error


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def base_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all run on this machine, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    return "file://" + _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="tidefold-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{base_folder(spark)}/tidefold/{name}-{uuid.uuid4().hex}"
