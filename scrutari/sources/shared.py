"""Folders, files and code that driver and executors share."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "scrutari")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    # Written on the driver only: Spark's file server hands it to the executors over the network.
    path = os.path.join(tempfile.mkdtemp(prefix="scrutari-code-"), "scrutari_code.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped[app] = True


def folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when the driver ends.

    A temporary one where that is unset and all is on one machine; elsewhere that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="scrutari-")
        _own[app] = f"{base.rstrip('/')}/scrutari-index-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove_quietly, spark, _own[app])
    return _own[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended
        return


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, *paths: str) -> int:
    """Bytes below some folders."""
    return sum(fs.getContentSummary(p).getLength() for p, fs in (_path(spark, x) for x in paths))


def mounted(spark: SparkSession, path: str) -> str | None:
    """A path of a file system that is mounted, as Python's own functions take it; None for any other."""
    p, fs = _path(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def make(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is no such folder."""
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear whole under a name that no file has; False if there is one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = f"{path}.{uuid.uuid4().hex[:8]}.new"
    p, fs = _path(spark, new)
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                # A rename of local files looks for the target first and so isn't atomic; a link is.
                to, of = (jvm.java.nio.file.Paths.get(x.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0)) for x in (target, p))
                jvm.java.nio.file.Files.createLink(to, of)
            else:
                none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(p, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        fs.delete(p, False)
