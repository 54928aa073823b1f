"""What Spark sessions need to run the library's Python functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, Path("textloom") / file.relative_to(PACKAGE))
    context.addPyFile(str(archive))
    context._textloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that the context has.

    Where neither is set, a session on one machine gets a temporary folder of its
    own, which goes when Python ends; on a cluster that is an error.
    """
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if (found := context._jsc.sc().getCheckpointDir()).isDefined():
        return found.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(context, "_textloom_folder"):
        context._textloom_folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, context._textloom_folder, ignore_errors=True)
    return context._textloom_folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from what was written.

    Spark's context cleaner removes the files once no plan refers to them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for tables that queries read again; removed with the others when Python ends."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4()}"
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.append((spark, path))
    return path


_SCRATCH: list[tuple[SparkSession, str]] = []


def _remove_scratch() -> None:
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        if spark.sparkContext._jsc is None:
            continue  # the session has ended
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone; what is left lies in the shared folder
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
