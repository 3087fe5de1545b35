"""Session settings that every entry point shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; it is deleted when the driver's Python ends.

    Where none is set and all run on one machine, as in tests, it is in a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cairnflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def drop_scratch() -> None:
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            if spark.sparkContext._jsc is not None:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(drop_scratch)


def build_session(master: str | None = None, app: str = "cairnflow", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides any setting.

    The package goes to the workers with it, as theirs may start in another folder.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, where it isn't installed; once a session."""
    import shutil
    from pathlib import Path

    if getattr(spark, "_cairnflow_sent", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cairnflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # workers fetch it from here as they start
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/cairnflow", "zip", root.parent, root.name))
    spark._cairnflow_sent = True
