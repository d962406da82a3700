"""The session's shared folder, and making the package known to the executors' Python workers."""

from __future__ import annotations

import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Spark's setting (since 4.1) by which a query drops the files of its shuffles when it ends.
_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Seconds from one collection that ``cut`` asks for to the next, and when it asked last.
APART, _asked = 10.0, -float("inf")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session that has none gets one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the session.

    Spark is told to drop the shuffles of the checkpoint as it ends, since the caller still holds ``df`` and
    with it all that it was made from. Broadcasts leave the executors only once the driver's JVM has collected
    what stood for them, which a driver with little to do may never do by itself, so this asks for it, but not
    at every one of many small cuts: collections in close order take so much of the time that the JVM
    answers by enlarging its heap.
    """
    global _asked
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_DROPS, None)
    spark.conf.set(_DROPS, "true")
    try:
        whole = df.select("*").checkpoint()  # a plan of its own, made under the setting
    finally:
        spark.conf.unset(_DROPS) if before is None else spark.conf.set(_DROPS, before)
    if time.monotonic() - _asked >= APART:
        spark.sparkContext._jvm.System.gc()
        _asked = time.monotonic()
    return whole


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the workers of this application, once, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="pyfiles-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark
