"""Session helpers: the shared scratch folder, materialised intermediates and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_sent: set[str] = set()
_written: list[tuple[SparkSession, str]] = []

#: Rows up to which a small side may be broadcast after it has been counted (tens of MB for narrow rows).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local folder only where that is unset (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _own["dir"]


def materialize(df: DataFrame, free: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    free: let the driver collect its garbage then, so that Spark deletes the shuffle files of plans that have ended; worth it
    after large shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._ledgerloom_path = path
    if free:
        spark._jvm.System.gc()
    return back


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; only when nothing lazy still reads it."""
    path = getattr(df, "_ledgerloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


def release() -> None:
    """Delete all scratch tables of this process; results that were not written yet become unreadable."""
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; nothing else can be done at exit
            return


atexit.register(release)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df itself (a shuffle join with AQE)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def prepare_python(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python code runs on executors: cap the rows in an Arrow batch, so that a batch of long texts fits a worker,
    and send this package along (once for each application)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / f"{top.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        spark.sparkContext.addPyFile(str(at))
        _sent.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
