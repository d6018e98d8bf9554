"""Session helpers: table access and durable, shared materialisation."""

from __future__ import annotations

import atexit
import io
import pathlib
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []
_collected = 0.0


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context, by way of the shared folder.

    Functions of this package travel to the workers by name, so these must be able to import it wherever they run.
    """
    sc = spark.sparkContext
    if getattr(sc, "_siftlake_shipped", False):
        return
    root = pathlib.Path(__file__).parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark)}/siftlake/package-{uuid.uuid4().hex}/siftlake_package.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(path)
    _OWN.append((spark, path))
    sc._siftlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. The path may belong to any store that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back on a temporary folder; on a cluster an unset folder is an error, because a
    machine-local path would be visible to one machine only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _let_go(spark: SparkSession, every: float = 2.0) -> None:
    """The shuffles of a query just written are of no more use; the driver's cleaner drops them once they are collected.

    Small queries in a row share a collection: what they shuffle together is small as well.
    """
    global _collected
    if time.monotonic() - _collected > every:
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def durable(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage without depending on any executor's own disk: a lost executor only costs the tasks it ran.
    The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _OWN.append((spark, path))
    _let_go(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def durable_counted(df: DataFrame, name: str = "part") -> tuple[DataFrame, int]:
    """``durable`` and the number of rows, counted by the write itself: no further job."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def memoised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path`` if a finished write is there; else what ``build`` gives, written there first."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Log:
    """Rows gathered over the rounds of a loop in one shared folder: each round appends, and the plan of a reader stays one scan."""

    def __init__(self, first: DataFrame, name: str = "log"):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_dir(self.spark)}/siftlake/{name}-{uuid.uuid4().hex}"
        _OWN.append((self.spark, self.path))
        self.append(first)

    def append(self, rows: DataFrame) -> int:
        """Write ``rows`` (which may read this log as it is now) and give their number. A round has a folder of its own, so a retried write replaces it."""
        seen = Observation()
        self._rounds = getattr(self, "_rounds", 0)
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/round={self._rounds}")
        self._rounds += 1
        _let_go(self.spark)
        return seen.get["n"]

    def read(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={i}" for i in range(self._rounds)])
        out._durable_path = self.path
        return out


def release(df: DataFrame) -> None:
    """Delete what ``durable`` wrote, when everything that reads it has itself been written."""
    spark, path = df.sparkSession, df._durable_path
    discard(path, spark)
    _OWN.remove((spark, path))


def discard(df_path: str, spark: SparkSession) -> None:
    """Delete a folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _OWN:
        try:
            discard(path, spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return
