"""Session helpers: table access, the shared work folder, and written intermediate tables.

Intermediate results that cut lineage are written as Parquet below the folder
that the cluster names in ``spark.checkpoint.dir``; every executor can read
them again after a loss. Only where that setting is absent on a local master
(tests on one machine) a folder of our own is used; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own_dir: str | None = None


def build(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="trama-code-")  # on the driver, whose file server hands it out
    atexit.register(_remove_local, tmp)
    to = Path(tmp) / "trama.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady(spark: SparkSession) -> SparkSession:
    """A session of our own in the same application for operators that run one small plan many times.

    Its plans are static: re-planning costs more than such a round takes, and a relation to broadcast would be built in
    the driver. The caller's settings stay as they are. Frames go from one session to the other by ``Work.load``.
    """
    own = spark.newSession()
    # stages that do the same share one compiled class, wherever they stand in a plan
    for key, value in (("codegen.useIdInClassName", "false"), ("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1"), ("shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")), ("session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        own.conf.set(f"spark.sql.{key}", value)
    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or one of our own where it is unset and the master is local."""
    global _own_dir
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="trama-work-")
        atexit.register(_remove_local, _own_dir)
    return f"file://{_own_dir}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


_works: set[Work] = set()


@atexit.register
def _clear_all() -> None:
    for work in list(_works):
        work.clear()


class Work:
    """Written intermediate tables of one run of an operator.

    ``save`` writes a frame below the shared folder and reads it back, which
    cuts its lineage; ``load`` reads it in another session; ``drop`` removes a
    table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _works.add(self)

    def save(self, df: DataFrame, name: str, **figures: Column) -> DataFrame:
        """df, written. Figures are aggregates over its rows, taken as they are written, and become its ``figures``."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        seen = Observation() if figures else None
        if seen:
            df = df.observe(seen, *[c.alias(n) for n, c in figures.items()])
        df.write.option("compression", "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._trama_path = path
        out.figures = seen.get if seen else {}
        return out

    def load(self, df: DataFrame, spark: SparkSession) -> DataFrame:
        """A saved frame as one of another session of the application."""
        out = spark.read.schema(df.schema).parquet(df._trama_path)
        out._trama_path = df._trama_path
        return out

    def clear(self) -> None:
        """Removes all tables of the run, at the latest as the driver ends."""
        _works.discard(self)
        try:
            self._delete(self.root)
        except Exception:  # the JVM may have ended before
            pass

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_trama_path", None)
        if path is not None:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
