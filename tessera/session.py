"""Session helpers: a local session for tests, shared tables that cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", app: str = "tessera") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if it is set.

    A folder of our own is used only where the session names none, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/tessera-shared"
    return named.rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders ``by`` a column if one is named, and read it back.

    Cuts the lineage: what follows never recomputes ``df``, and a lost executor
    loses none of it. The table is deleted when the driver process ends.
    """
    spark = df.sparkSession
    path = _own_path(spark, name)
    (df.hint("rebalance", by).write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The full URI of a new folder in the shared folder; it is deleted when the driver process ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(_own_path(spark, name))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    return re.sub("^file:/+", "file:///", files.makeQualified(target).toString())


def _own_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def bucketed(df: DataFrame, n: int, column: str) -> DataFrame:
    """Write ``df`` as a table in ``n`` buckets of ``column`` to the shared folder and read it back.

    Joins on ``column`` with rows in ``n`` partitions by it don't shuffle the table.
    The table is dropped when the driver process ends.
    """
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    df.write.bucketBy(n, column).sortBy(column).format("parquet").option("path", shared_folder(spark, name)).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended already
        return


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` wrote for ``df``, once nothing reads it."""
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for entry in [e for e in _written if any(f.endswith(e[1].rsplit("/", 1)[1]) for f in files)]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; the cluster's own cleaning is left
            return
