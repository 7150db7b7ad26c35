"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("larkspan")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, as in tests, a local master falls back to /tmp; a real
    cluster without the setting is an error, since executors would not see
    each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


#: Bytes of a Parquet file that may well be one row group, which Spark reads in one task.
ONE_GROUP = 32 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """A scanned table; a single small file, which one task may read alone, is dealt out to all cores, any other table is left as it lies.

    Only the place of rows changes, never the rows.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if (4 << 20) < size < ONE_GROUP and len(rows.inputFiles()) == 1:
        return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return rows


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_left: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    for path, spark in _left.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone by now
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/larkspan/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkspan_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing lazy reads it."""
    for df in dfs:
        path = getattr(df, "_larkspan_path", None)
        if path:
            _delete(df.sparkSession, path)
            _left.pop(path, None)
