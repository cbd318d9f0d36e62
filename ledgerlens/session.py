"""Session settings and the shared scratch area."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster, use the cluster's own."""
    here = str(Path(__file__).resolve().parents[1])  # stateful streams look their functions up on PYTHONPATH only
    os.environ["PYTHONPATH"] = os.pathsep.join([here, *filter(None, [os.environ.get("PYTHONPATH")])])
    b = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerlens")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_PROVIDER: ROCKSDB,
    } | conf
    spark = b.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once per context: functions that run
    there are found by name, wherever the driver was started. The driver's own worker, which looks at
    a stateful stream's functions first, knows no sent files, only PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerlens-")) / "ledgerlens.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc.environment["PYTHONPATH"] = os.pathsep.join([str(archive), *filter(None, [sc.environment.get("PYTHONPATH")])])
    sc._ledgerlens_shipped = True  # type: ignore[attr-defined]


@contextmanager
def stateful(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Streams that start inside keep their state on RocksDB, whatever the session's setting: Spark's own
    default has no transformWithState. A micro-batch stores its changes only. A stream takes its settings
    along when it starts; the session's come back."""
    wanted = {STATE_PROVIDER: ROCKSDB, CHANGELOG: "true"} | conf
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where
    the setting is absent and Spark runs in a single process."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir() or made


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores, for work in Python: a table of one
    row group would keep one core busy. A scan that has enough partitions is left alone, so that
    large tables are never exchanged for this. Rows and results are the same either way."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def if_small(df: DataFrame) -> DataFrame:
    """df as a broadcast side if it has at most BROADCAST_ROWS rows and about BROADCAST_BYTES bytes,
    both counted first; else df, to be joined by exchange."""
    rows, most = BROADCAST_ROWS, BROADCAST_BYTES
    width: Column = F.lit(0)
    for f in df.schema.fields:
        text = F.col(f"`{f.name}`").cast("string") if not isinstance(f.dataType, T.AtomicType) else F.col(f"`{f.name}`")
        wide = not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DatetimeType)
        width = width + (F.coalesce(F.octet_length(text), F.lit(0)) + 16 if wide else F.lit(16))
    n, size = df.limit(rows + 1).select(width.alias("w")).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_written: dict[str, SparkSession] = {}


def _forget() -> None:
    for path, spark in _written.items():
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(_forget)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it back: the lineage
    ends there, several consumers read it, and it outlives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    w = df.write.option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._ledgerlens_path = path  # type: ignore[attr-defined]
    return table


def release(table: DataFrame | None) -> None:
    """Deletes a table of `materialize` whose consumers have ended; those of no use to a long job
    need not stay until its end."""
    path = getattr(table, "_ledgerlens_path", None)
    if path and _written.pop(path, None):
        delete(table.sparkSession, path)  # type: ignore[union-attr]
