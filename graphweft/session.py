"""What every operator needs from the session: tables, shared storage, code on the workers, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which :func:`checked_broadcast` sends a frame to every executor.
BROADCAST_ROWS = 100_000

_shipped: dict[str, str] = {}
_tables: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages can import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="graphweft-"), "graphweft_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where it is unset, as in tests, a local one is set.

    On a cluster a folder of the driver's machine would be another one on each executor, so there the setting is required.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return folder or current.get()
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="graphweft-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small input has fewer partitions than there are; larger inputs stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read again: drawn ids stay as they are, and plans over it start afresh."""
    if not df.columns:
        return cut(df)
    plain = df.select(*[F.col(f"`{n}`").cast("string").alias(n) if t == "void" else F.col(f"`{n}`") for n, t in df.dtypes])
    path = f"{_tables_of(df.sparkSession)}/{uuid.uuid4().hex}"
    plain.write.parquet(path)
    out = df.sparkSession.read.schema(plain.schema).parquet(path)
    out.settled_at = path
    return out


def _tables_of(spark: SparkSession) -> str:
    """The folder of this application's settled tables; no frame outlives the application, so they are deleted when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        _tables[app] = f"{shared_dir(spark).rstrip('/')}/graphweft-tables/{app}"
        atexit.register(_drop, spark, _tables[app])
    return _tables[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the table of a settled frame that nothing will read any more: all that was made from it is written."""
    path = getattr(df, "settled_at", None)
    if path:
        _delete(df.sparkSession, path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``rows`` rows, else ``df`` itself, which then joins by shuffle."""
    return F.broadcast(df) if at_most(df, rows) else df


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp as it is written, whatever the session's time zone."""
    seconds = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c).cast("decimal(18,6)") * 1_000_000).cast("long")


def month_of_micros(c: Column) -> Column:
    """``yyyy-MM`` of microseconds since 1970 (UTC)."""
    day = F.date_from_unix_date((F.floor(c / F.lit(86_400_000_000))).cast("int"))
    return F.date_format(day, "yyyy-MM")
