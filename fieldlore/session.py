"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it was counted and has at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fieldlore-code-")) / "fieldlore.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set and all runs in one machine (tests),
    which goes when the driver ends."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        told = tempfile.mkdtemp(prefix="fieldlore-checkpoint-")
        atexit.register(shutil.rmtree, told, ignore_errors=True)
        sc.setCheckpointDir(told)
    elif told is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    return told or sc.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder's path in the shared folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(kind: T.DataType, c: Column) -> Column:
    """Bytes of a value, by its type and, of strings and arrays, by its length."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        own = F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x) + 16) if isinstance(kind.elementType, T.StringType) else 16 * F.coalesce(F.size(c), F.lit(0))
        return own + 24
    if isinstance(kind, T.StructType):
        return functools.reduce(lambda a, b: a + b, [_bytes(f.dataType, c[f.name]) for f in kind], F.lit(16))
    return F.lit(16)


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, counted both, are within the limits, else as it is."""
    size = functools.reduce(lambda a, b: a + b, [_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema], F.lit(0))
    rows, bytes_ = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and bytes_ <= most else df


#: Parts into which a hot key is spread.
SALTS = 32


def salted(left: DataFrame, right: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of a side with hot keys (left) and a lookup side (right): broadcast if the lookup is small; else the left
    rows of a key are spread by their hash over SALTS parts, each of which gets the key's lookup rows."""
    hinted = small_or_plain(right, limit)
    if hinted is not right:
        return left.join(hinted, key)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [key, "_salt"]).drop("_salt")


def build_session(app: str = "fieldlore", cores: str | None = None) -> SparkSession:
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
