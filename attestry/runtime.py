"""Session helpers shared by every operator.

Nothing here reads data; these functions decide where intermediate tables go, how
Python workers find the package, and whether a side is small enough to broadcast.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its *estimated or counted* size is below this many bytes.
BROADCAST_BYTES = 8 << 20

_own_dirs: list[str] = []


def builder(app: str = "attestry", cores: int | str = "*") -> SparkSession.Builder:
    """A local session as the tests and the bench use it; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def ensure_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package.

    A cluster without a shared file system gets the package with ``--py-files``; where the
    path below exists on the workers (local mode, shared mounts) the variable suffices.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of files)."""
    ensure_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="attestry-"))
        atexit.register(shutil.rmtree, _own_dirs[0], True)
    return f"file://{_own_dirs[0]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        # the session has ended: what lies in this machine's file system can still be removed
        local = re.sub("^file:/+", "/", path)
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """For CPU-heavy steps: repartitions if the scan has fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


Query = Callable[[SparkSession, str], DataFrame]


#: A key is hot if it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def measured(df: DataFrame) -> int:
    """Bytes of df's rows as a broadcast holds them, from the values themselves; one row per partition is moved."""
    fixed = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}
    size = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = c if kind in ("string", "binary") else F.to_json(F.struct(c))
        size = size + (F.lit(8) if kind in fixed else F.coalesce(F.octet_length(text), F.lit(0)) + 24)
    return df.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with at least 1/HOT_SHARE of df's rows: at most HOT_SHARE rows, from counts made before their shuffle."""
    n = df.count()
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT_SHARE >= n).select(*keys)


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", small_bytes: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Joins ("inner" or "left") on keys of which one may hold a third of big's rows.

    small (unique by keys) is broadcast if its measured bytes are at most BROADCAST_BYTES. Beyond
    that big's rows of hot keys, and those with a null key, are joined where they lie to the at
    most HOT_SHARE rows of small that they can meet; only the others are shuffled by key. big is
    read again for that, so it should be a table or a written step. A loop can pass small_bytes
    and hot where they do not change.
    """
    if (measured(small) if small_bytes is None else small_bytes) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    hot = hot_keys(big, keys) if hot is None else hot
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    stays = F.coalesce("_hot", F.lit(False))
    for k in keys:
        stays = stays | F.col(k).isNull()
    few = small.join(F.broadcast(hot), keys, "left_semi")
    return marked.filter(stays).drop("_hot").join(F.broadcast(few), keys, how).unionByName(marked.filter(~stays).drop("_hot").join(small, keys, how))


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """df, written once in its present order, with row numbers from 1: row counts of the partitions before
    (one row per partition) plus the place in the partition. No sort, nothing gathered in one task."""
    from pyspark.sql import Window

    placed = materialize(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1))
    before = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_id", "_p", "_i", "_n", "_before")
