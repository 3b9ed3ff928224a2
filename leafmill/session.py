"""Session helpers: reading the given tables and cutting lineage safely."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Smaller tables are not worth spreading.
SPREAD_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spread(spark.read.parquet(table_path(sf_dir, name)))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if its files make fewer partitions than there are cores, as with one small file; larger tables
    are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES:
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a private one is set only where the
    session names none (single-machine tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="leafmill-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and go on from its files: the plan is computed once,
    the files are compressed, and they survive the loss of executors. They are removed by `drop`, or when the program ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def private_folder(spark: SparkSession) -> str:
    """The path of a folder for state, in the checkpoint folder; removed when the program ends."""
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def drop(*tables: DataFrame) -> None:
    """Remove materialised tables that no further result reads."""
    for t in tables:
        path = t.written_at
        _delete(_WRITTEN.pop(path), path)


_WRITTEN: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is not None:  # a session that has ended leaves its folder to its owner
            _delete(spark, path)
