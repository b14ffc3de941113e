"""What the operators share: names that clash with nothing, tables in the shared folder, sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs
    on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if named is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="pipelens-")
        named = _own[app]
    return f"{named.rstrip('/')}/pipelens-{app}"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    if (key := f"exit {spark.sparkContext.applicationId}") not in _own:
        _own[key] = path
        atexit.register(_forget, spark)
    return path


def _forget(spark: SparkSession) -> None:
    try:
        remove(spark, shared_folder(spark))
    except Exception:  # noqa: BLE001  the session may be gone by now
        return


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that no later step reads, through Spark's own file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again. Returns it and its path."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df doesn't have, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str):
    """The top-level column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


BATCH_ROWS, BATCH_BYTES, SCAN_ROWS = 2048, 1 << 20, 512


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow, by batches of BATCH_BYTES and BATCH_ROWS at most, or fewer rows if the session says so. Rows hold
    whole texts, and Spark's 10,000 of them would be the largest thing in a task's memory, in the executor as well as in
    its Python worker; so would the 4,096 of them that its Parquet reader takes at once. A larger row is a batch of its
    own. The settings stay in the session, as plans read them when they run."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf.set(rows, min(BATCH_ROWS, int(conf.get(rows))) if int(conf.get(rows)) > 0 else BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.parquet.columnarReaderBatchSize", min(SCAN_ROWS, int(conf.get("spark.sql.parquet.columnarReaderBatchSize"))))
    return df.mapInArrow(tidy(f), schema)


def tidy(f):
    """f over Arrow batches; when it is done, its worker gives freed memory back, as it may idle beside the next one."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _trim()

    return run


def _trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return
