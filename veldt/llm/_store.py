"""Shared storage and small session helpers of the training-data operators.

Intermediate tables that cut lineage are Parquet files in the folder that the
cluster names in ``spark.checkpoint.dir``; executors can be lost, the files stay.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch of very long texts stays small enough for a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Rows that the Parquet reader decodes at a time: the default of 4096 texts is one array of many MB in the heap.
READER_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set a local master gets a temporary one; on a cluster that's an error, as executors don't share a machine's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veldt-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_roots: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's folder, which goes when the driver's Python ends."""
    root = f"{shared_folder(spark)}/veldt-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root, True)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def _delete(jvm, conf, path: str, at_exit: bool = False) -> None:
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:
        if not at_exit:  # at the end the JVM may be gone already; the folder stays then
            raise


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_veldt_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            _delete(sc._jvm, sc._jsc.hadoopConfiguration(), path.rsplit("/", 1)[0])


_SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


#: Rows of one file of a table whose number of rows is known to have a bound.
FILE_ROWS = 250_000


def materialize(df: DataFrame, name: str, compact: bool = False, most: int | None = None) -> DataFrame:
    """Write df to the shared folder and return the table read back: lineage ends here.

    compact is for plans without Python work that end in a shuffle: its partitions are then
    joined up to the advisory size, so a small table is one file and not one for each core.
    most is a bound on the number of (short) rows: there are tasks and files in proportion.
    """
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    spark = df.sparkSession
    path = fresh_path(spark, name)
    spread = spark.conf.get(_SPREAD)
    if compact:
        spark.conf.set(_SPREAD, "false")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SPREAD, spread)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldt_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what one batch of texts holds in the JVM and in a Python worker.

    The session keeps these settings: a returned DataFrame is run later, and is planned then.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def shielded(docs: DataFrame, *names: str):
    """docs with columns of these names (which an operator would replace) set aside, and a function that puts them back."""
    clashing = [c for c in docs.columns if c in names]
    aside = dict(zip(clashing, unused(docs.columns, *(f"_aside_{c}" for c in clashing))))
    columns = docs.columns
    return docs.withColumnsRenamed(aside), lambda out: out.select(*[F.col(aside.get(c, c)).alias(c) for c in columns])


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until no column (whatever its case) is called so."""
    held = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out
