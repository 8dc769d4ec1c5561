"""What the operators share: staged tables in the cluster's shared folder, and limits on Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch that goes to Python holds at most so many rows and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 4096, 24 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches and lets Python workers of the same machine image import this library."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; in local mode, where that is unset, a temporary one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_shelfmark_shared", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
            spark.sparkContext._shelfmark_shared = found
    return found.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: str | None = None, bucket_by: str | None = None) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it again: lineage ends there, and any executor may be lost.

    A table in buckets of a column is dealt out by it already when it is joined or grouped.
    """
    mark = uuid.uuid4().hex[:12]
    path = f"{shared_dir(df.sparkSession)}/{name}-{mark}"
    writer = df.write.mode("overwrite")
    if bucket_by:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        writer.bucketBy(buckets, bucket_by).option("path", path).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").saveAsTable(f"{name}_{mark}")
        return df.sparkSession.table(f"{name}_{mark}")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shelfmark_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Removes a staged table that no later plan reads."""
    path = getattr(df, "_shelfmark_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def py_remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(task's partition, rows before the batch, batch)."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield part, before, batch
        before += batch.num_rows


def with_row_key(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns (all, if none is given), row_file and row_index, which name a row alike in every later scan, however the scan is split among tasks.

    The keys are two columns of Parquet's own metadata; a table that isn't a plain scan of files is staged first. Callers whose
    tables may have columns of these names ask for `whole(docs)`, one struct of all columns.
    """
    keys = [F.xxhash64("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index")]
    return plain(docs).select(*(columns or ("*",)), *keys)


def plain(docs: DataFrame) -> DataFrame:
    """docs as a plain scan of Parquet files: itself, or staged. Whoever takes row keys of a table twice takes them of this."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return staged(docs, "rows")


def whole(docs: DataFrame, *left_out: str) -> Column:
    """All columns but those left out, whatever their names, as one struct `row`."""
    return F.struct(F.lit(0).alias("_"), *[F.col(_quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in left_out]).alias("row")


def unfolded(keyed: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, from the struct `row`; some changed."""
    return keyed.select(*[changed[c].alias(c) if c in changed else F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows whose text `keep` says true of; it gets an Arrow array. All columns, whatever their names, stay as they are."""
    place = docs.columns.index(column)
    numbers = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # Python functions take no name that holds a point or a quote

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place)), pa.bool_()))

    return numbers.mapInArrow(rows, numbers.schema).toDF(*docs.columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
