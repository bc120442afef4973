"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 continuation bytes; a text has as many code points as other bytes.
CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(raw: bytes) -> int:
    return len(raw.translate(None, CONTINUATION))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at exactly these six bytes."""
    return raw.split() if raw else []


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key is in no fold (null)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def is_fold(key: str | Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(fold(key, modulus) == F.lit(remainder), F.lit(False))


def id_and_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Only the key and the text's UTF-8 bytes, so that further columns, of whatever name, don't matter."""
    return docs.select(F.col(key), F.col(text).cast("binary").alias("raw"), *more)


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Columns of ``schema`` from each Arrow batch by ``work``, which returns a list of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, names, strict=True)],
                    schema=names,
                )

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, only a local master, whose one
    process has no others to share with, gets one of its own; a cluster raises an error."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="manifestry-checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: recomputed by no later job, kept when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_hash(docs: DataFrame) -> Column:
    """64 bits of all columns of a row; rows of equal id and hash are taken as equal. Maps, which Spark cannot
    hash, are left out."""
    return F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions than there are (one small file); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
