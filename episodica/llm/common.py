"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that one Arrow batch may hold; documents can be long.
TEXT_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a local one, in local mode only, as other machines couldn't see it.

    What ``cut`` and ``written`` put there stays, as results may still be computed from it; delete the folder when a job is over.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files: lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back, so that Spark knows its real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in small batches, whatever their length."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def map_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` runs once a task and gives a function from a batch to the output's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, arrow = make(), to_arrow_schema(fields)
        for batch in batches:
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(*columns: str, seed: int = 0):
    """A signed 64-bit hash of the columns; nulls count as a value of their own."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns], F.lit(seed))


def row_key(*columns: str):
    """A key of 128 bits for rows of the same values, so that of any number of rows no two others share one; nulls count as a value of their own."""
    parts = [x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("\u0000")), F.lit("\u0001"))]
    return F.unhex(F.md5(F.concat(*parts)))


def hash_share(column, share) :
    """Whether a signed 64-bit hash falls into the lowest ``share`` of all values."""
    return column.cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * share
