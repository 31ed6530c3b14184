"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests); then one is made and set.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _LOCAL.get(spark.sparkContext.applicationId)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        _LOCAL[spark.sparkContext.applicationId] = root
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Intermediate tables of one operator in the shared folder.

    Writing cuts the lineage with files that outlive any executor; it is used
    for narrow tables that are read more than once. ``clear`` deletes all but
    those marked as ``last``, which the operator's result still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not last:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for path in self.paths:
            at = jvm.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; the table stays, as a result still reads it."""
    return Scratch(df.sparkSession).written(df, name, last=True)


def input_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), null text as empty: clashing extra columns can't matter."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``mapInArrow`` with state made once per task: ``make()`` gives a function of a batch that returns columns."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)
        del step
        release_memory()

    return df.mapInArrow(run, schema)


def some_texts(column: pa.Array, rows: int = 500) -> Iterator[str]:
    """The strings of a column, of which only some rows at a time become Python objects."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def release_memory() -> None:
    """At the end of a task: what its caches held goes back to the system, as workers live on."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: freed memory stays with the worker
            pass


def filter_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows whose text (null: empty) the function of texts keeps; all columns pass through Arrow, nothing is joined or moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                yield some.filter(pa.array(keep([t or "" for t in some.column(text_col).to_pylist()]), pa.bool_()))
        del keep
        release_memory()

    return df.mapInArrow(run, df.schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text (null: empty), modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
