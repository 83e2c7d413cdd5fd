"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions of this subpackage travel to the executors by value: no install there is needed
cloudpickle.register_pickle_by_value(sys.modules["canframes.llm"])

WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_PER_BATCH = "1000"


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel in Arrow batches: unless the session says otherwise, batches of
    1,000 rows instead of Spark's 10,000 keep a task's buffers to a few MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ROWS_PER_BATCH)


def map_batches(df: DataFrame, schema: str, fn: Callable[[list[dict]], Iterator[dict] | list[dict]], columns: list[str], chunk_rows: int = 256) -> DataFrame:
    """``fn`` over chunks of rows of ``columns`` in Arrow batches; only those columns travel.
    Chunks keep the Python objects alive at one time to a few hundred documents."""
    bounded_batches(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                rows = list(fn(batch.slice(at, chunk_rows).to_pylist()))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


@contextlib.contextmanager
def scoped_setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs run inside the block only."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Shared:
    """A driver-side object of bounded size for the tasks, broadcast once; pickled by value
    so that executors need no install of this subpackage."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value


def text_key(text: Column) -> Column:
    """128-bit digest of a text: equal texts share it, so work that depends on the text alone
    is done once per distinct text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def codepoints_before(raw: bytes, ends: list[int]) -> list[int]:
    """Code-point offsets of ascending byte offsets in UTF-8 ``raw``."""
    out, at, n = [], 0, 0
    for e in ends:
        n += len(raw[at:e].decode("utf-8", "replace"))
        at = e
        out.append(n)
    return out
