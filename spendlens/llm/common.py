"""Helpers of the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's text modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % F.lit(n)


def kept_share(share: Column | float, *keys: Column | str) -> Column:
    """True for about ``share`` of the rows, chosen by a hash of the keys."""
    unit = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit < share


def once_per_process(key: str, make: Callable):
    """What make() gives, kept for later tasks of the same worker process."""
    store = sys.modules.setdefault("spendlens_llm_kept", types.ModuleType("spendlens_llm_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def every_character() -> np.ndarray:
    """All code points as one-character strings."""
    return np.arange(0x110000, dtype="<u4").view("<U1")


def with_columns(df: DataFrame, added: str, fn: Callable[[list], list[np.ndarray | list]], text: str = "text") -> DataFrame:
    """df and new columns computed batch by batch from its texts; an old column of the same name gives way."""
    new = T.StructType.fromDDL(added)
    df = df.drop(*new.fieldNames())
    at, types = df.columns.index(text), [f.type for f in to_arrow_schema(new)]
    schema = T.StructType(df.schema.fields + new.fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b.column(at).to_pylist())
            extra = [pa.array(v, type=t, from_pandas=False) for v, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=names)

    return df.mapInArrow(run, schema)


def arrow_rows(schema: str) -> Callable[[list], pa.RecordBatch]:
    """A maker of record batches out of columns."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def make(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], names=fields.names)

    return make


def summed(df: DataFrame, keys: str, value: str, dtype: str = "<f8") -> DataFrame:
    """Element-wise sums of packed arrays, one row per key."""
    key_cols = keys.split()
    out = T.StructType([df.schema[k] for k in key_cols] + [T.StructField(value, T.BinaryType())])
    types = to_arrow_schema(out)

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, dtype) for v in t.column(value).to_pylist())
        row = {k: [t.column(k)[0].as_py()] for k in key_cols} | {value: [np.asarray(total, dtype).tobytes()]}
        return pa.table(row, schema=types)

    return df.groupBy(*key_cols).applyInArrow(add, out)
