"""Small helpers shared by the text operators: tables, row-wise Arrow functions, digests.

Row-wise operators are Arrow functions from a text column to a struct, so they
ride on whatever columns the input has and never look at a name twice. Spark
cuts the batches by rows and by bytes (``spark.sql.execution.arrow.max*PerBatch``),
and a function below works on one text at a time, so memory follows the longest
text and not the number of rows.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavement.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; the workers get the package first."""
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_struct(df: DataFrame, text: str, function, stem: str) -> tuple[DataFrame, str]:
    """``df`` with the struct that ``function`` makes of column ``text``, and the struct's name."""
    name = fresh(df, stem)
    return df.withColumn(name, function(F.col(f"`{text}`"))), name


def arrow_struct(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.StructArray:
    """Row tuples as one Arrow struct array."""
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays(
        [pa.array(c, type=t) for c, (_, t) in zip(columns, fields)],
        fields=[pa.field(n, t) for n, t in fields])


def give_back() -> None:
    """Return freed memory to the machine: workers live on between stages, and what one leaves is missing in the next."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def order_key(id_: Column, seed: int) -> Column:
    """Seeded shuffle key of any id type: md5 of id and seed, the same on any engine."""
    return F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed))))


def gram_hashes(codes: np.ndarray, sizes: tuple[int, ...], seed: int = 0) -> list[np.ndarray]:
    """For each size n, ascending, one 64-bit hash per run of n neighbouring codes (uint64, wrapping)."""
    mult, out = np.uint64(0x9E3779B97F4A7C15), []
    h = np.full(len(codes), seed * 2 + 1, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, sizes[-1] + 1):
            if len(codes) < n:
                out += [np.empty(0, np.uint64)] * (len(sizes) - len(out))
                break
            h = (h if n == 1 else h[:-1]) ^ codes[n - 1:]
            h *= mult
            h ^= h >> np.uint64(29)
            if n in sizes:
                out.append(h * mult)
    return out
