"""Whitening of embeddings with Spark MLlib's ``BlockMatrix``.

Every task cuts its rows in blocks of ``ROWS`` and writes them; a block is named by
its task and its number there, which is its place in the grid of the matrix.

* Sums per dimension are exact integers, so that rows are centred before anything
  is multiplied.
* Scatter: the blocks, dealt to stripes, times their transposes. On the left a
  stripe's rows stand in column r, on the right in column c, and (r, c) is another
  pair for each stripe. So each block of the product is the scatter of one stripe,
  no task gets more than a stripe of ``STRIPE`` blocks, and nothing is multiplied
  that is not needed. The sum over stripes goes to the driver: dimension squared
  numbers. Their eigenvectors are found there.
* Projection: the grid of blocks times a block-diagonal matrix that holds the
  whitening matrix once per column of the grid, so that the work is dealt over the
  whole grid. The covariance of what comes out is measured on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pavement.plans.storage import written

#: Rows of a block, blocks of a stripe.
ROWS, STRIPE = 1024, 64
SCALE, SHIFT = 64, 1_000_000


def integer_vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, x): floor(64 c) + 1,000,000 of every vector without null or non-finite entries; null and empty ones go."""
    v = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return (df.where((F.size(F.col(f"`{vector}`")) > 0) & usable)
            .select(F.col(f"`{id_}`").alias("id"), F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT).alias("x")))


def _cutter(schema: pa.Schema, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a task's rows; ``x`` is row by row, little-endian 64-bit."""
        task, number, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            x = rows.column("x").combine_chunks()
            x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
            sizes = np.unique(np.diff(x.offsets.to_numpy()))
            if len(sizes) != 1:
                raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
            values = x.flatten().to_numpy(zero_copy_only=False).astype("<i8")
            ids = rows.column("id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            columns = [[task], [number], [rows.num_rows], [int(sizes[0])],
                       pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), [values.tobytes()]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type)
                                               for k, c in enumerate(columns)], schema=schema)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            while count >= most:
                rows = pa.concat_tables(held)
                yield block(rows.slice(0, most))
                held, count, number = [rows.slice(most)], count - most, number + 1
        if count:
            yield block(pa.concat_tables(held))

    return cut


def blocks_of(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """(task, number, size, width, ids, x): the rows in blocks, written."""
    id_type = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("number", T.IntegerType()),
                           T.StructField("size", T.IntegerType()), T.StructField("width", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(id_type)), T.StructField("x", T.BinaryType())])
    arrow = pa.schema([pa.field("task", pa.int32()), pa.field("number", pa.int32()), pa.field("size", pa.int32()),
                       pa.field("width", pa.int32()), pa.field("ids", pa.list_(to_arrow_type(id_type))), pa.field("x", pa.binary())])
    return written(vectors.mapInArrow(_cutter(arrow, rows), schema))


def _integers(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, "<i8").reshape(-1, width)


def column_sums(blocks: DataFrame, width: int) -> list[int]:
    """Exact sum of every dimension."""

    @F.arrow_udf("array<long>")
    def sums(x: pa.Array) -> pa.Array:
        return pa.array([_integers(b.as_py(), width).sum(axis=0).tolist() for b in x], pa.list_(pa.int64()))

    total = (blocks.select(F.posexplode(sums("x")).alias("k", "s")).groupBy("k")
             .agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect())
    return [int(r["s"]) for r in sorted(total, key=lambda r: r["k"])]


class Centre:
    """The exact mean of every dimension, as whole part and rest; blocks have ``rows`` rows."""

    def __init__(self, n: int, sums: list[int], rows: int = ROWS):
        self.n, self.rows = n, rows
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: bytes) -> np.ndarray:
        """x - S / n, with one rounding."""
        return (_integers(x, len(self.whole)) - self.whole) - self.rest / self.n

    def padded(self, x: bytes) -> DenseMatrix:
        """A whole block of centred rows; rows that are not there are zeros."""
        full = np.zeros((self.rows, len(self.whole)))
        rows = self.centred(x)
        full[:len(rows)] = rows
        return DenseMatrix(self.rows, len(self.whole), full.ravel(order="F"))

    def deviations(self, x: bytes) -> list[int]:
        """Sum over the dimensions of (n x - S)^2 for each row, exact."""
        gap = _integers(x, len(self.whole)) - self.whole
        most = self.n * (int(np.abs(gap).max()) + 1)
        if len(self.whole) * most * most >= 1 << 63:
            gap = gap.astype(object)
        return [int(d) for d in ((self.n * gap - self.rest) ** 2).sum(axis=1)]


def scatter(blocks: DataFrame, centre: Centre, grid: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of the outer products of centred rows."""
    width, per_task, total = len(centre.whole), grid[1], grid[0] * grid[1]
    side = max(1, math.ceil(math.sqrt(total / STRIPE)))
    rows = blocks.select("task", "number", "x").rdd

    def laid(column) -> BlockMatrix:
        def place(r):
            i = r["task"] * per_task + r["number"]
            return (i, column(i)), centre.padded(r["x"])
        return BlockMatrix(rows.map(place), centre.rows, width, total * centre.rows, side * width)

    product = laid(lambda i: i % side).transpose().multiply(laid(lambda i: i // side % side))
    return product.blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def projected(blocks: DataFrame, centre: Centre, grid: tuple[int, int], whiten: np.ndarray) -> BlockMatrix:
    """The grid of blocks with every row multiplied by ``whiten``."""
    width, kept = whiten.shape
    context = blocks.sparkSession.sparkContext
    left = blocks.select("task", "number", "x").rdd.map(lambda r: ((r["task"], r["number"]), centre.padded(r["x"])))
    one = DenseMatrix(width, kept, whiten.ravel(order="F"))
    right = context.parallelize(range(grid[1]), min(grid[1], 64)).map(lambda k: ((k, k), one))
    return (BlockMatrix(left, centre.rows, width, grid[0] * centre.rows, grid[1] * width)
            .multiply(BlockMatrix(right, width, kept, grid[1] * width, grid[1] * kept)))


def whitened(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = 32,
             block_rows: int = ROWS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Vectors that are null, empty, or hold null or non-finite entries go; vectors of
    different lengths are an error. Ids may be of any type, null or repeated: every
    row is one of the fit list. Components without variance (eigenvalue below the
    rounding of the largest) are not returned, so a table of equal vectors, of one
    vector or of none has no rows. Only the two columns are read; tables are built
    while the plan is built.
    """
    id_type = df.schema[id_].dataType
    out = T.StructType([T.StructField(id_, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    spark = df.sparkSession
    blocks = blocks_of(integer_vectors(df, id_, vector), block_rows)
    n, low, width, tasks, per_task = blocks.agg(F.sum("size"), F.min("width"), F.max("width"), F.max("task") + 1,
                                                F.max("number") + 1).first()
    if not n:
        return spark.createDataFrame([], out)
    if low != width:
        raise ValueError(f"vectors of different lengths: {low} to {width}")
    centre, grid = Centre(n, column_sums(blocks, width), block_rows), (tasks, per_task)
    covariance = scatter(blocks, centre, grid) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values[0], 0) * width * np.finfo(float).eps).sum()))
    if not kept:
        return spark.createDataFrame([], out)
    explained = (values[:kept] / values.sum()).tolist()
    product = projected(blocks, centre, grid, vectors[:, :kept] / np.sqrt(values[:kept]))

    def moments(block):
        p = block[1].toArray()
        return np.vstack([p.T @ p, p.sum(axis=0)])

    both = product.blocks.map(moments).treeReduce(np.add) / n
    error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(kept)).max())
    found = spark.createDataFrame(
        product.blocks.map(lambda b: (b[0][0], b[0][1], bytearray(b[1].toArray().astype("<f8").tobytes()))),
        "task int, number int, p binary")
    fields = pa.schema([pa.field(id_, to_arrow_type(id_type)), pa.field("component", pa.int32()), pa.field("n", pa.int64()),
                        pa.field("deviation", pa.int64()), pa.field("whitened", pa.float64()),
                        pa.field("explained", pa.float64()), pa.field("identity_error", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, x, p = (batch.column(c)[k] for c in ("ids", "x", "p"))
                size = len(ids.values)
                whole = np.frombuffer(p.as_py(), "<f8").reshape(-1, kept)[:size]
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(np.repeat(np.arange(size), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * kept, n, np.int64)),
                    pa.array(centre.deviations(x.as_py()), pa.int64()).take(pa.array(np.repeat(np.arange(size), kept))),
                    pa.array(whole.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * kept, error))], schema=fields)

    return blocks.join(found, ["task", "number"]).select("ids", "x", "p").mapInArrow(rows, out)
