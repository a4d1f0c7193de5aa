"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded md5, each row's rank becomes
a fraction of its source, and all rows are put in the order of that fraction:
any stretch of the order holds every source in its share of the corpus. Shards
are equal stretches, so their row counts differ by one at most.

No source is ever sorted in one task. Ranks are taken within slices of the
shuffle key (uniform, as it is an md5) and shifted by the rows of the slices
before; the number of slices follows the number of rows. The same is done for
the positions in the final order, whose slices are ranges of the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavement.llm.columns import fresh, order_key
from pavement.plans.storage import join_side, written

SHARDS = 16
SEED = 11
#: Rows that one slice holds on average; one task sorts a few slices.
SLICE = 20_000


def _head(hexed: Column) -> Column:
    """The first 32 bits of a hex digest as a long."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long")


def _shifted(df: DataFrame, by: list[str], slice_: str, order: list[Column], out: str) -> DataFrame:
    """Zero-based position in the order (slice, order) within ``by``, sorted one slice at a time."""
    counts = df.groupBy(*by, slice_).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = upto.orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, slice_, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(upto).alias("_n"))
    within = Window.partitionBy(*by, slice_).orderBy(*order)
    return (join_side(df, offsets, [*by, slice_], "inner")
            .withColumn(out, F.col("_off") + F.row_number().over(within) - 1)
            .drop("_off"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_: str = "doc_id", source: str = "source",
               text: str = "text", slice_: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: id, source, size, text_crc32, shard and slot (position in its shard).

    Size is the UTF-8 length of the text plus one. A null text has no bytes, a
    null source is a source of its own, a null id takes part like any other.
    Rows of one id are ordered by the md5 of their text; fully repeated rows are
    interchangeable, so their order does not show. An empty table gives no rows.
    Only these columns are read, so others may have any names. The narrow rows
    are written once while the plan is built.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = written(docs.select(
        F.col(f"`{id_}`").alias("_id"), F.col(f"`{source}`").cast("string").alias("_source"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(body) + 1).cast("long").alias("_size"), F.crc32(body).alias("_crc"),
        F.coalesce(F.md5(F.col(f"`{text}`").cast("binary")), F.lit("")).alias("_body"),
        F.coalesce(order_key(F.col(f"`{id_}`"), seed), F.lit("")).alias("_key")))
    total = rows.count()
    slices = max(1, -(-total // slice_))
    # the text's digest spreads rows of one id, or of none, over the slices as well
    mixed = F.md5(F.concat_ws(":", "_key", "_body"))
    ranked = _shifted(rows.withColumn("_mixed", mixed)
                      .withColumn("_slice", F.floor(_head(F.col("_mixed")) * F.lit(slices) / F.lit(2.0 ** 32))),
                      ["_stratum"], "_slice", [F.col("_mixed")], "_rank")
    # where in its share a source begins is drawn from its name: sources of one row spread over all shards
    begin = (_head(F.md5(F.concat_ws(":", "_stratum", F.lit(str(seed))))) + 0.5) / F.lit(2.0 ** 32)
    placed = (ranked.withColumn("_at", (F.col("_rank") + begin) / F.col("_n")).drop("_n", "_rank", "_slice")
              .withColumn("_slice", F.floor(F.col("_at") * slices)))
    final = _shifted(placed, [], "_slice", [F.col("_at"), F.col("_stratum"), F.col("_mixed")], "_pos")
    shard = F.expr(f"_pos * {shards} div greatest(_n, 1)")
    return (final.withColumn("_shard", shard)
            .select(F.col("_id").alias(id_), F.col("_source").alias("source"), F.col("_size").alias("size"),
                    F.col("_crc").alias("text_crc32"), F.col("_shard").cast("int").alias("shard"),
                    F.expr(f"_pos - (_shard * _n + {shards - 1}) div {shards}").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_: str = "doc_id", **how) -> None:
    """Write the documents as one folder per shard, each sorted by slot within its files.

    Ids must be unique here, as the texts are joined to their slots by id.
    """
    slots = shard_rows(docs, shards, id_=id_, **how).select(F.col(id_).alias("_id"), "shard", "slot")
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    (docs.join(slots.withColumnsRenamed({"shard": shard, "slot": slot}), F.col(f"`{id_}`").eqNullSafe(F.col("_id")))
     .drop("_id").repartition(shard, F.floor(F.col(slot) / 100_000)).sortWithinPartitions(shard, slot)
     .write.partitionBy(shard).parquet(path))
