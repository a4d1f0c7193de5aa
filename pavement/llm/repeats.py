"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over eight bytes sets triggers: a place is one if its hash is the
smallest of some window of ``w`` neighbouring places. Triggers depend on nearby
bytes alone, so equal strings are cut into the same phrases, and every string of
``LENGTH`` bytes has one: the first trigger at least ``w - 1`` bytes after its
start (its anchor) is the same in all its occurrences.

The corpus order is only needed as far as equality of the first ``LENGTH`` bytes
of suffixes goes. The dictionary is the set of contexts around anchors, named by
their digests and counted over the whole corpus; the parse says where they stand:

* the core of an anchor is what all strings with that anchor have in common;
  a core that occurs once rules all of them out,
* its reach is everything that those strings cover; if all occurrences of a core
  have the same reach, all their strings are equal, one row standing for up to
  ``w`` suffixes. That is what makes highly repetitive text cheap.

Only where the same core stands in different reaches (at the ends of repeats)
are the suffixes themselves compared, by the digest of their ``LENGTH`` bytes.
This is done twice: with wide windows over all texts, which leaves the places
that can matter at all, then with narrow windows there.

Texts and contexts are named by 64-bit digests; equal names are taken as equal
(for 10^9 names, two that differ collide with a chance of about 3 in 100).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavement.llm.columns import arrow_struct
from pavement.llm.neardup import BROADCAST_ROWS
from pavement.plans.storage import written

LENGTH = 400
WIDE, NARROW = 180, 32
_GRAM = 8


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:size - width], values[width - size:]) if size < width else values


def triggers(data: bytes, width: int) -> np.ndarray:
    """Places whose hash is the smallest of some window of ``width`` places, ascending."""
    n = len(data) - _GRAM + 1
    if n < width:
        return np.empty(0, np.int64)
    grams = np.lib.stride_tricks.as_strided(np.frombuffer(data + b"\0" * 8, np.uint8), (n, 8), (1, 1))
    with np.errstate(over="ignore"):
        h = np.ascontiguousarray(grams).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    least = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint32)
    return np.flatnonzero(h == _slide(np.concatenate([edge, least, edge]), width, np.maximum))


def core(data: bytes, at: int, width: int) -> int | None:
    """Name of what all strings anchored at ``at`` share; None where no string fits."""
    lo, hi = at - width + 1, at - 2 * width + 1 + LENGTH
    return _name(data[lo:hi]) if lo >= 0 and hi <= len(data) else None


def _name(data: bytes) -> int:
    """Signed 64-bit digest."""
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def starts_of(at: int, n: int, width: int) -> tuple[int, int]:
    """Range (end exclusive) of the starts of strings that can have ``at`` as their anchor, within n bytes."""
    return max(0, at - 2 * width + 1), min(at - width + 1, n - LENGTH) + 1


def reach(data: bytes, at: int, width: int) -> int:
    """Name of the bytes that strings anchored at ``at`` cover, and of where the anchor stands in them."""
    lo = max(0, at - 2 * width + 1)
    return _name(data[lo:at - width + 1 + LENGTH] + (at - lo).to_bytes(4, "little"))


class _Rows:
    """Rows of a task as flat columns, handed on in slices of bounded size."""

    MOST = 200_000

    def __init__(self, **columns: pa.DataType):
        self.schema = pa.schema(list(columns.items()))
        self.held: list[list[np.ndarray]] = [[] for _ in columns]
        self.size = 0

    def add(self, count: int, *columns) -> None:
        """``count`` rows; a column is an array of them or one value for all."""
        for held, values in zip(self.held, columns):
            held.append(values if isinstance(values, np.ndarray) else np.full(count, values, np.int64))
        self.size += count

    def slices(self, least: int = MOST) -> Iterator[pa.RecordBatch]:
        """What is held, if there are ``least`` rows of it."""
        if self.size >= least:
            whole = [np.concatenate(h) for h in self.held]
            for k in range(0, self.size, self.MOST):
                yield pa.RecordBatch.from_arrays([pa.array(c[k:k + self.MOST], t) for c, t in zip(whole, self.schema.types)],
                                                 schema=self.schema)
            self.held, self.size = [[] for _ in self.held], 0


def _names(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of several stretches."""
    hashed = xxhash.xxh3_64_intdigest
    return np.array([hashed(data[a:b]) for a, b in zip(begin.tolist(), end.tolist())], np.uint64).view(np.int64)


def _cores(data: bytes, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors where a string fits, and the names of their cores."""
    at = at[(at >= width - 1) & (at <= len(data) - LENGTH + 2 * width - 1)]
    return at, _names(data, at - width + 1, at - 2 * width + 1 + LENGTH)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Rows(name=pa.int64(), at=pa.int32(), core=pa.int64())
    for batch in batches:
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text")):
            data = text.as_py().encode("utf-8")
            at, cores = _cores(data, triggers(data, WIDE), WIDE)
            out.add(len(at), name, at, cores)
            yield from out.slices()
    yield from out.slices(1)


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Rows(name=pa.int64(), copies=pa.int64(), at=pa.int32(), core=pa.int64(), reach=pa.int64())
    for batch in batches:
        for name, copies, text, places in zip(batch.column("name").to_pylist(), batch.column("copies").to_pylist(),
                                              batch.column("text"), batch.column("places")):
            data = text.as_py().encode("utf-8")
            # starts that are still possible, and from them where their narrow anchors can be
            left = covered([starts_of(at, len(data), WIDE) for at in places.as_py()])
            all_ = triggers(data, NARROW)
            for a, b in covered([(a + NARROW - 1, b + 2 * NARROW - 1) for a, b in left]):
                at, cores = _cores(data, all_[np.searchsorted(all_, a):np.searchsorted(all_, b)], NARROW)
                reaches = np.array([reach(data, x, NARROW) for x in at.tolist()], np.int64)
                out.add(len(at), name, copies, at, cores, reaches)
            yield from out.slices()
    yield from out.slices(1)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the anchors that need them, named together with their distance to the anchor."""
    out = _Rows(name=pa.int64(), start=pa.int32(), string=pa.int64(), weight=pa.int64())
    hashed = xxhash.xxh3_64_intdigest
    for batch in batches:
        for name, text, anchors in zip(batch.column("name").to_pylist(), batch.column("text"), batch.column("open")):
            data = text.as_py().encode("utf-8")
            places, weights = (anchors.values.field(k).to_numpy() for k in ("at", "weight"))
            for at, weight in zip(places.tolist(), weights.tolist()):
                a, b = starts_of(at, len(data), NARROW)
                if a < b:
                    strings = np.array([hashed(data[i:i + LENGTH] + bytes([at - i])) for i in range(a, b)], np.uint64).view(np.int64)
                    out.add(b - a, name, np.arange(a, b), strings, weight)
                yield from out.slices()
    yield from out.slices(1)


_CUT = "n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _cut(texts: pa.Array, whole: pa.Array, single: pa.Array) -> pa.Array:
    rows = []
    for t, w, s in zip(texts, whole, single):
        data = t.as_py().encode("utf-8")
        spans = []
        for at in w.as_py() or []:
            a, b = starts_of(at, len(data), NARROW)
            if a < b:
                spans.append((a, b - 1 + LENGTH))
        spans = covered(spans + [(i, i + LENGTH) for i in s.as_py() or []])
        kept, last = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(data[last:a])
            last = b
        kept.update(data[last:])
        rows.append((sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
    return arrow_struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                         ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], rows)


def _few(side: DataFrame) -> DataFrame:
    """A written table of names: broadcast while it is small, else joined by a shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def text_name(text: Column) -> Column:
    """64-bit name of a text."""
    return F.xxhash64(text.cast("binary"))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(name, n_removed, n_spans, kept_sha256, spans) of each distinct text from which something goes.

    ``spans`` are byte ranges. A byte goes if a string of ``LENGTH`` bytes over it
    also starts anywhere else, in the same text, another, or a copy of it. Null,
    empty and shorter texts never lose anything. Builds its tables while the plan
    is built.
    """
    body = F.col(f"`{text}`")
    named = docs.where(F.octet_length(body) >= LENGTH).select(text_name(body).alias("name"), body.alias("text"))
    places = written(named.mapInArrow(_wide, "name long, at int, core long"))
    often = written(places.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"))
    near = written(places.join(often, "core").groupBy("name").agg(F.collect_set("at").alias("places")))
    # from here on a text stands for all its copies, with their number as its weight
    copies = named.join(_few(near.select("name")), "name", "left_semi")
    texts = written(copies.groupBy("name").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(near, "name"))
    rows = written(texts.select("name", "copies", "text", "places")
                   .mapInArrow(_narrow, "name long, copies long, at int, core long, reach long"))
    reaches = rows.groupBy("reach").agg(F.min("core").alias("core"), F.sum("copies").alias("same"),
                                        F.min(F.struct("name", "at")).alias("rep"))
    reaches = written(reaches)
    cores = reaches.groupBy("core").agg(F.sum("same").alias("all")).where("all > 1")
    judged = (rows.join(reaches.join(cores, "core").drop("core"), "reach")
              .select("name", "at", "same", (F.col("same") < F.col("all")).alias("mixed"),
                      ((F.col("rep.name") == F.col("name")) & (F.col("rep.at") == F.col("at"))).alias("rep")))
    weight = F.when(F.col("mixed") & F.col("rep"), F.struct("at", F.col("same").alias("weight")))
    marks = written(judged.groupBy("name").agg(F.collect_list(F.when(F.col("same") > 1, F.col("at"))).alias("whole"),
                                               F.collect_list(weight).alias("open")))
    ready = written(texts.drop("places", "copies").join(marks, "name"))
    suffixes = written(ready.where(F.size("open") > 0).select("name", "text", "open")
                       .mapInArrow(_suffixes, "name long, start int, string long, weight long"))
    twice = written(suffixes.groupBy("string").agg(F.sum("weight").alias("c")).where("c > 1").select("string"))
    single = (suffixes.join(twice, "string").groupBy("name").agg(F.collect_set("start").alias("single")))
    done = ready.join(written(single), "name", "left").select("name", F.arrow_udf(_cut, _CUT)("text", "whole", "single").alias("r"))
    return done.select("name", "r.*").where("n_removed > 0")


def repeats(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges, null if none).

    Null texts are as empty ones. Repeated rows are copies of each other. Only
    the two columns are read.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_}`").alias("_id"), text_name(F.col(f"`{text}`")).alias("name"),
                       F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("_whole"))
    found = written(repeated_spans(docs, text))
    return (base.join(found, "name", "left")
            .select(F.col("_id").alias(id_), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                    F.coalesce("kept_sha256", "_whole").alias("kept_sha256"), "spans"))
